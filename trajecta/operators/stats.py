"""Statistics and evaluation metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and interpolated 1 % and 99 % quantiles of each position of an array."""
    flat = df.select(*keys, F.posexplode(array).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    q = F.percentile("v", F.array(F.lit(0.01), F.lit(0.99)))
    out = flat.groupBy(*keys, "dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), q.alias("q"), F.count("v").alias("n"))
    return out.select(*keys, "dim", "mean", "std", "min", "max", F.col("q")[0].alias("q01"), F.col("q")[1].alias("q99"), "n")


def distribution(value: str) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9)))
    return [F.avg(value).alias("mean"), q[0].alias("p50"), q[1].alias("p90"), F.count(value).alias("n")]


def mean_if_complete(metric: Column, included: Column) -> Column:
    """The mean over included rows; null if any of them lacks the metric."""
    return F.when((F.count_if(included & metric.isNotNull()) == F.count_if(included)) & (F.count_if(included) > 0), F.avg(F.when(included, metric)))


def metric_summary(results: DataFrame, metrics: list[str], failed: Column, group: str) -> DataFrame:
    """Overall and per group, in one pass: rows, failures, and means over rows that didn't fail."""
    sets = results.withColumn("_failed", failed).groupingSets([[], [F.col(group)]], F.col(group))
    return sets.agg(F.grouping(group).cast("int").alias("overall"), F.count("*").alias("n"), F.count_if("_failed").alias("failed"), *[mean_if_complete(F.col(m), ~F.col("_failed")).alias(m) for m in metrics])


def horizon_errors(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and root mean square error for each horizon; partial sums merge across tasks."""
    e = F.col("predicted") - F.col("actual")
    return pairs.groupBy(*keys, "h").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def flattened(df: DataFrame, keys: list[str], metrics: list[str], prefix: str) -> DataFrame:
    """(path, value): one row for each metric, its path from the keys."""
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("value")) for m in metrics])
    path = F.concat_ws("/", F.lit(prefix), *[F.col(k).cast("string") for k in keys], F.col("p.m"))
    return df.select(*keys, F.explode(pairs).alias("p")).select(path.alias("path"), "p.value")


def warping_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic-time-warping distance of two paths of points, diagonal by diagonal, so memory grows with their length only."""
    n, m = len(a), len(b)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by place in a, of the two diagonals before
    before[0] = 0.0
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1)
        i = np.arange(low, high + 1)
        step = np.linalg.norm(a[i - 1] - b[d - i - 1], axis=1)
        new = np.full(n + 1, np.inf)
        new[i] = step + np.minimum(np.minimum(before[i - 1], last[i - 1]), last[i])
        before, last = last, new
    return float(last[n])


def ndtw(paths: DataFrame, key: str, radius: float, drop_repeats: bool = False) -> DataFrame:
    """(key, dtw, ndtw) of each key's predicted and reference path (rows: key, kind, step, x, y, z)."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sides = {k: g.sort_values("step")[["x", "y", "z"]].to_numpy(float) for k, g in batch.groupby("kind")}
        p, r = sides.get("predicted", np.zeros((0, 3))), sides.get("reference", np.zeros((0, 3)))
        if drop_repeats:
            p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(axis=1)])] if len(p) else p
        d = warping_distance(p, r) if len(p) and len(r) else float("nan")
        return pd.DataFrame({key: [batch[key].iloc[0]], "dtw": [d], "ndtw": [float(np.exp(-d / (max(len(r), 1) * radius)))]})

    kind = dict(paths.dtypes)[key]
    return paths.select(key, "kind", "step", "x", "y", "z").groupBy(key).applyInPandas(run, f"`{key}` {kind}, dtw double, ndtw double")


def path_efficiency(success: Column, shortest: Column, taken: Column) -> Column:
    """Success weighted by path length."""
    return success.cast("double") * shortest / F.greatest(taken, shortest, F.lit(1e-6))


