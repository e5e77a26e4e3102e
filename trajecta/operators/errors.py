"""Errors of predicted action chunks as sums that merge: by horizon, by rank, and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions import geometry as G

#: Actions are x, y, z and yaw, then whatever else there is.
NAMES = ("dx", "dy", "dz", "dyaw")


def dimension_names(dims: int) -> list[str]:
    return [*NAMES, *[f"aux_{i}" for i in range(4, dims)]][:dims]


def action_steps(chunks: DataFrame, keys: list[str], dims: int = 4) -> DataFrame:
    """(keys, h, last, squared, elements, abs_<name>, sq_<name>, translation, yaw): each step that isn't padding.

    ``chunks`` has ``predicted``, ``target`` (normalised), ``raw_predicted``, ``raw_target`` (arrays of
    steps of ``dims`` numbers) and ``padding``, one flag a step. ``h`` counts from 1; ``last`` marks a
    chunk's last step that counts. Yaw is compared around the circle. Arrays of different lengths are an error.
    """
    parts = ["predicted", "target", "raw_predicted", "raw_target", "padding"]
    shape = F.size("predicted")
    odd = F.array(*[F.size(p) != shape for p in parts[1:]])
    own = chunks.withColumn("padding", F.when(F.array_contains(odd, True), F.raise_error(F.lit("predictions, targets and padding differ in length")).cast("array<boolean>")).otherwise(F.col("padding")))
    own = own.withColumn("_end", F.array_max(F.transform("padding", lambda p, i: F.when(~p, i))))
    steps = own.select(*keys, "_end", F.posexplode(F.arrays_zip(*parts)).alias("_i", "_s")).where("NOT _s.padding")
    raw = [F.col("_s.raw_predicted")[d] - F.col("_s.raw_target")[d] for d in range(dims)]
    raw[3] = G.wrap_angle(raw[3])
    squared = F.aggregate(F.zip_with("_s.predicted", "_s.target", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    named = steps.select(*keys, (F.col("_i") + 1).alias("h"), (F.col("_i") == F.col("_end")).alias("last"), squared.alias("squared"), F.lit(dims).cast("bigint").alias("elements"), F.array(*raw).alias("_raw"))
    each = [c for d, n in enumerate(dimension_names(dims)) for c in (F.abs(F.col("_raw")[d]).alias(f"abs_{n}"), (F.col("_raw")[d] * F.col("_raw")[d]).alias(f"sq_{n}"))]
    length = F.sqrt(sum((F.col("_raw")[d] * F.col("_raw")[d] for d in range(1, 3)), F.col("_raw")[0] * F.col("_raw")[0]))
    return named.select(*keys, "h", "last", "squared", "elements", *each, length.alias("translation"), F.abs(F.col("_raw")[3]).alias("yaw"))


def error_sums(steps: DataFrame, keys: list[str], dims: int = 4) -> DataFrame:
    """Sums and counts of steps by key: what ranks write, and what ``merged_sums`` adds up."""
    sums = ["squared", "elements", *[f"{k}_{n}" for n in dimension_names(dims) for k in ("abs", "sq")], "translation", "yaw"]
    last = F.col("last")
    ends = [F.count_if(last).alias("frames"), F.coalesce(F.sum(F.when(last, F.col("translation"))), F.lit(0.0)).alias("endpoint")]
    return steps.groupBy(*keys).agg(F.count("*").alias("steps"), *[F.sum(c).alias(c) for c in sums], *ends)


def merged_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over parts of the same keys; the order and the number of parts don't matter."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys and dict(parts.dtypes)[c] in ("bigint", "double")])


def finished(sums: DataFrame, keys: list[str], dims: int = 4) -> DataFrame:
    """(keys, mse, mae_<name>, rmse_<name>, translation_l2, yaw_abs, endpoint, waypoints, frames); null where nothing counts."""

    def mean(c: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(c) / F.col(n))

    each = [c for n in dimension_names(dims) for c in (mean(f"abs_{n}", "steps").alias(f"mae_{n}"), F.sqrt(mean(f"sq_{n}", "steps")).alias(f"rmse_{n}"))]
    return sums.select(*keys, mean("squared", "elements").alias("mse"), *each, mean("translation", "steps").alias("translation_l2"), mean("yaw", "steps").alias("yaw_abs"), mean("endpoint", "frames").alias("endpoint"), F.col("steps").alias("waypoints"), "frames")
