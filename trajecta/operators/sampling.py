"""Deterministic sampling, splits and batching. Orders come from hashes, so reruns agree."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.hashing import stable_rank
from trajecta.operators.chains import dense_numbers


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows: one from each stratum, the rest by its share of all rows and largest remainder.

    A stratum gives no more rows than it has; what is then missing goes round by round to those with
    rows left, largest remainder first. Fewer rows or more strata than ``n`` are errors. Quotas are
    computed on one row per stratum; only they are joined back.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    all_ = sizes.agg(F.count("*").alias("strata"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")).first()
    if n <= 0 or all_.rows < n:
        raise ValueError(f"{all_.rows} rows, {n} asked for")
    if all_.strata > n:
        raise ValueError(f"{all_.strata} strata can't each give one of {n} rows")
    exact = F.lit(n - all_.strata) * F.col("size") / F.lit(all_.rows)
    q = sizes.withColumn("_e", exact).withColumn("_own", F.least(F.col("size") - 1, F.floor("_e")))
    missing = n - all_.strata - (q.agg(F.sum("_own").alias("n")).first().n or 0)
    slots = q.where(F.col("size") - 1 > F.col("_own")).select(stratum, (F.col("_e") - F.floor("_e")).alias("_f"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("size") - 1 - F.col("_own"), F.lit(max(missing, 1))))).alias("_round"))
    extra = slots.orderBy("_round", F.desc("_f"), stable_rank(seed, F.col(stratum))).limit(missing).groupBy(stratum).agg(F.count("*").alias("_more"))
    quota = q.alias("q").join(extra.alias("e"), F.col(f"q.{stratum}").eqNullSafe(F.col(f"e.{stratum}")), "left").select(F.col(f"q.{stratum}").alias("_s"), (1 + F.col("_own") + F.coalesce("_more", F.lit(0))).alias("quota"))
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(stable_rank(seed, F.col(key)), key))
    numbered = df.withColumn("_r", order)
    return numbered.join(F.broadcast(quota) if all_.strata <= 100_000 else quota, F.col(stratum).eqNullSafe(F.col("_s"))).where("_r <= quota").drop("_r", "_s", "quota")


def even_positions(length: Column, count: Column) -> Column:
    """Distinct positions spread evenly over [0, length), halves rounded to even."""
    steps = F.greatest(count - 1, F.lit(1)).cast("double")
    return F.when((length <= 0) | (count <= 0), F.array().cast("array<bigint>")).when(count == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1), lambda i: F.bround(i * (length - 1) / steps).cast("bigint"))))


def anchored_sample(df: DataFrame, key: str, position: str, n: int, seed: str) -> DataFrame:
    """First, middle and last position of each key, filled up to ``n`` in hash order."""
    whole = Window.partitionBy(key)
    size = F.count("*").over(whole)
    anchor = (F.col(position) == 0) | (F.col(position) == F.floor((size - 1) / 2)) | (F.col(position) == size - 1)
    ranked = df.withColumn("_a", anchor)
    order = Window.partitionBy(key).orderBy(F.col("_a").desc(), stable_rank(seed, F.concat_ws(":", F.col(key), F.col(position))), position)
    return ranked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r", "_a")


def target_frames(counts: DataFrame, key: str, size: str, n: int, first: int = 4) -> DataFrame:
    """(key, position): up to ``first`` even positions of every key, then round by round up to ``n`` in all."""
    even = counts.select(key, size, F.posexplode(even_positions(F.col(size), F.least(F.col(size), F.lit(first)))).alias("round", "position"))
    rest = counts.select(key, size, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size).cast("bigint") - 1)).alias("position")).join(even.select(key, "position"), [key, "position"], "left_anti")
    rest = rest.withColumn("round", F.lit(first) + F.row_number().over(Window.partitionBy(key).orderBy("position")) - 1)
    both = even.select(key, "round", "position").unionByName(rest.select(key, "round", "position"))
    return both.orderBy("round", key, "position").limit(n).select(key, "position")


def contiguous_parts(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Adds ``part``: consecutive runs, larger ones first. ``order`` should be unique; rows are numbered range by range."""
    small, larger = divmod(df.count(), parts)
    r = F.col("_row")
    after = F.lit(larger) + F.floor((r - larger * (small + 1)) / max(small, 1))
    part = F.when(r < larger * (small + 1), F.floor(r / (small + 1))).otherwise(after).cast("int")
    return dense_numbers(df, order, "_row").withColumn("part", part).drop("_row")


def length_buckets(df: DataFrame, length: str, width: int, batch: int, seed: str, key: str) -> DataFrame:
    """Adds ``bucket`` and ``batch``: rows of like length, in hash order, ``batch`` at a time."""
    b = df.withColumn("bucket", F.floor(F.col(length) / width).cast("bigint"))
    order = Window.partitionBy("bucket").orderBy(stable_rank(seed, F.col(key)), key)
    return b.withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch).cast("bigint"))


def balanced_ranks(counts: DataFrame, key: str, size: str, ranks: int) -> DataFrame:
    """(key, rank): the largest group first, each to the rank with the least so far.

    Greedy, so it runs on the driver over one row per group; the caller passes groups, not rows.
    """
    rows = counts.select(key, size).orderBy(F.desc(size), key).collect()
    heap = [(0, r) for r in range(ranks)]
    out = []
    for row in rows:
        load, r = heapq.heappop(heap)
        out.append((row[key], r))
        heapq.heappush(heap, (load + row[size], r))
    return counts.sparkSession.createDataFrame(out, f"`{key}` {dict(counts.dtypes)[key]}, rank int")


def balanced_outcomes(df: DataFrame, success: Column, key: str, n: int, seed: str) -> DataFrame:
    """Half successes and half failures, topped up from the other side where one is short.

    Only the first ``n`` of each side can be taken, so only those are ranked.
    """
    marked = df.withColumn("_s", success)
    order = [stable_rank(seed, F.col(key)), F.col(key)]
    sides = marked.where("_s").orderBy(*order).limit(n).unionByName(marked.where("NOT _s").orderBy(*order).limit(n))
    ranked = sides.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).withColumn("_top", F.when(F.col("_r") <= F.lit(n) / 2, 0).otherwise(1))
    return ranked.orderBy("_top", "_r", F.desc("_s")).limit(n).drop("_s", "_r", "_top")


def exact_group_split(counts: DataFrame, key: str, size: str, quota: int, seed: str, nearest: bool = False) -> list:
    """Groups, never split, whose sizes add up to the quota exactly; in hash order, by subset sums over the groups.

    A quota that no groups add up to is an error or, with ``nearest``, the largest sum below it is taken.
    """
    rows = counts.select(key, size).orderBy(stable_rank(seed, F.col(key)), key).collect()
    reached: dict[int, tuple[int, object] | None] = {0: None}
    for row in rows:
        for total in sorted(reached, reverse=True):
            new = total + row[size]
            if new <= quota and new not in reached:
                reached[new] = (total, row[key])
    if quota not in reached and not nearest:
        raise ValueError(f"no groups add up to {quota}")
    chosen, at = [], max(reached)
    while reached[at] is not None:
        at, name = reached[at]
        chosen.append(name)
    return chosen[::-1]


def lightweight_subset(df: DataFrame, scene: str, excluded: list, key: str, fraction: float, strides: list[int], seed: str) -> DataFrame:
    """A share of the rows outside some scenes, in hash order, with strides dealt in turn."""
    left = df.where(~F.col(scene).isin(excluded))
    n = int(left.count() * fraction)
    numbered = dense_numbers(left.withColumn("_h", stable_rank(seed, F.col(key))), ["_h", key], "_row").where(F.col("_row") < n)
    return numbered.withColumn("stride", F.element_at(F.array(*map(F.lit, strides)), (F.col("_row") % len(strides) + 1).cast("int"))).drop("_h", "_row")
