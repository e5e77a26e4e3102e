"""Index lists, batches and token gathering for training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.functions.hashing import hash_bucket, stable_rank
from trajecta.operators.chains import dense_numbers


def strided_indices(counts: DataFrame, key: str, size: str, stride: int) -> DataFrame:
    """(key, position): every stride-th place and the last one; none for an empty episode."""
    last = F.col(size).cast("long") - 1
    places = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))
    return counts.where(F.col(size) > 0).select(key, F.explode(places).alias("position"))


def random_gaps(counts: DataFrame, key: str, size: str, gaps: list[int], seed: str) -> DataFrame:
    """(key, position): from zero in steps drawn from ``gaps`` by hash, and the last place."""
    n = F.col(size).cast("long")
    draws = counts.where(n > 0).select(key, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / min(gaps)).cast("long"))).alias("_i"))
    drawn = F.element_at(F.array(*[F.lit(g) for g in gaps]), hash_bucket(F.concat_ws(":", F.lit(seed), key, "_i"), len(gaps)).cast("int") + 1)
    before = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    walked = draws.withColumn("_g", drawn).select(key, "_n", F.coalesce(F.sum("_g").over(before), F.lit(0)).cast("long").alias("position")).where("position < _n - 1").drop("_n")
    return walked.unionByName(counts.where(n > 0).select(key, (n - 1).alias("position")))


def at_positions(rows: DataFrame, positions: DataFrame, order: list[str], position: str = "position") -> DataFrame:
    """The rows at places of an order, as often as asked for; negative places count from the end, places outside it find nothing.

    The number of rows is a one-row table, so that its broadcast is bounded.
    """
    total = rows.agg(F.count("*").alias("_n"))
    wanted = positions.select(F.col(position).alias("asked")).join(F.broadcast(total)).withColumn("number", F.when(F.col("asked") < 0, F.col("asked") + F.col("_n")).otherwise(F.col("asked"))).drop("_n")
    return dense_numbers(rows, order).join(wanted, "number")


def rank_share(rows: DataFrame, order: list[str], ranks: int) -> DataFrame:
    """Deals rows to ranks in turn."""
    return dense_numbers(rows, order).withColumn("rank", (F.col("number") % ranks).cast("int"))


def representative_pair(rows: DataFrame, key: str, scene: str, length: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The two rows of different scenes whose lengths differ most, among lengths between two quantiles.

    One pass: the longest and shortest of each scene, then the best two scenes of either kind; the
    best pair is among those four. Ties go to the smaller key.
    """
    bounds = rows.agg(F.percentile(length, F.lit(low)).alias("_lo"), F.percentile(length, F.lit(high)).alias("_hi"))
    kept = rows.join(F.broadcast(bounds)).where(F.col(length).between(F.col("_lo"), F.col("_hi")))
    ends = kept.groupBy(scene).agg(F.min(F.struct((-F.col(length)).alias("v"), F.col(key).alias("k"))).alias("long"), F.min(F.struct(F.col(length).alias("v"), F.col(key).alias("k"))).alias("short"))
    longest = ends.orderBy("long").limit(2).select(F.col(scene).alias("_a"), (-F.col("long.v")).alias("longest"), F.col("long.k").alias("long_key"))
    shortest = ends.orderBy("short").limit(2).select(F.col(scene).alias("_b"), F.col("short.v").alias("shortest"), F.col("short.k").alias("short_key"))
    pairs = longest.join(F.broadcast(shortest), F.col("_a") != F.col("_b"))
    return pairs.orderBy(F.col("shortest") - F.col("longest"), "long_key", "short_key").limit(1).select("long_key", "short_key", (F.col("longest") - F.col("shortest")).alias("span"))


def synchronised_batches(rows: DataFrame, length: str, width: int, batch: int, ranks: int, seed: str, key: str) -> DataFrame:
    """Length buckets dealt so that at each step all ranks have a batch of one bucket.

    Adds ``bucket``, ``step`` in the bucket, ``rank`` and ``complete``: whether the step fills every rank.
    """
    bucket = F.floor(F.col(length) / width).cast("long")
    own = Window.partitionBy("bucket")
    d = rows.withColumn("bucket", bucket).withColumn("_r", F.row_number().over(own.orderBy(stable_rank(seed, F.col(key)), key)) - 1).withColumn("_n", F.count("*").over(own))
    whole = batch * ranks
    step = F.floor(F.col("_r") / whole).cast("long")
    return d.withColumns({"step": step, "rank": (F.floor(F.col("_r") / batch) % ranks).cast("int"), "complete": (step + 1) * whole <= F.col("_n")}).drop("_r", "_n")


def padded_to_batch(rows: DataFrame, values: str, batch: str, fill: Column) -> DataFrame:
    """Lists padded to the longest of their batch, and ``valid``, the length that each had."""
    longest = F.max(F.size(values)).over(Window.partitionBy(batch))
    d = rows.withColumn("_w", longest).withColumn("valid", F.size(values))
    return d.withColumn(values, F.concat(F.col(values), F.array_repeat(fill, F.col("_w") - F.col("valid")))).drop("_w")


def relative_states(poses: DataFrame, history: int) -> DataFrame:
    """(episode, frame, slot, dx, dy, dz, dyaw, padded): the last ``history`` steps, the newest in the last slot.

    A slot without a step, at the start of an episode, is zero and padded.
    """
    by = Window.partitionBy("episode").orderBy("frame")
    d = poses.withColumn("_p", G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw")))
    d = d.withColumn("_d", G.body_delta(F.lag("_p").over(by), F.col("_p"))).withColumn("_d", F.when(F.col("frame") > 0, F.col("_d")))
    slots = F.array(*[F.struct(F.lit(history - 1 - k).alias("slot"), F.lag("_d", k).over(by).alias("d")) for k in range(history)])
    d = d.select("episode", "frame", slots.alias("_s")).select("episode", "frame", F.inline("_s"))
    return d.select("episode", "frame", "slot", *[F.coalesce(F.col("d")[k], F.lit(0.0)).alias(k) for k in ("dx", "dy", "dz", "dyaw")], F.col("d").isNull().alias("padded"))


def latest(rows: DataFrame, key: str, index: str, k: int) -> DataFrame:
    """The last ``k`` rows of each key, with ``step`` counted from the first of them."""
    own = Window.partitionBy(key)
    d = rows.withColumn("_r", F.row_number().over(own.orderBy(F.col(index).desc()))).where(F.col("_r") <= k)
    return d.withColumn("step", F.col(index) - F.min(index).over(own)).drop("_r")


def gather(samples: DataFrame, key: str, refs: str, index: DataFrame, ref: str, payload: list[str]) -> DataFrame:
    """(key, items): for each of a sample's references, in order, what the index has; null where it has nothing.

    References are looked up once each, so one that many samples share is read and joined once.
    """
    wide = samples.select(key, F.posexplode(refs).alias("_at", "_ref"))
    found = index.select(F.col(ref).alias("_ref"), F.struct(*payload).alias("_v")).join(wide.select("_ref").distinct(), "_ref", "left_semi")
    got = wide.join(found, "_ref", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l"))
    return got.select(key, F.transform("_l", lambda e: e["_v"]).alias("items"))
