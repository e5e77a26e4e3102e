"""Order from links and dense numbering, without one task seeing all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROUNDS = 40


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a folder of its own only where that is unset."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="trajecta-"))
    return df.checkpoint()


def linked_order(rows: DataFrame, token: str, following: str) -> DataFrame:
    """(token, head, position): each row's list, named by its first token, and its place in it from 0.

    ``following`` names the next row of a list and is null, empty or unknown at its end. Pointers to
    predecessors double each round, so the rounds grow with the logarithm of the longest list; each
    is two equality joins on unique tokens, so no list needs to fit a task. Tokens must be unique
    and named as next once at most. A ring has no head: its rows are not returned.
    """
    own = rows.select(F.col(token).alias("token"), F.col(following).alias("next"))
    before = own.where("next IS NOT NULL").select(F.col("next").alias("token"), F.col("token").alias("back"))
    state = own.select("token").join(before, "token", "left")
    # ``back``: the row that far behind, null once the head is reached; ``head``: the earliest row met.
    state = _cut(state.select("token", "back", F.coalesce("back", "token").alias("head"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("bigint").alias("position")))
    going = state.where("back IS NOT NULL").count()
    for _ in range(MAX_ROUNDS):
        if not going:
            break
        behind = state.select(F.col("token").alias("back"), F.col("back").alias("back2"), F.col("head").alias("head2"), F.col("position").alias("more"))
        step = state.join(behind, "back", "left")
        jumped = F.col("back").isNotNull()
        state = _cut(step.select("token", F.col("back2").alias("back"), F.when(jumped, F.col("head2")).otherwise(F.col("head")).alias("head"), F.when(jumped, F.col("position") + F.col("more")).otherwise(F.col("position")).alias("position")))
        left = state.where("back IS NOT NULL").count()
        if left == going:  # only rings are left: every list loses rows in every round
            break
        going = left
    return state.where("back IS NULL").select("token", "head", "position")


def dense_numbers(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 0 in order: sorted ranges, numbered inside, plus the sizes of the ranges before.

    Only one count per range meets in a task. ``order`` should be unique; ties are numbered in any order.
    """
    return running_total(rows, order, F.lit(1), name)


def running_total(rows: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """Adds the sum of ``size`` over all earlier rows in order: sums inside sorted ranges, plus the sums of the ranges before."""
    return running_totals(rows, order, {name: size})


def running_totals(rows: DataFrame, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """Adds, by name, the sums of several sizes over all earlier rows in order; rows come out in sorted ranges."""
    own = {f"_size{i}": size for i, size in enumerate(sizes.values())}
    placed = _cut(rows.withColumns(own).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in own])
    starts = sums.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in own])
    within = placed.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in own}).join(F.broadcast(starts), "_part")
    found = within.withColumns({name: (F.col(f"{c}_start") + F.col(f"{c}_inside")).cast("bigint") for name, c in zip(sizes, own, strict=True)})
    return found.drop("_part", *own, *[f"{c}_{x}" for c in own for x in ("start", "inside")])
