"""Joins that Spark has no operator for, as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """Both sides in one stream; right rows come first at equal times."""
    a = left.select(F.col(key), F.col(at), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_hit"))
    hit = F.struct(*[F.col(p) for p in payload])
    b = right.select(F.col(key), F.col(at), F.lit(0).alias("_side"), F.lit(None).alias("_row"), hit.alias("_hit"))
    return a.unionByName(b)


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time, or nulls (``hit``).

    One shuffle by key and one sort: no pair of rows is ever built.
    """
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = _merged(left, right, key, at, payload).withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", F.col("_hit").alias("hit"))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """Each left row with the nearest right row of its key on either side; the earlier one wins a tie.

    ``payload`` must have the time column.
    """
    back = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = _merged(left, right, key, at, payload).withColumns({"_b": F.last("_hit", ignorenulls=True).over(back), "_a": F.last("_hit", ignorenulls=True).over(ahead)})
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    before, after = micros(F.col(at)) - micros(F.col(f"_b.{at}")), micros(F.col(f"_a.{at}")) - micros(F.col(at))
    near = F.when(F.col("_a").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_a"))
    return both.where("_side = 1").select("_row.*", near.alias("hit"))


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """Rows of equal keys whose ``at`` (left) and ``r_<at>`` (right) differ by at most the tolerance.

    Right rows go to their cell and both neighbours, so the join is on equal cells.
    """
    cell = F.floor(F.col(at) / tolerance).cast("bigint")
    r = right.withColumn("_c", F.floor(F.col(f"r_{at}") / tolerance).cast("bigint"))
    r = r.withColumn("_c", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)))
    return left.withColumn("_c", cell).join(r, [*keys, "_c"]).where(F.abs(F.col(at) - F.col(f"r_{at}")) <= tolerance).drop("_c")


def interval_first_match(rows: DataFrame, intervals: DataFrame, key: list[str], at: str, width: float, start: str = "start", end: str = "end", order: str = "segment") -> DataFrame:
    """Each row with its key's first segment (by ``order``) with start <= at < end, else the key's first segment (``segment``).

    Numbers are cut into cells of ``width``; a segment is listed under each cell it touches.
    """
    cells = intervals.withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor(F.col(end) / width).cast("bigint"))))
    found = rows.withColumn("_c", F.floor(F.col(at) / width).cast("bigint")).withColumn("_id", F.monotonically_increasing_id())
    hits = found.join(cells.select(*key, "_c", start, end, F.col(order).alias("_o")), [*key, "_c"], "left")
    inside = F.when((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)), F.col("_o"))
    best = hits.groupBy("_id", *rows.columns).agg(F.min(inside).alias("_m"))
    first = intervals.groupBy(*key).agg(F.min(order).alias("_f"))
    return best.join(first, key, "left").select(*rows.columns, F.coalesce("_m", "_f").alias(order))


def left_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails if either side repeats a key."""
    for side in (left, right):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats")
    return left.join(right, key, "left")


def paired(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer match with a ``status``: matched, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("matched")
    return a.join(b, key, "full_outer").withColumn("status", status).drop("_l", "_r")
