"""Dataset rules: each gives one row (rule, violations); all rows are checked, none sampled."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def missing_reference(rule: str, child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key))
    return _row(child.join(keys, child_key, "left_anti"), rule)


def repeated(rule: str, df: DataFrame, key: list[str]) -> DataFrame:
    return _row(df.groupBy(*key).count().where("count > 1"), rule)


def broken(rule: str, df: DataFrame, condition: Column) -> DataFrame:
    """Rows on which the condition isn't true."""
    return _row(df.where(~F.coalesce(condition, F.lit(False))), rule)


def collisions(rule: str, df: DataFrame, raw: str, made: Column) -> DataFrame:
    """Made keys that stand for more than one raw key."""
    return _row(df.groupBy(made.alias("_k")).agg(F.countDistinct(raw).alias("_n")).where("_n > 1"), rule)


def count_mismatch(rule: str, declared: DataFrame, rows: DataFrame, key: str, size: str) -> DataFrame:
    """Keys whose declared size isn't their number of rows, on either side."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    both = declared.select(key, F.col(size).alias("_d")).join(counts, key, "full_outer")
    return _row(both.where(F.coalesce("_n", F.lit(0)) != F.coalesce("_d", F.lit(0))), rule)


def report(rules: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, rules)


def first_failure(frames: DataFrame, key: str, index: str, reasons: list[tuple[str, Column]]) -> DataFrame:
    """(key, failed_at, failure) per group: its first frame with a reason, the first that holds there; null if whole.

    One partial aggregation per group; a whole group is rejected for one frame by joining on null failures.
    """
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons])
    bad = reason.isNotNull()
    return frames.groupBy(key).agg(F.min(F.when(bad, F.col(index))).alias("failed_at"), F.min_by(F.when(bad, reason), F.when(bad, F.struct(F.col(index), reason))).alias("failure"))


def filter_report(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): the first reason that holds for each row, or kept."""
    first = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons], F.lit("kept"))
    return df.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))


def repair_plan(found: DataFrame, actions: dict[str, str]) -> DataFrame:
    """The actions that a report calls for."""
    table = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])
    return found.where("violations > 0").select("rule", "violations", F.coalesce(table[F.col("rule")], F.lit("inspect")).alias("action"))
