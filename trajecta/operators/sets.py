"""Set operations with an order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    others = [c for c in df.columns if c not in key]
    ranked = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    # min_by keeps one row per key in each task, so a large group of repeats never meets in one place.
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), ranked).alias("_r")).select(*key, "_r.*")


def priority_union(tables: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, from the first table that has it."""
    ranked = [t.withColumn("priority", F.lit(i)) for i, t in enumerate(tables)]
    return first_of_each(functools.reduce(DataFrame.unionByName, ranked), key, ["priority", *order])


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): both zero if the sets are equal."""
    left = a.distinct().withColumn("_l", F.lit(1))
    right = b.distinct().withColumn("_r", F.lit(1))
    both = left.join(right, a.columns, "full_outer")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def union_with_offsets(tables: dict[str, DataFrame], index: str) -> DataFrame:
    """All tables with their name and an index that goes on from table to table."""
    start, parts = 0, []
    for name, t in tables.items():
        parts.append(t.withColumn("dataset", F.lit(name)).withColumn("global_index", F.col(index) + start))
        start += t.count()
    return functools.reduce(DataFrame.unionByName, parts)


