"""Draws and buckets that depend on content alone, equal on every engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def hash_bucket(key: Column, n: int) -> Column:
    """A bucket in [0, n) from the first 60 bits of the key's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("bigint"), F.lit(n))


def stable_rank(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)
