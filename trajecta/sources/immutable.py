"""Proof that source files were left alone: digests before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file under a root, by path below it; each is read once, by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    below = F.substring_index(F.col("path"), f"{base}/", -1)
    return files.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def manifest_faults(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, fault): what is changed, missing or extra."""
    old = before.select("path", F.col("length").alias("_l"), F.col("sha256").alias("_s"))
    both = old.join(after, "path", "full")
    fault = F.when(F.col("_s").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when((F.col("_l") != F.col("length")) | (F.col("_s") != F.col("sha256")), "changed")
    return both.select("path", fault.alias("fault")).where("fault IS NOT NULL")
