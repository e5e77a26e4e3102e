"""JSON lines by byte ranges, with each line's place and number in its file, and streams of lines merged in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.operators.chains import _cut, dense_numbers

_PLACED = "file string, split long, at long, place long, size long, value string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, byte_start, byte_end, index, value) of every line with more than white space; ``index`` counts them from 0 in each file.

    Spark deals files out in byte ranges; a line belongs to the range that it begins in. Each range is
    read in order and places its lines within itself; sums over the ranges before give the
    rest, so no task reads more than its ranges. Lines end with a line feed; the last may lack it.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    own = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, place = None, 0, 0
        for batch in batches:
            file, split = batch.column(0), batch.column(1)
            size = pc.add(pc.binary_length(batch.column(2).cast(pa.large_binary())), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            full = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(batch.column(2))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = list(zip(file.to_pylist(), split.to_pylist(), strict=True))
            begin, before = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for i, key in enumerate(keys):
                if key != now:
                    now, at, place = key, 0, 0
                begin[i], before[i] = at, place
                at += int(size[i])
                place += int(full[i])
            yield pa.RecordBatch.from_arrays([file, split, pa.array(begin), pa.array(np.where(full > 0, before, -1)), pa.array(size), batch.column(2)], ["file", "split", "at", "place", "size", "value"])

    placed = own.mapInArrow(run, _PLACED)
    sums = placed.groupBy("file", "split").agg(F.sum("size").alias("_bytes"), F.count_if(F.col("place") >= 0).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("file", "split", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_bytes", "_lines")])
    begin = F.col("_bytes") + F.col("at")
    return placed.where("place >= 0").join(starts, ["file", "split"]).select("file", begin.alias("byte_start"), (begin + F.col("size")).alias("byte_end"), (F.col("_lines") + F.col("place")).alias("index"), "value")


def read_range(spark: SparkSession, path: str, schema: str, byte_start: int = 0, byte_end: int | None = None, start_index: int = 0) -> DataFrame:
    """The lines of one file that begin in a byte range, parsed; ``index`` counts on from ``start_index``.

    A line that isn't an object of ``schema`` is an error that names its byte.
    """
    lines = numbered_lines(spark, path).where(F.col("byte_start") >= byte_start)
    lines = lines if byte_end is None else lines.where(F.col("byte_start") < byte_end)
    first = lines.agg(F.min("index")).first()[0] or 0
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    bad = F.raise_error(F.concat(F.lit("invalid JSON at byte "), F.col("byte_start").cast("string"), F.lit(" in "), F.col("file")))
    rows = lines.withColumn("_v", parsed).withColumn("_v", F.when(F.col("_v._corrupt").isNotNull() | F.col("_v").isNull(), bad.cast("void")).otherwise(F.col("_v")))
    return rows.select((F.col("index") - first + start_index).alias("index"), "byte_start", "byte_end", "_v.*").drop("_corrupt")


def runs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(run, key, first, rows): the runs of equal keys in order; ``order`` counts from 0 without gaps."""
    before = rows.select((F.col(order) + 1).alias(order), F.col(key).alias("_before"))
    starts = rows.join(before, order, "left").where(~F.col(key).eqNullSafe(F.col("_before")) | (F.col(order) == 0)).select(F.col(key), F.col(order).alias("first"))
    numbered = _cut(dense_numbers(starts, ["first"], "run"))
    following = numbered.select((F.col("run") - 1).alias("run"), F.col("first").alias("_next"))
    last = rows.agg((F.max(order) + 1).alias("_all"))
    ended = numbered.join(following, "run", "left").crossJoin(F.broadcast(last))  # one row
    return ended.select("run", key, "first", (F.coalesce("_next", "_all") - F.col("first")).alias("rows"))


def merged_streams(lead: DataFrame, others: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """(position, key, then first and rows of each other stream): ordered streams read side by side.

    The n-th row of ``lead`` goes with the n-th run of equal keys in each other stream. A
    stream that ends early, goes on after the lead's end or has another key there is an error.
    ``order`` counts every stream's rows from 0 without gaps.
    """
    out = lead.select(F.col(order).alias("position"), key)
    for name, stream in others.items():
        own = runs(stream, key, order).select(F.col("run").alias("position"), F.col(key).alias("_key"), F.col("first").alias(f"{name}_first"), F.col("rows").alias(f"{name}_rows"))
        both = out.join(own, "position", "full")
        at = F.col("position").cast("string")
        fault = (
            F.when(F.col("_key").isNull() & F.col(f"{name}_first").isNull(), F.concat(F.lit(f"{name} ends before row "), at))
            .when(F.col(key).isNull(), F.concat(F.lit(f"{name} goes on after the last row, at run "), at))
            .when(F.col(key) != F.col("_key"), F.concat(F.lit(f"{name} has "), F.col("_key").cast("string"), F.lit(" where "), F.col(key).cast("string"), F.lit(" is due, at row "), at))
        )
        out = both.withColumn(key, F.when(fault.isNotNull(), F.raise_error(fault).cast(dict(lead.dtypes)[key])).otherwise(F.col(key))).drop("_key")
    return out


def merge_by_index(parts: list[DataFrame], index: str) -> DataFrame:
    """The rows of several streams with ``index`` strictly increasing over all of them; a number that is there twice is an error."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    twice = F.count("*").over(Window.partitionBy(index)) > 1
    bad = F.raise_error(F.concat(F.lit("the index isn't strictly increasing at "), F.col(index).cast("string"))).cast(dict(rows.dtypes)[index])
    return rows.withColumn(index, F.when(twice, bad).otherwise(F.col(index)))
