"""Work that is resumed: an index that a stream extends batch by batch, and plans less what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trajecta.operators import sampling
from trajecta.operators.chains import dense_numbers


def batch_sink(root: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch to a folder of its number.

    A batch that is run again after a failure replaces what its first run left, so no row is there
    twice. ``after`` is called with the number once the batch is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        if after:
            after(number)

    return write


def extend_index(rows: DataFrame, root: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Add a stream's rows to the index at ``root``; a restart with the same checkpoint goes on after the last finished batch."""
    return rows.writeStream.foreachBatch(batch_sink(root, after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_indexed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of the index with the number of their batch; keep one root for one checkpoint."""
    return spark.read.schema(f"{schema}, batch long").parquet(root)


def remaining_plan(plan: DataFrame, records: DataFrame, key: str, order: str, workers: int, completed: Column, failed: Column) -> DataFrame:
    """(key, ordinal, worker): the plan's rows still to be done, dealt to workers in equal runs of the plan's order.

    A row is done if a record says so without a failure; any other record, and none, leaves it to
    do. ``ordinal`` is the row's place in the whole plan, so it doesn't change from run to run.
    """
    done = records.where(completed & ~F.coalesce(failed, F.lit(False))).select(key).distinct()
    numbered = dense_numbers(plan.select(key, order), [order], "ordinal").select(key, "ordinal")
    left = numbered.join(done, key, "left_anti")
    return sampling.contiguous_parts(left, ["ordinal"], workers).select(key, "ordinal", F.col("part").alias("worker"))
