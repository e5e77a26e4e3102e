"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Files


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="trajecta-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trajecta/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors lose nothing.

    What the write has shuffled is removed with its end, and not when the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more; other tables stay."""
    spark = table.sparkSession
    for folder in {x.split("/")[-2] for x in table.inputFiles()}:
        path = f"{shared_dir(spark)}/trajecta/{folder}"
        Files(spark, path).delete(path)


#: Rows of text that go to a Python worker at once; whole texts are long rows.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, so that their buffers don't grow with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is executed inside; the caller's comes back."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of at most ``rows`` rows for what is executed inside; the caller's setting comes back."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
