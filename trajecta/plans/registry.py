"""The registry of named queries, and the stand-in tables that they read.

``events`` stands for frames (an episode is a user, in order of time), ``embeddings`` for poses (an
episode is a label, the first four numbers are x, y, z, yaw), ``orders`` and ``lineitem`` for episodes
and their frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def frames(self) -> DataFrame:
        e = self.events.select(F.col("user_id").alias("episode"), "event_id", "ts", "event_type", "value")
        return windows.number_frames(e, "episode", ["ts", "event_id"])

    @property
    def poses(self) -> DataFrame:
        v = F.col("embedding")
        e = self.embeddings.select(F.col("label").cast("bigint").alias("episode"), "vec_id", *[v[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "yaw"))])
        return windows.number_frames(e, "episode", ["vec_id"])


FRAMES = "frames AS (SELECT user_id AS episode, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
POSES = "poses AS (SELECT CAST(label AS BIGINT) AS episode, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS yaw, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings)"
_WRAP = "(({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi())"


def wrap_sql(x: str) -> str:
    return _WRAP.format(f"({x})")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c, name: str):
    return F.round(c, 6).alias(name)
