"""What goes wrong only on more rows, larger keys or equal values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.helpers import duck_rows, spark_rows
from trajecta.functions import strings as S
from trajecta.plans import queries as Q


@pytest.fixture
def written(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_groups_that_cannot_be_halved(spark, written):
    rows = [(1000 * k + i, k) for k in range(5) for i in range(100 + k % 3)]
    got = {r.s_nationkey: r.n for r in Q.QUERIES["exact_group_split"](spark, written("supplier", rows, "s_suppkey long, s_nationkey int")).collect()}
    assert sum(got.values()) == 203 and len(got) == 2  # of 504


def test_first_of_equal_values(spark, written):
    rows = [(9, 1, "view", 7.0), (3, 1, "error", 7.0), (5, 1, None, 7.0), (4, 1, "view", None), (2, 2, "view", None), (8, 3, "view", 1.0), (6, 3, "view", 1.0), (7, 3, "view", 2.0), (1, 3, None, 2.0)]
    at = written("events", [(r[0], r[1], r[2], r[3]) for r in rows], "event_id long, user_id long, event_type string, value double")
    got = spark_rows(Q.QUERIES["episode_aggregates"](spark, at))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    assert got == duck_rows(c, Q.SQL["episode_aggregates"])
    assert {r.user_id: (r.lowest, r.highest) for r in Q.QUERIES["episode_aggregates"](spark, at).collect()} == {1: (3, 3), 2: (None, None), 3: (6, 1)}


def test_numbers_of_more_than_six_digits(spark, written):
    at = written("orders", [(7, 1), (999999, 2), (1234567, 3), (90000000, 4)], "o_orderkey long, o_custkey long")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet/*.parquet'")
    assert spark_rows(Q.QUERIES["ref_build_parse"](spark, at)) == duck_rows(c, Q.SQL["ref_build_parse"])
    missing = spark.sql("SELECT CAST(NULL AS BIGINT) AS f").select(S.frame_ref(F.lit("e"), F.col("f"), F.lit("front")).alias("ref"))
    assert missing.first().ref is None
