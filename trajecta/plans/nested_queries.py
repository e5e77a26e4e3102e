"""Queries over nested values: reports whose paths move, shapes, and equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions import nested
from trajecta.plans.registry import Tables, query


def _reports(t: Tables) -> DataFrame:
    """One report an order: its root, its items' files, and lists of files by flag; some paths only look like the root."""
    root = F.when(F.col("l_orderkey") % 3 == 0, "/stage/x2").otherwise("/stage/x")
    path = F.concat(root, F.lit("/"), F.col("l_partkey").cast("string"))
    item = F.struct("l_linenumber", path.alias("path"), F.struct(F.lit("/stage/x").alias("home"), F.lit("a /stage/x/b").alias("said")).alias("more"))
    own = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("item")))).alias("l"))
    report = F.struct(F.lit("/stage/x").alias("root"), F.col("l.item").alias("files"), F.create_map(F.lit("/stage/x"), F.transform("l.item", lambda i: i["path"])).alias("by_name"))
    return own.select("l_orderkey", report.alias("report"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN '/stage/x2/' ELSE '/data/y/' END || l_partkey AS path FROM lineitem) SELECT l_orderkey, '/data/y' AS root, string_agg(path, ',' ORDER BY l_linenumber, l_partkey) AS files, string_agg(path, ',' ORDER BY l_linenumber, l_partkey) AS named, '/data/y' AS home, 'a /stage/x/b' AS said, '/stage/x' AS name FROM p GROUP BY l_orderkey")
def rebased_reports(t: Tables) -> DataFrame:
    d = _reports(t)
    d = d.select("l_orderkey", nested.rebased(F.col("report"), nested.column_type(d, "report"), "/stage/x", "/data/y").alias("r"))
    first = F.get("r.files", F.lit(0))["more"]
    return d.select("l_orderkey", F.col("r.root").alias("root"), F.array_join("r.files.path", ",").alias("files"), F.array_join(F.get(F.map_values("r.by_name"), F.lit(0)), ",").alias("named"), first["home"].alias("home"), first["said"].alias("said"), F.get(F.map_keys("r.by_name"), F.lit(0)).alias("name"))


@query("SELECT l_orderkey, CAST(count(*) AS VARCHAR) || ',' || max(l_linenumber) FILTER (first) || CASE WHEN max(l_linenumber) FILTER (first) > 0 THEN ',2' ELSE '' END AS shape FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 AS first FROM lineitem) GROUP BY l_orderkey")
def nested_shapes(t: Tables) -> DataFrame:
    """Shapes of lists of lists of pairs: an order's items, as many pairs as the item's number."""
    pairs = F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda i: F.array(i, F.col("l_partkey").cast("int")))
    d = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", pairs.alias("pairs")))).alias("l")).select("l_orderkey", F.col("l.pairs").alias("v"))
    return d.select("l_orderkey", F.array_join(nested.shape(F.col("v"), nested.column_type(d, "v")), ",").alias("shape"))


@query("SELECT event_id, NOT (event_type = 'click' AND value > 20) AS same FROM events")
def nested_equality(t: Tables) -> DataFrame:
    """Two forms of an event: fields in another order, NaN for null, and for some another value deep inside."""
    number = F.when(F.col("value") > 20, F.col("value").cast("double"))
    other = F.when(F.col("event_type") == "click", number + 1).otherwise(F.coalesce(number, F.lit(float("nan"))))
    a = F.struct(F.col("event_type").alias("kind"), F.array(F.struct(number.alias("v"), F.col("user_id").alias("u"))).alias("list"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("map"))
    b = F.struct(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)).alias("map"), F.array(F.struct(F.col("user_id").alias("u"), other.alias("v"))).alias("list"), F.col("event_type").alias("kind"))
    d = t.events.select("event_id", a.alias("a"), b.alias("b"))
    return d.select("event_id", nested.equal(F.col("a"), nested.column_type(d, "a"), F.col("b"), nested.column_type(d, "b")).alias("same"))
