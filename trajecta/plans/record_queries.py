"""Queries of the raw-record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators import records
from trajecta.plans.registry import FRAMES, POSES, Tables, query, r6, wrap_sql


@query("SELECT count(*) FILTER (starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '3-')) AS kept, count(*) FILTER (NOT (starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '3-'))) AS dropped FROM orders")
def prefix_filter(t: Tables) -> DataFrame:
    return records.prefix_counts(t.orders, F.col("o_orderpriority"), ["1-", "3-"])


@query(f"WITH {FRAMES} SELECT event_id, round(CASE WHEN value > 50 THEN value ELSE frame / 5.0 END, 6) AS seconds FROM frames")
def episode_time(t: Tables) -> DataFrame:
    own = F.when(F.col("value") > 50, F.col("value"))
    return t.frames.select("event_id", r6(records.resolve_time(own, F.col("frame"), 5), "seconds"))


@query(f"WITH {POSES} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(-z, 6) AS z, round({wrap_sql('radians(yaw * 200)')}, 6) AS yaw FROM poses")
def drone_pose(t: Tables) -> DataFrame:
    p = records.drone_pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw") * 200)
    return t.poses.select("vec_id", p.alias("p")).select("vec_id", *[r6(F.col(f"p.{c}"), c) for c in ("x", "y", "z", "yaw")])


@query(f"WITH {FRAMES} SELECT episode, camera, (event_id + extra) / 5.0 AS \"offset\" FROM frames, (VALUES ('front', 0), ('rear', 3)) v(camera, extra) WHERE frame = 0")
def video_offsets(t: Tables) -> DataFrame:
    first = t.frames.where("frame = 0").select("episode", F.col("event_id").alias("index"))
    cameras = F.array(F.struct(F.lit("front").alias("camera"), F.lit(0).alias("extra")), F.struct(F.lit("rear").alias("camera"), F.lit(3).alias("extra")))
    video = t.events.select(F.col("event_id").alias("index"), F.explode(cameras).alias("c")).select("index", "c.camera", F.lit(True).alias("available"), (F.col("index") + F.col("c.extra")).alias("video_frame"))
    return records.first_frame_offsets(first, video, ["front", "rear"], 5)


@query("WITH p AS (SELECT p_partkey, p_size + 40 AS size, row_number() OVER (ORDER BY sha256('s7:' || p_partkey)) - 1 AS r, count(*) OVER () AS n FROM part), k AS (SELECT *, 5000 // n + CASE WHEN r < 5000 % n THEN 1 ELSE 0 END AS c, size - 9 AS high FROM p) SELECT p_partkey, kind, CAST(CASE WHEN c = 1 THEN (4 + high) // 2 ELSE round_even(4 + i * (high - 4) / greatest(c - 1, 1)::DOUBLE, 0) END AS BIGINT) AS frame FROM k, range(0, 60) q(i), (VALUES ('original'), ('augmented')) v(kind) WHERE i < c")
def paired_anchors(t: Tables) -> DataFrame:
    parents = t.part.select("p_partkey", (F.col("p_size") + 40).cast("bigint").alias("size"))
    return records.paired_anchors(parents, "p_partkey", "size", 5000, ["original", "augmented"], "s7")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_returnflag, l_suppkey, l_partkey, l_linenumber, l_orderkey) - 1 AS position FROM lineitem")
def video_order(t: Tables) -> DataFrame:
    refs = t.lineitem.select("l_returnflag", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey")
    return records.video_order(refs, ["l_returnflag", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"]).drop("l_returnflag")


@query("WITH o AS (SELECT c_custkey AS k, c_nationkey AS scene, c_mktsegment AS status, c_custkey % 3 AS attempts FROM customer), n AS (SELECT s_suppkey * 3 % 1700 AS k, s_nationkey AS scene FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey * 3 % 1700 ORDER BY s_suppkey DESC) = 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.scene ELSE n.scene END AS scene, CASE WHEN o.k IS NULL THEN 'pending' ELSE o.status END AS status, CASE WHEN o.k IS NULL THEN 0 ELSE o.attempts END AS attempts FROM o FULL JOIN n ON o.k = n.k")
def job_upsert(t: Tables) -> DataFrame:
    """Jobs added again keep their status and attempts; only the scene is the new one."""
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("scene"), F.col("c_mktsegment").alias("status"), (F.col("c_custkey") % 3).alias("attempts"))
    new = t.supplier.select((F.col("s_suppkey") * 3 % 1700).alias("k"), F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("at"))
    return records.upsert(old, new, ["k"], "at", {"status": F.lit("pending"), "attempts": F.lit(0)})


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS remaining FROM customer")
def job_remaining(t: Tables) -> DataFrame:
    jobs = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return records.work_remaining(t.customer.select("c_custkey"), jobs, "c_custkey", F.col("o_orderstatus") == "O")


@query("SELECT o_orderkey, '[\"' || o_orderpriority || '\\u00e9\",' || coalesce(CAST(nullif(o_custkey % 3, 0) AS VARCHAR), 'null') || ',\"\\ud83d\\ude00' || o_orderstatus || '\"]' AS key FROM orders")
def scenario_key(t: Tables) -> DataFrame:
    number = F.nullif(F.col("o_custkey") % 3, F.lit(0))
    return t.orders.select("o_orderkey", records.group_key(F.concat("o_orderpriority", F.lit("é")), number, F.concat(F.lit("😀"), "o_orderstatus")).alias("key"))


@query("WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages) SELECT page_id, CASE WHEN s[1] <> '' THEN s[1] ELSE 'open' END AS scene, CASE WHEN len(s) >= 3 AND s[2] = 'astar_data' THEN s[3] ELSE coalesce(s[2], 'open') END AS subtype FROM p")
def scene_subtype(t: Tables) -> DataFrame:
    s = records.scene_and_subtype(F.regexp_replace("url", "^https?://", ""), "open")
    return t.pages.select("page_id", s.alias("s")).select("page_id", "s.*")


@query("SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'o' THEN 'open' WHEN 'f' THEN 'done' ELSE 'open' END AS status FROM orders")
def status_alias(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", records.named_as(F.concat(F.lit(" "), "o_orderstatus"), {"o": "open", "f": "done", "p": "open"}).alias("status"))


@query(f"WITH {POSES}, n AS (SELECT greatest(0, frame + 5 - (count(*) OVER (PARTITION BY episode) - 1)) AS padded FROM poses) SELECT count(*) FILTER (padded > 0) AS frames_padded, CAST(sum(padded) AS BIGINT) AS steps_padded FROM n")
def padding_counts(t: Tables) -> DataFrame:
    last = t.poses.groupBy("episode").agg(F.max("frame").alias("last"))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.col("frame") + j > F.col("last"))
    return records.padding_counts(t.poses.join(last, "episode"), ahead)
