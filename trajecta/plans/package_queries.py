"""Queries that check and rewrite packages; ``orders`` and ``lineitem`` stand for episodes and their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.operators import package
from trajecta.plans.registry import FRAMES, POSES, Tables, query, r6, wrap_sql


@query("WITH w AS (SELECT conv_id, turn, length(text) * 1.0 AS s, row_number() OVER b - 1 AS place, lag(length(text)) OVER b AS p, lead(turn) OVER b AS nt FROM conversations WINDOW b AS (PARTITION BY conv_id ORDER BY turn, length(text))) SELECT conv_id, turn, r AS reason FROM w, (VALUES ('index'), ('time'), ('next_place')) v(r) WHERE CASE r WHEN 'index' THEN turn <> place WHEN 'time' THEN s <= p ELSE abs(nt - (turn + turn % 3)) > 1e-5 END")
def trace_faults(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("seconds"), (F.col("turn") + F.col("turn") % 3).alias("declared"))
    return package.trace_faults(c, "conv_id", "turn", "seconds", ["turn"], ["declared"])


@query("WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS i FROM lineitem), d AS (SELECT o_orderkey, CAST(o_custkey % 7 AS INTEGER) AS n FROM orders WHERE o_orderstatus <> 'P'), w AS (SELECT p.*, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS place FROM p LEFT JOIN d ON o_orderkey = l_orderkey) SELECT l_orderkey, i, r AS reason FROM w, (VALUES ('undeclared_episode'), ('beyond_end'), ('gap_before')) v(r) WHERE CASE r WHEN 'undeclared_episode' THEN n IS NULL WHEN 'beyond_end' THEN i >= n ELSE i <> place END")
def presence_faults(t: Tables) -> DataFrame:
    present = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"))
    declared = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).cast("int").alias("n"))
    return package.presence_faults(present, declared, "l_orderkey", "i", "n")


@query("WITH e AS (SELECT p_partkey AS episode, p_size AS terminal, p_size % 4 AS k FROM part), s AS (SELECT episode, terminal, i AS image, CASE WHEN i = 3 THEN terminal ELSE i * (k + 1) END AS wp FROM e, range(0, 4) r(i)), g AS (SELECT *, wp - lag(wp) OVER (PARTITION BY episode ORDER BY image) AS step FROM s), sh AS (SELECT episode, bool_or(step <= 0) AS grow, bool_or((image < 3 AND step NOT IN (1, 2)) OR (image = 3 AND step > 2)) AS gap FROM g GROUP BY episode), j AS (SELECT * FROM s WHERE (episode + image) % 11 <> 0) SELECT episode, CAST(NULL AS BIGINT) AS image, 'growth' AS reason FROM sh WHERE grow UNION ALL SELECT episode, NULL, 'gap' FROM sh WHERE gap UNION ALL SELECT episode, image, 'images_missing' FROM s WHERE (episode + image) % 11 = 0 UNION ALL SELECT episode, image, 'requests_repeated' FROM s WHERE episode % 50 = 7 UNION ALL SELECT episode, image, 'requests_waypoint' FROM s WHERE episode % 50 = 9")
def stream_faults(t: Tables) -> DataFrame:
    e = F.col("p_size") % 4 + 1
    schedule = F.array(*[(e * i).cast("long") for i in range(3)], F.col("p_size").cast("long"))
    episodes = t.part.select(F.col("p_partkey").alias("episode"), F.col("p_size").cast("long").alias("terminal"), schedule.alias("schedule"))
    rows = episodes.select("episode", F.posexplode("schedule").alias("image", "waypoint")).withColumn("image", F.col("image").cast("long"))
    requests = rows.withColumn("waypoint", F.when(F.col("episode") % 50 == 9, F.col("waypoint") - 1).otherwise(F.col("waypoint")))
    requests = requests.unionByName(requests.where("episode % 50 = 7"))
    return package.stream_faults(episodes, rows.where("(episode + image) % 11 <> 0"), requests, [1, 2])


@query(f"WITH {POSES} SELECT vec_id, r AS reason FROM poses, (VALUES ('position'), ('unit'), ('size'), ('channels')) v(r) WHERE CASE r WHEN 'position' THEN vec_id % 17 = 0 WHEN 'unit' THEN vec_id % 13 = 0 WHEN 'size' THEN vec_id % 11 = 0 ELSE vec_id % 5 = 2 END")
def request_faults(t: Tables) -> DataFrame:
    scale = F.when(F.col("vec_id") % 13 == 0, 1.5).otherwise(1.0)
    p = t.poses.withColumn("q", G.yaw_quaternion(F.col("yaw")))
    position = F.array("x", "y", F.when(F.col("vec_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    d = p.select("vec_id", position.alias("position"), F.array(*[F.col("q")[k] * scale for k in "wxyz"]).alias("quaternion"), F.when(F.col("vec_id") % 11 == 0, 0).otherwise(640).alias("width"), F.lit(480).alias("height"), F.when(F.col("vec_id") % 5 == 2, 2).otherwise(3).alias("channels"))
    return package.request_faults(d, ["vec_id"])


@query(f"WITH {POSES} SELECT episode, round(max(CASE WHEN vec_id % 40 <> 3 THEN abs(vec_id % 9) * 0.01 END), 6) AS worst, count(*) FILTER (vec_id % 40 = 3) AS unmatched, max(CASE WHEN vec_id % 40 <> 3 THEN abs(vec_id % 9) * 0.01 END) <= 0.075 AND count(*) FILTER (vec_id % 40 = 3) = 0 AS aligned FROM poses GROUP BY episode")
def alignment(t: Tables) -> DataFrame:
    world = t.poses.where("vec_id % 40 <> 3").withColumn("x", F.col("x") + F.col("vec_id") % 9 * 0.01)
    return package.alignment(t.poses, world, ["episode", "frame"], 0.075).withColumn("worst", F.round("worst", 6))


@query("WITH i AS (SELECT s_suppkey AS ref, s_nationkey AS shard, CAST(floor(s_acctbal) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 + CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS row FROM supplier), w AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY row, ref) - 1 AS place FROM i) SELECT ref, r AS reason FROM w, (VALUES ('row'), ('shard_full'), ('tokens')) v(r) WHERE CASE r WHEN 'row' THEN row <> place WHEN 'shard_full' THEN row >= 3 ELSE tokens <= 0 END")
def token_index_faults(t: Tables) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    i = t.supplier.select(F.col("s_suppkey").alias("ref"), F.col("s_nationkey").alias("shard"), F.floor("s_acctbal").alias("tokens"), (at + F.when(F.col("s_suppkey") % 10 == 9, 1).otherwise(0)).alias("row"))
    return package.token_index_faults(i, "ref", "shard", "row", "tokens", 3)


@query(f"WITH {FRAMES} SELECT episode, frame, 'count' AS reason FROM frames WHERE event_id % 20 = 4 UNION ALL SELECT episode, frame, 'range' FROM frames WHERE event_id % 30 = 6 AND frame > 0")
def history_faults(t: Tables) -> DataFrame:
    past = F.sequence(F.greatest(F.col("frame") - 3, F.lit(0)), F.col("frame") - 1)
    frames = t.frames.select("episode", "frame", "event_id")
    h = frames.where("frame > 0").select("episode", "frame", "event_id", F.explode(past).alias("history_frame"))
    h = h.withColumn("history_frame", F.when((F.col("event_id") % 30 == 6) & (F.col("history_frame") == F.col("frame") - 1), F.col("frame")).otherwise(F.col("history_frame")))
    counts = frames.select("episode", "frame", (F.least(F.col("frame"), F.lit(3)) + F.when(F.col("event_id") % 20 == 4, 1).otherwise(0)).alias("n"))
    return package.history_faults(h, counts)


@query("SELECT s_nationkey, count(*) AS sources, count(DISTINCT s_suppkey % 2) = 1 AS agree, CAST(min(s_suppkey % 2) AS BIGINT) AS mean FROM supplier GROUP BY s_nationkey")
def shared_statistics(t: Tables) -> DataFrame:
    return package.shared_statistics(t.supplier.select("s_nationkey", (F.col("s_suppkey") % 2).alias("mean")), "s_nationkey", ["mean"])


@query("WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM c) THEN 'new' ELSE 'old' END AS origin, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM c) THEN l_quantity + 1 ELSE l_quantity END AS quantity FROM lineitem")
def hybrid_package(t: Tables) -> DataFrame:
    old = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"))
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return package.hybrid(old, old.withColumn("quantity", F.col("quantity") + 1), done, "l_orderkey")


@query("WITH e AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_episode FROM orders WHERE o_orderstatus = 'P') SELECT l_linenumber, l_partkey, l_suppkey, new_episode, row_number() OVER (ORDER BY new_episode, l_linenumber, l_partkey, l_suppkey) - 1 AS new_index FROM lineitem JOIN e ON l_orderkey = o_orderkey")
def split_subset(t: Tables) -> DataFrame:
    episodes = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    frames = package.subset(episodes, t.lineitem, episodes.where("o_orderstatus = 'P'"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "new_index")[1]
    return frames.select("l_linenumber", "l_partkey", "l_suppkey", "new_episode", "new_index")


@query("SELECT o_orderpriority, count(*) AS planned, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS resolved, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS unresolved FROM orders GROUP BY o_orderpriority")
def unresolved_plans(t: Tables) -> DataFrame:
    return package.planned_against_results(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderpriority")


@query(f"WITH {POSES}, s AS (SELECT episode, frame, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)) AS d, abs({wrap_sql('yaw - lag(yaw) OVER w')}) > 0.1 AS turns FROM poses WINDOW w AS (PARTITION BY episode ORDER BY frame)) SELECT episode, round(min(d), 6) AS shortest, round(avg(d), 6) AS mean, round(max(d), 6) AS longest, arg_max(frame, d) AS longest_at, round(avg(turns::INTEGER), 6) AS turning FROM s WHERE d IS NOT NULL GROUP BY episode")
def step_metrics(t: Tables) -> DataFrame:
    d = package.step_metrics(t.poses, 0.1)
    return d.select("episode", r6(F.col("shortest"), "shortest"), r6(F.col("mean"), "mean"), r6(F.col("longest"), "longest"), "longest_at", r6(F.col("turning"), "turning"))


@query(f"WITH {FRAMES}, c AS (SELECT *, bool_or(value > 60) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS hit FROM frames) SELECT episode, count(*) AS frames, round(avg((value > 5 AND NOT hit)::INTEGER), 6) AS tracked, bool_or(hit) AS collided, min(CASE WHEN hit THEN frame END) AS collided_at FROM c GROUP BY episode")
def following_rates(t: Tables) -> DataFrame:
    d = package.following(t.frames, "episode", ["frame"], F.col("value") > 5, F.col("value") > 60)
    return d.withColumn("tracked", F.round("tracked", 6))


@query("WITH c AS (SELECT l_orderkey, l_linenumber % 2 AS camera, avg((l_quantity <= 12)::INTEGER) AS near, avg(abs(l_discount * 100 - l_quantity)) AS diff FROM lineitem GROUP BY 1, 2), d AS (SELECT l_orderkey, max(near) AS near_share, max(diff) AS largest_change, count(*) FILTER (near > 0.5) AS close_cameras FROM c GROUP BY 1) SELECT l_orderkey, round(near_share, 6) AS near_share, round(largest_change, 6) AS largest_change, CASE WHEN largest_change < 15 THEN 'tiny diff' WHEN close_cameras > 0 THEN 'close' WHEN o_totalprice < 100000 THEN 'distance' END AS reason FROM d LEFT JOIN orders ON o_orderkey = l_orderkey")
def depth_collision(t: Tables) -> DataFrame:
    pixels = t.lineitem.withColumn("before", F.col("l_discount") * 100).withColumn("camera", F.col("l_linenumber") % 2)
    moved = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("distance"))
    d = package.depth_collision(pixels, moved, "l_orderkey", "camera", "before", "l_quantity", 12, 0.5, 15, 100000)
    return d.select("l_orderkey", F.round("near_share", 6).alias("near_share"), F.round("largest_change", 6).alias("largest_change"), "reason")
