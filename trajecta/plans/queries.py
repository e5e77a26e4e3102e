"""Named queries over the standard tables, each with its SQL.

``events`` stands for frames (an episode is a user, in order of time), ``embeddings`` for poses (an
episode is a label, the first four numbers are x, y, z, yaw), ``orders`` and ``lineitem`` for episodes
and their frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.functions import hashing as H
from trajecta.functions import strings as S
from trajecta.operators import chains, history, joins, quality, retiming, sampling, sets, stats, trajectory, windows
from trajecta.plans import batch_queries, context_queries, nested_queries, package_queries, pose_queries, record_queries, run_queries, source_queries, video_queries  # noqa: F401  (they register theirs)
from trajecta.plans.registry import FRAMES, POSES, QUERIES, SQL, Tables, query, r6, wrap_sql
from trajecta.streaming import windows as streams


# --- geometry -----------------------------------------------------------------------------------


@query(f"WITH {POSES}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM poses WINDOW w AS (PARTITION BY episode ORDER BY frame)), a AS (SELECT episode, count(*) AS n, sum(coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)), 0)) AS path FROM s GROUP BY episode), e AS (SELECT f.episode, sqrt((l.x-f.x)*(l.x-f.x)+(l.y-f.y)*(l.y-f.y)+(l.z-f.z)*(l.z-f.z)) AS direct FROM (SELECT episode, max(frame) AS m FROM poses GROUP BY episode) k JOIN poses f ON f.episode = k.episode AND f.frame = 0 JOIN poses l ON l.episode = k.episode AND l.frame = k.m), c AS (SELECT p.episode, avg(cos(p.yaw)*(q.x-p.x)+sin(p.yaw)*(q.y-p.y)) AS dx, avg(cos(p.yaw)*(q.y-p.y)-sin(p.yaw)*(q.x-p.x)) AS dy FROM poses p JOIN poses q ON p.episode = q.episode AND q.frame BETWEEN p.frame+1 AND p.frame+8 GROUP BY p.episode) SELECT a.episode, a.n, round(path, 6) AS path_length, round(direct, 6) AS displacement, round(direct / greatest(path, direct, 1e-6), 6) AS efficiency, round(dx, 6) AS mean_dx, round(dy, 6) AS mean_dy FROM a JOIN e ON a.episode = e.episode JOIN c ON a.episode = c.episode")
def episode_summary(t: Tables) -> DataFrame:
    p = t.poses.withColumn("p", G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw")))
    w = Window.partitionBy("episode").orderBy("frame")
    step = F.coalesce(G.distance(F.col("p"), F.lag("p").over(w)), F.lit(0.0))
    a = p.withColumn("step", step).groupBy("episode").agg(F.count("*").alias("n"), F.sum("step").alias("path"), F.min_by("p", "frame").alias("first"), F.max_by("p", "frame").alias("last"))
    direct = G.distance(F.col("first"), F.col("last"))
    c = windows.action_chunk(t.poses, 8).groupBy("episode").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    return a.join(c, "episode").select("episode", "n", r6(F.col("path"), "path_length"), r6(direct, "displacement"), r6(stats.path_efficiency(F.lit(True), direct, F.col("path")), "efficiency"), r6(F.col("dx"), "mean_dx"), r6(F.col("dy"), "mean_dy"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({wrap_sql('l_extendedprice')}, 6) AS angle FROM lineitem")
def wrap_angle(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(G.wrap_angle(F.col("l_extendedprice")), "angle"))


@query(f"WITH {POSES}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(yaw) OVER w AS pw FROM poses WINDOW w AS (PARTITION BY episode ORDER BY frame)) SELECT vec_id, round(cos(pw)*(x-px)+sin(pw)*(y-py), 6) AS dx, round(cos(pw)*(y-py)-sin(pw)*(x-px), 6) AS dy, round(z-pz, 6) AS dz, round({wrap_sql('yaw-pw')}, 6) AS dyaw FROM s WHERE px IS NOT NULL")
def body_delta(t: Tables) -> DataFrame:
    w = Window.partitionBy("episode").orderBy("frame")
    p = t.poses.withColumn("p", G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))).withColumn("q", F.lag("p").over(w)).where("q IS NOT NULL")
    d = p.withColumn("d", G.body_delta(F.col("q"), F.col("p")))
    return d.select("vec_id", *[r6(F.col(f"d.{c}"), c) for c in ("dx", "dy", "dz", "dyaw")])


@query(f"WITH {POSES} SELECT vec_id, CASE WHEN abs(x) < 0.01 THEN 0.0 ELSE x END AS x, CASE WHEN {wrap_sql('yaw')} > 0.2618 THEN 'left' WHEN {wrap_sql('yaw')} < -0.2618 THEN 'right' ELSE 'straight' END AS turn, round(cos(yaw / 2), 6) AS qw, round(sin(yaw / 2), 6) AS qz FROM poses")
def pose_scalars(t: Tables) -> DataFrame:
    q = G.yaw_quaternion(F.col("yaw"))
    return t.poses.select("vec_id", G.clean_number(F.col("x"), 0.01).alias("x"), G.turn_direction(G.wrap_angle(F.col("yaw"))).alias("turn"), r6(q["w"], "qw"), r6(q["z"], "qz"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount * 100 AS d FROM lineitem), w AS (SELECT *, greatest(0, least(q, 25) - greatest(0, d)) AS iw, greatest(0, least(q, 25) - greatest(0, 5)) AS ih FROM b) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN q*q + greatest(0, 25-d)*20 - iw*ih > 0 THEN iw*ih / (q*q + greatest(0, 25-d)*20 - iw*ih) ELSE 0 END, 6) AS iou FROM w")
def box_iou(t: Tables) -> DataFrame:
    box = lambda *v: F.struct(*[x.cast("double").alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(G.box_iou(box(F.lit(0), F.lit(0), q, q), box(d, F.lit(5), F.lit(25), F.lit(25))), "iou"))


# --- windows ------------------------------------------------------------------------------------

_CHUNK = "round(cos(p.yaw)*(q.x-p.x)+sin(p.yaw)*(q.y-p.y), 6) AS dx, round(cos(p.yaw)*(q.y-p.y)-sin(p.yaw)*(q.x-p.x), 6) AS dy, round(q.z-p.z, 6) AS dz, round({}, 6) AS dyaw".format(wrap_sql("q.yaw-p.yaw"))


@query(f"WITH {POSES} SELECT p.episode, p.frame, CAST(q.frame - p.frame AS INTEGER) AS h, {_CHUNK} FROM poses p JOIN poses q ON p.episode = q.episode AND q.frame BETWEEN p.frame + 1 AND p.frame + 8")
def action_chunk(t: Tables) -> DataFrame:
    return windows.action_chunk(t.poses, 8).select("episode", "frame", "h", *[r6(F.col(c), c) for c in ("dx", "dy", "dz", "dyaw")])


@query(f"WITH {POSES}, n AS (SELECT episode, max(frame) AS m FROM poses GROUP BY episode), g AS (SELECT p.*, CAST(h AS INTEGER) AS h, least(p.frame + h, m) AS target FROM poses p JOIN n ON p.episode = n.episode, range(1, 9) r(h)) SELECT p.episode, p.frame, p.h, {_CHUNK} FROM g p JOIN poses q ON p.episode = q.episode AND q.frame = p.target")
def action_chunk_repeat_last(t: Tables) -> DataFrame:
    return windows.action_chunk(t.poses, 8, repeat_last=True).select("episode", "frame", "h", *[r6(F.col(c), c) for c in ("dx", "dy", "dz", "dyaw")])


@query(f"WITH {POSES}, g AS (SELECT episode, frame, CAST(h AS INTEGER) AS h, x, y, yaw FROM poses, range(1, 5) r(h)) SELECT p.episode, p.frame, p.h, round(coalesce(cos(p.yaw)*(q.x-p.x)+sin(p.yaw)*(q.y-p.y), 0), 6) AS dx, q.x IS NULL AS padded FROM g p LEFT JOIN poses q ON p.episode = q.episode AND q.frame = p.frame + p.h")
def action_chunk_padded(t: Tables) -> DataFrame:
    return windows.padded_chunk(windows.action_chunk(t.poses, 4), t.poses, 4).select("episode", "frame", "h", r6(F.col("dx"), "dx"), "padded")


@query(f"WITH {POSES} SELECT p.episode, p.frame, CAST(p.frame - q.frame AS INTEGER) AS back, round(cos(p.yaw)*(q.x-p.x)+sin(p.yaw)*(q.y-p.y), 6) AS dx, round(cos(p.yaw)*(q.y-p.y)-sin(p.yaw)*(q.x-p.x), 6) AS dy FROM poses p JOIN poses q ON p.episode = q.episode AND q.frame BETWEEN p.frame - 6 AND p.frame - 1")
def past_waypoints(t: Tables) -> DataFrame:
    return windows.past_waypoints(t.poses, 6).select("episode", "frame", "back", r6(F.col("dx"), "dx"), r6(F.col("dy"), "dy"))


@query(f"WITH {POSES}, s AS (SELECT *, frame * 0.5 + (vec_id % 3) * 0.1 AS sec FROM poses), d AS (SELECT *, (cos(lag(yaw) OVER w) * (x - lag(x) OVER w) + sin(lag(yaw) OVER w) * (y - lag(y) OVER w)) / greatest(sec - lag(sec) OVER w, 1e-6) AS v, ({wrap_sql('yaw - lag(yaw) OVER w')}) / greatest(sec - lag(sec) OVER w, 1e-6) AS r, greatest(sec - lag(sec) OVER w, 1e-6) AS dt FROM s WINDOW w AS (PARTITION BY episode ORDER BY frame)), e AS (SELECT vec_id, episode, frame, dt, coalesce(v, lead(v) OVER w, 0) AS velocity, coalesce(r, lead(r) OVER w, 0) AS yaw_rate FROM d WINDOW w AS (PARTITION BY episode ORDER BY frame)) SELECT vec_id, round(velocity, 6) AS velocity, round(yaw_rate, 6) AS yaw_rate, round(coalesce((velocity - lag(velocity) OVER (PARTITION BY episode ORDER BY frame)) / dt, 0), 6) AS acceleration FROM e")
def dynamics(t: Tables) -> DataFrame:
    p = t.poses.withColumn("sec", F.col("frame") * 0.5 + (F.col("vec_id") % 3) * 0.1)
    return windows.dynamics(p, "sec").select("vec_id", *[r6(F.col(c), c) for c in ("velocity", "yaw_rate", "acceleration")])


@query("SELECT event_id, CAST(CASE WHEN value > 20 THEN sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 ELSE -1 END AS BIGINT) AS frame_offset FROM events")
def frame_offset(t: Tables) -> DataFrame:
    return windows.running_offset(t.events, ["event_type", "user_id"], ["ts", "event_id"], F.col("value") > 20, "frame_offset").select("event_id", "frame_offset")


@query("SELECT user_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY user_id) - count(*) AS BIGINT) AS start FROM events GROUP BY user_id")
def episode_offsets(t: Tables) -> DataFrame:
    return windows.exclusive_offsets(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n")


@query("SELECT l_orderkey, l_linenumber, previous FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM lineitem) WHERE l_linenumber <> previous + 1")
def contiguity_violations(t: Tables) -> DataFrame:
    return windows.contiguity_breaks(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "previous")


@query("SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn, max(turn) - min(turn) + 1 = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def turn_contiguity(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.max("turn") - F.min("turn") + 1 == F.count("*")).alias("contiguous"))


@query(f"WITH {FRAMES} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), 0.0) AS filled FROM frames")
def forward_fill(t: Tables) -> DataFrame:
    f = t.frames.withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.forward_fill(f, "v", "filled", 0.0).select("event_id", "filled")


@query(f"WITH {POSES}, d AS (SELECT vec_id, episode, frame, coalesce({wrap_sql('yaw * 3 - lag(yaw * 3) OVER (PARTITION BY episode ORDER BY frame)')}, yaw * 3) AS d FROM poses) SELECT vec_id, round(sum(d) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM d")
def unwrap(t: Tables) -> DataFrame:
    return windows.unwrap(t.poses.withColumn("a", F.col("yaw") * 3), "a", "unwrapped").select("vec_id", r6(F.col("unwrapped"), "unwrapped"))


@query(f"WITH {FRAMES}, g AS (SELECT *, value > 30 AS f, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS grp FROM frames) SELECT event_id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY episode, grp ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g")
def streaks(t: Tables) -> DataFrame:
    return windows.streaks(t.frames, F.col("value") > 30).select("event_id", "streak")


@query(f"WITH {FRAMES} SELECT event_id, bool_or(value > 90) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS reached, max(value) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS best FROM frames")
def oracle_flag(t: Tables) -> DataFrame:
    f = windows.running_any(t.frames, F.col("value") > 90, "reached")
    return windows.running_any(f, F.col("value"), "best").select("event_id", "reached", "best")


@query(f"WITH {FRAMES} SELECT a.episode, a.frame, h.frame AS history_frame FROM frames a JOIN frames h ON a.episode = h.episode AND h.frame BETWEEN a.frame - 4 AND a.frame - 1")
def recent_history(t: Tables) -> DataFrame:
    return windows.recent_history(t.frames, 4)


@query(f"WITH {FRAMES}, k AS (SELECT episode, frame, least(frame, 4) AS n FROM frames WHERE frame > 0) SELECT DISTINCT episode, frame, CAST(CASE WHEN n = 1 THEN 0 ELSE floor(i * (frame - 1) / (n - 1)::DOUBLE) END AS BIGINT) AS history_frame FROM k, range(0, 4) r(i) WHERE i < n")
def uniform_history(t: Tables) -> DataFrame:
    return windows.uniform_history(t.frames, 4)


@query(f"WITH {FRAMES}, s AS (SELECT event_id, episode, frame, abs(value - lag(value, 1, value) OVER (PARTITION BY episode ORDER BY frame)) AS step FROM frames) SELECT event_id, round(pow(CASE WHEN sum(step) OVER a <= 1e-6 THEN CASE WHEN count(*) OVER a > 1 THEN frame / (count(*) OVER a - 1) ELSE 0 END ELSE sum(step) OVER r / sum(step) OVER a END, 2), 6) AS progress FROM s WINDOW a AS (PARTITION BY episode), r AS (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING)")
def path_progress(t: Tables) -> DataFrame:
    w = Window.partitionBy("episode").orderBy("frame")
    f = t.frames.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("step", F.coalesce("step", F.lit(0.0)))
    return windows.path_progress(f, "step", 2.0).select("event_id", r6(F.col("progress"), "progress"))


# --- history ------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(greatest(0, floor((p_size * 37 - 2 * (64 + 1 + 3)) / (2 * (4 + 1 + 3.0)))) AS BIGINT) AS capacity FROM part")
def bats_capacity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", history.capacity(F.col("p_size") * 37, 64, 2).alias("capacity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity <= 0 THEN 0 ELSE least(1.0, greatest(0.0, (1 - 0.1) * exp(4.0 * (l_linenumber - l_quantity) / l_quantity) + 0.1)) END, 6) AS p FROM lineitem")
def keep_probability(t: Tables) -> DataFrame:
    p = history.keep_probability(F.col("l_linenumber"), F.col("l_quantity"), 4.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(p, "p"))


_SELECTED = "c AS (SELECT a.episode, a.frame, h.frame AS history_frame, least(1.0, greatest(0.0, 0.9 * exp(6.0 * (h.frame - a.frame) / a.frame) + 0.1)) AS p, ('0x' || substr(sha256('history:' || a.episode || ':' || a.frame || ':' || h.frame), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM frames a JOIN frames h ON a.episode = h.episode AND h.frame < a.frame), k AS (SELECT *, row_number() OVER (PARTITION BY episode, frame ORDER BY draw / p, history_frame) AS r FROM c WHERE draw < p), sel AS (SELECT episode, frame, history_frame FROM k WHERE r <= 5)"


@query(f"WITH {FRAMES}, {_SELECTED} SELECT * FROM sel")
def history_bats_hash(t: Tables) -> DataFrame:
    return history.select_history(t.frames, 6.0, 5).select("episode", "frame", "history_frame")


@query(f"WITH RECURSIVE {FRAMES}, {_SELECTED}, l AS (SELECT f.episode, f.frame, list(s.history_frame ORDER BY s.history_frame) AS cs FROM frames f LEFT JOIN sel s ON s.episode = f.episode AND s.frame = f.frame GROUP BY f.episode, f.frame), m AS (SELECT episode, frame, cs, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS newest FROM l WHERE frame = 0 UNION ALL SELECT l.episode, l.frame, l.cs, m.n + CASE WHEN len(list_filter(m.cs, lambda c: c > m.newest)) > 0 THEN 1 ELSE 0 END, coalesce(list_min(list_filter(m.cs, lambda c: c > m.newest)), m.newest) FROM m JOIN l ON l.episode = m.episode AND l.frame = m.frame + 1) SELECT episode, frame, n, CASE WHEN n > 0 THEN newest END AS newest FROM m")
def long_memory(t: Tables) -> DataFrame:
    ranked = history.select_history(t.frames, 6.0, 5).groupBy("episode", "frame").agg(F.sort_array(F.collect_list("history_frame")).alias("candidates"))
    f = t.frames.select("episode", "frame").join(ranked, ["episode", "frame"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<bigint>")))
    return history.long_memory(f).select("episode", "frame", F.size("memory").cast("bigint").alias("n"), F.array_max("memory").alias("newest"))


@query("SELECT event_id, CAST((CASE WHEN value > 10 THEN 1 ELSE 0 END) | (CASE WHEN event_type = 'click' THEN 2 ELSE 0 END) | (CASE WHEN user_id % 3 = 0 THEN 4 ELSE 0 END) AS BIGINT) AS mask FROM events")
def bitmask_encode(t: Tables) -> DataFrame:
    return t.events.select("event_id", history.camera_mask([F.col("value") > 10, F.col("event_type") == "click", F.col("user_id") % 3 == 0]).alias("mask"))


@query("SELECT p_partkey, name FROM part, (VALUES (0, 'front'), (1, 'left'), (2, 'right'), (3, 'rear')) v(i, name) WHERE (p_size >> i) & 1 = 1")
def bitmask_expand(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(history.expand_mask(F.col("p_size").cast("bigint"), ["front", "left", "right", "rear"])).alias("name"))


# --- joins --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def task_join(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_type")


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def one_to_one_left(t: Tables) -> DataFrame:
    return joins.left_one_to_one(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_fk(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_selected(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_backward(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return joins.asof_backward(left, right, "user_id", "ts", ["event_id", "value"]).select("event_id", F.col("hit.event_id").alias("purchase_id"), F.col("hit.value").alias("purchase_value"))


@query("WITH e AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT e.event_id, e.ts, p.event_id AS pid, p.ts AS pts FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts), a AS (SELECT e.event_id, p.event_id AS pid, p.ts AS pts FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts) SELECT b.event_id, CASE WHEN a.pid IS NULL OR b.ts - b.pts <= a.pts - b.ts THEN b.pid ELSE a.pid END AS nearest_id FROM b JOIN a ON a.event_id = b.event_id")
def asof_nearest(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_nearest(left, right, "user_id", "ts", ["event_id", "ts"]).select("event_id", F.col("hit.event_id").alias("nearest_id"))


@query("SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 0.05 AND a.event_type = 'click' AND b.event_type = 'view'")
def tolerance_join(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'click'").select("event_id", "user_id", "value")
    b = t.events.where("event_type = 'view'").select(F.col("event_id").alias("other_id"), "user_id", F.col("value").alias("r_value"))
    return joins.tolerance_join(a, b, ["user_id"], "value", 0.05).select("event_id", "other_id")


@query("WITH s AS (SELECT s_nationkey AS k, s_suppkey AS segment, s_acctbal AS a, s_acctbal + 900 AS b FROM supplier), c AS (SELECT c_custkey, c_nationkey AS k, c_acctbal AS v FROM customer) SELECT c_custkey, coalesce(min(CASE WHEN a <= v AND v < b THEN segment END), (SELECT min(segment) FROM s x WHERE x.k = c.k)) AS segment FROM c LEFT JOIN s ON s.k = c.k GROUP BY c_custkey, c.k")
def interval_first_match(t: Tables) -> DataFrame:
    segments = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("segment"), F.col("s_acctbal").alias("start"), (F.col("s_acctbal") + 900).alias("end"))
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("at"))
    return joins.interval_first_match(rows, segments, ["k"], "at", 500.0).select("c_custkey", "segment")


@query("SELECT n_nationkey, view FROM nation, (VALUES ('front'), ('left'), ('right'), ('rear')) v(view)")
def frame_views(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(F.array(*map(F.lit, ("front", "left", "right", "rear")))).alias("view"))


@query("SELECT coalesce(a.c_custkey, b.o_custkey) AS custkey, CASE WHEN b.o_custkey IS NULL THEN 'left_only' WHEN a.c_custkey IS NULL THEN 'right_only' ELSE 'matched' END AS status FROM customer a FULL JOIN (SELECT DISTINCT o_custkey FROM orders) b ON a.c_custkey = b.o_custkey")
def paired_stream(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("custkey"))
    b = t.orders.select(F.col("o_custkey").alias("custkey")).distinct()
    return joins.paired(a, b, ["custkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name, r_name, coalesce(p_brand, 'none') AS brand FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey")
def dimension_chain(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name", "r_name", F.coalesce("p_brand", F.lit("none")).alias("brand"))


@query("SELECT conv_id, turn, length(text) AS n, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations QUALIFY role = 'assistant'")
def dialogue_pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return t.conversations.withColumn("asked", asked).where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"), "asked")


@query()
def nearest_segment(t: Tables) -> DataFrame:
    """Distance of each pose to its smoothed path, and the nearest point of that path."""
    near = trajectory.nearest_smoothed(t.poses, "vec_id", 2.0, 5.0)
    return near.select("vec_id", "nearest", r6(F.col("deviation"), "deviation"))


# --- statistics and metrics -----------------------------------------------------------------------


@query("WITH f AS (SELECT label, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.99), 6) AS q99, count(v) AS n FROM f GROUP BY label, dim")
def stats_action(t: Tables) -> DataFrame:
    s = stats.column_statistics(t.embeddings, "embedding", ["label"])
    return s.select("label", "dim", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max", "q01", "q99")], "n")


@query("WITH q AS (SELECT l_returnflag AS k, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(2 * (l_extendedprice - lo) / greatest(hi - lo, 1e-6) - 1, 6) AS v FROM lineitem JOIN q ON l_returnflag = k")
def normalize(t: Tables) -> DataFrame:
    q = t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    v = G.normalise(F.col("l_extendedprice"), F.col("q")[0], F.col("q")[1])
    return t.lineitem.join(q, "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", r6(v, "v"))


_RESULTS = "r AS (SELECT o_orderkey, o_orderpriority AS scene, o_orderstatus = 'F' AS failed, CASE WHEN o_custkey % 50 <> 0 OR o_orderpriority <> '1-URGENT' THEN o_totalprice END AS metric, o_totalprice / 2 AS other FROM orders)"


@query(f"WITH {_RESULTS} SELECT scene, CAST(GROUPING(scene) AS INTEGER) AS overall, count(*) AS n, count(*) FILTER (failed) AS failed, round(CASE WHEN count(metric) FILTER (NOT failed) = count(*) FILTER (NOT failed) AND count(*) FILTER (NOT failed) > 0 THEN avg(metric) FILTER (NOT failed) END, 4) AS metric, round(CASE WHEN count(*) FILTER (NOT failed) > 0 THEN avg(other) FILTER (NOT failed) END, 4) AS other FROM r GROUP BY GROUPING SETS ((), (scene))")
def metric_summary(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderpriority").alias("scene"), (F.col("o_orderstatus") == "F").alias("fail"), F.when((F.col("o_custkey") % 50 != 0) | (F.col("o_orderpriority") != "1-URGENT"), F.col("o_totalprice")).alias("metric"), (F.col("o_totalprice") / 2).alias("other"))
    s = stats.metric_summary(o, ["metric", "other"], F.col("fail"), "scene")
    return s.select("scene", "overall", "n", "failed", F.round("metric", 4).alias("metric"), F.round("other", 4).alias("other"))


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'unknown') AS kind, count(*) AS n FROM orders GROUP BY 1")
def breakdown(t: Tables) -> DataFrame:
    k = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("unknown"))
    return t.orders.groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(avg(coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, 0)), 4) AS m FROM orders GROUP BY 1")
def failures_as_zero(t: Tables) -> DataFrame:
    m = F.coalesce(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")), F.lit(0.0))
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg(m), 4).alias("m"))


@query(f"WITH {FRAMES}, e AS (SELECT a.event_type, CAST(b.frame - a.frame AS INTEGER) AS h, a.value - b.value AS d FROM frames a JOIN frames b ON a.episode = b.episode AND b.frame BETWEEN a.frame + 1 AND a.frame + 4) SELECT event_type, h, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, count(*) AS n FROM e GROUP BY event_type, h")
def horizon_metrics(t: Tables) -> DataFrame:
    w = Window.partitionBy("episode").orderBy("frame")
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lead("value", h).over(w).alias("actual")) for h in range(1, 5)])
    pairs = t.frames.withColumn("s", steps).select("event_type", F.col("value").alias("predicted"), F.explode("s").alias("s")).select("event_type", "predicted", "s.*").where("actual IS NOT NULL")
    return stats.horizon_errors(pairs, ["event_type"]).select("event_type", "h", r6(F.col("mae"), "mae"), r6(F.col("rmse"), "rmse"), "n")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def distribution(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_returnflag").agg(*stats.distribution("l_quantity"))
    return d.select("l_returnflag", *[r6(F.col(c), c) for c in ("mean", "p50", "p90")], "n")


@query("WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_discount) AS m FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))) SELECT round(avg(m), 6) AS macro_mean, count(*) AS n FROM g WHERE l_linestatus IS NULL")
def macro_mean(t: Tables) -> DataFrame:
    g = t.lineitem.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")]], "l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("m"))
    return g.where("l_linestatus IS NULL").agg(r6(F.avg("m"), "macro_mean"), F.count("*").alias("n"))


@query("WITH g AS (SELECT l_returnflag AS k, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY 1) SELECT 'eval/' || k || '/quantity' AS path, round(q, 6) AS value FROM g UNION ALL SELECT 'eval/' || k || '/tax', round(t, 6) FROM g")
def flatten_metrics(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return stats.flattened(g, ["l_returnflag"], ["quantity", "tax"], "eval")


@query("SELECT user_id, count(DISTINCT event_type) AS types, min_by(event_id, {'value': value, 'id': event_id}) FILTER (value IS NOT NULL) AS lowest, max_by(event_id, {'value': value, 'id': -event_id}) FILTER (value IS NOT NULL) AS highest, bool_or(value > 95) AS any_high, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY user_id")
def episode_aggregates(t: Tables) -> DataFrame:
    """Kinds, extremes and errors of each user's events; of equal values the first event_id is the lowest and the highest."""
    known = F.col("value").isNotNull() & F.col("event_id").isNotNull()
    lowest = F.min_by("event_id", F.when(known, F.struct("value", "event_id"))).alias("lowest")
    highest = F.max_by("event_id", F.when(known, F.struct("value", -F.col("event_id")))).alias("highest")
    error = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("types"), lowest, highest, F.bool_or(F.col("value") > 95).alias("any_high"), r6(F.avg(error), "error_rate"))


@query("SELECT count(*) AS frames, count(DISTINCT user_id) AS episodes, count(*) FILTER (value > 50) AS high, round(sum(value), 2) AS total FROM events")
def inventory(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("frames"), F.countDistinct("user_id").alias("episodes"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'de' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def reject_report(t: Tables) -> DataFrame:
    return quality.filter_report(t.documents, [("short", F.col("n_chars") < 200), ("language", F.col("lang") == "de")])


@query()
def ndtw(t: Tables) -> DataFrame:
    p = t.poses.select("episode", F.col("frame").alias("step"), "x", "y", "z")
    both = p.withColumn("kind", F.lit("predicted")).unionByName(p.where("step % 2 = 0").withColumn("kind", F.lit("reference")))
    return stats.ndtw(both, "episode", 3.0).select("episode", r6(F.col("dtw"), "dtw"), r6(F.col("ndtw"), "ndtw"))


# --- sampling -------------------------------------------------------------------------------------

_RANK = "sha256('{0}:' || {1})"


@query("WITH z AS (SELECT lang, count(*) AS size, count(*) OVER () AS strata, sum(count(*)) OVER () AS total FROM documents GROUP BY lang), q AS (SELECT *, (60 - strata) * size / total AS e FROM z), f AS (SELECT *, least(size - 1, floor(e)) AS own FROM q), g AS (SELECT *, 60 - strata - sum(own) OVER () AS missing FROM f), s AS (SELECT lang, missing, row_number() OVER (ORDER BY i, e - floor(e) DESC, sha256('s1:' || lang)) AS place FROM g, range(1, 61) r(i) WHERE i <= size - 1 - own), x AS (SELECT lang, count(*) AS more FROM s WHERE place <= missing GROUP BY lang), k AS (SELECT g.lang, 1 + own + coalesce(more, 0) AS quota FROM g LEFT JOIN x ON x.lang = g.lang), o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, o.lang FROM o JOIN k ON o.lang = k.lang WHERE n <= quota")
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 60, "s1")


@query("SELECT DISTINCT p_partkey, CAST(CASE WHEN k = 1 THEN 0 ELSE round_even(i * (p_size - 1) / greatest(k - 1, 1)::DOUBLE, 0) END AS BIGINT) AS position FROM (SELECT p_partkey, p_size, least(p_size, 6) AS k FROM part), range(0, 6) r(i) WHERE i < k")
def even_positions(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("bigint")
    return t.part.select("p_partkey", F.explode(sampling.even_positions(n, F.least(n, F.lit(6).cast("bigint")))).alias("position"))


@query(f"WITH {FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM frames), a AS (SELECT *, (frame = 0 OR frame = floor((n - 1) / 2.0) OR frame = n - 1) AS anchor FROM c) SELECT episode, frame FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY anchor DESC, sha256('s2:' || episode || ':' || frame), frame) AS r FROM a) WHERE r <= 7")
def anchored_sample(t: Tables) -> DataFrame:
    return sampling.anchored_sample(t.frames.select("episode", "frame"), "episode", "frame", 7, "s2")


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), e AS (SELECT user_id, i AS round, CAST(CASE WHEN least(n, 4) = 1 THEN 0 ELSE round_even(i * (n - 1) / greatest(least(n, 4) - 1, 1)::DOUBLE, 0) END AS BIGINT) AS position FROM c, range(0, 4) r(i) WHERE i < least(n, 4)), a AS (SELECT c.user_id, i AS position FROM c, range(0, (SELECT max(n) FROM c)) r(i) WHERE i < n EXCEPT SELECT user_id, position FROM e), m AS (SELECT user_id, round, position FROM e UNION ALL SELECT user_id, 3 + row_number() OVER (PARTITION BY user_id ORDER BY position), position FROM a) SELECT user_id, position FROM m ORDER BY round, user_id, position LIMIT 400")
def target_frames(t: Tables) -> DataFrame:
    return sampling.target_frames(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n", 400)


@query("SELECT doc_id, CAST((('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT) % 16 AS BIGINT) AS bucket, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents")
def hash_bucket(t: Tables) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", H.hash_bucket(k, 16).alias("bucket"), H.hash_uniform(k).alias("u"))


@query("SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS part FROM customer")
def partition_contiguous(t: Tables) -> DataFrame:
    return sampling.contiguous_parts(t.customer.select("c_custkey"), ["c_custkey"], 7)


@query("SELECT doc_id, CAST(floor(n_chars / 500.0) AS BIGINT) AS bucket, CAST(floor((row_number() OVER (PARTITION BY floor(n_chars / 500.0) ORDER BY sha256('s3:' || doc_id), doc_id) - 1) / 8.0) AS BIGINT) AS batch FROM documents")
def length_buckets(t: Tables) -> DataFrame:
    return sampling.length_buckets(t.documents.select("doc_id", "n_chars"), "n_chars", 500, 8, "s3", "doc_id").select("doc_id", "bucket", "batch")


@query()
def lpt_balance(t: Tables) -> DataFrame:
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return sampling.balanced_ranks(c, "c_nationkey", "n", 4)


@query()
def exact_group_split(t: Tables) -> DataFrame:
    """Nations of half the suppliers, or of the most below half: many groups of nearly one size can't all be halved."""
    c = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    chosen = sampling.exact_group_split(c, "s_nationkey", "n", t.supplier.count() // 2, "s4", nearest=True)
    return c.where(F.col("s_nationkey").isin(chosen))


@query("WITH r AS (SELECT o_orderkey, o_orderstatus = 'O' AS s, row_number() OVER (PARTITION BY o_orderstatus = 'O' ORDER BY sha256('s5:' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderkey, s AS success FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN r <= 25 THEN 0 ELSE 1 END, r, s DESC) AS k FROM r) WHERE k <= 50")
def balanced_outcomes(t: Tables) -> DataFrame:
    return sampling.balanced_outcomes(t.orders.select("o_orderkey", (F.col("o_orderstatus") == "O").alias("success")), F.col("success"), "o_orderkey", 50, "s5")


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('s6:' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM customer WHERE c_nationkey NOT IN (1, 2)) SELECT c_custkey, CAST(CASE (r - 1) % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END AS INTEGER) AS stride FROM c WHERE r <= CAST(floor(n * 0.5) AS BIGINT)")
def lightweight_subset(t: Tables) -> DataFrame:
    return sampling.lightweight_subset(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", [1, 2], "c_custkey", 0.5, [2, 3, 5], "s6").select("c_custkey", "stride")


# --- sets -----------------------------------------------------------------------------------------


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedupe_first(t: Tables) -> DataFrame:
    return sets.first_of_each(t.documents.select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("WITH u AS (SELECT doc_id, quality AS v, 0 AS p FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, quality + 10, 1 FROM labels UNION ALL SELECT doc_id, -1, 2 FROM documents) SELECT doc_id, CAST(arg_min(v, p) AS INTEGER) AS v, CAST(min(p) AS INTEGER) AS priority FROM u GROUP BY doc_id")
def priority_union(t: Tables) -> DataFrame:
    a = t.labels.where("toxic = 1").select("doc_id", F.col("quality").alias("v"))
    b = t.labels.select("doc_id", (F.col("quality") + 10).alias("v"))
    c = t.documents.select("doc_id", F.lit(-1).alias("v"))
    return sets.priority_union([a, b, c], ["doc_id"], ["v"])


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right")
def set_equality(t: Tables) -> DataFrame:
    return sets.set_difference_counts(t.documents.select("doc_id"), t.labels.select("doc_id"))


@query("SELECT 'customer' AS dataset, c_custkey AS k, c_custkey AS global_index FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_suppkey + (SELECT count(*) FROM customer) FROM supplier")
def union_offsets(t: Tables) -> DataFrame:
    return sets.union_with_offsets({"customer": t.customer.select(F.col("c_custkey").alias("k")), "supplier": t.supplier.select(F.col("s_suppkey").alias("k"))}, "k").select("dataset", "k", "global_index")


# --- strings --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey || '/' || format('{:06d}', o_orderkey) || '/front' AS ref, CAST(o_custkey AS VARCHAR) AS episode, o_orderkey AS frame, 'front' AS camera FROM orders")
def ref_build_parse(t: Tables) -> DataFrame:
    r = t.orders.select("o_orderkey", S.frame_ref(F.col("o_custkey"), F.col("o_orderkey"), F.lit("front")).alias("ref"))
    return r.withColumn("p", S.parse_ref(F.col("ref"))).select("o_orderkey", "ref", "p.*")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(replace(html, chr(65533), ''), '\\+', '/', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages")
def normalize_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.normalise_text(F.col("html")).alias("text"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, NULLIF(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), '') AS safe FROM pages")
def extract_sanitize(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, r"/([a-z]{2})/", 1).alias("lang"), S.sanitise(u).alias("safe"))


@query("SELECT o_orderkey, format('move {:.3f} for {}', o_totalprice, lower(o_orderpriority)) AS text FROM orders")
def instruction_template(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.format_string("move %.3f for %s", "o_totalprice", F.lower("o_orderpriority")).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, sha256(props) AS digest FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.sha2("props", 256).alias("digest"))


# --- SQL job queue --------------------------------------------------------------------------------

_JOBS = "SELECT o_orderkey AS job_id, o_custkey % 20 AS scene_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'complete' ELSE 'running' END AS status, o_custkey % 4 AS worker_id, o_orderkey AS position FROM orders"


@query(f"WITH jobs AS ({_JOBS}) SELECT status, count(*) AS n FROM jobs GROUP BY status")
def job_status(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT status, count(*) AS n FROM (" + _JOBS.replace("FROM orders", "FROM {orders}") + ") GROUP BY status", orders=t.orders)


_CLAIM = "SELECT job_id, scene_id FROM (SELECT *, CASE WHEN scene_id = 3 THEN 0 WHEN scene_id IN (SELECT DISTINCT scene_id FROM jobs WHERE status = 'running' AND worker_id <> 1) THEN 2 ELSE 1 END AS priority FROM jobs WHERE status = 'pending' AND scene_id NOT IN (7, 8)) ORDER BY priority, scene_id, position LIMIT 1"


@query(f"WITH jobs AS ({_JOBS}) {_CLAIM}")
def job_claim(t: Tables) -> DataFrame:
    jobs = t.spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return t.spark.sql(_CLAIM.replace("FROM jobs", "FROM {jobs}"), jobs=jobs)


@query(f"WITH jobs AS ({_JOBS}) SELECT job_id, CASE WHEN status = 'running' AND worker_id = 1 THEN 'pending' WHEN status = 'pending' AND scene_id = 3 THEN 'skipped' ELSE status END AS status FROM jobs WHERE NOT starts_with(CAST(job_id AS VARCHAR), '99')")
def job_transitions(t: Tables) -> DataFrame:
    jobs = t.spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    new = F.when((F.col("status") == "running") & (F.col("worker_id") == 1), "pending").when((F.col("status") == "pending") & (F.col("scene_id") == 3), "skipped").otherwise(F.col("status"))
    return jobs.where(~F.col("job_id").cast("string").like("99%")).select("job_id", new.alias("status"))


# --- quality --------------------------------------------------------------------------------------


@query("SELECT 'order_without_lines' AS rule, count(*) AS violations FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'line_without_part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'vector_size', count(*) FROM embeddings WHERE NOT (len(embedding) = 64) UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.09) UNION ALL SELECT 'length_mismatch', count(*) FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) WHERE n <> 4 UNION ALL SELECT 'name_collision', count(*) FROM (SELECT lower(substr(url, 1, 14)) AS k FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1)")
def quality_report(t: Tables) -> DataFrame:
    return quality.report(
        [
            quality.missing_reference("order_without_lines", t.orders, t.lineitem, "o_orderkey", "l_orderkey"),
            quality.missing_reference("line_without_part", t.lineitem, t.part, "l_partkey", "p_partkey"),
            quality.repeated("repeated_line", t.lineitem, ["l_orderkey", "l_linenumber"]),
            quality.broken("vector_size", t.embeddings, F.size("embedding") == 64),
            quality.broken("discount_range", t.lineitem, F.col("l_discount").between(0, 0.09)),
            quality.count_mismatch("length_mismatch", t.orders.select(F.col("o_orderkey").alias("k"), F.lit(4).alias("n")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k", "n"),
            quality.collisions("name_collision", t.pages, "url", F.lower(F.substring("url", 1, 14))),
        ]
    )


# --- trajectories ---------------------------------------------------------------------------------


@query()
def pchip_densify(t: Tables) -> DataFrame:
    d = trajectory.densify(t.poses, 0.1, 0.2)
    return d.select("episode", "step", *[r6(F.col(c), c) for c in ("x", "y", "z", "yaw")])


@query()
def smooth_retime(t: Tables) -> DataFrame:
    d = retiming.smooth_and_retime(t.poses, "embeddings")
    return d.select("episode", "step", *[r6(F.col(c), c) for c in ("x", "y", "z", "yaw", "turn", "deviation")], "reason")


@query()
def pack_shards(t: Tables) -> DataFrame:
    items = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "o_orderkey").agg(F.count("*").alias("n"))
    return trajectory.pack_shards(items, "o_orderpriority", "o_orderkey", "n", 100)


# --- chains, tangents and whole-episode rejection -----------------------------------------------------


@query(f"WITH {FRAMES} SELECT event_id, first_value(event_id) OVER (PARTITION BY episode ORDER BY frame) AS head, frame AS position FROM frames")
def linked_order(t: Tables) -> DataFrame:
    linked = t.frames.withColumn("next_id", F.lead("event_id").over(Window.partitionBy("episode").orderBy("frame")))
    return chains.linked_order(linked, "event_id", "next_id").withColumnRenamed("token", "event_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS number FROM orders WHERE o_orderstatus = 'F'")
def subset_renumber(t: Tables) -> DataFrame:
    kept = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return chains.dense_numbers(kept, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query(f"WITH {POSES}, s AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM poses WINDOW w AS (PARTITION BY episode ORDER BY frame)), a AS (SELECT *, CASE WHEN sqrt(dx*dx+dy*dy) > 0.2 THEN atan2(dy, dx) END AS t FROM s), f AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS filled, first_value(t) OVER (PARTITION BY episode ORDER BY frame) AS head, max(t) OVER (PARTITION BY episode) AS most FROM a) SELECT vec_id, round(coalesce(filled, 0.5), 6) AS tangent, CASE WHEN most IS NULL THEN 'start_yaw' WHEN head IS NULL THEN 'leading_start_yaw' ELSE 'none' END AS yaw_fallback FROM f")
def tangent_yaw(t: Tables) -> DataFrame:
    made = windows.tangent_yaw(t.poses.drop("yaw"), F.lit(0.5), 0.2)
    return made.select("vec_id", r6(F.col("yaw"), "tangent"), "yaw_fallback")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_retailprice < 920 THEN 'unusable' END AS reason FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON l_partkey = p_partkey), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, reason) AS n FROM r WHERE reason IS NOT NULL) SELECT o.l_orderkey, CAST(k.l_linenumber AS BIGINT) AS failed_at, k.reason AS failure FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN k ON k.l_orderkey = o.l_orderkey AND k.n = 1")
def episode_rejects(t: Tables) -> DataFrame:
    images = t.part.where("p_size <> 7").select("p_partkey", "p_retailprice")
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey").join(images, F.col("l_partkey") == F.col("p_partkey"), "left")
    return quality.first_failure(rows, "l_orderkey", "l_linenumber", [("missing", F.col("p_partkey").isNull()), ("unusable", F.col("p_retailprice") < 920)])


# --- event time -----------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    return streams.tumbling(t.events, "1 hour", "1 hour", "event_type").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_windows(t: Tables) -> DataFrame:
    return streams.sessions(t.events, "2 hours", "1 hour", "user_id").withColumn("total", F.round("total", 4))
