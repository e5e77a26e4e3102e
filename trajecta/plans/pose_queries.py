"""Queries of pose, camera and picture geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.operators import waypoints, windows
from trajecta.plans.registry import POSES, Tables, query, r6, wrap_sql

def _by():
    return Window.partitionBy("episode").orderBy("frame")


def _pose() -> Column:
    return G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))


@query(f"WITH {POSES}, s AS (SELECT p.*, f.x AS fx, f.y AS fy, f.z AS fz, f.yaw AS fw FROM poses p JOIN poses f ON f.episode = p.episode AND f.frame = 0) SELECT vec_id, round(cos(fw)*(x-fx)+sin(fw)*(y-fy), 6) AS lx, round(cos(fw)*(y-fy)-sin(fw)*(x-fx), 6) AS ly, round(fz-z, 6) AS lz, round({wrap_sql('yaw-fw')}, 6) AS lyaw FROM s")
def local_poses(t: Tables) -> DataFrame:
    d = windows.local_poses(t.poses, z_sign=-1)
    return d.select("vec_id", r6(F.col("local.dx"), "lx"), r6(F.col("local.dy"), "ly"), r6(F.col("local.dz"), "lz"), r6(F.col("local.dyaw"), "lyaw"))


@query(f"WITH {POSES} SELECT p.vec_id, round(p.x - f.x, 5) AS ex, round(p.y - f.y, 5) AS ey, round(p.z - f.z, 5) AS ez FROM poses p JOIN poses f ON f.episode = p.episode AND f.frame = 0")
def integrated_actions(t: Tables) -> DataFrame:
    p = t.poses
    step = p.withColumn("p", _pose()).withColumn("b", F.lag("p").over(_by())).withColumn("d", G.body_delta(F.col("b"), F.col("p")))
    first = F.first(F.col("yaw")).over(_by())
    d = step.select("episode", "frame", "vec_id", first.alias("start"), *[F.coalesce(F.col("d")[k], F.lit(0.0)).alias(k) for k in ("dx", "dy", "dz", "dyaw")])
    return windows.integrate(d, F.col("start")).select("vec_id", *[F.round(c, 5).alias(f"e{c}") for c in "xyz"])


@query(f"WITH {POSES}, s AS (SELECT *, lead(yaw) OVER (PARTITION BY episode ORDER BY frame) AS nyaw FROM poses) SELECT vec_id, round(degrees(2 * acos(least(1.0, abs(cos(yaw/2)*cos(nyaw/2)+sin(yaw/2)*sin(nyaw/2))))), 3) AS err FROM s WHERE nyaw IS NOT NULL")
def quaternion_error(t: Tables) -> DataFrame:
    p = t.poses.withColumn("q", G.yaw_quaternion(F.col("yaw"))).withColumn("n", F.lead("q").over(_by())).where("n IS NOT NULL")
    return p.select("vec_id", F.round(G.quaternion_error(F.col("q"), F.col("n")), 3).alias("err"))


@query("WITH b AS (SELECT p_partkey, p_size * 40 AS w, 100 + p_size % 7 * 90 AS h FROM part), s AS (SELECT *, least(224.0::DOUBLE / w, 224.0::DOUBLE / h) AS scale FROM b), z AS (SELECT *, round_even(w * scale, 0) AS nw, round_even(h * scale, 0) AS nh FROM s) SELECT p_partkey, round(scale, 6) AS scale, CAST(nw AS BIGINT) AS width, CAST(nh AS BIGINT) AS height, CAST(floor((224 - nw) / 2) AS BIGINT) AS left_margin, CAST(floor((224 - nh) / 2) AS BIGINT) AS top_margin FROM z")
def letterbox(t: Tables) -> DataFrame:
    b = t.part.select("p_partkey", G.letterbox(F.col("p_size") * 40, 100 + F.col("p_size") % 7 * 90, 224).alias("b"))
    return b.select("p_partkey", r6(F.col("b.scale"), "scale"), "b.width", "b.height", F.col("b.left").alias("left_margin"), F.col("b.top").alias("top_margin"))


@query(f"WITH {POSES}, s AS (SELECT *, lead(x, 3) OVER w - x AS gx, lead(y, 3) OVER w - y AS gy, lead(z, 3) OVER w - z AS gz FROM poses WINDOW w AS (PARTITION BY episode ORDER BY frame)) SELECT vec_id, sqrt(gx*gx+gy*gy+gz*gz) <= 0.3 AND abs(atan2(cos(yaw)*gy-sin(yaw)*gx, cos(yaw)*gx+sin(yaw)*gy)) <= 1.0 AS seen FROM s WHERE gx IS NOT NULL")
def target_visible(t: Tables) -> DataFrame:
    p = t.poses.withColumn("p", _pose()).withColumn("g", F.lead("p", 3).over(_by())).where("g IS NOT NULL")
    return p.select("vec_id", G.visible(F.col("p"), F.col("g"), 0.3, 1.0).alias("seen"))


@query(f"WITH {POSES}, n AS (SELECT episode, max(frame) AS m FROM poses GROUP BY episode), s AS (SELECT p.vec_id, cos(p.yaw)*(q.y-p.y)-sin(p.yaw)*(q.x-p.x) AS dy, q.z-p.z AS dz, {wrap_sql('q.yaw-p.yaw')} AS dyaw FROM poses p JOIN n ON n.episode = p.episode JOIN poses q ON q.episode = p.episode AND q.frame = least(p.frame + 4, n.m)) SELECT vec_id, CASE WHEN dy > 0.05 THEN 'left' WHEN dy < -0.05 THEN 'right' ELSE 'forward' END AS command, CASE WHEN dz > 0.1 THEN 'take off' WHEN dz < -0.1 THEN 'landing' WHEN dyaw > 0.1 THEN 'left' WHEN dyaw < -0.1 THEN 'right' ELSE 'cruise' END AS stage FROM s")
def lateral_command(t: Tables) -> DataFrame:
    ahead = Window.partitionBy("episode").orderBy("frame").rowsBetween(0, 4)
    d = t.poses.withColumn("p", _pose()).withColumn("d", G.body_delta(F.col("p"), F.last("p").over(ahead)))
    return d.select("vec_id", G.command(F.col("d"), 0.05).alias("command"), G.stage(F.col("d"), 0.1, 0.1).alias("stage"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(greatest(CAST(round_even(l_extendedprice / 1000 * 24, 0) AS BIGINT), 0), 999) AS BIGINT) AS number FROM lineitem")
def frame_number(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", G.frame_number(F.col("l_extendedprice") / 1000, 24, 1000).alias("number"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount * 100 AS d FROM lineitem), w AS (SELECT *, greatest(0, least(q, 25) - greatest(0, d)) * greatest(0, least(q, 25) - greatest(0, 5)) AS i, greatest(0, 25-d)*20 AS b2, greatest(q, 25) * greatest(q, 25) AS hull FROM b) SELECT l_orderkey, l_linenumber, l_partkey, round(i / (q*q + b2 - i) - (hull - (q*q + b2 - i)) / hull, 6) AS giou FROM w")
def box_giou(t: Tables) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    zero, side = F.lit(0.0), F.lit(25.0)
    a = F.struct(zero.alias("x1"), zero.alias("y1"), q.alias("x2"), q.alias("y2"))
    b = F.struct(d.alias("x1"), F.lit(5.0).alias("y1"), side.alias("x2"), side.alias("y2"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(G.box_giou(a, b), "giou"))


@query(f"WITH {POSES} SELECT vec_id, round(x + cos(yaw)*0.5 - sin(yaw)*0.2, 6) AS cx, round(y + sin(yaw)*0.5 + cos(yaw)*0.2, 6) AS cy, round(z + 0.1, 6) AS cz, round({wrap_sql('yaw + 1.5')}, 6) AS cyaw, round(-y, 6) AS ry, round({wrap_sql('-yaw')}, 6) AS ryaw, round(1 - 2*sin(yaw/2)*sin(yaw/2), 6) AS m00, round(-2*cos(yaw/2)*sin(yaw/2), 6) AS m01 FROM poses")
def camera_pose(t: Tables) -> DataFrame:
    q = G.yaw_quaternion(F.col("yaw"))
    p = t.poses.select("vec_id", G.mounted(_pose(), F.lit(0.5), F.lit(0.2), F.lit(0.1), F.lit(1.5)).alias("c"), G.reflected(_pose(), "reflect_y_yaw").alias("r"), G.rotation_matrix(q["w"], q["x"], q["y"], q["z"]).alias("m"))
    m = F.col("m")
    return p.select("vec_id", r6(F.col("c.x"), "cx"), r6(F.col("c.y"), "cy"), r6(F.col("c.z"), "cz"), r6(F.col("c.yaw"), "cyaw"), r6(F.col("r.y"), "ry"), r6(F.col("r.yaw"), "ryaw"), r6(m[0][0], "m00"), r6(m[0][1], "m01"))


@query()
def waypoint_updates(t: Tables) -> DataFrame:
    """Each frame's new time and actions over even waypoints a tenth apart."""
    u = waypoints.frame_updates(waypoints.even_waypoints(t.poses, 0.1, 0.2))
    return u.select("episode", "frame", "timestamp", "h", *[r6(F.col(c), c) for c in ("dx", "dy", "dz", "dyaw")], "padded")


@query()
def waypoint_summary(t: Tables) -> DataFrame:
    s = waypoints.path_summary(waypoints.even_waypoints(t.poses, 0.1, 0.2))
    return s.select("episode", "frames", "dense_waypoints", r6(F.col("max_position_step"), "max_position_step"), r6(F.col("max_yaw_step"), "max_yaw_step"))


@query()
def waypoint_action_statistics(t: Tables) -> DataFrame:
    s = waypoints.action_statistics(waypoints.frame_updates(waypoints.even_waypoints(t.poses, 0.1, 0.2)))
    return s.select("dim", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max")], "n")
