"""Queries of running episodes and of merged action errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators import errors
from trajecta.plans.registry import FRAMES, Tables, query, r6, wrap_sql
from trajecta.streaming import episodes


def loop_steps(t: Tables) -> DataFrame:
    """Events as steps of the episodes of their users; values make positions, event types the flags."""
    v = F.col("value")
    return t.frames.select("episode", F.col("frame").alias("step"), F.col("ts").cast("timestamp").alias("ts"), v.alias("x"), (v % 7).alias("y"), (v % 3).alias("z"), F.lit(20.0).alias("goal_x"), F.lit(4.0).alias("goal_y"), F.lit(1.0).alias("goal_z"), ((F.col("event_type") == "purchase") & (v > 30)).alias("stop"), (v > 150).alias("collided"))


_STEPS = "s AS (SELECT episode, frame, ts, value AS x, value % 7 AS y, value % 3 AS z, event_type = 'purchase' AND value > 30 AS stop, value > 150 AS collided FROM frames)"


@query(f"WITH {FRAMES}, {_STEPS}, d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS moved, sqrt((x - 20) ** 2 + (y - 4) ** 2 + (z - 1) ** 2) <= 5 AS near, CASE WHEN stop THEN 'stop' WHEN collided THEN 'collision' WHEN frame >= 39 THEN 'max_steps' END AS reason FROM s WINDOW w AS (PARTITION BY episode ORDER BY frame)), e AS (SELECT episode, min(frame) FILTER (reason IS NOT NULL) AS last FROM d GROUP BY 1), k AS (SELECT d.* FROM d JOIN e USING (episode) WHERE last IS NULL OR frame <= last) SELECT episode, coalesce(max(reason), 'timeout') AS reason, count(*) AS steps, round(sum(moved), 6) AS path_length, bool_or(near) AS oracle, coalesce(max(reason), '') = 'stop' AND arg_max(near, frame) AS success FROM k GROUP BY episode")
def episode_loop(t: Tables) -> DataFrame:
    return episodes.finished_episodes(loop_steps(t), 40, 5.0).drop("ended").withColumn("path_length", F.round("path_length", 6))


def _chunks(t: Tables) -> DataFrame:
    """Embeddings as chunks of eight predicted and eight true actions; raw values scale with the dimension."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    part = lambda first: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: v[first + h * 4 + d]))
    raw = lambda c: F.transform(c, lambda s: F.transform(s, lambda x, d: x * (d + 1) * 4))
    pad = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: (F.col("vec_id") % 5 == 0) & (h >= F.col("vec_id") % 9))
    d = t.embeddings.select(F.col("label").cast("bigint").alias("dataset"), (F.col("vec_id") % 3).alias("rank"), part(0).alias("predicted"), part(32).alias("target"), pad.alias("padding"))
    return d.withColumns({"raw_predicted": raw(F.col("predicted")), "raw_target": raw(F.col("target"))})


_NAMES = errors.dimension_names(4)
_STEPPED = f"e AS (SELECT label::BIGINT AS dataset, vec_id, h, d, embedding[h * 4 + d + 1]::DOUBLE AS p, embedding[32 + h * 4 + d + 1]::DOUBLE AS t FROM embeddings, range(8) a(h), range(4) b(d) WHERE NOT (vec_id % 5 = 0 AND h >= vec_id % 9)), f AS (SELECT *, p - t AS n, CASE WHEN d = 3 THEN {wrap_sql('(p - t) * 16')} ELSE (p - t) * (d + 1) * 4 END AS raw FROM e), g AS (SELECT dataset, vec_id, h, max(h) OVER (PARTITION BY vec_id) = h AS last, sum(n * n) AS squared, sqrt(sum(raw * raw) FILTER (d < 3)) AS l2, {', '.join(f'sum(raw) FILTER (d = {d}) AS r{d}' for d in range(4))} FROM f GROUP BY dataset, vec_id, h)"
_FINISHED = f"round(sum(squared) / (4 * count(*)), 6) AS mse, {', '.join(f'round(avg(abs(r{d})), 6) AS mae_{n}, round(sqrt(avg(r{d} * r{d})), 6) AS rmse_{n}' for d, n in enumerate(_NAMES))}, round(avg(l2), 6) AS translation_l2, round(avg(abs(r3)), 6) AS yaw_abs, round(avg(l2) FILTER (last), 6) AS endpoint, count(*) AS waypoints, count(*) FILTER (last) AS frames"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_STEPPED} SELECT dataset, CAST(h + 1 AS INTEGER) AS h, {_FINISHED} FROM g GROUP BY dataset, h")
def action_errors_by_horizon(t: Tables) -> DataFrame:
    """Errors of each horizon, merged from what three ranks have summed on their own."""
    parts = errors.error_sums(errors.action_steps(_chunks(t), ["dataset", "rank"]), ["dataset", "rank", "h"])
    return _rounded(errors.finished(errors.merged_sums(parts.drop("rank"), ["dataset", "h"]), ["dataset", "h"]))


@query(f"WITH {_STEPPED} SELECT dataset, {_FINISHED} FROM g GROUP BY dataset")
def action_errors(t: Tables) -> DataFrame:
    """Errors over all horizons, merged from the sums by horizon and rank."""
    parts = errors.error_sums(errors.action_steps(_chunks(t), ["dataset", "rank"]), ["dataset", "rank", "h"])
    return _rounded(errors.finished(errors.merged_sums(parts.drop("rank", "h"), ["dataset"]), ["dataset"]))
