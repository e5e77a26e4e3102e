"""Checks and rewrites of whole dataset packages: traces, streams that must agree, requests, indexes, subsets.

A check returns its faults, one row for each with the place and a ``reason``; no rows mean a sound package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.operators.chains import dense_numbers
from trajecta.operators.stats import mean_if_complete


def _faults(df: DataFrame, place: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row for each rule that a row breaks, null counting as kept."""
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]), lambda r: r.isNotNull())
    return df.select(*place, F.explode(broken).alias("reason"))


def trace_faults(frames: DataFrame, key: str, index: str, seconds: str, here: list[str], declared: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Indexes must count from 0, time must grow, and each frame's declared next place must be the next frame's."""
    by = Window.partitionBy(key).orderBy(index, seconds)
    d = frames.withColumn("_at", F.row_number().over(by) - 1).withColumn("_before", F.lag(seconds).over(by))
    off = reduce(lambda a, b: a | b, [F.abs(F.lead(h).over(by) - F.col(n)) > tolerance for h, n in zip(here, declared, strict=True)])
    d = d.withColumn("_off", off)
    return _faults(d, [key, index], [("index", F.col(index) != F.col("_at")), ("time", F.col(seconds) <= F.col("_before")), ("next_place", F.col("_off"))])


def presence_faults(present: DataFrame, declared: DataFrame, key: str, index: str, size: str) -> DataFrame:
    """Which of an episode's declared places 0 to size - 1 are there: places beyond them and gaps before the last are faults, a missing tail isn't."""
    by = Window.partitionBy(key).orderBy(index)
    d = present.select(key, index).distinct().join(declared.select(key, F.col(size).alias("_n")), key, "left").withColumn("_at", F.row_number().over(by) - 1)
    return _faults(d, [key, index], [("undeclared_episode", F.col("_n").isNull()), ("beyond_end", F.col(index) >= F.col("_n")), ("gap_before", F.col(index) != F.col("_at"))])


def stream_faults(episodes: DataFrame, images: DataFrame, requests: DataFrame, gaps: list[int]) -> DataFrame:
    """Three streams of a package must agree.

    ``episodes`` (episode, terminal, schedule): the schedule starts at 0, grows by one of ``gaps`` (the
    last step may be shorter) and ends at the terminal place. ``images`` (episode, image, waypoint)
    hold the schedule's places in order; ``requests`` have the same columns, once each.
    """
    s = F.col("schedule")
    steps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: b - a)
    allowed = F.array(*[F.lit(g).cast("long") for g in gaps])
    inner = F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))
    none = F.lit(None).cast("long").alias("image")
    shape = _faults(
        episodes.select("*", none),
        ["episode", "image"],
        [
            ("start", F.coalesce(F.get(s, F.lit(0)) != 0, F.lit(True))),
            ("end", F.get(s, F.size(s) - 1) != F.col("terminal")),
            ("growth", F.exists(steps, lambda g: g <= 0)),
            ("gap", F.exists(inner, lambda g: ~F.array_contains(allowed, g)) | (F.get(steps, F.size(steps) - 1) > max(gaps))),
        ],
    )
    planned = episodes.select("episode", F.posexplode("schedule").alias("image", "_planned")).withColumn("image", F.col("image").cast("long"))
    counted = lambda df, name: df.groupBy("episode", "image").agg(F.count("*").alias(f"_n_{name}"), F.min("waypoint").alias(f"_{name}"))
    joined = planned.join(counted(images, "images"), ["episode", "image"], "full").join(counted(requests, "requests"), ["episode", "image"], "full")
    rules = [("unplanned", F.col("_planned").isNull())]
    for name in ("images", "requests"):
        rules += [(f"{name}_missing", F.col(f"_n_{name}").isNull()), (f"{name}_repeated", F.col(f"_n_{name}") > 1), (f"{name}_waypoint", F.col(f"_{name}") != F.col("_planned"))]
    return shape.unionByName(_faults(joined, ["episode", "image"], rules))


def request_faults(requests: DataFrame, place: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``position`` has three finite numbers, ``quaternion`` four of length 1, and width, height and channels (1, 3 or 4) are positive."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")) & v.isNotNull()
    q, p = F.col("quaternion"), F.col("position")
    length = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, v: a + v * v))
    rules = [
        ("position", F.coalesce((F.size(p) != 3) | ~F.forall(p, finite), F.lit(True))),
        ("quaternion", F.coalesce((F.size(q) != 4) | ~F.forall(q, finite), F.lit(True))),
        ("unit", F.abs(length - 1) > tolerance),
        ("size", F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True))),
        ("channels", F.coalesce(~F.col("channels").isin(1, 3, 4), F.lit(True))),
    ]
    return _faults(requests, place, rules)


def alignment(poses: DataFrame, world: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The largest distance between stored and world positions of each episode, and whether it is within tolerance; frames without a partner fail it."""
    a = poses.select(*keys, G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw")).alias("_a"))
    b = world.select(*keys, G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw")).alias("_b"))
    d = a.join(b, keys, "full").withColumn("_e", G.distance(F.col("_a"), F.col("_b")))
    return d.groupBy(keys[0]).agg(F.max("_e").alias("worst"), F.count_if(F.col("_e").isNull()).alias("unmatched"), (F.coalesce(F.max("_e"), F.lit(0.0)) <= tolerance).alias("_within")).withColumn("aligned", F.col("_within") & (F.col("unmatched") == 0)).drop("_within")


def token_index_faults(index: DataFrame, ref: str, shard: str, row: str, tokens: str, shard_rows: int) -> DataFrame:
    """References are unique, rows of a shard count from 0 without gaps and fit in it, token counts are positive."""
    d = index.withColumn("_same", F.count("*").over(Window.partitionBy(ref))).withColumn("_at", F.row_number().over(Window.partitionBy(shard).orderBy(row, ref)) - 1)
    return _faults(d, [ref], [("repeated", F.col("_same") > 1), ("row", F.col(row) != F.col("_at")), ("shard_full", F.col(row) >= shard_rows), ("tokens", F.col(tokens) <= 0)])


def history_faults(history: DataFrame, counts: DataFrame) -> DataFrame:
    """``history`` (episode, frame, history_frame) must lie before its frame, once each, and be as many as ``counts`` (episode, frame, n) says."""
    by = ["episode", "frame"]
    late = history.groupBy(*by).agg(F.count("*").alias("_found"), F.countDistinct("history_frame").alias("_kinds"), F.count_if((F.col("history_frame") >= F.col("frame")) | (F.col("history_frame") < 0)).alias("_out"))
    d = counts.join(late, by, "full")
    return _faults(d, by, [("count", F.coalesce("_found", F.lit(0)) != F.coalesce("n", F.lit(0))), ("repeated", F.col("_kinds") != F.col("_found")), ("range", F.col("_out") > 0)])


def shared_statistics(stats: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row of statistics for each key and whether all of the key's sources agree on it."""
    v = F.struct(*values)
    return stats.groupBy(key).agg(F.count("*").alias("sources"), (F.count_distinct(F.to_json(v)) == 1).alias("agree"), F.min(v).alias("_v")).select(key, "sources", "agree", "_v.*")


def hybrid(old: DataFrame, new: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """New rows of completed episodes, old rows of all others, with their ``origin``."""
    done = completed.select(key).distinct()
    return new.join(done, key, "left_semi").withColumn("origin", F.lit("new")).unionByName(old.join(done, key, "left_anti").withColumn("origin", F.lit("old")))


def subset(episodes: DataFrame, frames: DataFrame, chosen: DataFrame, key: str, order: list[str], index: str) -> tuple[DataFrame, DataFrame]:
    """The chosen episodes and their frames, both numbered anew from 0 without gaps."""
    kept = dense_numbers(episodes.join(chosen.select(key).distinct(), key, "left_semi"), [key], "new_episode")
    own = frames.join(kept.select(key, "new_episode"), key)
    return kept, dense_numbers(own, ["new_episode", *order], index)


def planned_against_results(planned: DataFrame, results: DataFrame, key: str, group: str) -> DataFrame:
    """How many planned episodes of each group have a result and how many don't."""
    done = results.select(key, F.lit(True).alias("_done")).distinct()
    return planned.join(done, key, "left").groupBy(group).agg(F.count("*").alias("planned"), F.count("_done").alias("resolved")).withColumn("unresolved", F.col("planned") - F.col("resolved"))


def step_metrics(poses: DataFrame, turning: float) -> DataFrame:
    """Shortest, mean and longest step of each episode, where the longest is, and the share of steps that turn."""
    by = Window.partitionBy("episode").orderBy("frame")
    d = poses.withColumn("_p", G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))).withColumn("_b", F.lag("_p").over(by)).where("_b IS NOT NULL")
    d = d.withColumn("_s", G.distance(F.col("_p"), F.col("_b"))).withColumn("_t", F.abs(G.wrap_angle(F.col("_p")["yaw"] - F.col("_b")["yaw"])) > turning)
    return d.groupBy("episode").agg(F.min("_s").alias("shortest"), F.avg("_s").alias("mean"), F.max("_s").alias("longest"), F.max_by("frame", "_s").alias("longest_at"), F.avg(F.col("_t").cast("int")).alias("turning"))


def following(rows: DataFrame, key: str, order: list[str], followed: Column, collided: Column) -> DataFrame:
    """Share of frames followed before the first collision, whether one came, and at which frame."""
    by = Window.partitionBy(key).orderBy(*order)
    d = rows.withColumn("_f", followed).withColumn("_c", F.max(collided).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(by) - 1)
    return d.groupBy(key).agg(F.count("*").alias("frames"), F.avg((F.col("_f") & ~F.col("_c")).cast("int")).alias("tracked"), F.bool_or("_c").alias("collided"), F.min(F.when(F.col("_c"), F.col("_at"))).cast("long").alias("collided_at"))


def depth_collision(pixels: DataFrame, moved: DataFrame, key: str, camera: str, before: str, after: str, near: float, share: float, tiny: float, stuck: float) -> DataFrame:
    """Whether each place collides, by its cameras' depth before and after a step and the distance ``moved`` (key, distance).

    ``tiny diff`` if the mean change of every camera is under ``tiny``; else ``close`` if more than
    ``share`` of some camera's pixels are at most ``near`` after it; else ``distance`` if it moved less
    than ``stuck``; else null.
    """
    cameras = pixels.groupBy(key, camera).agg(F.avg((F.col(after) <= near).cast("int")).alias("_near"), F.avg(F.abs(F.col(before) - F.col(after))).alias("_diff"))
    d = cameras.groupBy(key).agg(F.max("_near").alias("near_share"), F.max("_diff").alias("largest_change"), F.count_if(F.col("_near") > share).alias("close_cameras"))
    reason = F.when(F.col("largest_change") < tiny, "tiny diff").when(F.col("close_cameras") > 0, "close").when(F.col("distance") < stuck, "distance")
    return d.join(moved.select(key, "distance"), key, "left").withColumn("reason", reason)
