"""Small rewrites of raw records: prefixes, times, poses, video offsets, anchors, orders, upserts and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.functions.hashing import stable_rank
from trajecta.operators.chains import dense_numbers


def has_prefix(value: Column, prefixes: list[str]) -> Column:
    """Whether a value starts with one of the prefixes; without any, all do. A null value is empty."""
    v = F.coalesce(value, F.lit(""))
    return reduce(lambda a, b: a | b, [v.startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def prefix_counts(df: DataFrame, value: Column, prefixes: list[str]) -> DataFrame:
    """(kept, dropped) of a prefix filter, in one pass."""
    kept = F.count_if(has_prefix(value, prefixes))
    return df.agg(kept.alias("kept"), (F.count("*") - kept).alias("dropped"))


def resolve_time(seconds: Column, frame: Column, fps: float) -> Column:
    """The source's own time, else frame over fps."""
    if fps <= 0:
        raise ValueError(f"fps must be positive, not {fps}")
    return F.coalesce(seconds.cast("double"), frame / F.lit(float(fps)))


def drone_pose(x: Column, y: Column, z_up: Column, yaw_degrees: Column) -> Column:
    """(x, y, z down, yaw in wrapped radians); a number that is missing or not finite is an error."""
    values = [c.cast("double") for c in (x, y, z_up, yaw_degrees)]
    bad = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in values])
    a, b, c, d = values
    p = F.struct(*[G.clean_number(v).alias(k) for k, v in (("x", a), ("y", b), ("z", -c), ("yaw", G.wrap_angle(F.radians(d))))])
    return F.when(bad, F.raise_error(F.lit("a drone pose needs finite x, y, z and yaw"))).otherwise(p)


def first_frame_offsets(episodes: DataFrame, video: DataFrame, cameras: list[str], fps: float) -> DataFrame:
    """(episode, camera, offset): the seconds at which each episode's first frame stands in each camera's video.

    ``episodes`` (episode, index of the first frame), ``video`` (index, camera, available,
    video_frame). A pair without an available row is an error.
    """
    asked = episodes.select("episode", "index", F.explode(F.array(*map(F.lit, cameras))).alias("camera"))
    there = video.where("available").select("index", "camera", (F.col("video_frame") / F.lit(float(fps))).alias("offset"))
    missing = F.raise_error(F.concat(F.lit("no video frame for the start of episode "), F.col("episode").cast("string"), F.lit(" in "), F.col("camera")))
    return asked.join(there, ["index", "camera"], "left").select("episode", "camera", F.coalesce("offset", missing.cast("double")).alias("offset"))


#: Frames at either end of a trajectory that no anchor stands on.
ANCHOR_MARGINS = (4, 8)


def anchor_frames(size: Column, count: Column) -> Column:
    """``count`` frames spread evenly between the margins, halves rounded to even; the middle for one. Too short a trajectory is an error."""
    low, high = F.lit(ANCHOR_MARGINS[0]).cast("bigint"), size.cast("bigint") - 1 - ANCHOR_MARGINS[1]
    room = F.greatest(high - low + 1, F.lit(0))
    short = F.raise_error(F.concat(F.lit("a trajectory of "), size.cast("string"), F.lit(" frames has room for "), room.cast("string"), F.lit(" anchors, not "), count.cast("string"))).cast("array<bigint>")
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)).cast("bigint") - 1), lambda i: F.bround(low + i * (high - low) / F.greatest(count - 1, F.lit(1)).cast("double")).cast("bigint"))
    return F.when(count <= 0, F.array().cast("array<bigint>")).when(room < count, short).when(count == 1, F.array(F.floor((low + high) / 2).cast("bigint"))).otherwise(spread)


def paired_anchors(parents: DataFrame, key: str, size: str, count: int, kinds: list[str], seed: str) -> DataFrame:
    """(key, kind, frame): ``count`` anchors shared out over all parents, evenly spaced in each, the same for every kind of trace.

    Each parent gets the whole part; the remainder goes to the first in hash order.
    """
    n = parents.count()
    if count < 0 or count and not n:
        raise ValueError(f"can't share {count} anchors out over {n} parents")
    base, extras = divmod(count, n) if n else (0, 0)
    ranked = dense_numbers(parents.select(key, size).withColumn("_h", stable_rank(seed, F.col(key))), ["_h"], "_r")
    own = ranked.withColumn("_n", F.lit(base) + (F.col("_r") < extras).cast("int"))
    frames = own.select(key, F.explode(anchor_frames(F.col(size), F.col("_n"))).alias("frame"))
    return frames.select(key, F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "frame")


def video_order(refs: DataFrame, columns: list[str], name: str = "position") -> DataFrame:
    """Numbers references in the order in which their frames stand in the videos (camera, chunk, file, frame, reference)."""
    return dense_numbers(refs, columns, name)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The old rows, with the columns of ``new`` in place of theirs where keys are equal, and its other rows added.

    Columns that ``new`` lacks stay as they are; in an added row they are ``defaults`` or null. Of
    equal keys in ``new`` the last by ``order`` counts, whose column stays out of the result.
    Keys of ``old`` must be unique.
    """
    given = [c for c in new.columns if c not in keys and c != order]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(F.lit(True).alias("_there"), *given), order).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(last, keys, "full")
    def column(c: str) -> Column:
        if c in given:
            return F.when(F.col("_new._there"), F.col(f"_new.{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None))
        return F.when(F.col("_old").isNull(), (defaults or {}).get(c, F.lit(None))).otherwise(F.col(c))

    names = [*old.columns, *[c for c in given if c not in old.columns]]
    return both.select(*[F.col(c) if c in keys else column(c).alias(c) for c in names])


def work_remaining(groups: DataFrame, jobs: DataFrame, key: str, open_: Column) -> DataFrame:
    """Adds ``remaining``: whether any of a group's jobs is open."""
    left = jobs.where(open_).select(key).distinct().withColumn("_open", F.lit(True))
    return groups.join(left, key, "left").withColumn("remaining", F.coalesce("_open", F.lit(False))).drop("_open")


def group_key(*parts: Column) -> Column:
    """Several values as one compact JSON list of ASCII: numbers and nulls as they are, other characters as UTF-16 escapes."""
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_extract(F.to_json(F.array(p)), r"(?s)^\[(.*)\]$", 1) for p in parts]), F.lit("]"))
    escaped = F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.array_join(escaped, ""))


def scene_and_subtype(path: Column, default: str) -> Column:
    """(scene, subtype) of an image path: its first part, and its third below ``astar_data`` or else its second."""
    p = F.split(F.coalesce(path, F.lit("")), "/")
    scene = F.when(p[0] != "", p[0]).otherwise(F.lit(default))
    subtype = F.when((F.size(p) >= 3) & (F.get(p, F.lit(1)) == "astar_data"), F.get(p, F.lit(2))).otherwise(F.coalesce(F.get(p, F.lit(1)), F.lit(default)))
    return F.struct(scene.alias("scene"), subtype.alias("subtype"))


def named_as(value: Column, aliases: dict[str, str]) -> Column:
    """The name that a trimmed, lower-cased alias stands for; any other value, null too, is an error."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(value, F.lit("null"))))
    return F.coalesce(F.try_element_at(names, F.coalesce(F.lower(F.trim(value)), F.lit(""))), unknown.cast("string"))


def budget_summary(rows: DataFrame, history: Column, target: Column, rate: Column, floor: float = 0.1) -> DataFrame:
    """One row: how many rows, their least and most history frames and rates, and how many budgets no rate can meet.

    A budget can't be met where even the floor of the keep probability keeps ``target`` frames or
    more. Frames are 0 and rates infinite where there are no rows.
    """
    none = F.lit(float("inf"))
    return rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.min(history), F.lit(0)).alias("frames_min"),
        F.coalesce(F.max(history), F.lit(0)).alias("frames_max"),
        F.count_if((history > 0) & (F.least(history, target) <= history * F.lit(floor))).alias("infeasible"),
        F.coalesce(F.min(rate), none).alias("k_min"),
        F.coalesce(F.max(rate), none).alias("k_max"),
    )


def padding_counts(rows: DataFrame, mask: Column) -> DataFrame:
    """One row: the frames with a padded step, and the padded steps of all; a null mask has none."""
    padded = F.coalesce(F.size(F.filter(mask, lambda m: m)), F.lit(0))
    padded = F.when(mask.isNull(), F.lit(0)).otherwise(padded)
    return rows.agg(F.count_if(padded > 0).alias("frames_padded"), F.coalesce(F.sum(padded), F.lit(0)).alias("steps_padded"))
