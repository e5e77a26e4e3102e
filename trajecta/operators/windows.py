"""Operators over the ordered frames of episodes.

Look-ahead and look-back use lead and lag, so a frame never carries a list longer than its horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.operators.chains import running_total


def _by(episode: str, *order: str):
    return Window.partitionBy(episode).orderBy(*order)


def number_frames(df: DataFrame, episode: str, order: list[str], name: str = "frame") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(_by(episode, *order)) - 1).cast("bigint"))


def action_chunk(poses: DataFrame, horizon: int, repeat_last: bool = False) -> DataFrame:
    """(episode, frame, h, dx, dy, dz, dyaw): the next ``horizon`` poses from each frame's own frame of reference.

    Truncated at the episode's end, or continued with its last pose.
    """
    w = _by("episode", "frame")
    here = G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))
    end = F.last("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = []
    df = poses.select("episode", "frame", here.alias("p")).withColumn("_end", end)
    for h in range(1, horizon + 1):
        later = F.lead("p", h).over(w)
        steps.append(F.struct(F.lit(h).alias("h"), (F.coalesce(later, F.col("_end")) if repeat_last else later).alias("q")))
    df = df.withColumn("_s", F.array(*steps)).select("episode", "frame", "p", F.explode("_s").alias("s")).where(F.col("s.q").isNotNull())
    return df.select("episode", "frame", F.col("s.h").alias("h"), G.body_delta(F.col("p"), F.col("s.q")).alias("d")).select("episode", "frame", "h", "d.*")


def padded_chunk(chunk: DataFrame, frames: DataFrame, horizon: int) -> DataFrame:
    """One row per frame and step, zero where the chunk ends early, with a mask that says so."""
    grid = frames.select("episode", "frame", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    full = grid.join(chunk, ["episode", "frame", "h"], "left")
    return full.select("episode", "frame", "h", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dx", "dy", "dz", "dyaw")], F.col("dx").isNull().alias("padded"))


def past_waypoints(poses: DataFrame, history: int) -> DataFrame:
    """(episode, frame, back, dx, dy): up to ``history`` earlier poses from each frame's frame of reference."""
    w = _by("episode", "frame")
    here = G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))
    df = poses.select("episode", "frame", here.alias("p"))
    steps = [F.struct(F.lit(k).alias("back"), F.lag("p", k).over(w).alias("q")) for k in range(1, history + 1)]
    df = df.withColumn("_s", F.array(*steps)).select("episode", "frame", "p", F.explode("_s").alias("s")).where(F.col("s.q").isNotNull())
    d = G.body_delta(F.col("p"), F.col("s.q"))
    return df.select("episode", "frame", F.col("s.back").alias("back"), d["dx"].alias("dx"), d["dy"].alias("dy"))


def dynamics(poses: DataFrame, seconds: str, tiny: float = 1e-7) -> DataFrame:
    """Adds ``velocity`` (forward, in the body's frame), ``yaw_rate`` and ``acceleration``.

    Backward differences over time steps of at least a microsecond; an episode's first row takes the
    step after it, and all are zero for a single frame. Numbers next to zero become zero; any that
    isn't finite is an error.
    """
    w = _by("episode", "frame")
    own = G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))
    d = poses.withColumn("_d", G.body_delta(F.lag(own).over(w), own)).withColumn("_t", F.greatest(F.col(seconds) - F.lag(seconds).over(w), F.lit(1e-6)))
    for name, part in (("velocity", "dx"), ("yaw_rate", "dyaw")):
        rate = F.col("_d")[part] / F.col("_t")
        d = d.withColumn(name, G.finite_number(F.coalesce(rate, F.lead(rate).over(w), F.lit(0.0)), tiny))
    change = (F.col("velocity") - F.lag("velocity").over(w)) / F.col("_t")
    return d.withColumn("acceleration", G.finite_number(F.coalesce(change, F.lit(0.0)), tiny)).drop("_d", "_t")


def running_offset(df: DataFrame, key: list[str], order: list[str], available: Column, name: str = "offset") -> DataFrame:
    """A running counter within each key; -1 on unavailable rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(available.cast("bigint")).over(w) - 1
    return df.withColumn(name, F.when(available, n).otherwise(F.lit(-1)).cast("bigint"))


def exclusive_offsets(counts: DataFrame, order: str, size: str) -> DataFrame:
    """Adds ``start``: the sum of earlier sizes, range by range, so no task sees all rows."""
    return running_total(counts, [order], F.col(size), "start")


def contiguity_breaks(df: DataFrame, key: str, index: str, tie: list[str]) -> DataFrame:
    """Rows whose index isn't one more than the row's before."""
    w = Window.partitionBy(key).orderBy(index, *tie)
    return df.withColumn("previous", F.lag(index).over(w)).where(F.col(index) != F.col("previous") + 1)


def forward_fill(df: DataFrame, value: str, name: str, start: float | None = None) -> DataFrame:
    w = _by("episode", "frame").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(name, filled if start is None else F.coalesce(filled, F.lit(start)))


def unwrap(df: DataFrame, angle: str, name: str) -> DataFrame:
    """The angle without jumps: the first, and the sum of wrapped steps since."""
    w = _by("episode", "frame")
    step = df.withColumn("_d", F.coalesce(G.wrap_angle(F.col(angle) - F.lag(angle).over(w)), F.col(angle)))
    return step.withColumn(name, F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def tangent_yaw(df: DataFrame, start: Column, least: float = 1e-6) -> DataFrame:
    """Adds yaw, the direction of the step that follows, and yaw_fallback.

    A step no longer than ``least`` on the plane, and the last frame, keep the last direction; before
    the first one the ``start`` yaw holds. yaw_fallback says where that was: ``none``,
    ``leading_start_yaw``, or ``start_yaw`` for an episode without any step.
    """
    w = _by("episode", "frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    df = df.withColumn("_t", F.when(F.hypot(dx, dy) > least, F.atan2(dy, dx)))
    fallback = F.when(F.max("_t").over(whole).isNull(), "start_yaw").when(F.first("_t").over(whole).isNull(), "leading_start_yaw").otherwise("none")
    filled = F.coalesce(F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), start)
    return df.withColumns({"yaw": filled, "yaw_fallback": fallback}).drop("_t")


def streaks(df: DataFrame, flag: Column, name: str = "streak") -> DataFrame:
    """How many rows up to this one the flag has held without a break."""
    w = _by("episode", "frame")
    df = df.withColumn("_f", flag).withColumn("_g", F.sum((~F.col("_f")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("episode", "_g").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col("_f").cast("bigint")).over(inside)).drop("_f", "_g")


def running_any(df: DataFrame, flag: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.max(flag).over(_by("episode", "frame").rowsBetween(Window.unboundedPreceding, 0)))


def recent_history(df: DataFrame, k: int) -> DataFrame:
    """(episode, frame, history_frame): the last ``k`` earlier frames."""
    first = F.greatest(F.lit(0), F.col("frame") - k)
    return df.where("frame > 0").select("episode", "frame", F.explode(F.sequence(first, F.col("frame") - 1)).alias("history_frame"))


def uniform_history(df: DataFrame, k: int) -> DataFrame:
    """(episode, frame, history_frame): up to ``k`` earlier frames spread evenly (truncated positions)."""
    n = F.least(F.col("frame"), F.lit(k)).cast("int")
    at = F.when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * (F.col("frame") - 1) / (n - 1)).cast("bigint")))
    return df.where("frame > 0").select("episode", "frame", F.explode(F.array_distinct(at)).alias("history_frame"))


def path_progress(df: DataFrame, step: str, gamma: float = 1.0) -> DataFrame:
    """Adds ``progress``: distance so far over all, to the power gamma; for an episode that stays put, its share of frames."""
    w = _by("episode", "frame")
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, n = F.sum(step).over(whole), F.count("*").over(whole)
    still = F.when(n > 1, F.col("frame") / (n - 1)).otherwise(0.0)
    return df.withColumn("progress", F.pow(F.when(total <= 1e-6, still).otherwise(F.sum(step).over(so_far) / total), F.lit(gamma)))


def local_poses(poses: DataFrame, z_sign: int = 1, tiny: float = 1e-7) -> DataFrame:
    """Each pose seen from its episode's first one (``local``), numbers next to zero as zero."""
    own = G.pose(F.col("x"), F.col("y"), F.col("z"), F.col("yaw"))
    d = poses.withColumn("_d", G.body_delta(F.first(own).over(_by("episode", "frame")), own, z_sign))
    return d.withColumn("local", F.struct(*[G.clean_number(F.col("_d")[k], tiny).alias(k) for k in ("dx", "dy", "dz", "dyaw")])).drop("_d")


def integrate(steps: DataFrame, start_yaw: Column) -> DataFrame:
    """Positions from body-frame steps, each relative to the pose before; the episode starts at zero.

    Headings are running sums, and so are the steps turned by the heading before them: two windows of
    one sort, no fold over whole episodes.
    """
    by = _by("episode", "frame")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    h = steps.withColumn("yaw", start_yaw + F.sum("dyaw").over(running)).withColumn("_h", F.lag("yaw").over(by)).withColumn("_h", F.coalesce("_h", start_yaw))
    c, s = F.cos("_h"), F.sin("_h")
    moves = {"x": c * F.col("dx") - s * F.col("dy"), "y": s * F.col("dx") + c * F.col("dy"), "z": F.col("dz")}
    return h.select("*", *[F.sum(m).over(running).alias(k) for k, m in moves.items()]).drop("_h").withColumn("yaw", G.wrap_angle(F.col("yaw")))
