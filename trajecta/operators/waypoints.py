"""Even waypoints between frames, and the frames' new times and actions that follow from them.

Between two frames there are as many steps as their distance or their turn needs, spread evenly along
a shape-preserving curve through the frames. The curve is made episode by episode; times, actions,
summaries and statistics are windows and aggregates over the waypoints.

Defined cases: an episode of one frame has one waypoint; a null or non-finite pose is an error that names
the episode; standing still gives equal waypoints if there is a turn to spread; equal frames are taken
in the order of their positions; rows without an episode are a path of their own; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .trajectory import monotone_cubic

# Metres and radians between waypoints, waypoints a second, actions of a frame.
SPACING = 1.0
YAW_STEP = math.radians(15.0)
RATE = 1.0
HORIZON = 8
WAYPOINTS = "episode long, waypoint long, frame long, x double, y double, z double, yaw double"
_POSE = ("x", "y", "z", "yaw")


def _wrapped(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi


def even_path(poses: np.ndarray, spacing: float, yaw_step: float) -> tuple[np.ndarray, np.ndarray]:
    """All waypoints of a path, and the place of each pose among them.

    The curve is measured on at least 64 chords a segment and 32 a waypoint; a waypoint's place is its
    share of its segment's length, and its yaw the same share of the segment's turn.
    """
    if len(poses) == 1:
        return poses.copy(), np.zeros(1, int)
    turn = _wrapped(np.diff(poses[:, 3]))
    far = np.linalg.norm(np.diff(poses[:, :3], axis=0), axis=1)
    count = np.maximum(1, np.floor(np.maximum(far / spacing, np.abs(turn) / yaw_step) + 0.5)).astype(int)
    knot = np.concatenate([[0], np.cumsum(count)])
    chords = np.maximum(64, 32 * count)
    first = np.concatenate([[0], np.cumsum(chords)])
    at = np.append(np.repeat(knot[:-1], chords) + (np.arange(first[-1]) - np.repeat(first[:-1], chords)) * np.repeat(count / chords, chords), knot[-1])
    curve = np.stack([monotone_cubic(knot.astype(float), poses[:, k], at) for k in range(3)], axis=1)
    arc = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(curve, axis=0), axis=1))])
    segment = np.repeat(np.arange(len(count)), count)
    share = (np.arange(knot[-1]) - knot[segment]) / count[segment]
    target = arc[first[segment]] + share * np.diff(arc[first])[segment]
    out = np.empty((knot[-1] + 1, 4))
    for k in range(3):
        out[:-1, k] = np.interp(target, arc, curve[:, k])
    out[:-1, 3] = _wrapped(poses[segment, 3] + share * turn[segment])
    out[knot] = poses
    return out, knot


def even_waypoints(poses: DataFrame, spacing: float = SPACING, yaw_step: float = YAW_STEP) -> DataFrame:
    """(episode, waypoint, frame, x, y, z, yaw); ``frame`` is null between frames."""
    if spacing <= 0 or yaw_step <= 0:
        raise ValueError("spacing and yaw_step must be positive")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", *_POSE])
        episode, p = g["episode"].iloc[0], g[[*_POSE]].to_numpy(float)
        if not np.isfinite(p).all():
            raise ValueError(f"episode {episode}: a pose is not finite")
        dense, knot = even_path(p, spacing, yaw_step)
        frame = pd.Series(pd.NA, index=range(len(dense)), dtype="Int64")
        frame.iloc[knot] = g["frame"].to_numpy()
        out = pd.DataFrame({"episode": None if pd.isna(episode) else int(episode), "waypoint": np.arange(len(dense)), "frame": frame})
        return out.assign(**dict(zip(_POSE, dense.T, strict=True)))

    return poses.select("episode", "frame", *_POSE).groupBy("episode").applyInPandas(run, WAYPOINTS)


def frame_updates(waypoints: DataFrame, horizon: int = HORIZON, rate: float = RATE) -> DataFrame:
    """(episode, frame, timestamp, h, dx, dy, dz, dyaw, padded): each frame's time and its next ``horizon`` waypoints.

    Steps after the last waypoint are zero and padded.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    w = Window.partitionBy("episode").orderBy("waypoint")
    here = G.pose(*map(F.col, _POSE))
    ahead = F.collect_list("p").over(w.rowsBetween(1, horizon))
    rows = waypoints.select("episode", "waypoint", "frame", here.alias("p")).withColumn("ahead", ahead).where("frame IS NOT NULL")
    steps = rows.select("episode", "frame", (F.col("waypoint") / F.lit(rate)).alias("timestamp"), "p", "ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    d = G.body_delta(F.col("p"), F.get("ahead", F.col("h") - 1))
    padded = F.col("h") > F.size("ahead")
    return steps.select("episode", "frame", "timestamp", "h", *[F.coalesce(d[c], F.lit(0.0)).alias(c) for c in ("dx", "dy", "dz", "dyaw")], padded.alias("padded"))


def path_summary(waypoints: DataFrame) -> DataFrame:
    """(episode, frames, dense_waypoints, max_position_step, max_yaw_step in degrees); zero steps for a single waypoint."""
    w = Window.partitionBy("episode").orderBy("waypoint")
    before = {c: F.lag(c).over(w) for c in _POSE}
    moved = F.sqrt(sum((F.col(c) - before[c]) ** 2 for c in ("x", "y", "z")))
    turned = F.degrees(F.abs(G.wrap_angle(F.col("yaw") - before["yaw"])))
    steps = waypoints.select("episode", "frame", moved.alias("moved"), turned.alias("turned"))
    most = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    return steps.groupBy("episode").agg(F.count("frame").alias("frames"), F.count("*").alias("dense_waypoints"), most("moved").alias("max_position_step"), most("turned").alias("max_yaw_step"))


def action_statistics(updates: DataFrame) -> DataFrame:
    """(dim, mean, std, min, max, n) of the new actions, padded steps included as they are stored."""
    dims = ("dx", "dy", "dz", "dyaw")
    long = updates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("v")) for c in dims])).alias("u")).select("u.*")
    return long.groupBy("dim").agg(F.mean("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
