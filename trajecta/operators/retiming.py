"""Flight paths smoothed within a corridor and retimed to whole seconds, one episode a group.

A path is resampled densely, smoothed more where it bends, and passed at a drawn speed that drops in
bends, so that it ends after a whole number of seconds. An episode's path is bounded by its flight,
so episodes are the unit of work; Spark spreads them by a shuffle on the episode.

Defined cases: episodes with a null or non-finite pose, without extent, that leave their corridor even
unsmoothed, or that are shorter than the slowest speed's first second give one row with ``reason`` and
no step; repeated positions count once; equal frames are taken in the order of their positions; rows
without an episode are a path of their own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .nearest import Nearest
from .trajectory import gaussian

RETIMED = "episode long, step long, x double, y double, z double, yaw double, turn double, deviation double, reason string"
#: Points that are searched at once for their nearest source point, at first and at most.
_FEED = (1 << 10, 1 << 17)


@dataclass(frozen=True)
class Pace:
    """Speeds (m/s), corridor (m) and bends (rad/m) of a retimed flight."""

    # Fixed values.
    mean: float = 1.0
    spread: float = 0.05
    slowest: float = 0.9
    fastest: float = 1.1
    strength: float = 0.1
    samples: int = 50
    corridor: float | None = None
    in_turn: float = 0.55
    bend_from: float = 0.08
    bend_full: float = 0.45
    turn_widening: float = 2.0


class Unfit(ValueError):
    """A path that can't be retimed; its text is the reason."""


def arc_length(xyz: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(xyz, axis=0), axis=1))])


def bend_share(xyz: np.ndarray, arc: np.ndarray, pace: Pace) -> np.ndarray:
    """0 where the curvature is at most ``bend_from``, 1 from ``bend_full`` on, in between in proportion."""
    moved = np.concatenate([[True], np.diff(arc) > 1e-10])
    s, p = arc[moved], xyz[moved]
    if len(s) < 3:
        return np.zeros(len(arc))
    direction = np.gradient(p, s, axis=0)
    length = np.linalg.norm(direction, axis=1, keepdims=True)
    direction = np.where(length > 1e-9, direction / np.maximum(length, 1e-9), 0.0)
    curvature = np.linalg.norm(np.gradient(direction, s, axis=0), axis=1)
    per_sample = s[-1] / (len(s) - 1)
    curvature = gaussian(curvature[:, None], max(0.5, 0.35 / max(per_sample, 1e-8)), 3.0)[:, 0]
    share = np.clip((curvature - pace.bend_from) / (pace.bend_full - pace.bend_from), 0.0, 1.0)
    return share if moved.all() else np.interp(arc, s, share)


def natural_spline(u: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic through (u, v) whose second derivative is zero at both ends, in linear time."""
    h, slope = np.diff(u), np.diff(v) / np.diff(u)
    bend, carry = np.zeros(len(u)), np.zeros(len(u))
    for i in range(1, len(u) - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * carry[i - 1]
        carry[i] = h[i] / pivot
        bend[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * bend[i - 1]) / pivot
    for i in range(len(u) - 2, 0, -1):
        bend[i] -= carry[i] * bend[i + 1]
    k = np.clip(np.searchsorted(u, at, side="right") - 1, 0, len(u) - 2)
    left, right, w = at - u[k], u[k + 1] - at, h[k]
    curve = (bend[k] * right**3 + bend[k + 1] * left**3) / (6 * w)
    return curve + (v[k] / w - bend[k] * w / 6) * right + (v[k + 1] / w - bend[k + 1] * w / 6) * left


def farthest(points: np.ndarray, own: np.ndarray, source: np.ndarray | Nearest, limit: float) -> float:
    """The largest distance from a point to its nearest source point; any value above ``limit`` once one is.

    ``own``: a source point for each point, which bounds its distance, so that only points whose bound is
    above the largest distance found are searched, and each only until it is known to be nearer than that.
    """
    source = source if isinstance(source, Nearest) else Nearest(source)
    bound = np.linalg.norm(points - own, axis=1)
    order = np.argsort(-bound, kind="stable")
    most, first, step = 0.0, 0, _FEED[0]
    while first < len(order) and bound[order[first]] > most:
        some = order[first : first + step]
        most = max(most, float(np.sqrt(source.search(points[some[bound[some] > most]], most * most * (1 - 1e-15))[0].max())))
        if most > limit:
            break
        first, step = first + step, min(2 * step, _FEED[1])
    return most


def smooth_path(poses: np.ndarray, pace: Pace) -> tuple[np.ndarray, float]:
    """Dense poses of the smoothed path, yaw without jumps, and how far it is from the source at most."""
    apart = np.concatenate([[True], np.linalg.norm(np.diff(poses[:, :3], axis=0), axis=1) > 1e-8])
    knots = poses[apart]
    chord = arc_length(knots[:, :3])
    if len(knots) < 2 or chord[-1] <= 1e-8:
        raise Unfit("no extent")
    u, typical = chord / chord[-1], float(np.median(np.diff(chord)))
    limit = min(0.3, 0.25 * typical) if pace.corridor is None else pace.corridor
    n = max(200, math.ceil(chord[-1] * pace.samples))
    along = lambda count: np.stack([np.interp(np.linspace(0, 1, count), u, knots[:, k]) for k in range(3)], axis=1)
    dense, source = along(n), along(max(n, 50 * len(knots)))
    own = source[np.rint(np.linspace(0, 1, n) * (len(source) - 1)).astype(int)]
    turn = bend_share(dense, np.linspace(0, chord[-1], n), pace)[:, None]
    searched = Nearest(source)
    widest = min(1.5 * limit, max(0.0, pace.strength) * typical) * (n - 1) / chord[-1]
    for width in (widest, widest / 2, widest / 4, 0.0):
        xyz = (1 - turn) * gaussian(dense, width) + turn * gaussian(dense, width * pace.turn_widening)
        xyz[[0, -1]] = poses[[0, -1], :3]
        off = farthest(xyz, own, searched, limit + 1e-9)
        if off <= limit + 1e-9:
            yaw = np.unwrap(knots[:, 3])
            return np.column_stack([xyz, natural_spline(u, yaw, np.linspace(0, 1, n))]), off
    raise Unfit("outside the corridor")


def whole_seconds(length: float, speed: float, pace: Pace) -> int:
    """The duration whose constant speed is nearest to ``speed`` and allowed; of two alike the shorter one."""
    if length < pace.slowest:
        raise Unfit("too short")
    least = max(1, math.ceil(length / pace.fastest))
    most = max(least, math.floor(length / pace.slowest))
    near = [min(max(x, least), most) for x in (math.floor(length / speed), math.ceil(length / speed))]
    return min(near, key=lambda x: (abs(length / x - speed), x))


def drawn_speed(dataset: str, episode: int, pace: Pace) -> float:
    """A normal draw within the limits, from the first four bytes of the SHA-256 of ``dataset:episode``."""
    seed = int(hashlib.sha256(f"{dataset}:{episode}".encode()).hexdigest()[:8], 16)
    return float(np.clip(np.random.default_rng(seed).normal(pace.mean, pace.spread), pace.slowest, pace.fastest))


def timed(poses: np.ndarray, speed: float, pace: Pace) -> tuple[np.ndarray, np.ndarray, float]:
    """Poses at whole seconds, the bend of each pose's next second (0 for the last), and the deviation."""
    if not np.isfinite(poses).all():
        raise Unfit("not finite")
    dense, off = smooth_path(poses, pace)
    arc = arc_length(dense[:, :3])
    bend = bend_share(dense[:, :3], arc, pace)
    local = speed * (1 - (1 - pace.in_turn) * bend)
    clock = np.concatenate([[0.0], np.cumsum(np.diff(arc) / ((local[1:] + local[:-1]) / 2))])
    seconds = max(whole_seconds(float(arc[-1]), speed, pace), math.ceil(clock[-1] - 1e-9))
    at = np.interp(np.arange(seconds + 1), clock * (seconds / clock[-1]), arc)
    out = np.stack([np.interp(at, arc, dense[:, k]) for k in range(4)], axis=1)
    out[0], out[-1, :3], out[-1, 3] = poses[0], poses[-1, :3], np.unwrap(poses[:, 3])[-1]
    return out, np.append(np.interp((at[1:] + at[:-1]) / 2, arc, bend), 0.0), off


def smooth_and_retime(poses: DataFrame, dataset: str, pace: Pace = Pace()) -> DataFrame:
    """(episode, step, x, y, z, yaw, turn, deviation, reason): a row for each second, or one with the reason."""
    names = [x.split()[0] for x in RETIMED.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "x", "y", "z", "yaw"])
        episode = None if pd.isna(g["episode"].iloc[0]) else int(g["episode"].iloc[0])
        try:
            at, turn, off = timed(g[["x", "y", "z", "yaw"]].to_numpy(float), drawn_speed(dataset, episode, pace), pace)
        except Unfit as why:
            return pd.DataFrame([(episode, *[None] * 7, str(why))], columns=names)
        columns = [episode, np.arange(len(at)), *at.T, turn, off, None]
        return pd.DataFrame(dict(zip(names, columns, strict=True)), columns=names)

    return poses.select("episode", "frame", "x", "y", "z", "yaw").groupBy("episode").applyInPandas(run, RETIMED)
