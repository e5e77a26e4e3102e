"""Resampling and smoothing of whole trajectories: numpy in grouped functions, one episode at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .nearest import Nearest

_OUT = "episode long, step long, x double, y double, z double, yaw double"


def monotone_slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Slopes of a shape-preserving cubic: weighted harmonic means inside, limited one-sided ones at the ends."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros(len(v))
    if len(v) == 2:
        return np.full(2, d[0])
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    inner = np.zeros(len(d) - 1)
    inner[same] = (w1 + w2)[same] / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])
    m[1:-1] = inner
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[end] = 0.0 if s * d0 <= 0 else (3 * d0 if d0 * d1 < 0 and abs(s) > abs(3 * d0) else s)
    return m


def monotone_cubic(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    m = monotone_slopes(t, v)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    s = (at - t[k]) / h
    return (1 + 2 * s) * (1 - s) ** 2 * v[k] + s * (1 - s) ** 2 * h * m[k] + s * s * (3 - 2 * s) * v[k + 1] + s * s * (s - 1) * h * m[k + 1]


def _ordered(g: pd.DataFrame) -> np.ndarray:
    p = g.sort_values("frame")[["x", "y", "z", "yaw"]].to_numpy(float)
    p[:, 3] = np.unwrap(p[:, 3])
    return p


def _wrapped(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi


def _frame(episode: int, p: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"episode": episode, "step": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "yaw": _wrapped(p[:, 3])})


def densify(poses: DataFrame, spacing: float, yaw_step: float) -> DataFrame:
    """More poses along a shape-preserving curve, so that neither spacing nor turn is exceeded; knots stay."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p, episode = _ordered(g), int(g["episode"].iloc[0])
        if len(p) < 2:
            return _frame(episode, p)
        t = np.arange(len(p), dtype=float)
        parts = np.maximum(np.ceil(np.linalg.norm(np.diff(p[:, :3], axis=0), axis=1) / spacing), np.ceil(np.abs(np.diff(p[:, 3])) / yaw_step)).clip(1).astype(int)
        at = np.concatenate([*[i + np.arange(n) / n for i, n in enumerate(parts)], [len(p) - 1.0]])
        return _frame(episode, np.stack([monotone_cubic(t, p[:, k], at) for k in range(4)], axis=1))

    return poses.select("episode", "frame", "x", "y", "z", "yaw").groupBy("episode").applyInPandas(run, _OUT)


def gaussian(v: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """Smoothed along the first axis, the ends repeated; the kernel ends at ``reach`` sigmas."""
    if sigma <= 0 or len(v) < 2:
        return v.copy()
    r = int(reach * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    padded = np.concatenate([np.repeat(v[:1], r, axis=0), v, np.repeat(v[-1:], r, axis=0)])
    return np.stack([np.convolve(padded[:, j], k, mode="valid") for j in range(v.shape[1])], axis=1)


def smooth(poses: DataFrame, sigma: float, corridor: float) -> DataFrame:
    """Positions smoothed as far as no point leaves its corridor: sigma, half, a quarter, or not at all; ends stay."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = _ordered(g)
        return _frame(int(g["episode"].iloc[0]), np.concatenate([_smoothed(p[:, :3], sigma, corridor), p[:, 3:]], axis=1))

    return poses.select("episode", "frame", "x", "y", "z", "yaw").groupBy("episode").applyInPandas(run, _OUT)


def _smoothed(xyz: np.ndarray, sigma: float, corridor: float) -> np.ndarray:
    for s in (sigma, sigma / 2, sigma / 4, 0.0):
        q = gaussian(xyz, s)
        q[[0, -1]] = xyz[[0, -1]]
        if s == 0 or np.linalg.norm(q - xyz, axis=1).max() <= corridor:
            break
    return q


def nearest_smoothed(poses: DataFrame, key: str, sigma: float, corridor: float) -> DataFrame:
    """(key, nearest, deviation): the point of its episode's path (as ``smooth`` gives it) that is nearest to each pose.

    Exact, of equally near points the first; points are ruled out in blocks. One episode a task. Points
    that aren't finite are nearest to none, and poses that aren't have none. Poses without an episode are left out.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame")
        xyz = g[["x", "y", "z"]].to_numpy(float)
        path = _smoothed(xyz, sigma, corridor)
        there = np.flatnonzero(np.isfinite(path).all(axis=1))
        there = np.sort(there[np.unique(path[there], axis=0, return_index=True)[1]])
        asked = np.isfinite(xyz).all(axis=1) & (len(there) > 0)
        square, at = Nearest(path[there]).search(xyz[asked]) if asked.any() else (np.zeros(0), np.zeros(0, np.int64))
        nearest, deviation = pd.array([None] * len(g), "Int64"), np.full(len(g), np.nan)
        nearest[asked], deviation[asked] = there[at], np.sqrt(square)
        return pd.DataFrame({key: g[key].to_numpy(), "nearest": nearest, "deviation": deviation})

    own = poses.where("episode IS NOT NULL").select("episode", "frame", key, "x", "y", "z")
    return own.groupBy("episode").applyInPandas(run, f"`{key}` {dict(poses.dtypes)[key]}, nearest long, deviation double")


def pack_shards(items: DataFrame, scene: str, order: str, size: str, target: int) -> DataFrame:
    """Adds ``shard``: in order within each scene, a new one whenever the target would be passed."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, shard, held, out = g.sort_values(order), 0, 0, []
        for n in g[size]:
            if held and held + n > target:
                shard, held = shard + 1, 0
            held += n
            out.append(shard)
        return g.assign(shard=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes) + ", shard long"
    return items.groupBy(scene).applyInPandas(run, schema)
