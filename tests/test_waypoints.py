"""Even waypoints against a plain reading of their rule, and the updates that follow from them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import waypoints
from trajecta.operators.trajectory import monotone_cubic

POSES = "episode long, frame long, x double, y double, z double, yaw double"


def _wrap(a: float) -> float:
    return (a + math.pi) % (2 * math.pi) - math.pi


def _plain(p: np.ndarray, spacing: float, yaw_step: float) -> tuple[list, list]:
    """Segment by segment: a fine curve, walked until each waypoint's share of its length is reached."""
    counts = [max(1, math.floor(math.dist(a[:3], b[:3]) / spacing + 0.5), math.floor(abs(_wrap(b[3] - a[3])) / yaw_step + 0.5)) for a, b in zip(p, p[1:])]
    knots = [0]
    for c in counts:
        knots.append(knots[-1] + c)
    out = []
    for i, c in enumerate(counts):
        at = np.linspace(knots[i], knots[i + 1], 20 * max(64, 32 * c) + 1)
        fine = np.stack([monotone_cubic(np.array(knots, float), p[:, k], at) for k in range(3)], axis=1)
        walked = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(fine, axis=0), axis=1))])
        for j in range(c):
            n = int(np.argmin(np.abs(walked - walked[-1] * j / c))) if walked[-1] else 0
            out.append((*(fine[n] if j else p[i, :3]), _wrap(p[i, 3] + j / c * _wrap(p[i + 1, 3] - p[i, 3])) if j else p[i, 3]))
    return [*out, tuple(p[-1])], knots


def _path(seed: int, n: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    p = np.column_stack([np.cumsum(r.normal(scale=3, size=(n, 3)), axis=0), r.uniform(-math.pi, math.pi, n)])
    p[4, :3] = p[3, :3]  # turns in place
    p[7] = p[6]  # stands still
    return p


@pytest.mark.parametrize("seed", [1, 2])
def test_path_equals_plain_walk(seed):
    p = _path(seed)
    got, knot = waypoints.even_path(p, 1.0, math.radians(15))
    want, places = _plain(p, 1.0, math.radians(15))
    assert list(knot) == places and len(got) == len(want) and np.array_equal(got[knot], p)
    assert np.abs(got[:, :3] - np.array(want)[:, :3]).max() < 0.02  # both read the curve by chords
    assert max(abs(_wrap(a - b[3])) for a, b in zip(got[:, 3], want)) < 1e-9


def test_steps_are_rounded_half_up():
    for far, turn, want in ((2.5, 0.0, 3), (2.49, 0.0, 2), (0.1, 0.0, 1), (1.0, 3.2 * 0.5, 3), (1.0, -3.6 * 0.5, 4)):
        assert waypoints.even_path(np.array([[0, 0, 0, 0.0], [far, 0, 0, turn]]), 1.0, 0.5)[1][1] == want


def test_straight_line_and_turn_over_the_seam():
    got, knot = waypoints.even_path(np.array([[0, 0, 0, 3.0], [4, 0, 0, -3.0]]), 1.0, 10.0)
    assert np.allclose(got[:, 0], range(5)) and list(knot) == [0, 4]
    assert np.allclose(np.diff(np.unwrap(got[:, 3])), (2 * math.pi - 6) / 4)


def test_updates_summary_and_statistics(spark):
    paths = {1: _path(5), 2: _path(6, 9), None: np.array([[1.0, 2.0, 3.0, 0.5]])}
    rows = [(e, 10 * i, *map(float, q)) for e, p in paths.items() for i, q in enumerate(p)]
    df = spark.createDataFrame(rows, POSES).selectExpr("*", "1 AS waypoint", "0 AS p")
    w = waypoints.even_waypoints(df)
    got = {(r.episode, r.frame, r.h): r for r in waypoints.frame_updates(w).collect()}
    assert len(got) == 8 * len(rows)
    actions = []
    for e, p in paths.items():
        dense, knot = waypoints.even_path(p, waypoints.SPACING, waypoints.YAW_STEP)
        for i, k in enumerate(knot):
            for h in range(1, 9):
                r, want = got[e, 10 * i, h], (0.0, 0.0, 0.0, 0.0)
                if k + h < len(dense):
                    d, c, s = dense[k + h] - p[i], math.cos(p[i, 3]), math.sin(p[i, 3])
                    want = (c * d[0] + s * d[1], c * d[1] - s * d[0], d[2], _wrap(d[3]))
                assert r.timestamp == k and r.padded == (k + h >= len(dense))
                assert np.allclose((r.dx, r.dy, r.dz, r.dyaw), want)
                actions.append(want)
    s = {r.episode: r for r in waypoints.path_summary(w).collect()}
    for e, p in paths.items():
        dense, _ = waypoints.even_path(p, waypoints.SPACING, waypoints.YAW_STEP)
        step = np.linalg.norm(np.diff(dense[:, :3], axis=0), axis=1)
        turn = [abs(math.degrees(_wrap(x))) for x in np.diff(dense[:, 3])]
        assert (s[e].frames, s[e].dense_waypoints) == (len(p), len(dense))
        assert s[e].max_position_step == pytest.approx(max(step, default=0)) and s[e].max_yaw_step == pytest.approx(max(turn, default=0))
    a = np.array(actions)
    for r in waypoints.action_statistics(waypoints.frame_updates(w)).collect():
        v = a[:, ("dx", "dy", "dz", "dyaw").index(r.dim)]
        assert np.allclose((r.mean, r.std, r.min, r.max, r.n), (v.mean(), v.std(), v.min(), v.max(), len(v)))


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, None, 0.0)], POSES)
    with pytest.raises(Exception, match="episode 1: a pose is not finite"):
        waypoints.even_waypoints(df).collect()
    empty = waypoints.even_waypoints(df.where("false"))
    assert waypoints.frame_updates(empty).count() == waypoints.path_summary(empty).count() == 0
    with pytest.raises(ValueError):
        waypoints.even_waypoints(df, 0.0)
    same = spark.createDataFrame([(1, 0, 2.0, 0.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 0.0, 0.0)], POSES)
    assert [r.x for r in waypoints.even_waypoints(same).orderBy("waypoint").select(F.col("x")).collect()] == [0.0, 1.0, 2.0]
