"""Smoothing and retiming against worked numbers and plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from trajecta.operators import retiming
from trajecta.operators.retiming import Pace

POSES = "episode long, frame long, x double, y double, z double, yaw double"
PACE = Pace()


def _corner(n: int = 20) -> np.ndarray:
    legs = [(float(i), 0.0) for i in range(n)] + [(n - 1.0, float(i)) for i in range(1, n)]
    return np.array([(x, y, 0.0, 0.0 if y == 0 else math.pi / 2) for x, y in legs])


def test_straight_flight_is_even():
    poses = np.array([(float(i), 0.0, 0.0, 0.1 * i) for i in range(11)])
    at, turn, off = retiming.timed(poses, 1.0, PACE)
    assert np.allclose(at[:, 0], np.arange(11)) and np.allclose(at[:, 1:3], 0) and np.allclose(at[:, 3], 0.1 * np.arange(11))
    assert not turn.any() and off < 0.01


def test_corner_is_rounded_and_slower():
    poses = _corner()
    at, turn, off = retiming.timed(poses, 1.0, PACE)
    step = np.linalg.norm(np.diff(at[:, :3], axis=0), axis=1)
    assert 0 < off <= 0.25 and turn.max() == 1 and turn[0] == 0
    assert step[turn[:-1].argmax()] < 0.8 < step[0]
    assert np.array_equal(at[0], poses[0]) and np.array_equal(at[-1], poses[-1])
    assert len(at) - 1 > 38  # seconds that the even flight would take


def test_duration_equals_plain_choice():
    for length in (0.95, 1.0, 7.3, 38.0, 123.4, 1000.0):
        for speed in (0.9, 0.97, 1.0, 1.03, 1.1):
            least = max(1, math.ceil(length / PACE.fastest))
            options = range(least, max(least, math.floor(length / PACE.slowest)) + 1)
            assert retiming.whole_seconds(length, speed, PACE) == min(options, key=lambda n: (abs(length / n - speed), n))
    with pytest.raises(retiming.Unfit, match="too short"):
        retiming.whole_seconds(0.89, 1.0, PACE)


def test_natural_spline_equals_dense_solution():
    rng = np.random.default_rng(3)
    for n in (2, 3, 12):
        u, v = np.concatenate([[0.0], np.cumsum(rng.uniform(0.1, 1, n - 1))]), rng.normal(size=n)
        h, m = np.diff(u), np.eye(n)
        right = np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
        bend = np.linalg.solve(m, right)
        at = np.linspace(0, u[-1], 50)
        k = np.clip(np.searchsorted(u, at, side="right") - 1, 0, n - 2)
        d = at - u[k]
        first = np.diff(v)[k] / h[k] - h[k] * (2 * bend[k] + bend[k + 1]) / 6
        want = v[k] + first * d + bend[k] / 2 * d**2 + (bend[k + 1] - bend[k]) / (6 * h[k]) * d**3
        assert np.allclose(retiming.natural_spline(u, v, at), want)
        assert np.allclose(retiming.natural_spline(u, v, u), v)


def test_largest_distance_equals_all_pairs():
    rng = np.random.default_rng(5)
    source = rng.normal(size=(700, 3))
    points = source + rng.normal(scale=0.3, size=source.shape)
    want = np.linalg.norm(points[:, None] - source, axis=2).min(axis=1).max()
    assert retiming.farthest(points, source, source, math.inf) == pytest.approx(want)
    assert retiming.farthest(points, source, source, want / 2) > want / 2


def test_curvature_of_a_circle():
    for radius, want in ((50.0, 0.0), (4.0, (0.25 - 0.08) / 0.37), (1.0, 1.0)):
        a = np.linspace(0, math.pi, 4000)
        xyz = np.stack([radius * np.cos(a), radius * np.sin(a), 0 * a], axis=1)
        share = retiming.bend_share(xyz, retiming.arc_length(xyz), PACE)
        assert np.allclose(share[500:-500], want, atol=1e-3)
    doubled = np.repeat(xyz, 2, axis=0)
    assert np.allclose(retiming.bend_share(doubled, retiming.arc_length(doubled), PACE)[::2], share)


def test_speed_is_drawn_from_the_digest():
    seed = int.from_bytes(hashlib.sha256(b"a:7").digest()[:4], "big")
    assert retiming.drawn_speed("a", 7, PACE) == np.clip(np.random.default_rng(seed).normal(1.0, 0.05), 0.9, 1.1)


def test_groups_and_reasons(spark):
    rows = [(1, i, *map(float, p)) for i, p in enumerate(_corner(6))]
    rows += [(2, 0, 0.0, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0, 1.0)]  # no extent
    rows += [(3, 0, 0.0, 0.0, 0.0, 0.0), (3, 1, 0.5, 0.0, 0.0, 0.0)]  # too short
    rows += [(4, 0, 0.0, 0.0, 0.0, 0.0), (4, 1, None, 0.0, 0.0, 0.0), (5, 0, 0.0, float("nan"), 0.0, 0.0)]
    rows += [(None, i, 2.0 * i, 0.0, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, POSES)
    got = retiming.smooth_and_retime(df.selectExpr("*", "1 AS step", "'x' AS reason"), "a").collect()
    why = {r.episode: r.reason for r in got}
    assert why == {1: None, 2: "no extent", 3: "too short", 4: "not finite", 5: "not finite", None: None}
    assert sum(r.episode in (2, 3, 4, 5) for r in got) == 4
    one = sorted((r for r in got if r.episode == 1), key=lambda r: r.step)
    want, turn, off = retiming.timed(_corner(6), retiming.drawn_speed("a", 1, PACE), PACE)
    assert np.allclose([(r.x, r.y, r.z, r.yaw, r.turn) for r in one], np.column_stack([want, turn])) and one[0].deviation == pytest.approx(off)
    assert retiming.smooth_and_retime(df.where("false"), "a").count() == 0


def test_farthest_of_many_points_is_not_all_pairs(monkeypatch):
    rng, seen, keep = np.random.default_rng(8), [0], retiming.Nearest._candidates
    source = np.cumsum(rng.normal(size=(20000, 3)) * 0.1, axis=0)
    points = source + rng.normal(size=source.shape) * 0.2

    def counted(self, low, high, most):
        for chosen in keep(self, low, high, most):
            seen[0] += 64 * len(chosen)
            yield chosen

    monkeypatch.setattr(retiming.Nearest, "_candidates", counted)
    got = retiming.farthest(points, source, source, math.inf)
    want = max(float(np.sqrt(((source - p) ** 2).sum(axis=1).min())) for p in points)
    assert got == pytest.approx(want, abs=1e-12) and 0 < seen[0] < len(points) ** 2 / 10
