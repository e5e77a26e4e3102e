"""Exact nearest points against all pairs, and how much of them is looked at."""

import numpy as np
import pytest

from trajecta.operators import trajectory
from trajecta.operators.nearest import Nearest, blocked

POSES = "episode long, frame long, vec_id long, x double, y double, z double, yaw double"


def _all_pairs(points, some):
    return sum((some[:, k][:, None] - points[:, k]) ** 2 for k in range(3))


@pytest.mark.parametrize("n, m", [(1, 1), (5, 3), (700, 900), (5000, 4000)])
def test_nearest_equals_all_pairs(n, m):
    r = np.random.default_rng(n)
    points, some = np.unique(np.round(r.normal(size=(n, 3)), 1), axis=0), np.round(r.normal(size=(m, 3)), 1)
    square, at = Nearest(points).search(some)
    want = _all_pairs(points, some)
    assert np.array_equal(square, want.min(axis=1)) and np.array_equal(at, want.argmin(axis=1))
    order, starts = blocked(some)
    assert sorted(order) == list(range(m)) and (np.diff(np.append(starts, m)) <= 64).all()


def test_few_points_are_looked_at(monkeypatch):
    r, seen, keep = np.random.default_rng(0), [0], Nearest._candidates
    points = r.normal(size=(20000, 3))

    def counted(self, low, high, most):
        for chosen in keep(self, low, high, most):
            seen[0] += 64 * len(chosen)
            yield chosen

    monkeypatch.setattr(Nearest, "_candidates", counted)
    Nearest(points).search(points + 0.01)
    assert seen[0] < len(points) ** 2 / 10


def test_nearest_of_smoothed_paths(spark):
    r = np.random.default_rng(2)
    rows = [(e, i, 1000 * e + i, *map(float, r.normal(size=3)), 0.0) for e in range(3) for i in range(150)]
    rows += [(7, 0, 7000, 1.0, 1.0, 1.0, 0.0), (7, 1, 7001, 1.0, 1.0, 1.0, 0.0), (8, 0, 8000, None, 1.0, 1.0, 0.0), (8, 1, 8001, 2.0, 1.0, 1.0, 0.0), (None, 0, 9000, 1.0, 1.0, 1.0, 0.0)]
    poses = spark.createDataFrame(rows, POSES)
    got = {x.vec_id: (x.nearest, x.deviation) for x in trajectory.nearest_smoothed(poses, "vec_id", 2.0, 5.0).collect()}
    assert len(got) == len(rows) - 1 and got[7000] == got[7001] == (0, 0.0) and got[8000] == (None, None)
    for e in range(3):
        own = np.array([x[3:6] for x in rows if x[0] == e])
        path = trajectory._smoothed(own, 2.0, 5.0)
        want = _all_pairs(path, own)
        assert [got[1000 * e + i] for i in range(150)] == [(int(w.argmin()), float(np.sqrt(w.min()))) for w in want]
