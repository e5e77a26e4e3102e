"""Exact nearest points of many points, without all pairs: blocks of near points that are ruled out by their boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a block, and blocks of a group.
BLOCK = 64
GROUP = 64


def blocked(points: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which each ``size`` of them are near each other, and where the blocks start.

    Halved at the middle of the widest axis until a block is small enough.
    """
    order, starts, left = np.arange(len(points)), [], [(0, len(points))]
    while left:
        a, b = left.pop()
        if b - a <= size:
            starts.append(a)
            continue
        own = points[order[a:b]]
        axis = np.argmax(own.max(axis=0) - own.min(axis=0))
        half = (b - a + 2 * size - 1) // (2 * size) * size
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)] if half < b - a else order[a:b]
        left += [(a + half, b), (a, a + half)]
    return order, np.array(starts, np.int64)


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squares that no two points of a box and of each other box come below."""
    return sum(np.maximum(np.maximum(lows[:, k] - high[k], low[k] - highs[:, k]), 0.0) ** 2 for k in range(3))


class Nearest:
    """Points in blocks with their boxes, and groups of blocks with theirs; memory is linear in the points."""

    def __init__(self, points: np.ndarray) -> None:
        self.order, self.starts = blocked(points)
        self.points = points[self.order]
        self.ends = np.append(self.starts[1:], len(points))
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)
        self.groups = np.arange(0, len(self.starts), GROUP)
        self.group_low, self.group_high = np.minimum.reduceat(self.low, self.groups), np.maximum.reduceat(self.high, self.groups)

    def search(self, some: np.ndarray, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """(square, number) of the nearest point of each of ``some``, of equally near ones the first.

        Many equal points should be given once. Points with one at most ``least`` (squared) away may get any such instead. Squares are rounded as
        those of all pairs are, and bounds by boxes alike, so that none is missed.
        """
        best, at = np.full(len(some), np.inf), np.full(len(some), len(self.points), np.int64)
        if len(some) and len(self.points):
            order, starts = blocked(some)
            for own in np.split(order, starts[1:]):
                best[own], at[own] = self._of_block(some[own], least)
        return best, at

    def _of_block(self, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        best, at = np.full(len(own), np.inf), np.full(len(own), len(self.points), np.int64)
        low, high = own.min(axis=0), own.max(axis=0)
        for chosen in self._candidates(low, high, lambda: best.max() if best.max() > least else -1.0):
            squares = sum((own[:, k][:, None] - self.points[chosen, k]) ** 2 for k in range(3))
            near = squares.min(axis=1)
            first = np.where(squares == near[:, None], self.order[chosen], len(self.points)).min(axis=1)
            at = np.where(near < best, first, np.where(near == best, np.minimum(at, first), at))
            best = np.minimum(best, near)
        return best, at

    def _candidates(self, low: np.ndarray, high: np.ndarray, most) -> Iterator[np.ndarray]:
        """Places of points, nearest blocks first, until all others are farther than ``most()``."""
        groups = _apart(low, high, self.group_low, self.group_high)
        for g in np.argsort(groups, kind="stable"):
            if groups[g] > most():
                return
            blocks = np.arange(self.groups[g], min(self.groups[g] + GROUP, len(self.starts)))
            apart = _apart(low, high, self.low[blocks], self.high[blocks])
            order, done, some = np.argsort(apart, kind="stable"), 0, 1
            while done < len(order) and apart[order[done]] <= most():
                now = order[done : done + some]
                now = blocks[now[apart[now] <= most()]]
                yield np.concatenate([np.arange(a, b) for a, b in zip(self.starts[now], self.ends[now], strict=True)])
                done, some = done + some, 2 * some
