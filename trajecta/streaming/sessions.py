"""Live sessions: each arriving frame chooses its history and updates its session's memory.

A session's state is the numbers of its frames and of its memory, and what was accepted last; it lives
in the state store, so a restarted stream goes on where the last committed batch ended. The choice is
that of ``history.context_rows``: the same draws, rates and order, so a stream and a batch over the same
frames agree row for row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trajecta.operators.history import Budget

OUTPUT = "episode long, frame long, index long, accepted boolean, bats_k double, history_frames array<struct<frame_index:bigint,camera_mask:bigint>>, long_memory_frames array<struct<frame_index:bigint,camera_mask:bigint>>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FRAME = StructType([StructField("frame_index", LongType()), StructField("camera_mask", LongType())])


def rate(frames: int, budget: Budget) -> float:
    """The rate at which that many earlier frames keep the budget's target, by halving, as ``Budget.row`` solves it."""
    target = min(float(frames), budget.target)
    if target >= frames:
        return 0.0
    if target <= frames * budget.floor:
        return budget.most
    low, high = 0.0, budget.most
    for _ in range(100):
        mid = (low + high) / 2
        if frames * ((1 - budget.floor) * (1 - math.exp(-mid)) / mid + budget.floor) > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chosen(episode: object, frame: int, earlier: list[Row], k: float, budget: Budget, seed: str) -> list[Row]:
    """The earlier frames that a frame keeps, in order."""
    drawn = []
    for h in earlier:
        p = min(1.0, max(0.0, (1 - budget.floor) * math.exp(k * (h.frame_index - frame) / frame) + budget.floor))
        draw = int(hashlib.sha256(f"{seed}:{episode}:{frame}:{h.frame_index}".encode()).hexdigest()[:13], 16) / (1 << 52)
        if draw < p:
            drawn.append((draw / p, h.frame_index, h))
    return sorted((h for _, _, h in sorted(drawn, key=lambda d: d[:2])[: budget.capacity]), key=lambda h: h.frame_index)


class Sessions(StatefulProcessor):
    """Takes a session's rows in order of frame; one that isn't newer than the last, or is of an earlier time, is refused."""

    def __init__(self, budget: Budget, seed: str):
        self._budget, self._seed = budget, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._frames = handle.getListState("frames", _FRAME)
        self._memory = handle.getListState("memory", _FRAME)
        self._last = handle.getValueState("last", StructType([StructField("frame", LongType()), StructField("time", DoubleType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last = self._last.get() or (-1, -math.inf)
        frames = [Row(frame_index=f[0], camera_mask=f[1]) for f in self._frames.get()]
        memory = [Row(frame_index=f[0], camera_mask=f[1]) for f in self._memory.get()]
        known, remembered = len(frames), len(memory)
        for r in sorted(rows, key=lambda r: (r.frame, r.time)):
            if r.frame <= last[0] or r.time < last[1]:
                yield Row(episode=key[0], frame=r.frame, index=r["index"], accepted=False, bats_k=None, history_frames=[], long_memory_frames=[])
                continue
            k = rate(len(frames), self._budget)
            picked = chosen(key[0], r.frame, frames, k, self._budget, self._seed) if frames else []
            yield Row(episode=key[0], frame=r.frame, index=r["index"], accepted=True, bats_k=k, history_frames=[h for h in picked if h.camera_mask], long_memory_frames=list(memory))
            newest = memory[-1].frame_index if memory else -1
            fresh = next((h for h in picked if h.frame_index > newest), None)
            if fresh is not None and fresh.camera_mask:
                memory.append(fresh)
            frames.append(Row(frame_index=r.frame, camera_mask=r.mask))
            last = (r.frame, r.time)
        if len(frames) > known:
            self._frames.appendList([tuple(f) for f in frames[known:]])
            self._last.update(tuple(last))
        if len(memory) > remembered:
            self._memory.appendList([tuple(f) for f in memory[remembered:]])

    def close(self) -> None:
        pass


def live_context(frames: DataFrame, budget: Budget, seed: str = "history") -> DataFrame:
    """(episode, frame, index, accepted, bats_k, history_frames, long_memory_frames) of a stream of frames.

    ``frames`` has episode, frame, index, time in seconds and mask; a session is an episode. The
    session's state store must be RocksDB's (``PROVIDER``).
    """
    own = frames.select(F.col("episode").cast("long"), F.col("frame").cast("long"), F.col("index").cast("long"), F.col("time").cast("double"), F.col("mask").cast("long"))
    return own.groupBy("episode").transformWithState(Sessions(budget, seed), OUTPUT, "Append", "None")
