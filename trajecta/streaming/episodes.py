"""Running episodes: a state machine for each, which gives one record when the episode ends.

An episode ends with a step that says stop, with a collision, with the last step allowed, or when event
time passes its last step by a gap. Later rows of an ended episode change nothing. ``finished_episodes``
says the same of a whole table.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "episode long, reason string, steps long, path_length double, oracle boolean, success boolean, ended timestamp"
_STATE = "x double, y double, z double, steps long, path double, oracle boolean, near boolean, at long, over boolean"


class Loop(StatefulProcessor):
    def __init__(self, limit: int, radius: float, gap_ms: int):
        self._limit, self._radius, self._gap = limit, radius, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._now = handle.getValueState("now", _STATE)

    def _record(self, key: tuple, s: tuple, reason: str) -> Row:
        ended = datetime.datetime.fromtimestamp(0, datetime.UTC).replace(tzinfo=None) + datetime.timedelta(microseconds=s[7])
        return Row(episode=key[0], reason=reason, steps=s[3], path_length=s[4], oracle=s[5], success=reason == "stop" and s[6], ended=ended)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        s = self._now.get()
        s = tuple(s) if s is not None else None
        for r in sorted(rows, key=lambda r: (r.us, r.step)):
            if s is not None and s[8]:
                break
            moved = 0.0 if s is None else math.sqrt((r.x - s[0]) ** 2 + (r.y - s[1]) ** 2 + (r.z - s[2]) ** 2)
            near = math.sqrt((r.x - r.goal_x) ** 2 + (r.y - r.goal_y) ** 2 + (r.z - r.goal_z) ** 2) <= self._radius
            steps = 1 if s is None else s[3] + 1
            reason = "stop" if r.stop else "collision" if r.collided else "max_steps" if steps >= self._limit else None
            s = (r.x, r.y, r.z, steps, (0.0 if s is None else s[4]) + moved, near or (s is not None and s[5]), near, r.us, reason is not None)
            if reason:
                yield self._record(key, s, reason)
        self._now.update(s)
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        if not s[8]:
            self._handle.registerTimer(s[7] // 1000 + self._gap)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        s = self._now.get()
        if s is not None and not s[8]:
            s = tuple(s)
            self._now.update((*s[:8], True))
            yield self._record(key, s, "timeout")

    def close(self) -> None:
        pass


_COLUMNS = ("episode", "step", "ts", "x", "y", "z", "goal_x", "goal_y", "goal_z", "stop", "collided")


def watch_episodes(steps: DataFrame, limit: int, radius: float, gap: datetime.timedelta, late: str) -> DataFrame:
    """(episode, reason, steps, path_length, oracle, success, ended) of a stream of steps, as episodes end.

    ``steps`` has episode, step, ts, x, y, z, the goal and the flags stop and collided. An episode's rows
    of one batch are taken in order of time; rows later than ``late`` are dropped. The state store must be RocksDB's.
    """
    own = steps.select(*_COLUMNS, F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return own.groupBy("episode").transformWithState(Loop(limit, radius, int(gap.total_seconds() * 1000)), OUTPUT, "Append", "EventTime")


def finished_episodes(steps: DataFrame, limit: int, radius: float) -> DataFrame:
    """The same records of a whole table; ``reason`` is timeout where no step ends the episode."""
    w = Window.partitionBy("episode").orderBy("ts", "step")

    def distance(*pairs: tuple[Column, Column]) -> Column:
        return F.sqrt(sum((a - b) * (a - b) for a, b in pairs[1:]) + (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1]))

    moved = F.coalesce(distance(*[(F.col(c), F.lag(c).over(w)) for c in "xyz"]), F.lit(0.0))
    near = distance(*[(F.col(c), F.col(f"goal_{c}")) for c in "xyz"]) <= radius
    d = steps.select(*_COLUMNS).withColumns({"_n": F.row_number().over(w), "_moved": moved, "_near": near})
    reason = F.when(F.col("stop"), "stop").when(F.col("collided"), "collision").when(F.col("_n") >= limit, "max_steps")
    d = d.withColumn("_reason", reason).withColumn("_over", F.coalesce(F.max(F.col("_reason").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("NOT _over")
    found = d.groupBy("episode").agg(F.coalesce(F.max("_reason"), F.lit("timeout")).alias("reason"), F.count("*").alias("steps"), F.sum("_moved").alias("path_length"), F.max("_near").alias("oracle"), F.max_by("_near", F.struct("ts", "step")).alias("_near"), F.max("ts").alias("ended"))
    return found.select("episode", "reason", "steps", "path_length", "oracle", ((F.col("reason") == "stop") & F.col("_near")).alias("success"), "ended")
