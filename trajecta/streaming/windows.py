"""Streams: event-time windows, and sessions that reject what comes out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str, by: str) -> DataFrame:
    """Count and sum per window and key; rows later than ``late`` are dropped by the watermark."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions_in_order(events: DataFrame) -> DataFrame:
    """(user_id, frame, ts, total, error): a running state per user.

    Rows of a batch are taken in time order; one that is older than the last accepted row is given
    out as an error and leaves the state alone.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, frame, total = state.get if state.exists else (-1, -1, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            at = int(ts.value // 1000)
            late = at < last
            if not late:
                last, frame, total = at, frame + 1, total + float(value)
            out.append((key[0], frame, ts, total, late))
        state.update((last, frame, total))
        yield pd.DataFrame(out, columns=["user_id", "frame", "ts", "total", "error"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, frame long, ts timestamp, total double, error boolean", "last long, frame long, total double", "append", GroupStateTimeout.NoTimeout)
