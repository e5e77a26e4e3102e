"""Queries of the video index: events are frames, each seen by a front and a rear camera; errors have no rear picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators import video_index, windows
from trajecta.plans.registry import Tables, query

CAMERAS = ["front", "rear"]
_INDEX = """v AS (SELECT event_id AS "index", video_key, event_type <> 'error' OR video_key = 'front' AS available, event_id // 1000 AS chunk_index, event_id // 100 % 10 AS file_index FROM events, (VALUES ('front'), ('rear')) c(video_key)),
i AS (SELECT *, CASE WHEN available THEN count(*) FILTER (available) OVER (PARTITION BY video_key, chunk_index, file_index ORDER BY "index") - 1 ELSE -1 END AS video_frame_index FROM v)"""


def _index(t: Tables) -> DataFrame:
    at, key = F.col("event_id"), F.explode(F.array(*map(F.lit, CAMERAS))).alias("video_key")
    shard = [F.floor(at / 1000).cast("bigint").alias("chunk_index"), (F.floor(at / 100) % 10).cast("bigint").alias("file_index")]
    rows = t.events.select(at.alias("index"), "event_type", key, *shard)
    rows = rows.withColumn("available", (F.col("event_type") != "error") | (F.col("video_key") == "front")).drop("event_type")
    return windows.running_offset(rows, video_index.SHARD, ["index"], F.col("available"), "video_frame_index")


@query(f"""WITH {_INDEX} SELECT event_id, i.video_key, chunk_index, file_index, available, video_frame_index, i."index" * 2 + CASE i.video_key WHEN 'front' THEN 0 ELSE 1 END AS row_position FROM events e JOIN i ON i."index" = e.event_id WHERE e.value > 50 AND i.video_key = CASE WHEN e.event_type = 'view' THEN 'front' ELSE 'rear' END""")
def video_lookup(t: Tables) -> DataFrame:
    wanted = t.events.where("value > 50").select(F.col("event_id").alias("index"), F.when(F.col("event_type") == "view", "front").otherwise("rear").alias("video_key"))
    return video_index.lookup(_index(t), wanted, CAMERAS).withColumnRenamed("index", "event_id")


@query(f"""WITH {_INDEX}, n AS (SELECT count(*) // 2 AS half FROM events) SELECT video_key, chunk_index, file_index, max(video_frame_index) + 1 AS frames FROM i, n WHERE "index" < half GROUP BY ALL""")
def video_subset(t: Tables) -> DataFrame:
    half = t.events.count() // 2
    return video_index.used_frames(video_index.first_frames(_index(t), half))


@query(f"""WITH {_INDEX}, r AS (SELECT video_key, chunk_index, file_index, count(*) FILTER (available) AS "rows" FROM i GROUP BY ALL), d AS (SELECT video_key, event_id // 1000 AS chunk_index, event_id // 100 % 10 AS file_index, count(*) AS frames FROM events, (VALUES ('front'), ('rear')) c(video_key) WHERE event_type <> 'signup' OR video_key = 'front' GROUP BY ALL)
SELECT video_key, chunk_index, file_index, "rows", frames, 'count differs' AS fault FROM r JOIN d USING (video_key, chunk_index, file_index) WHERE "rows" <> frames""")
def video_count_faults(t: Tables) -> DataFrame:
    index = _index(t)
    videos = index.join(t.events.select(F.col("event_id").alias("index"), "event_type"), "index").where("event_type != 'signup' OR video_key = 'front'")
    return video_index.count_faults(index, videos.groupBy(*video_index.SHARD).agg(F.count("*").alias("frames")))
