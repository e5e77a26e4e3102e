"""The index of frames in videos: one row for each frame and camera, with its shard and place in the video.

Rows are (index, video_key, available, chunk_index, file_index, video_frame_index), in the order of the
frame and, within it, of the camera; unavailable frames have place -1.

Defined cases: null ``available`` counts as unavailable; a frame without a camera, a camera twice in a
frame, and a camera that isn't configured are faults with a name; empty tables give empty results; more
columns are kept by ``first_frames`` and ignored by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = ["video_key", "chunk_index", "file_index"]


def _available() -> Column:
    return F.coalesce(F.col("available"), F.lit(False))


def first_frames(index: DataFrame, frames: int) -> DataFrame:
    """The rows of the frames below ``frames``; the bound reaches the scan."""
    return index.where(F.col("index") < frames)


def used_frames(index: DataFrame) -> DataFrame:
    """(video_key, chunk_index, file_index, frames): how much of each video the rows reach into."""
    return index.groupBy(*SHARD).agg(F.greatest(F.max("video_frame_index") + 1, F.lit(0)).cast("bigint").alias("frames"))


def layout_faults(index: DataFrame, cameras: list[str], frames: int) -> DataFrame:
    """(index, fault): frames whose rows aren't one for each camera, and frames out of range or absent.

    Absent frames are found as gaps between the frames that are there, so nothing is made for each
    frame that should be; a gap has one row, with its first frame.
    """
    known = F.col("video_key").isin(cameras)
    per = index.groupBy("index").agg(
        F.count(F.when(~known, 1)).alias("other"),
        F.count(F.when(known, 1)).alias("n"),
        F.countDistinct(F.when(known, F.col("video_key"))).alias("kinds"),
    )
    fault = (
        F.when(F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= frames), "out of range")
        .when(F.col("other") > 0, "unknown camera")
        .when(F.col("n") > F.col("kinds"), "camera twice")
        .when(F.col("kinds") < len(set(cameras)), "camera missing")
    )
    inside = per.where((F.col("index") >= 0) & (F.col("index") < frames)).select("index")
    # A frame whose predecessor is absent ends a gap; the gap's first frame is one after the last frame before it.
    ends = inside.select(F.col("index").alias("at")).union(inside.sparkSession.createDataFrame([(frames,)], "at long"))
    after = inside.select((F.col("index") + 1).alias("at")).union(inside.sparkSession.createDataFrame([(0,)], "at long"))
    gaps = after.join(ends, "at", "left_anti").select(F.col("at").alias("index"), F.lit("absent from here on").alias("fault"))
    return per.select("index", fault.alias("fault")).where("fault IS NOT NULL").union(gaps)


def lookup(index: DataFrame, wanted: DataFrame, cameras: list[str]) -> DataFrame:
    """``wanted`` (index, video_key, ...) with its row's position, shard, availability and place in the video.

    The position is the one in the dense table, frame times cameras plus the camera's place in ``cameras``.
    A wanted frame that isn't in the index is an error that names it.
    """
    place = F.array_position(F.array(*map(F.lit, cameras)), F.col("video_key"))
    found = index.select("index", "video_key", _available().alias("available"), "chunk_index", "file_index", "video_frame_index", F.lit(True).alias("_found"))
    absent = F.raise_error(F.concat_ws(" ", F.lit("no video row for frame"), F.col("index").cast("string"), F.lit("of"), F.col("video_key")))
    row = F.when(F.col("_found") & (place > 0), F.col("index") * len(cameras) + place - 1).otherwise(absent.cast("bigint"))
    return wanted.join(found, ["index", "video_key"], "left").withColumn("row_position", row).drop("_found")


def count_faults(index: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_key, chunk_index, file_index, rows, frames, fault): videos whose length isn't their available rows.

    ``videos`` has SHARD and ``frames``, the length that each video declares. A video that only one side
    knows and one without frames are faults as well.
    """
    rows = index.groupBy(*SHARD).agg(F.count(F.when(_available(), 1)).alias("rows"))
    both = rows.join(videos.select(*SHARD, F.col("frames").cast("bigint").alias("frames")), SHARD, "full_outer")
    fault = (
        F.when(F.col("rows").isNull(), "not in the index")
        .when(F.col("frames").isNull(), "no video")
        .when(F.col("frames") <= 0, "no frames")
        .when(F.col("rows") != F.col("frames"), "count differs")
    )
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select(*SHARD, "rows", "frames", "fault")
