"""The video index: faults of its layout, lookups and video lengths."""

from __future__ import annotations

import pytest

from trajecta.operators import video_index

INDEX = "index long, video_key string, available boolean, chunk_index long, file_index long, video_frame_index long"


def _rows(frames):
    return [(i, c, True, 0, 0, i) for i in frames for c in ("a", "b")]


def test_layout_faults_are_named(spark):
    rows = _rows([0, 1, 4, 5]) + [(1, "a", True, 0, 0, 9), (4, "x", True, 0, 0, 0), (9, "a", True, 0, 0, 0), (None, "a", True, 0, 0, 0)]
    rows = [r for r in rows if r[:2] != (5, "b")]
    got = video_index.layout_faults(spark.createDataFrame(rows, INDEX), ["a", "b"], 8).collect()
    want = [(1, "camera twice"), (2, "absent from here on"), (4, "unknown camera"), (5, "camera missing"), (6, "absent from here on"), (9, "out of range"), (None, "out of range")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert video_index.layout_faults(spark.createDataFrame(_rows(range(8)), INDEX), ["a", "b"], 8).count() == 0
    empty = spark.createDataFrame([], INDEX)
    assert [tuple(r) for r in video_index.layout_faults(empty, ["a"], 3).collect()] == [(0, "absent from here on")]
    assert video_index.layout_faults(empty, ["a"], 0).count() == 0


def test_lookup_gives_the_dense_position_and_names_what_is_absent(spark):
    index = spark.createDataFrame(_rows(range(4)) + [(4, "a", None, 1, 0, -1)], INDEX)
    wanted = spark.createDataFrame([(3, "b", "q"), (4, "a", "r"), (3, "b", "s")], "index long, video_key string, note string")
    got = {r.note: (r.row_position, r.available, r.video_frame_index) for r in video_index.lookup(index, wanted, ["a", "b"]).collect()}
    assert got == {"q": (7, True, 3), "r": (8, False, -1), "s": (7, True, 3)}
    with pytest.raises(Exception, match="no video row for frame 4 of b"):
        video_index.lookup(index, spark.createDataFrame([(4, "b")], "index long, video_key string"), ["a", "b"]).collect()


def test_count_faults(spark):
    rows = [(i, "a", i != 2, 0, f, i) for f in range(4) for i in range(3)]
    videos = [("a", 0, 0, 2), ("a", 0, 1, 3), ("a", 0, 2, 0), ("b", 0, 0, 5)]
    got = video_index.count_faults(spark.createDataFrame(rows, INDEX), spark.createDataFrame(videos, "video_key string, chunk_index long, file_index long, frames int")).collect()
    assert sorted((r.video_key, r.file_index, r.rows, r.frames, r.fault) for r in got if r.rows) == [("a", 1, 2, 3, "count differs"), ("a", 2, 2, 0, "no frames"), ("a", 3, 2, None, "no video")]
    assert [(r.video_key, r.frames, r.fault) for r in got if r.rows is None] == [("b", 5, "not in the index")]


def test_subset(spark):
    index = spark.createDataFrame(_rows(range(4)) + [(0, "c", False, 0, 0, -1)], INDEX)
    got = video_index.used_frames(video_index.first_frames(index, 3)).collect()
    assert sorted((r.video_key, r.frames) for r in got) == [("a", 3), ("b", 3), ("c", 0)]
