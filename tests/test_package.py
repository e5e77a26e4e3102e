import math

import pytest
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.operators import batches, package, windows

POSES = "episode long, frame long, x double, y double, z double, yaw double"


def reasons(df, *place):
    return sorted(tuple(r[p] for p in (*place, "reason")) for r in df.collect())


def test_first_frame_local_literal(spark):
    poses = spark.createDataFrame([(0, 0, 10.0, 20.0, -4.0, math.pi / 2), (0, 1, 10.0, 22.0, -3.0, math.pi / 2)], POSES)
    got = [tuple(r.local) for r in windows.local_poses(poses).orderBy("frame").collect()]
    assert got[0] == (0, 0, 0, 0) and got[1] == pytest.approx((2, 0, 1, 0))


def test_quaternion_error_ignores_sign_and_length(spark):
    row = spark.sql("SELECT named_struct('w', 1D, 'x', 0D, 'y', 0D, 'z', 0D) a, named_struct('w', -2D, 'x', 0D, 'y', 0D, 'z', 0D) b, named_struct('w', 0D, 'x', 0D, 'y', 0D, 'z', 0D) c").select(G.quaternion_error(F.col("a"), F.col("b")), G.quaternion_error(F.col("a"), F.col("c"))).first()
    assert row[0] == 0 and row[1] == math.inf


def test_frame_rate(spark):
    rows = spark.createDataFrame([("30000/1001",), ("25",), ("x",), ("5/0",), (None,)], "r string").select(G.frame_rate(F.col("r"))).collect()
    assert rows[0][0] == pytest.approx(29.97003) and [r[0] for r in rows[1:]] == [25.0, None, None, None]


def test_empty_tables(spark):
    poses = spark.createDataFrame([], POSES)
    counts = spark.createDataFrame([], "k long, n long")
    assert windows.local_poses(poses).count() == 0 and batches.relative_states(poses, 3).count() == 0 and package.step_metrics(poses, 0.1).count() == 0
    assert batches.strided_indices(counts, "k", "n", 2).count() == 0 and batches.random_gaps(counts, "k", "n", [1, 2], "s").count() == 0
    assert batches.representative_pair(spark.createDataFrame([], "k long, s string, n long"), "k", "s", "n").count() == 0


def test_strides_hold_the_last_place_and_skip_empty_episodes(spark):
    counts = spark.createDataFrame([(1, 1), (2, 4), (3, 0), (4, None)], "k long, n long")
    assert sorted(map(tuple, batches.strided_indices(counts, "k", "n", 2).collect())) == [(1, 0), (2, 0), (2, 2), (2, 3)]
    assert {r.position for r in batches.random_gaps(counts, "k", "n", [1], "s").where("k = 2").collect()} == {0, 1, 2, 3}


def test_representative_pair_against_all_pairs(spark):
    rows = [(i, "abc"[i * i % 3], (i * 37) % 23) for i in range(40)]
    got = batches.representative_pair(spark.createDataFrame(rows, "k long, s string, n long"), "k", "s", "n").first()
    assert got.span == max(a[2] - b[2] for a in rows for b in rows if a[1] != b[1])
    assert rows[got.long_key][1] != rows[got.short_key][1] and rows[got.long_key][2] - rows[got.short_key][2] == got.span


def test_gather_keeps_order_and_repeats(spark):
    samples = spark.createDataFrame([(1, ["b", "a", "b", "z"])], "k long, refs array<string>")
    index = spark.createDataFrame([("a", 1), ("b", 2)], "ref string, n long")
    assert [v and v.n for v in batches.gather(samples, "k", "refs", index, "ref", ["n"]).first()["items"]] == [2, 1, 2, None]


def test_trace_and_presence_faults(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 1.0, 2.0), (1, 1, 1.0, 2.0, 9.0), (1, 3, 1.0, 3.0, 0.0)], "k long, i long, s double, x double, nx double")
    assert reasons(package.trace_faults(t, "k", "i", "s", ["x"], ["nx"]), "i") == [(1, "next_place"), (3, "index"), (3, "time")]
    declared = spark.createDataFrame([(1, 4), (2, 3)], "k long, n long")
    have = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (2, 3), (3, 0)], "k long, i long")
    assert reasons(package.presence_faults(have, declared, "k", "i", "n"), "k", "i") == [(2, 2, "gap_before"), (2, 3, "beyond_end"), (2, 3, "gap_before"), (3, 0, "undeclared_episode")]


def test_stream_faults(spark):
    episodes = spark.createDataFrame([(1, 5, [0, 2, 4, 5]), (2, 3, [1, 3]), (3, 2, [0, 2]), (4, 9, [])], "episode long, terminal long, schedule array<long>")
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate([0, 2, 4, 5])] + [(2, 0, 1), (2, 1, 3), (3, 0, 0), (3, 1, 1), (3, 2, 2)], "episode long, image long, waypoint long")
    got = reasons(package.stream_faults(episodes, rows, rows.where("NOT (episode = 1 AND image = 3)"), [2]), "episode", "reason")
    assert {g[:2] for g in got} == {(1, "requests_missing"), (2, "start"), (3, "images_waypoint"), (3, "requests_waypoint"), (3, "unplanned"), (4, "start")}


def test_request_faults_take_null_as_broken(spark):
    schema = "id long, position array<double>, quaternion array<double>, width int, height int, channels int"
    rows = spark.createDataFrame([(1, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], 2, 2, 3), (2, None, [2.0, 0.0, 0.0, 0.0], 0, 2, 3), (3, [0.0, 0.0, None], None, 1, None, None)], schema)
    assert reasons(package.request_faults(rows, ["id"]), "id") == [(2, "position"), (2, "size"), (2, "unit"), (3, "channels"), (3, "position"), (3, "quaternion"), (3, "size")]
