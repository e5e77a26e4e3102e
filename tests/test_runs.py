"""Episode loops as streams and batches, and action errors that merge."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import SF
from trajecta.operators import errors
from trajecta.plans.registry import Tables
from trajecta.plans.run_queries import loop_steps
from trajecta.streaming import episodes
from trajecta.streaming.sessions import PROVIDER

STEP = "episode long, step long, ts timestamp, x double, y double, z double, goal_x double, goal_y double, goal_z double, stop boolean, collided boolean"


def _row(episode, step, second, x, stop=False, collided=False):
    return (episode, step, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second), float(x), 0.0, 0.0, 10.0, 0.0, 0.0, stop, collided)


def _plain(rows):
    return sorted((r.episode, r.reason, r.steps, round(r.path_length, 9), r.oracle, r.success, r.ended) for r in rows)


ROWS = [_row(1, 0, 0, 0), _row(1, 1, 1, 9), _row(1, 2, 2, 14, stop=True), _row(1, 3, 3, 10), _row(2, 0, 0, 0), _row(2, 1, 1, 9.5, stop=True, collided=True), _row(3, 0, 0, 5, collided=True), _row(3, 1, 1, 10, stop=True), *[_row(4, i, i, i) for i in range(9)], _row(5, 0, 0, 10), _row(5, 1, 2, 3)]
WANT = [(1, "stop", 3, 14.0, True, False), (2, "stop", 2, 9.5, True, True), (3, "collision", 1, 0.0, False, False), (4, "max_steps", 6, 5.0, False, False), (5, "timeout", 2, 7.0, True, False)]


def test_finished_episodes_by_hand(spark):
    got = episodes.finished_episodes(spark.createDataFrame(ROWS, STEP).repartition(3), 6, 1.0).collect()
    assert [r[:6] for r in _plain(got)] == WANT
    assert episodes.finished_episodes(spark.createDataFrame([], STEP), 6, 1.0).count() == 0


def _watch(spark, path, parts, limit, radius, gap):
    """Run a stream over files that come one by one, with a restart between them, and a far later row that lets timers run out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for i, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
            q = episodes.watch_episodes(stream, limit, radius, gap, "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            assert q.awaitTermination(240), i
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{path}/out")


def test_loop_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, STEP)
    late = [_row(99, 0, 40 * 86400, 0)]
    parts = [rows.where("step < 1"), rows.where("step >= 1"), spark.createDataFrame(late, STEP), spark.createDataFrame([_row(99, 1, 41 * 86400, 0)], STEP)]
    got = _watch(spark, f"file://{tmp_path}", parts, 6, 1.0, datetime.timedelta(days=5)).where("episode < 99").collect()
    assert [r[:6] for r in _plain(got)] == WANT
    assert _plain(got) == _plain(episodes.finished_episodes(rows, 6, 1.0).collect())


def test_loop_of_events(spark, tmp_path):
    rows = loop_steps(Tables(spark, SF))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    after = [rows.limit(1).withColumns({"episode": F.lit(-1).cast("bigint"), "ts": F.lit(last + datetime.timedelta(days=400 + k))}) for k in range(2)]
    parts = [rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle), *after]
    got = _watch(spark, f"file://{tmp_path}", parts, 40, 5.0, datetime.timedelta(days=300)).where("episode >= 0").collect()
    assert _plain(got) == _plain(episodes.finished_episodes(rows, 40, 5.0).collect()) and len(got) > 10


def _made(spark, n=12, horizon=5, dims=5):
    r = np.random.default_rng(3)
    rows, kept = [], []
    for i in range(n):
        a, b, c, d = (r.normal(0, 2, (horizon, dims)) for _ in range(4))
        pad = [bool(h >= r.integers(0, horizon + 1)) for h in range(horizon)]
        rows.append((i % 2, i % 3, a.tolist(), b.tolist(), c.tolist(), d.tolist(), pad))
        kept.append((i % 2, a, b, c, d, pad))
    schema = "dataset int, rank int, " + ", ".join(f"{x} array<array<double>>" for x in ("predicted", "target", "raw_predicted", "raw_target")) + ", padding array<boolean>"
    return spark.createDataFrame(rows, schema), kept


def test_errors_equal_a_plain_sum_however_merged(spark):
    chunks, kept = _made(spark)
    steps = errors.action_steps(chunks, ["dataset", "rank"], 5)
    merged = errors.merged_sums(errors.error_sums(steps, ["dataset", "rank", "h"], 5).drop("rank", "h"), ["dataset"])
    direct = errors.error_sums(steps, ["dataset"], 5)
    for r, s in zip(errors.finished(merged, ["dataset"], 5).orderBy("dataset").collect(), errors.finished(direct, ["dataset"], 5).orderBy("dataset").collect(), strict=True):
        assert r.asDict() == pytest.approx(s.asDict())
        raw, norm, ends = [], [], []
        for dataset, a, b, c, d, pad in kept:
            if dataset != r.dataset:
                continue
            diff = c - d
            diff[:, 3] = (diff[:, 3] + math.pi) % (2 * math.pi) - math.pi
            valid = [h for h, p in enumerate(pad) if not p]
            raw += [diff[h] for h in valid]
            norm += [(a - b)[h] for h in valid]
            ends += [np.linalg.norm(diff[valid[-1], :3])] if valid else []
        raw, norm = np.array(raw), np.array(norm)
        assert r.mse == pytest.approx((norm**2).mean()) and r.waypoints == len(raw) and r.frames == len(ends)
        for i, n in enumerate(errors.dimension_names(5)):
            assert r[f"mae_{n}"] == pytest.approx(np.abs(raw[:, i]).mean()) and r[f"rmse_{n}"] == pytest.approx(math.sqrt((raw[:, i] ** 2).mean()))
        assert r.translation_l2 == pytest.approx(np.linalg.norm(raw[:, :3], axis=1).mean()) and r.yaw_abs == pytest.approx(np.abs(raw[:, 3]).mean()) and r.endpoint == pytest.approx(np.mean(ends))


def test_errors_of_odd_chunks(spark):
    chunks, _ = _made(spark, 2)
    padded = chunks.withColumn("padding", F.transform("padding", lambda p: F.lit(True)))
    assert errors.error_sums(errors.action_steps(padded, ["dataset"], 5), ["dataset"], 5).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        errors.action_steps(chunks.withColumn("padding", F.slice("padding", 1, 2)), ["dataset"], 5).collect()
