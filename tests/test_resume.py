"""Repair, resumed streams, lines by byte ranges, ordered streams, manifests and the records that changed with them."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.operators import records, windows
from trajecta.sources import immutable, lines
from trajecta.sources.dataset import write_frames
from trajecta.sources.repair import repair, repair_plan
from trajecta.streaming import resume


def _frames(spark, episodes=9):
    return spark.range(episodes * 4).select(F.floor(F.col("id") / 4).alias("episode_index"), (F.col("id") % 4).alias("frame_index"), F.col("id").alias("index"), (F.col("id") * 0.5).alias("x"))


def _bytes(root):
    return {os.path.relpath(p, root): hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def _shards(names):
    return {os.path.dirname(n) for n in names}


def test_repair_writes_bad_shards_only(spark, tmp_path):
    root, frames = f"{tmp_path}/set", _frames(spark)
    assert repair(frames, f"file://{root}", 2, 2).first().asDict() == {"complete_episodes": 0, "repaired_episodes": 9, "reused_shards": 0, "rewritten_shards": 5, "extra_shards": 0}
    assert repair(frames, f"file://{root}", 2, 2).first().rewritten_shards == 0
    before = _bytes(root)
    # A file cut short, a row lost, a value changed, and a shard that isn't asked for.
    broken = glob.glob(f"{root}/chunk_index=0/file_index=1/*.parquet")[0]
    with open(broken, "r+b") as f:
        f.truncate(40)
    other = frames.withColumn("x", F.when(F.col("index") == 17, -1.0).otherwise(F.col("x"))).where("index <> 0")
    other.where("episode_index IN (0, 1, 4, 5)").withColumns({"chunk_index": F.floor(F.col("episode_index") / 4).cast("int"), "file_index": F.lit(0)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_index", "file_index").parquet(f"file://{root}")
    frames.limit(1).withColumns({"chunk_index": F.lit(7), "file_index": F.lit(1)}).write.mode("append").partitionBy("chunk_index", "file_index").parquet(f"file://{root}")
    faults = {(r.chunk_index, r.file_index) for r in repair_plan(frames, f"file://{root}", 2, 2).where("NOT complete").collect()}
    assert faults == {(0, 0), (0, 1), (1, 0), (7, 1)}
    assert repair(frames, f"file://{root}", 2, 2).first().asDict() == {"complete_episodes": 3, "repaired_episodes": 6, "reused_shards": 2, "rewritten_shards": 3, "extra_shards": 1}
    after = _bytes(root)
    for shard in ("chunk_index=1/file_index=1", "chunk_index=2/file_index=0"):
        kept = {n: h for n, h in before.items() if n.startswith(shard)}
        assert kept and kept == {n: h for n, h in after.items() if n.startswith(shard)}
    assert repair_plan(frames, f"file://{root}", 2, 2).where("NOT complete").count() == 1
    got = spark.read.parquet(f"file://{root}").where("chunk_index < 7").select(*frames.columns)
    assert got.exceptAll(frames).isEmpty() and frames.exceptAll(got).isEmpty()


def test_writer_and_repair_agree(spark, tmp_path):
    frames = _frames(spark)
    write_frames(frames, f"file://{tmp_path}/set", 2, 2)
    assert repair_plan(frames, f"file://{tmp_path}/set", 2, 2).where("NOT complete").count() == 0


def test_index_is_extended_once_also_after_a_kill(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "id bigint, ref string"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select("id", F.concat(F.lit("r"), "id").alias("ref")).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def start(after=None):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        return resume.extend_index(rows, f"{path}/index", f"{path}/state", after)

    def die(number):
        if number == 1:
            raise RuntimeError("killed between the write and its commit")

    q = start(die)
    with pytest.raises(Exception, match="killed between"):
        q.awaitTermination(120)
    assert resume.read_indexed(spark, f"{path}/index", schema).count() == 20
    assert start().awaitTermination(120)
    got = resume.read_indexed(spark, f"{path}/index", schema)
    assert sorted(r.id for r in got.collect()) == list(range(30)) and got.select("batch").distinct().count() == 3
    spark.range(30, 35).select("id", F.lit("x").alias("ref")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    assert start().awaitTermination(120)
    assert sorted(r.id for r in resume.read_indexed(spark, f"{path}/index", schema).collect()) == list(range(35))


def test_remaining_plan(spark):
    plan = spark.createDataFrame([(f"e{i}", i) for i in range(7)], "uid string, at int")
    done = spark.createDataFrame([("e1", "completed", None), ("e2", "completed", True), ("e4", "running", None), ("e9", "completed", None), ("e6", "completed", False)], "uid string, status string, failure boolean")
    got = resume.remaining_plan(plan, done, "uid", "at", 2, F.col("status") == "completed", F.col("failure")).collect()
    assert sorted((r.ordinal, r.uid, r.worker) for r in got) == [(0, "e0", 0), (2, "e2", 0), (3, "e3", 0), (4, "e4", 1), (5, "e5", 1)]


def _plain_lines(data):
    out, at = [], 0
    for raw in data.split(b"\n"):
        if raw.strip():
            out.append((at, at + len(raw) + 1, len(out), raw.decode()))
        at += len(raw) + 1
    return out


@pytest.mark.parametrize("size", [16, 50, 1 << 20])
def test_lines_equal_a_plain_read(spark, tmp_path, size):
    data = "".join(json.dumps({"id": i, "t": "é😀" * (i % 9)}, ensure_ascii=i % 2 == 0) + ("\n\n" if i % 5 == 0 else " \n" if i % 7 == 0 else "\n") for i in range(60)).encode().rstrip(b"\n")
    (tmp_path / "a.jsonl").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = f"file://{tmp_path}/a.jsonl"
        got = sorted((r.byte_start, r.byte_end, r["index"], r.value) for r in lines.numbered_lines(spark, path).collect())
        want = _plain_lines(data)
        assert [(a, b, i, v.strip()) for a, b, i, v in got] == [(a, b, i, v.strip()) for a, b, i, v in want]
        a, b = want[10][0], want[25][0]
        some = lines.read_range(spark, path, "id long, t string", a, b, start_index=100).collect()
        assert sorted((r["index"], r.id, r.byte_start) for r in some) == [(100 + k, json.loads(v)["id"], s) for k, (s, _, _, v) in enumerate(want[10:25])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_broken_line_names_its_byte(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    with pytest.raises(Exception, match="invalid JSON at byte 10 in"):
        lines.read_range(spark, f"file://{tmp_path}/b.jsonl", "id long").collect()
    assert [r.id for r in lines.read_range(spark, f"file://{tmp_path}/b.jsonl", "id long", 12).collect()] == [3]


def _stream(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "at long, k string")


def test_ordered_streams(spark):
    lead = _stream(spark, "abc")
    good = lines.merged_streams(lead, {"x": _stream(spark, "aabccc"), "y": _stream(spark, "abc")}, "k", "at")
    assert sorted((r.position, r.k, r.x_first, r.x_rows, r.y_first, r.y_rows) for r in good.collect()) == [(0, "a", 0, 2, 0, 1), (1, "b", 2, 1, 1, 1), (2, "c", 3, 3, 2, 1)]
    for keys, said in (("aab", "x ends before row 2"), ("abcd", "x goes on after the last row, at run 3"), ("acb", "x has c where b is due, at row 1"), ("abac", "x has a where c is due, at row 2|x goes on after")):
        with pytest.raises(Exception, match=said):
            lines.merged_streams(lead, {"x": _stream(spark, keys)}, "k", "at").collect()


def test_merge_by_index(spark):
    a, b = spark.createDataFrame([(0, "a"), (4, "b")], "i long, v string"), spark.createDataFrame([(2, "c")], "i long, v string")
    assert [r.v for r in lines.merge_by_index([a, b], "i").orderBy("i").collect()] == ["a", "c", "b"]
    with pytest.raises(Exception, match="strictly increasing at 4"):
        lines.merge_by_index([a, b.withColumn("i", F.lit(4).cast("long"))], "i").collect()


def test_manifest_of_sources(spark, tmp_path):
    root = tmp_path / "src"
    (root / "deep").mkdir(parents=True)
    for name, text in (("a.txt", "1"), ("deep/b.txt", "2"), ("c.txt", "3")):
        (root / name).write_text(text)
    before = spark.createDataFrame(immutable.file_manifest(spark, f"file://{root}").collect())
    assert immutable.manifest_faults(before, immutable.file_manifest(spark, f"file://{root}")).count() == 0
    (root / "a.txt").write_text("9")
    (root / "c.txt").unlink()
    (root / "deep/d.txt").write_text("4")
    faults = immutable.manifest_faults(before, immutable.file_manifest(spark, f"file://{root}")).collect()
    assert sorted(map(tuple, faults)) == [("a.txt", "changed"), ("c.txt", "missing"), ("deep/d.txt", "extra")]


def test_anchors_by_hand(spark):
    d = spark.createDataFrame([(60, 3), (60, 1), (13, 1), (21, 9), (30, 0), (24, 4)], "size long, n int")
    got = [r.a for r in d.select(records.anchor_frames(F.col("size"), F.col("n")).alias("a")).collect()]
    assert got == [[4, 28, 51], [27], [4], [4, 5, 6, 7, 8, 9, 10, 11, 12], [], [4, 8, 11, 15]]
    with pytest.raises(Exception, match="13 frames has room for 1 anchors, not 2"):
        spark.createDataFrame([(13, 2)], "size long, n int").select(records.anchor_frames(F.col("size"), F.col("n"))).collect()


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([("a", 1, "done", 3), ("b", 2, "open", 1)], "id string, scene int, status string, attempts int")
    new = spark.createDataFrame([("a", 7, 1), ("c", 8, 2), ("c", 9, 3), ("b", None, 4)], "id string, scene int, at int")
    got = records.upsert(old, new, ["id"], "at", {"status": F.lit("pending"), "attempts": F.lit(0)})
    assert got.columns == old.columns
    assert sorted(map(tuple, got.collect())) == [("a", 7, "done", 3), ("b", None, "open", 1), ("c", 9, "pending", 0)]


def test_group_key_is_json(spark):
    d = spark.createDataFrame([("town é", 5, None, 'q"\\😀'), (None, None, 2.5, "")], "a string, b int, c double, d string")
    got = [r.k for r in d.select(records.group_key(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k")).collect()]
    assert got == [json.dumps(x, separators=(",", ":")) for x in (["town é", 5, None, 'q"\\😀'], [None, None, 2.5, ""])]


def test_dynamics_snap_and_refuse(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 5e-8, 0.0, 0.0, 0.0, 1.0), (1, 2, 1.0, 0.0, 0.0, 0.0, 2.0)]
    schema = "episode long, frame long, x double, y double, z double, yaw double, sec double"
    got = windows.dynamics(spark.createDataFrame(rows, schema), "sec").orderBy("frame").collect()
    assert [r.velocity for r in got][:2] == [0.0, 0.0] and abs(got[2].velocity - 1.0) < 1e-6
    with pytest.raises(Exception, match="must be finite"):
        windows.dynamics(spark.createDataFrame([*rows, (1, 3, float("inf"), 0.0, 0.0, 0.0, 3.0)], schema), "sec").collect()
    assert spark.range(1).select(G.finite_number(F.lit(1e-8)).alias("v")).first().v == 0.0
