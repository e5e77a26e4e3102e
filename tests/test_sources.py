import json

import pytest
from pyspark.sql import functions as F

from trajecta.sources import adapters, dataset


def test_shards_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    frames = spark.range(60).select((F.col("id") / 2).cast("long").alias("episode_index"), (F.col("id") % 2).alias("frame_index"), F.col("id").alias("index"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("action"))
    dataset.write_frames(frames, root, 5, 2)
    back = dataset.read_shards(spark, root, "episode_index long, frame_index long, index long, action array<double>")
    assert back.count() == 60 and {(r.chunk_index, r.file_index) for r in back.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)}
    assert dataset.rows_between(back, 10, 19).count() == 10
    dataset.write_statistics(frames, "action", "d", f"{root}-stats")
    row = spark.read.json(f"{root}-stats").first()
    assert row["mean"] == [29.5, 1.0] and row.num_transitions == 60


def test_adapters(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    a = put("a.json", json.dumps({"episode_id": "e", "instruction": " go\n on ", "frames": [{"frame_index": 0, "state": [1, 2, 3, 4]}]}))
    assert tuple(adapters.ADAPTERS["episode_json"](spark, a).first()) == ("e", 0, 1.0, 2.0, 3.0, 4.0, "go on")
    b = put("b.json", json.dumps({"episodes": [{"episode_id": "1", "trajectory_id": "t", "scene_id": 3, "instruction": {"instruction_text": "x"}, "reference_path": [[1, 2, 3, 0, 0, 0.5]]}]}))
    r = adapters.ADAPTERS["reference_paths"](spark, b).first()
    assert (r.x, r.y, r.z) == (1, -2, -3) and r.yaw == pytest.approx(-0.5)
    c = put("c.jsonl", json.dumps({"dataset_family": "r2r", "split": "val_seen", "episode_id": "10", "instruction_text": "y", "frame_index": 2, "position": [1, 2, 3], "yaw": 0.1}) + "\n\n")
    with pytest.raises(Exception, match="alformed"):
        adapters.ADAPTERS["manifest_lines"](spark, put("bad.jsonl", "not json\n")).collect()
    r = adapters.ADAPTERS["manifest_lines"](spark, c).collect()
    assert len(r) == 1 and r[0].episode_id == "r2r_val_seen_10" and (r[0].x, r[0].y, r[0].z) == (-3, -1, 2)
    d = put("d.jsonl", json.dumps({"episode_id": "q", "conversations": [{"from": "gpt", "value": "no"}, {"from": "human", "value": "fly"}], "states": [[100, 0, -50, 90]]}))
    r = adapters.ADAPTERS["dialogue_lines"](spark, d).first()
    assert (r.x, r.z, r.instruction) == (1, 0.5, "fly")
    e = put("e.csv", "episode_id,frame_index,x,y,z,yaw,instruction\ne,0,1e-9,2,3,0,hi\n")
    assert adapters.ADAPTERS["pose_csv"](spark, e).first().x == 0
    with pytest.raises(ValueError):
        adapters.adapter("pose_csv")(lambda s, p: None)


def test_column_contract(spark):
    assert dataset.required_columns(spark.range(1), ["id", "x"], ["id"]) == ["missing x", "forbidden id"]


def test_point_paths(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"folder": "a", "task_desc": "go", "gt_traj": [[0, 0, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]], "start_rot": [0, 0, 0.25]}, {"folder": "b", "task_desc": "stay", "gt_traj": [[0, 0, 0]], "start_rot": [0, 0, 0.5]}]))
    got = {(r.episode_id, r.frame_index): r.yaw for r in adapters.ADAPTERS["point_paths"](spark, f"file://{tmp_path}/p.json").collect()}
    half = pytest.approx(1.5707963)
    assert got == {("a", 0): 0.25, ("a", 1): 0, ("a", 2): half, ("a", 3): half, ("b", 0): 0.5}


def test_annotated_images(spark, tmp_path):
    episode = lambda name, ids, **more: {"image_path": name, "gpt_instruction": " go ", "action": [1] * len(ids), "index_list": ids, "pos": [[1, 2, 3]] * len(ids), "yaw": [0.5] * len(ids)} | more
    (tmp_path / "annotations.json").write_text(json.dumps([episode("s/whole", ["i0", "i1"]), episode("s/gap", ["i0", "i9"]), episode("s/empty", ["i0", "i2"]), episode("s/uneven", ["i0", "i1"], yaw=[0.5]), episode("s/short", ["i0"]), episode("s/none", []), episode("s/turned", ["i0", "i1"], pos=[[1, 2, 3, 0.5], [1, 2, 3, 0.6]])]))
    for name in ("whole", "gap", "empty", "uneven", "short", "turned"):
        spark.createDataFrame([("i0", b"x"), ("i1", b"y"), ("i2", None)], "image_id string, image binary").write.parquet(f"file://{tmp_path}/images/s/{name}")
    frames, rejects = adapters.annotated_image_rows(spark, f"file://{tmp_path}")
    assert [(r.episode_id, r.frame_index, r.x, r.yaw, r.instruction) for r in frames.orderBy("frame_index").collect()] == [("s/whole", 0, 1, 0.5, "go"), ("s/whole", 1, 1, 0.5, "go")]
    assert {r.episode_id: r.failure for r in rejects.collect()} == {"s/gap": "missing image row", "s/empty": "missing image bytes", "s/uneven": "lists of different lengths", "s/short": "less than two frames", "s/none": "less than two frames", "s/turned": "position and yaw differ"}


def test_keyframe_tables(spark, tmp_path):
    tables = {
        "scene": [{"name": "one", "description": "rain", "first_sample_token": "c"}],
        "sample": [{"token": "a", "next": ""}, {"token": "b", "next": "a"}, {"token": "c", "next": "b"}, {"token": "z", "next": ""}],
        "sensor": [{"token": "l", "channel": "LIDAR_TOP"}, {"token": "k", "channel": "CAM_FRONT"}],
        "calibrated_sensor": [{"token": "cl", "sensor_token": "l"}, {"token": "ck", "sensor_token": "k"}],
        "sample_data": [{"sample_token": s, "ego_pose_token": p, "calibrated_sensor_token": c, "is_key_frame": key} for s, p, c, key in (("a", "p3", "cl", True), ("b", "p2", "cl", True), ("c", "p1", "cl", True), ("c", "p9", "ck", True), ("c", "p9", "cl", False))],
        "ego_pose": [{"token": f"p{i}", "translation": [i, 0, 0], "rotation": [1, 0, 0, 0]} for i in (1, 2, 3, 9)],
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = adapters.ADAPTERS["keyframe_tables"](spark, f"file://{tmp_path}").orderBy("frame_index").collect()
    assert [(r.episode_id, r.frame_index, r.x) for r in got] == [("one", 0, 1), ("one", 1, 2), ("one", 2, 3)]
