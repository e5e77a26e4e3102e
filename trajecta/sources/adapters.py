"""Source adapters: raw layouts to frames (episode_id, frame_index, x, y, z, yaw, instruction).

Adapters register by name; each takes a session and a path and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.functions.strings import normalise_text
from trajecta.operators.chains import linked_order
from trajecta.operators.quality import first_failure
from trajecta.operators.windows import tangent_yaw

from .dataset import read_document, read_lines

Adapter = Callable[[SparkSession, str], DataFrame]
ADAPTERS: dict[str, Adapter] = {}


def adapter(name: str) -> Callable[[Adapter], Adapter]:
    def register(f: Adapter) -> Adapter:
        if name in ADAPTERS:
            raise ValueError(f"{name} is registered")
        ADAPTERS[name] = f
        return f

    return register


def _frames(df: DataFrame, pose: Column, instruction: Column) -> DataFrame:
    return df.select("episode_id", F.col("frame_index").cast("bigint").alias("frame_index"), pose.alias("p"), instruction.alias("instruction")).select("episode_id", "frame_index", "p.*", "instruction")


@adapter("episode_json")
def episode_json(spark: SparkSession, path: str) -> DataFrame:
    """One document per episode with a list of framed states (x, y, z, yaw)."""
    docs = read_document(spark, path, "episode_id string, instruction string, frames array<struct<frame_index:bigint,state:array<double>>>")
    rows = docs.select("episode_id", "instruction", F.explode("frames").alias("f"))
    s = F.col("f.state")
    return _frames(rows.withColumn("frame_index", F.col("f.frame_index")), G.pose(s[0], s[1], s[2], s[3]), normalise_text(F.col("instruction")))


@adapter("reference_paths")
def reference_paths(spark: SparkSession, path: str) -> DataFrame:
    """One document with many episodes, each a path of (x, y, z, roll, pitch, yaw); z points down."""
    docs = read_document(spark, path, "episodes array<struct<episode_id:string,trajectory_id:string,scene_id:bigint,instruction:struct<instruction_text:string>,reference_path:array<array<double>>>>")
    rows = docs.select(F.explode("episodes").alias("e")).select("e.episode_id", "e.instruction.instruction_text", F.posexplode("e.reference_path").alias("frame_index", "r"))
    r = F.col("r")
    return _frames(rows, G.pose(r[0], -r[1], -r[2], G.wrap_angle(-r[5])), normalise_text(F.col("instruction_text")))


@adapter("manifest_lines")
def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """One line per frame with a y-up position and a yaw; the episode's name is family, split and number."""
    rows = read_lines(spark, path, "dataset_family string, split string, episode_id string, instruction_text string, frame_index bigint, position array<double>, yaw double")
    p = F.col("position")
    named = rows.withColumn("episode_id", F.concat_ws("_", "dataset_family", "split", "episode_id"))
    q = G.axes_permuted(p[0], p[1], p[2])
    return _frames(named, G.pose(q["x"], q["y"], q["z"], F.col("yaw")), normalise_text(F.col("instruction_text")))


@adapter("dialogue_lines")
def dialogue_lines(spark: SparkSession, path: str) -> DataFrame:
    """One line per episode: states in centimetres and degrees, the instruction as the first human turn."""
    rows = read_lines(spark, path, "episode_id string, conversations array<struct<`from`:string,value:string>>, states array<array<double>>")
    said = F.filter("conversations", lambda t: t["from"] == "human")[0]["value"]
    flat = rows.select("episode_id", said.alias("said"), F.posexplode("states").alias("frame_index", "s"))
    s = F.col("s")
    return _frames(flat, G.centimetres_reflected(s[0], s[1], s[2], s[3]), normalise_text(F.col("said")))


@adapter("pose_csv")
def pose_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("episode_id string, frame_index bigint, x double, y double, z double, yaw double, instruction string").option("header", "true").csv(path)
    return _frames(rows, G.pose(*[G.clean_number(F.col(c)) for c in ("x", "y", "z", "yaw")]), normalise_text(F.col("instruction")))


@adapter("point_paths")
def point_paths(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a path of points (x, y, z) each; the yaw is that of the path, from the start's (roll, pitch, yaw)."""
    docs = read_document(spark, path, "folder string, task_desc string, gt_traj array<array<double>>, start_rot array<double>")
    rows = docs.select(F.col("folder").alias("episode"), "task_desc", F.col("start_rot")[2].alias("start"), F.posexplode("gt_traj").alias("frame", "p"))
    p = F.col("p")
    made = tangent_yaw(rows.select("episode", "task_desc", "start", "frame", p[0].alias("x"), p[1].alias("y"), p[2].alias("z")), F.col("start"))
    named = made.select(F.col("episode").alias("episode_id"), F.col("frame").alias("frame_index"), "x", "y", "z", "yaw", "task_desc")
    return _frames(named, G.pose(*map(F.col, ("x", "y", "z", "yaw"))), normalise_text(F.col("task_desc")))


def annotated_image_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of ``annotations.json`` and the image tables under ``images/<episode>/``.

    An annotation names its images in order beside a position and a yaw for each. One missing row, or
    one without bytes, rejects the whole episode; so do lists of different lengths or of less than two
    frames, or a fourth coordinate that isn't the yaw. rejects: (episode_id, failed_at, failure).
    """
    docs = read_document(spark, f"{path}/annotations.json", "image_path string, gpt_instruction string, action array<bigint>, index_list array<string>, pos array<array<double>>, yaw array<double>")
    size = F.size("index_list")
    uneven = (size != F.size("pos")) | (size != F.size("yaw")) | (size != F.size("action"))
    docs = docs.withColumns({"uneven": F.coalesce(uneven, F.lit(True)), "short": F.coalesce(size < 2, F.lit(True))})
    rows = docs.select(F.col("image_path").alias("episode_id"), "gpt_instruction", "uneven", "short", F.posexplode_outer(F.arrays_zip("index_list", "pos", "yaw")).alias("frame_index", "f")).select("*", "f.*").drop("f")
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/images").select(F.regexp_extract(F.col("_metadata.file_path"), r"/images/(.+)/[^/]+$", 1).alias("episode_id"), F.col("image_id").alias("index_list"), F.col("image").isNotNull().alias("bytes")).groupBy("episode_id", "index_list").agg(F.max("bytes").alias("bytes"))
    joined = rows.join(found, ["episode_id", "index_list"], "left")
    p = F.col("pos")
    wrong = F.coalesce(~F.size(p).isin(3, 4), F.lit(True)) | (F.size(p) == 4) & (F.abs(F.try_element_at(p, F.lit(4)) - F.col("yaw")) > 1e-5)
    failed = first_failure(joined, "episode_id", "frame_index", [("lists of different lengths", F.col("uneven")), ("less than two frames", F.col("short")), ("missing image row", F.col("bytes").isNull()), ("missing image bytes", ~F.col("bytes")), ("position and yaw differ", wrong)])
    whole = joined.join(failed.where("failure IS NULL"), "episode_id", "left_semi")
    return _frames(whole, G.pose(*[G.clean_number(x) for x in (p[0], p[1], p[2], F.col("yaw"))]), normalise_text(F.col("gpt_instruction"))), failed.where("failure IS NOT NULL")


@adapter("annotated_images")
def annotated_images(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of an annotation list whose images are all there."""
    return annotated_image_rows(spark, path)[0]


@adapter("keyframe_tables")
def keyframe_tables(spark: SparkSession, path: str) -> DataFrame:
    """Scenes as linked lists of samples, posed by the key frame of each sample's ``LIDAR_TOP`` sensor (JSON tables under the path)."""
    table = lambda name, schema: read_document(spark, f"{path}/{name}.json", schema)
    scenes = table("scene", "name string, description string, first_sample_token string")
    samples = table("sample", "token string, `next` string").withColumn("next", F.nullif("next", F.lit("")))
    lidar = table("sensor", "token string, channel string").where("channel = 'LIDAR_TOP'").select(F.col("token").alias("sensor_token"))
    mounted = table("calibrated_sensor", "token string, sensor_token string").join(lidar, "sensor_token", "left_semi").select(F.col("token").alias("calibrated_sensor_token"))
    data = table("sample_data", "sample_token string, ego_pose_token string, calibrated_sensor_token string, is_key_frame boolean").where("is_key_frame").join(mounted, "calibrated_sensor_token", "left_semi")
    poses = table("ego_pose", "token string, translation array<double>, rotation array<double>").select(F.col("token").alias("ego_pose_token"), "translation", "rotation")
    placed = linked_order(samples, "token", "next").join(scenes, F.col("head") == F.col("first_sample_token"))
    rows = placed.join(data, F.col("token") == F.col("sample_token")).join(poses, "ego_pose_token")
    v, q = F.col("translation"), F.col("rotation")
    named = rows.select(F.col("name").alias("episode_id"), F.col("position").alias("frame_index"), "description", v[0].alias("x"), v[1].alias("y"), v[2].alias("z"), G.quaternion_yaw(q[0], q[1], q[2], q[3]).alias("yaw"))
    return _frames(named, G.pose(*[G.clean_number(F.col(c)) for c in ("x", "y", "z", "yaw")]), normalise_text(F.col("description")))
