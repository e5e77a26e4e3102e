"""Poses and angles as column functions. A pose is a struct (x, y, z, yaw)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_angle(a: Column) -> Column:
    """The angle in [-pi, pi), with a floored remainder."""
    return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()


def pose(x: Column, y: Column, z: Column, yaw: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), yaw.cast("double").alias("yaw"))


def body_delta(anchor: Column, other: Column, z_sign: int = 1) -> Column:
    """The other pose seen from the anchor's moving frame."""
    dx, dy = other["x"] - anchor["x"], other["y"] - anchor["y"]
    c, s = F.cos(anchor["yaw"]), F.sin(anchor["yaw"])
    return F.struct((c * dx + s * dy).alias("dx"), (c * dy - s * dx).alias("dy"), ((other["z"] - anchor["z"]) * z_sign).alias("dz"), wrap_angle(other["yaw"] - anchor["yaw"]).alias("dyaw"))


def from_body_delta(anchor: Column, delta: Column) -> Column:
    """The inverse of body_delta."""
    c, s = F.cos(anchor["yaw"]), F.sin(anchor["yaw"])
    return pose(anchor["x"] + c * delta["dx"] - s * delta["dy"], anchor["y"] + s * delta["dx"] + c * delta["dy"], anchor["z"] + delta["dz"], wrap_angle(anchor["yaw"] + delta["dyaw"]))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)


def clean_number(v: Column, tiny: float = 1e-7) -> Column:
    """Null unless finite; numbers next to zero are zero."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).when(F.abs(v) < tiny, F.lit(0.0)).otherwise(v)


def finite_number(v: Column, tiny: float = 1e-7) -> Column:
    """Numbers next to zero are zero; one that isn't finite is an error."""
    odd = F.raise_error(F.concat(F.lit("a number must be finite, not "), v.cast("string"))).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), odd).when(F.abs(v) < tiny, F.lit(0.0)).otherwise(v)


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def yaw_quaternion(yaw: Column) -> Column:
    return F.struct(F.cos(yaw / 2).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(yaw / 2).alias("z"))


def axes_permuted(x: Column, y: Column, z: Column) -> Column:
    """Right-handed y-up coordinates as z-up: forward is -z, left is -x."""
    return F.struct((-z).alias("x"), (-x).alias("y"), y.alias("z"))


def centimetres_reflected(x: Column, y: Column, z: Column, yaw_degrees: Column) -> Column:
    """Centimetres with z down and degrees, as metres with z up and radians."""
    return pose(x / 100, y / 100, -z / 100, wrap_angle(F.radians(yaw_degrees)))


def turn_direction(dyaw: Column, straight: float = 0.2618) -> Column:
    return F.when(dyaw > straight, "left").when(dyaw < -straight, "right").otherwise("straight")


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); zero for empty boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda q: F.greatest(F.lit(0.0), q["x2"] - q["x1"]) * F.greatest(F.lit(0.0), q["y2"] - q["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def normalise(v: Column, low: Column, high: Column) -> Column:
    """To [-1, 1] between two quantiles, without clipping."""
    return 2 * (v - low) / F.greatest(high - low, F.lit(1e-6)) - 1


def unnormalise(v: Column, low: Column, high: Column) -> Column:
    return (v + 1) / 2 * F.greatest(high - low, F.lit(1e-6)) + low


def standardise(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / F.greatest(std, F.lit(1e-6))


def reflected(p: Column, mode: str) -> Column:
    """A pose with its y and yaw, or y, z and yaw, negated; ``identity`` leaves it."""
    if mode not in ("identity", "reflect_y_yaw", "reflect_y_z_yaw"):
        raise ValueError(mode)
    side = 1 if mode == "identity" else -1
    return pose(p["x"], p["y"] * side, p["z"] * (-1 if mode == "reflect_y_z_yaw" else 1), wrap_angle(p["yaw"] * side))


def mounted(p: Column, forward: Column, left: Column, up: Column, turn: Column) -> Column:
    """The world pose of a camera mounted at an offset in the body frame."""
    return from_body_delta(p, F.struct(forward.alias("dx"), left.alias("dy"), up.alias("dz"), turn.alias("dyaw")))


def rotation_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """The 3 x 3 matrix of a unit quaternion, by rows."""
    one, two = F.lit(1.0), F.lit(2.0)
    return F.array(
        F.array(one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)),
        F.array(two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x)),
        F.array(two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y)),
    )


def quaternion_error(a: Column, b: Column) -> Column:
    """Degrees between two quaternions (w, x, y, z) of any length; infinite if one has none."""
    parts = ("w", "x", "y", "z")
    dot = sum((a[k] * b[k] for k in parts), F.lit(0.0))
    size = F.sqrt(sum((a[k] * a[k] for k in parts), F.lit(0.0)) * sum((b[k] * b[k] for k in parts), F.lit(0.0)))
    return F.when(size > 1e-12, F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot) / size)))).otherwise(F.lit(float("inf")))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """How a picture is scaled and centred in a square: scale, whole width and height, left and top margin."""
    scale = F.least(size / width, size / height)
    w, h = F.bround(width * scale), F.bround(height * scale)
    return F.struct(scale.alias("scale"), w.cast("long").alias("width"), h.cast("long").alias("height"), F.floor((size - w) / 2).alias("left"), F.floor((size - h) / 2).alias("top"))


def visible(anchor: Column, target: Column, reach: float, half_angle: float) -> Column:
    """Whether the target lies within reach and within half_angle of the anchor's heading."""
    d = body_delta(anchor, target)
    return (distance(anchor, target) <= reach) & (F.abs(F.atan2(d["dy"], d["dx"])) <= half_angle)


def box_giou(a: Column, b: Column) -> Column:
    """Intersection over union, less the share of the enclosing box that neither covers."""
    area = lambda x: F.greatest(F.lit(0), x["x2"] - x["x1"]) * F.greatest(F.lit(0), x["y2"] - x["y1"])
    inter = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    hull = (F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])) * (F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"]))
    union = area(a) + area(b) - inter
    return F.try_divide(inter, union) - F.try_divide(hull - union, hull)


def frame_number(seconds: Column, rate: Column | float, frames: Column | int) -> Column:
    """The frame shown at a time, kept inside the clip."""
    last = F.lit(frames) - 1 if isinstance(frames, int) else frames - 1
    return F.least(F.greatest(F.bround(seconds * rate).cast("long"), F.lit(0)), last).cast("long")


def frame_rate(text: Column) -> Column:
    """``30000/1001`` or ``25`` as a number; null if it isn't one."""
    part = F.split(text, "/")
    return F.try_divide(part[0].try_cast("double"), F.coalesce(F.get(part, F.lit(1)).try_cast("double"), F.when(F.size(part) == 1, F.lit(1.0))))


def command(delta: Column, threshold: float) -> Column:
    """``left``, ``right`` or ``forward`` by the sideways part of a body delta."""
    return F.when(delta["dy"] > threshold, "left").when(delta["dy"] < -threshold, "right").otherwise("forward")


def stage(delta: Column, climb: float, turn: float) -> Column:
    """``take off``, ``landing``, ``left``, ``right`` or ``cruise``: climbing goes before turning."""
    return F.when(delta["dz"] > climb, "take off").when(delta["dz"] < -climb, "landing").when(delta["dyaw"] > turn, "left").when(delta["dyaw"] < -turn, "right").otherwise("cruise")
