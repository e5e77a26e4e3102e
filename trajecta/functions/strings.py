"""Text and reference helpers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_text(t: Column) -> Column:
    """Without replacement characters, with forward slashes and single blanks, trimmed."""
    t = F.regexp_replace(t, "�", "")
    t = F.regexp_replace(t, r"\\+", "/")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def sanitise(t: Column) -> Column:
    """A safe path component: other characters become _, and . and _ go from the ends; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(out != "", out)


def frame_ref(episode: Column, frame: Column, camera: Column) -> Column:
    """episode/frame/camera, the frame with six digits or as many as it has; null if a part is."""
    number = F.when(frame.isNotNull(), F.format_string("%06d", frame.cast("bigint")))
    return F.concat(episode.cast("string"), F.lit("/"), number, F.lit("/"), camera)


def parse_ref(ref: Column) -> Column:
    parts = F.split(ref, "/")
    return F.struct(F.element_at(parts, -3).alias("episode"), F.element_at(parts, -2).try_cast("bigint").alias("frame"), F.element_at(parts, -1).alias("camera"))


def natural_key(t: Column) -> Column:
    """A string that sorts digits by their number, however long: each run as its length without leading zeros, and itself."""
    runs = F.regexp_extract_all(t, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.regexp_replace(r, "^0+(?=.)", "")).cast("string"), 9, "0"), F.lit("."), F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(r)), "")


def json_number(v: Column) -> Column:
    """Null for numbers that JSON has no form for."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)
