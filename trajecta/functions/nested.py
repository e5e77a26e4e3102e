"""Functions over nested values of any depth, built from the column's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


def column_type(df: DataFrame, name: str) -> S.DataType:
    return df.schema[name].dataType


def rebased(value: Column, kind: S.DataType, old: str, new: str) -> Column:
    """The value with every string in it that is the path ``old``, or lies below it, moved to ``new``; names and map keys stay."""
    if isinstance(kind, S.StringType):
        below = (value == old) | value.startswith(f"{old}/")
        return F.when(below, F.concat(F.lit(new), F.substring(value, len(old) + 1, 1 << 30))).otherwise(value)
    if isinstance(kind, S.ArrayType):
        return F.transform(value, lambda x: rebased(x, kind.elementType, old, new))
    if isinstance(kind, S.MapType):
        return F.transform_values(value, lambda _, x: rebased(x, kind.valueType, old, new))
    if isinstance(kind, S.StructType):
        inner = F.struct(*[rebased(value[f.name], f.dataType, old, new).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def shape(value: Column, kind: S.DataType) -> Column:
    """The sizes of a list, its first element, that one's first element, and so on; empty for what is no list, null too."""
    none = F.array().cast("array<int>")
    if not isinstance(kind, S.ArrayType):
        return none
    return F.when(value.isNull(), none).otherwise(F.concat(F.array(F.size(value)), shape(F.get(value, F.lit(0)), kind.elementType)))


def normalised(value: Column, kind: S.DataType) -> Column:
    """A form in which equal values are equal: NaN is null, fields and map entries stand in order of their names."""
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, S.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType))
    if isinstance(kind, S.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), normalised(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, S.StructType):
        inner = F.struct(*[normalised(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), inner)
    return value


def equal(a: Column, a_kind: S.DataType, b: Column, b_kind: S.DataType) -> Column:
    """Whether two nested values are equal; nulls and NaN are, whatever they are in."""
    return normalised(a, a_kind).eqNullSafe(normalised(b, b_kind))
