from pyspark.sql import functions as F

from trajecta.functions import nested

NAN = float("nan")


def test_paths_move_at_every_depth(spark):
    kind = "struct<a:string,l:array<struct<p:string,m:map<string,array<string>>>>,n:int>"
    v = ("/s/x", [("/s/x/1", {"/s/x": ["/s/x/2", "/s/xy", None, "see /s/x/3"]}), None, (None, None)], 4)
    d = spark.createDataFrame([(v,), (None,)], f"v {kind}")
    got = [r.v for r in d.select(nested.rebased(F.col("v"), nested.column_type(d, "v"), "/s/x", "/t").alias("v")).collect()]
    assert got[1] is None and got[0].asDict(True) == {"a": "/t", "l": [{"p": "/t/1", "m": {"/s/x": ["/t/2", "/s/xy", None, "see /s/x/3"]}}, None, {"p": None, "m": None}], "n": 4}


def test_shapes(spark):
    d = spark.createDataFrame([([[[1, 2], [3]], []],), ([[]],), ([],), (None,), ([None, [[1]]],)], "v array<array<array<int>>>")
    got = [r.s for r in d.select(nested.shape(F.col("v"), nested.column_type(d, "v")).alias("s")).collect()]
    assert got == [[2, 2, 2], [1, 0], [0], [], [2]]
    assert spark.range(1).select(nested.shape(F.col("id"), spark.range(1).schema["id"].dataType).alias("s")).first().s == []


def test_equality(spark):
    kind = "struct<x:array<struct<v:double,w:map<string,int>>>>"
    rows = [(([(1.0, {"a": 1, "b": 2})],), ([(1.0, {"b": 2, "a": 1})],), True), (([(NAN, None)],), ([(None, None)],), True), (([(1.0, {})],), ([(1.0, None)],), False), (([(1.0, {"a": 1})],), ([(1.0, {"a": 2})],), False), (None, (None,), False), (None, None, True), (([],), ([None],), False)]
    d = spark.createDataFrame(rows, f"a {kind}, b {kind}, want boolean")
    k = nested.column_type(d, "a")
    assert d.where(nested.equal(F.col("a"), k, F.col("b"), k) != F.col("want")).count() == 0
