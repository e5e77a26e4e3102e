from pyspark.sql import functions as F

from tests.helpers import SF
from trajecta.streaming import windows as W


def _stream(spark, tmp_path, df):
    df.write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")


def test_tumbling_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    stream = W.tumbling(_stream(spark, tmp_path, e), "1 day", "1 hour", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert key(spark.table("tumbling").collect()) == key(W.tumbling(e, "1 day", "1 hour", "event_type").collect())


def test_sessions_reject_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 7, 1.0), (2, 20, 7, 2.0), (3, 15, 8, 5.0)], "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    q = W.sessions_in_order(_stream(spark, tmp_path, rows)).writeStream.outputMode("append").format("memory").queryName("ordered").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.frame, r.total, r.error) for r in spark.table("ordered").collect())
    assert got == [(7, 0, 1.0, False), (7, 1, 3.0, False), (8, 0, 5.0, False)]
