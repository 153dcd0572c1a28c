from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessaline.plans import flows
from tessaline.streaming import sessions


def test_open_buffers_are_drained_at_the_end(spark, tmp_path):
    at = datetime(2026, 1, 1)
    said = [("a", "Note", f"a {i}", at + timedelta(seconds=i)) for i in range(5)] + [("b", "Note", "only", at), ("b", "Note", "only", at), ("c", "Error", "urgent", at)]
    spark.createDataFrame(said, "user_id string, memory_type string, content string, received_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    rows = sessions.drained_to_end(sessions.buffered(stream, sessions.Buffering(messages=2, seconds=60)), str(tmp_path), "t").collect()
    got = {(x.user_id, x.reason, x.text, x.first_at, x.last_at) for x in rows}
    when = lambda i: at + timedelta(seconds=i)
    assert got == {
        ("a", "count", "a 0\na 1", when(0), when(1)), ("a", "count", "a 2\na 3", when(2), when(3)), ("a", "close", "a 4", when(4), when(4)),
        ("b", "close", "only", at, at), ("c", "urgent", "urgent", at, at),
    }
    assert len(rows) == len(got)


def test_every_message_is_drained(spark, base):
    sums = flows.t02_stream_buffer(spark, base).agg(F.sum("messages").alias("n")).first().n
    rows = spark.read.parquet(f"{base}/remember_requests.parquet").where("content is not null and user_id is not null")
    assert sums == rows.select("user_id", sessions.normalised_hash(F.col("content"))).distinct().count()


def test_batches_are_merged_in_order():
    import pandas as pd

    batch = lambda *ts: pd.DataFrame({"memory_type": "Note", "content": "", "received_at": [pd.Timestamp(2026, 1, 1 + t) if t is not None else pd.NaT for t in ts], "hash": [str(t) for t in ts]})
    assert [x[3] for x in sessions.in_order(iter([batch(5, 1, None), batch(4, 0), batch(3, 2)]))] == ["0", "1", "2", "3", "4", "5", "None"]
