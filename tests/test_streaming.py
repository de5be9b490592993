"""The streaming form agrees with the batch form."""

from tidemark.streaming.windows import rolling_means


def test_stream_equals_batch(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    s = rolling_means(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("rolling").start()
    q.processAllAvailable()
    q.stop()
    a = {(r.window_start, r.event_type): r.n for r in spark.table("rolling").collect()}
    b = {(r.window_start, r.event_type): r.n for r in rolling_means(e).collect()}
    assert a == b and a
