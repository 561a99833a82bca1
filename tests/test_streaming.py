from lumengrid.streaming.entropy_stream import window_entropy, windowed_counts


def test_stream_counts_equal_batch_counts(spark, data, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counted = windowed_counts(stream, lateness="4000 days")
    query = counted.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start, r.symbol, r.n) for r in spark.table("counts").collect()}
    assert got == {(r.start, r.symbol, r.n) for r in windowed_counts(events).collect()}
    assert all(r.bits >= 0 for r in window_entropy(spark.table("counts")).collect())
