from colligo.streaming import kpi


def test_stream_gives_the_table_result(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = kpi.windowed(stream).writeStream.outputMode("update").format("memory").queryName("kpi").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("kpi").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in kpi.windowed(events).collect()}
