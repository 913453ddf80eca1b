from provenir.streaming import ingest


def test_votes_and_incarnations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", True, 0.5), (1, 2, "2024-01-01 00:01:00", False, 0.001), (1, 3, "2024-01-01 00:02:00", True, 0.001), (1, 4, "2024-01-01 02:00:00", False, 0.5)], "pid long, event_id long, ts string, boundary boolean, pred double").selectExpr("pid", "event_id", "cast(ts as timestamp) ts", "boundary", "pred")
    path = f"file://{tmp_path}/in"
    rows.write.parquet(path)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(path)
    for name, df in (("votes", ingest.window_votes(stream(), 0.1)), ("inc", ingest.incarnation_stream(stream()))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.normal, r.intrusions, r.flagged) for r in spark.table("votes").collect()] == [(1, 2, True)]
    assert sorted((r.event_id, r.incarnation) for r in spark.table("inc").collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]
