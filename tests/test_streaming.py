from quillgraph.streaming import events as op


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) as ts, id % 5 as user_id, if(id % 3 = 0, 'click', 'view') as event_type, cast(id as double) as value, '{}' as props from range(120)")
    rows.union(rows.where("event_id < 5")).repartition(3).write.parquet(str(tmp_path / "e"))
    batch = spark.read.schema(op.EVENTS).parquet(str(tmp_path / "e"))
    stream = lambda: op.read_events(spark, str(tmp_path / "e"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, run(spark, op.windowed_counts(stream()), "w", "complete"))) == sorted(map(key, op.windowed_counts(batch).collect()))
    assert sorted(map(key, run(spark, op.sessions(stream()), "s", "complete"))) == sorted(map(key, op.sessions(batch).collect()))
    assert len(run(spark, op.first_of_each(stream()).select("event_id"), "f", "append")) == 120
