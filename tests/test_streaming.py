import datetime as dt

from quillmill.streaming import limits

T = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, apply, name):
    """Feeds the rows through a stream, a file and so a micro-batch at a time."""
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "key string, at timestamp, id long, success boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp, id long, success boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = apply(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def at(*seconds, key="a", success=True, first=0):
    return [(key, T + dt.timedelta(seconds=s), first + i, success) for i, s in enumerate(seconds)]


def test_fixed_window_keeps_state(spark, tmp_path):
    got = run(spark, tmp_path, [at(0, 1, 2), at(59, 60, first=3)], lambda s: limits.fixed_window(s, 2, 60), "windows")
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(0, True), (1, True), (2, False), (3, False), (4, True)]


def test_token_bucket(spark, tmp_path):
    got = run(spark, tmp_path, [at(0, 0, 0, 1, 2.5)], lambda s: limits.token_bucket(s, 2, 1, 2), "buckets")
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [True, True, False, False, True]


def test_circuit_breaker(spark, tmp_path):
    got = run(spark, tmp_path, [at(0, 1, 2, success=False), at(3, 2000, first=3)], lambda s: limits.circuit_breaker(s), "circuits")
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [False, False, False, True, False]
