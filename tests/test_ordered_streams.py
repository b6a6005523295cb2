import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmill.plans.queries_streams import ORACLES, QUERIES
from quillmill.streaming import ordered

T = dt.datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, id long, success boolean"
MINUTE = 60_000


def decided(spark, folder, batches, limit, name):
    """key, id, allowed, remaining of the batches, one file and so one micro-batch each."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = ordered.limited(stream, limit).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(ordered.PROVIDER, before)
    return sorted(tuple(r) for r in spark.table(name).collect())


def at(key, minute, id, success=True):
    return key, T + dt.timedelta(minutes=minute), id, success


def bucket(events, capacity, rate, ms):
    """The same by hand, for keys that are never idle."""
    state, out = {}, []
    for key, when, id, _ in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        now = int(when.timestamp() * 1000)
        tokens, last = state.get(key, (capacity, now))
        whole = (now - last) // ms
        tokens, last = min(capacity, tokens + whole * rate), last + whole * ms
        out.append((key, id, tokens >= 1, max(tokens - 1, 0)))
        state[key] = max(tokens - 1, 0), last
    return sorted(out)


def test_batches_and_late_events_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    events = [at(f"k{rng.randrange(3)}", i * 0.7, i) for i in range(120)]
    shuffled = [e for start in range(0, 120, 8) for e in rng.sample(events[start : start + 8], 8)]  # at most 6 minutes late
    end = [at("end", 1000, 999)]
    want = bucket(events, 2, 1, 5 * MINUTE)
    assert {r[2] for r in want} == {True, False}
    limit = ordered.TokenBucket(2, 1, 5 * MINUTE, 1000 * MINUTE)
    assert decided(spark, str(tmp_path / "one"), [shuffled + end], limit, "one") == want
    many = [shuffled[i : i + 30] for i in range(0, 120, 30)] + [end]
    assert decided(spark, str(tmp_path / "many"), many, limit, "many") == want


def test_breaker_idle_keys_and_nulls(spark, tmp_path):
    bad = [at("a", m, m, False) for m in (0, 1, 2)] + [at("a", 3, 3, True), at("a", 40, 40, None), at("a", 41, 41, True)]
    idle = [at("b", 0, 50, False), at("b", 1, 51, False), at("b", 100, 52, False)]
    junk = [(None, T, 60, True), ("c", None, 61, True), ("c", T, None, True)]
    got = decided(spark, str(tmp_path), [bad + idle + junk, [at("end", 5000, 99)]], ordered.CircuitBreaker(3, 30 * MINUTE), "breaker")
    assert [(r[1], r[2], r[3]) for r in got if r[0] == "a"] == [(0, True, 2), (1, True, 1), (2, True, 0), (3, False, 0), (40, True, 2), (41, True, 3)]
    # An hour without events: the third failure is a first one again.
    assert [(r[1], r[3]) for r in got if r[0] == "b"] == [(50, 2), (51, 1), (52, 2)] and {r[0] for r in got} == {"a", "b"}


def test_apart(spark, tmp_path):
    events = [at("a", m, i) for i, m in enumerate((0, 4, 5, 9, 10))] + [at("end", 500, 99)]
    got = decided(spark, str(tmp_path), [events], ordered.Apart(5 * MINUTE), "apart")
    assert [(r[1], r[2]) for r in got] == [(0, True), (1, False), (2, True), (3, False), (4, True)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_decide_both_ways(spark, sf_dir, name):
    assert name in ORACLES
    assert {r["allowed"] for r in QUERIES[name](spark, sf_dir).select("allowed").distinct().collect()} == {True, False}


def test_the_session_is_left_as_it_was(spark, sf_dir):
    before = spark.conf.get(ordered.PROVIDER)
    ordered.replayed(spark, f"{sf_dir}/events.parquet", lambda s: s.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.lit(True).alias("success")), ordered.Apart(1))
    assert spark.conf.get(ordered.PROVIDER) == before
