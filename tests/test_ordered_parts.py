import random

from quillmill.streaming import ordered

from .test_ordered_streams import MINUTE, SCHEMA, at, bucket


def replayed(spark, folder, batches, limit, name, **options):
    """Sorted rows decided, and the progress of the stream's batches."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = ordered.limited(stream, limit, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(ordered.PROVIDER, before)
    return sorted(tuple(r) for r in spark.table(name).collect()), query.recentProgress


def test_the_operator_is_called_a_part_not_a_key(spark, tmp_path):
    events = [at(f"k{i % 300}", i * 0.01, i) for i in range(900)] + [at("end", 1000, 999)]
    got, progress = replayed(spark, str(tmp_path), [events], ordered.TokenBucket(2, 1, 5 * MINUTE, 1000 * MINUTE), "few_parts", parts=4)
    assert got == bucket(events[:-1], 2, 1, 5 * MINUTE)
    # A piece of waiting events a part and frame, not a row an event.
    assert progress[0].stateOperators[0].numRowsUpdated == 4


def test_keys_of_a_part_are_decided_each_by_itself(spark, tmp_path):
    rng = random.Random(5)
    # Of twenty keys the even ones are never idle for an hour, the odd ones stop now and then.
    events = [at(f"k{k}", m + rng.random() * 5, m * 100 + k, rng.random() < 0.4) for m in range(0, 600, 6) for k in range(20) if k % 2 == 0 or (m // 90 + k) % 3]
    end = [at("end", 5000, 10**6)]
    batches = [events[i : i + 500] for i in range(0, len(events), 500)] + [end]
    limit = ordered.CircuitBreaker(3, 30 * MINUTE)
    one, _ = replayed(spark, str(tmp_path / "one"), batches, limit, "one_part", parts=1)
    many, _ = replayed(spark, str(tmp_path / "many"), [events + end], limit, "many_parts", parts=512)
    want, state = [], {}
    for key, when, id, success in sorted(events, key=lambda e: (int(e[1].timestamp() * 1000), e[2])):
        ms = int(when.timestamp() * 1000)
        a, b, seen = state.get(key, (0, 0, ms))
        a, b = (0, 0) if ms - seen >= 60 * MINUTE else (a, b)
        a, b, allowed, remaining = limit.decide(a, b, ms, success)
        state[key] = a, b, ms
        want.append((key, id, allowed, remaining))
    assert one == many == sorted(want) and {r[2] for r in one} == {True, False}
