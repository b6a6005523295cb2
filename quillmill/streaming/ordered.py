"""Limits on event streams decided in event-time order, whatever order the events come in.

Events (key, at, id, success) wait in state until the watermark has passed them; a timer then takes them in
order of time and id. So an event is decided once, the same way for any division into micro-batches, and a restarted
stream goes on from its checkpoint. Times count in whole milliseconds. A key that had no event for `idle_ms` begins anew,
and its state is cleared. State is a few numbers a key and its events of the last LATE: later ones are left out, and those that
the watermark hasn't passed wait. Events without a key, time or id are left out; a null success counts as a failure.

A call of a stateful operator costs some milliseconds in Python however few events it brings, so it is made for a part of
the keys, not for each key; the state of a part's keys is read and written together.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stored import scratch

LATE, IDLE_MS = "10 minutes", 3_600_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id long, allowed boolean, remaining long"
PARTS, EVENTS_A_PIECE = 1024, 10_000


def _columns(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(list(column) for column in zip(*rows))


class _InOrder(StatefulProcessor):
    """A limit gives `start` and `decide`; a key's state is two numbers, and the time of the last event decided."""

    def __init__(self, ms: int, idle_ms: int = IDLE_MS):
        self.ms, self.idle_ms = ms, idle_ms

    def start(self) -> tuple[int, int]:
        return 0, 0

    def decide(self, a: int, b: int, ms: int, success: bool) -> tuple[int, int, bool, int]:
        """(both numbers after, allowed, remaining) for an event."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "ms array<long>, id array<long>, success array<boolean>, key array<string>")
        self._now = handle.getValueState("now", "key array<string>, a array<long>, b array<long>, seen array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self._waiting.appendValue(tuple(frame[c].tolist() for c in ("ms", "id", "success", "key")))
            self._handle.registerTimer(int(frame["ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(event for piece in self._waiting.get() for event in zip(*piece))
        now = {k: (a, b, seen) for k, a, b, seen in zip(*(self._now.get() or ()))}
        held, n_due, out = len(now), bisect_left(waiting, (passed,)), []
        for ms, id, success, k in waiting[:n_due]:
            a, b, seen = now.get(k, (0, 0, None))
            if seen is None or ms - seen >= self.idle_ms:
                a, b = self.start()
            a, b, allowed, remaining = self.decide(a, b, ms, success)
            now[k] = a, b, ms
            out.append((k, id, allowed, remaining))
        later = waiting[n_due:]
        if out and later:
            self._waiting.put([_columns(later[i : i + EVENTS_A_PIECE]) for i in range(0, len(later), EVENTS_A_PIECE)])
        elif out:
            self._waiting.clear()
        kept = [(k, *state) for k, state in now.items() if state[2] + self.idle_ms > passed]
        if kept and (out or len(kept) < held):
            self._now.update(_columns(kept))
            self._handle.registerTimer(min(seen for *_, seen in kept) + self.idle_ms)
        elif held and not kept:
            self._now.clear()
        if later:
            self._handle.registerTimer(later[0][0])
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "allowed", "remaining"])

    def close(self) -> None:
        pass


class TokenBucket(_InOrder):
    """State: tokens, and the time they were last given (-1: never). A whole interval gives `rate` tokens, parts carry over."""

    def __init__(self, capacity: int, rate: int, ms: int, idle_ms: int = IDLE_MS):
        super().__init__(ms, idle_ms)
        self.capacity, self.rate = capacity, rate

    def start(self) -> tuple[int, int]:
        return self.capacity, -1

    def decide(self, a: int, b: int, ms: int, success: bool) -> tuple[int, int, bool, int]:
        b = ms if b < 0 else b
        whole = (ms - b) // self.ms
        a, b = min(self.capacity, a + whole * self.rate), b + whole * self.ms
        return a - (a >= 1), b, a >= 1, a - (a >= 1)


class CircuitBreaker(_InOrder):
    """State: failures in a row, and the time until which the circuit is open. An open circuit lets nothing pass."""

    def __init__(self, failures: int, ms: int, idle_ms: int = IDLE_MS):
        super().__init__(ms, idle_ms)
        self.failures = failures

    def decide(self, a: int, b: int, ms: int, success: bool) -> tuple[int, int, bool, int]:
        if ms < b:
            return a, b, False, 0
        a = 0 if success else (a if b == 0 else 0) + 1  # a circuit that closed by time counts anew
        return a, ms + self.ms if a >= self.failures else 0, True, max(0, self.failures - a)


class Apart(_InOrder):
    """State: 1 and the time of the last request let through. Requests of a key under `ms` after it are repeats."""

    def decide(self, a: int, b: int, ms: int, success: bool) -> tuple[int, int, bool, int]:
        allowed = a == 0 or ms - b >= self.ms
        return 1, ms if allowed else b, allowed, 0


def limited(events: DataFrame, limit: _InOrder, parts: int = PARTS) -> DataFrame:
    """key, id, allowed, remaining of a stream of events (key, at, id, success) under a TokenBucket, CircuitBreaker or Apart.

    The keys are dealt out to `parts`, which a stream keeps for as long as it runs. The session's state store must be
    RocksDB's (PROVIDER = ROCKSDB).
    """
    told = events.where("key is not null and at is not null and id is not null").select(
        F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"),
        F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.coalesce("success", F.lit(False)).alias("success"),
        F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(parts)).alias("part"),
    )
    return told.withWatermark("at", LATE).groupBy("part").transformWithStateInPandas(limit, OUT, "append", "eventTime")


def replayed(spark: SparkSession, path: str, events, limit: _InOrder) -> DataFrame:
    """What `limit` decides on the Parquet files of a path, streamed to their end; events: from the read stream to (key, at, id, success).

    Files, progress and the result lie in a new folder under the shared one, so a restarted run could go on.
    """
    folder, before = f"{scratch(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(PROVIDER, None)
    # As a pattern the path may be a file too; a stream's plain path must be a folder.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        told = limited(events(stream), limit)
        query = told.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(OUT).parquet(f"{folder}/out")
