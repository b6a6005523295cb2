"""Keyed limits on event streams: fixed windows, token buckets, circuit breakers. And windowed request counts.

State is one small row per key; keys that were idle for an hour of event time are forgotten. Events carry (key, at, id);
within a micro-batch they are taken in order of time and id; events later than LATE are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS, LATE = 3_600_000, "10 minutes"


def _stateful(events: DataFrame, out: str, state: str, start: Callable[[], tuple], step: Callable[[tuple, pd.Series], tuple[tuple, dict]]) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        now, rows = (group.get if group.exists else start()), []
        batch = pd.concat(list(frames)).sort_values(["at", "id"])
        for row in batch.itertuples():
            now, told = step(now, row)
            rows.append({"key": key[0], "id": row.id, **told})
        group.update(now)
        group.setTimeoutTimestamp(max(int(batch["at"].max().timestamp() * 1000), group.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame(rows)

    return events.withWatermark("at", LATE).groupBy("key").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def fixed_window(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """key, id, allowed, remaining: a window opens with a key's first event and lets `most` pass in `seconds`."""

    def step(state: tuple, row) -> tuple[tuple, dict]:
        start, n = state
        t = row.at.timestamp()
        start, n = (t, 1) if n == 0 or t - start >= seconds else (start, n + 1)
        return (start, n), {"allowed": n <= most, "remaining": max(0, most - n)}

    return _stateful(events, "key string, id long, allowed boolean, remaining long", "start double, n long", lambda: (0.0, 0), step)


def token_bucket(events: DataFrame, capacity: int, rate: int, seconds: float) -> DataFrame:
    """key, id, allowed, tokens: `rate` tokens come back every full `seconds`, up to capacity; part intervals carry over."""

    def step(state: tuple, row) -> tuple[tuple, dict]:
        tokens, last = state
        t = row.at.timestamp()
        last = t if last < 0 else last
        whole = int((t - last) // seconds)
        if whole > 0:
            tokens, last = min(capacity, tokens + whole * rate), last + whole * seconds
        allowed = tokens >= 1
        tokens -= allowed
        return (tokens, last), {"allowed": bool(allowed), "tokens": tokens}

    return _stateful(events, "key string, id long, allowed boolean, tokens long", "tokens long, last double", lambda: (capacity, -1.0), step)


def circuit_breaker(events: DataFrame, failures: int = 3, seconds: float = 1800) -> DataFrame:
    """key, id, tripped: events with `success`; `failures` in a row open the circuit for `seconds`; a success closes it."""

    def step(state: tuple, row) -> tuple[tuple, dict]:
        run, until = state
        t = row.at.timestamp()
        tripped = t < until
        if not tripped:
            run, until = (0, 0.0) if row.success else (run + 1 if until == 0 else 1, 0.0)
            until = t + seconds if run >= failures else 0.0
        return (run, until), {"tripped": bool(tripped)}

    return _stateful(events, "key string, id long, tripped boolean", "run long, until double", lambda: (0, 0.0), step)


def request_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and failures per window and key; rows later than `late` are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "key").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("success")).alias("failed")).select("key", F.col("window.start").alias("start"), "requests", "failed")


def distinct_requests(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each request id once."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
