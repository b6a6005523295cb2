"""Queries that stream the events to their end, and their SQL.

Users stand in for the keys of a limit, errors for failed requests. A stream decides the events that its watermark has
passed, ten minutes before the last one; the SQL walks the same events a key at a time by recursion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ordered
from .standins import Domain

QUERIES: dict = {}
ORACLES: dict = {}
HOUR = 3_600_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


def _walk(first: str, step: str) -> str:
    """SQL of a walk: `first` gives a, b, allowed, remaining of a key's first event e, `step` those of e after w."""
    return f"""WITH RECURSIVE e AS (
  SELECT user_id AS k, event_id AS id, epoch_ms(ts) AS ms, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n
  FROM events WHERE user_id IS NOT NULL AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM events)),
w AS (SELECT k, n, id, ms, {first} FROM e WHERE n = 1 UNION ALL SELECT k, n, id, ms, {step} JOIN e ON e.k = w.k AND e.n = w.n + 1) q)
SELECT CAST(k AS VARCHAR) AS key, id, allowed, CAST(remaining AS BIGINT) AS remaining FROM w"""


def _events(stream):
    return stream.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("success"))


def _replayed(d: Domain, limit):
    return ordered.replayed(d.spark, f"{d.sf_dir}/events.parquet", _events, limit)


_E = "e.k, e.n, e.id, e.ms, e.ok"


@query(_walk(
    "1 AS a, ms AS b, true AS allowed, 1 AS remaining",
    f"""CAST(greatest(full_ - 1, 0) AS INTEGER), b, full_ >= 1, greatest(full_ - 1, 0) FROM (SELECT {_E},
    CASE WHEN e.ms - w.ms >= {120 * HOUR} THEN 2 ELSE least(2, w.a + (e.ms - w.b) // {12 * HOUR}) END AS full_,
    CASE WHEN e.ms - w.ms >= {120 * HOUR} THEN e.ms ELSE w.b + (e.ms - w.b) // {12 * HOUR} * {12 * HOUR} END AS b FROM w""",
))
def stream_token_bucket(d: Domain):
    """A bucket of two tokens a user, one back every twelve hours; five idle days begin anew."""
    return _replayed(d, ordered.TokenBucket(2, 1, 12 * HOUR, 120 * HOUR))


@query(_walk(
    "CAST(NOT ok AS INTEGER) AS a, CAST(0 AS BIGINT) AS b, true AS allowed, 2 - CAST(NOT ok AS INTEGER) AS remaining",
    f"""CAST(CASE WHEN open THEN before ELSE run END AS INTEGER), CASE WHEN open THEN until WHEN run >= 2 THEN ms + {24 * HOUR} ELSE 0 END, NOT open,
    CASE WHEN open THEN 0 ELSE greatest(0, 2 - run) END FROM (SELECT *, ms < until AS open, CASE WHEN ok THEN 0 WHEN until = 0 THEN before + 1 ELSE 1 END AS run FROM (SELECT {_E},
    CASE WHEN e.ms - w.ms >= {120 * HOUR} THEN 0 ELSE w.a END AS before, CASE WHEN e.ms - w.ms >= {120 * HOUR} THEN 0 ELSE w.b END AS until FROM w""",
).replace("w.n + 1) q)", "w.n + 1) q) p)"))
def stream_circuit_breaker(d: Domain):
    """Two errors of a user in a row open the circuit for a day; five idle days begin anew."""
    return _replayed(d, ordered.CircuitBreaker(2, 24 * HOUR, 120 * HOUR))


@query(_walk(
    "1 AS a, ms AS b, true AS allowed, 0 AS remaining",
    f"""1, CASE WHEN fresh THEN ms ELSE b END, fresh, 0 FROM (SELECT {_E}, w.b, e.ms - w.b >= {12 * HOUR} AS fresh FROM w""",
))
def stream_requests_apart(d: Domain):
    """Requests of a user under twelve hours after one let through are repeats."""
    return _replayed(d, ordered.Apart(12 * HOUR, 120 * HOUR))
