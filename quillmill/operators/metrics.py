"""Request metrics and coverage counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, percent


def latency_percentiles(requests: DataFrame, newest: int = 10_000) -> DataFrame:
    """p50, p95, p99 (nearest rank), largest and number of the newest latencies (at, id, latency)."""
    last = requests.where("latency is not null").orderBy(F.desc("at"), F.desc("id")).limit(newest)
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)").alias(f"p{round(p * 100)}")
    return last.agg(at(0.5), at(0.95), at(0.99), F.max("latency").alias("max"), F.count(F.lit(1)).alias("samples"))


def request_counters(requests: DataFrame, *keys: str) -> DataFrame:
    """requests, succeeded, failed per key."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def errors_by_type(requests: DataFrame, key: str, kind: str) -> DataFrame:
    """key, requests, succeeded, failed, errors (kind to count) of requests, whose `kind` is null where they succeeded.

    Counted by key and kind first, so a row's map is as large as there are kinds. A key without errors has an empty map.
    """
    each = requests.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    failed = F.col(kind).isNotNull()
    told = F.array_sort(F.collect_list(F.when(failed, F.struct(F.col(kind).alias("k"), F.col("n").alias("v")))))
    rows = each.groupBy(key).agg(F.sum("n").alias("requests"), F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failed"), F.map_from_entries(told).alias("errors"))
    return rows.select(key, "requests", (F.col("requests") - F.col("failed")).alias("succeeded"), "failed", "errors")


def coverage(persons: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """metric, n, share of the active persons, counted in one pass."""
    active = persons.where("is_active")
    one = active.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n"), F.col("total").alias("total")) for k in flags])).alias("r"))
    return rows.select("r.metric", "r.n", percent(F.col("r.n"), F.col("r.total")).alias("share"))


def size_tiers(groups: DataFrame, bounds: tuple[int, ...] = (100, 50, 20, 5)) -> DataFrame:
    """tier, groups: how many groups (column n) have at least each bound."""
    out = F
    for b in bounds:
        out = out.when(F.col("n") >= b, f">={b}")
    return groups.groupBy(out.otherwise(f"<{bounds[-1]}").alias("tier")).agg(F.count(F.lit(1)).alias("groups"))


def rotating_window(keys: DataFrame, run: int, size: int = 5, skipped: DataFrame | None = None) -> DataFrame:
    """The first `size` keys (idx, key) from this run's turn on, wrapping around, without the skipped ones (key): those that wait or are done.

    The list is a configuration, so its count is small. A skipped key's turn goes to the next one; turns count from it all the same.
    """
    n = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    turns = keys.withColumn("turn", F.pmod(F.col("idx") - F.pmod(F.lit(run * size).cast("long"), n), n))
    if skipped is not None:
        turns = turns.join(skipped.select("key"), "key", "left_anti")
    return turns.orderBy("turn").limit(size).select("turn", "key")


def missing_keys(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return expected.join(seen.select(key).distinct(), key, "left_anti")


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """added, removed, unchanged values per key of two (key, values array) frames."""
    joined = before.select(key, F.col("values").alias("b")).join(after.select(key, F.col("values").alias("a")), key, "full_outer")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    return joined.select(key, F.array_sort(F.array_except(a, b)).alias("added"), F.array_sort(F.array_except(b, a)).alias("removed"), F.array_sort(F.array_intersect(a, b)).alias("unchanged"))


def mean_by(df: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(value), digits).alias("mean"))


def rate_limited(requests: DataFrame, most: int, seconds: int) -> DataFrame:
    """requests (key, at, id) with allowed and remaining: a key's window opens with its first request and lasts `seconds`; `most` of it pass.

    Windows depend on one another, so each key's requests are walked in order of time and id by one task, batch by batch:
    time is linear and memory doesn't grow with a key's history. Nulls of the key are a key. For streams use streaming.limits.
    """
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("at"))
    ordered = requests.select("key", us.alias("us"), "id").repartition("key").sortWithinPartitions("key", "us", "id")
    kinds = dict(ordered.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, n = None, None, 0
        for batch in batches:
            allowed, remaining = [], []
            for k, t in zip(batch["key"].to_pylist(), batch["us"].to_pylist()):
                if k != key or start is None or (t is not None and t - start >= seconds * 1_000_000):
                    key, start, n = k, t, 0
                n += 1
                allowed.append(n <= most)
                remaining.append(max(0, most - n))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["id"], pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int32())], ["key", "id", "allowed", "remaining"])

    return ordered.mapInArrow(walk, f"key {kinds['key']}, id {kinds['id']}, allowed boolean, remaining int")


def latest_of_type(log: DataFrame) -> DataFrame:
    """The last row's payload of each action."""
    return log.groupBy("action").agg(F.max_by("payload", F.struct("created_at", "id")).alias("payload"), F.max("created_at").alias("created_at"))


def first_n(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("place") <= n)
