"""Centroid clustering in exact integers, with Yinyang bounds instead of full scans.

Vectors of exactly 64 components become integers floor(64 * x). The first centroids are the vectors of least
sha256("1:<vec_id>"), then rounds of assignment and exact componentwise floor(sum / count) follow, then one assignment more.
Centroids are cut into groups once. Every vector keeps an upper bound of the distance to its centroid and one lower bound
per group; after a round they are moved by how far the centroids went. A vector whose upper bound lies under all lower
bounds keeps its centroid unseen (global filter); else the distance to its centroid is taken anew and only groups whose
lower bound is not above it are scanned, exactly (group filter). Bounds are rounded outwards, so filters drop no centroid
that could win or tie; distances are integers and ties go to the smaller number.

The vectors with their bounds are a Parquet table in the shared folder, replaced each round; sums are grouped by cluster with
partial aggregation, and K rows of sums reach the driver: its size is that of the centroids.

Rows with a null vector, another length, or a component that is null or not finite are not clustered, nor are those with a
component beyond 2^18 in size, whose squared distances may not fit a long. A null vec_id never starts a centroid. Repeated
rows are vectors of their own; of rows with one vec_id the least vector starts first. With fewer vectors than K there are
as many centroids; without vectors the result is empty. Inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, small_batches

DIMS, SCALE, K, ROUNDS, GROUPS, SEED, MOST = 64, 64, 16, 3, 4, 1, 1 << 18
_MARGIN = 1e-9
_STATE = "vec_id {kind}, v array<int>, cluster int, distance bigint, upper double, lower array<double>"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the kept rows as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    kept = (F.size("embedding") == DIMS) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MOST))
    return embeddings.where(kept).select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def _order() -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to each row of c (or to its own row, for equal shapes of three axes)."""
    return np.stack([((v - one) ** 2).sum(1) for one in c], axis=1)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of the same clustering over the centroids themselves."""
    groups = max(1, min(groups, len(centroids)))
    means = centroids[:groups].astype(float)
    for _ in range(5):
        of = ((centroids[:, None] - means[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                means[g] = centroids[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


class Yinyang:
    """One round's centroids, their groups and how far each has moved since the last one."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.centroids, self.group = centroids, group
        drift = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(1))
        self.drift = drift * (1 + _MARGIN) + _MARGIN
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        self.group_drift = np.array([self.drift[m].max() for m in self.members])

    def first(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, squared distance, upper and lower bounds by a full scan."""
        d = squared(v, self.centroids)
        best = d.argmin(1)  # the first of equal ones
        return self._told(d.astype(float), best, d[np.arange(len(v)), best])

    def _told(self, d: np.ndarray, best: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        d[np.arange(len(d)), best] = np.inf
        lower = np.stack([np.sqrt(d[:, m].min(1)) for m in self.members], axis=1) * (1 - _MARGIN) - _MARGIN
        return best, own, np.sqrt(own) * (1 + _MARGIN) + _MARGIN, lower

    def next(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, squared distance (-1 where it wasn't needed), upper and lower bounds, and how many distances were taken."""
        cluster, upper, lower = cluster.copy(), upper + self.drift[cluster], lower - self.group_drift
        own = np.full(len(v), -1)
        open_ = np.flatnonzero(upper >= lower.min(1))  # global filter
        was = cluster[open_]
        mine = ((v[open_] - self.centroids[was]) ** 2).sum(1)
        upper[open_] = np.sqrt(mine) * (1 + _MARGIN) + _MARGIN
        taken, d = len(open_), np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
        d[np.arange(len(open_)), was] = mine
        scanned = upper[open_, None] >= lower[open_]  # group filter
        for g, m in enumerate(self.members):
            rows = np.flatnonzero(scanned[:, g])
            if len(rows):
                d[np.ix_(rows, m)] = squared(v[open_[rows]], self.centroids[m])
                taken += len(rows) * len(m)
        best = d.argmin(1)
        found = d[np.arange(len(d)), best]
        far = d.astype(float)
        far[d == np.iinfo(np.int64).max] = np.inf
        _, own[open_], fresh, low = self._told(far, best, found)
        # A group that wasn't scanned keeps its bound, but for the centroid the vector has left.
        lower[open_] = np.where(scanned, low, np.minimum(lower[open_], low))
        cluster[open_], upper[open_] = best, fresh
        return cluster, own, upper, lower, taken


def _round(state: DataFrame, kind: str, yinyang: Yinyang, last: bool) -> DataFrame:
    """The state after an assignment; first round: state is vec_id, v."""
    known = "upper" in state.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column(1).flatten().to_numpy().reshape(-1, DIMS).astype(np.int64)
            if known:
                lower = batch.column(5).flatten().to_numpy().reshape(len(v), -1)
                cluster, own, upper, lower, _ = yinyang.next(v, batch.column(2).to_numpy(), batch.column(4).to_numpy(), lower)
            else:
                cluster, own, upper, lower = yinyang.first(v)
            if last:
                own = ((v - yinyang.centroids[cluster]) ** 2).sum(1)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * lower.shape[1], pa.int32()), pa.array(lower.ravel()))
            told = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), pa.array(upper, pa.float64()), bounds]
            yield pa.RecordBatch.from_arrays(told, ["vec_id", "v", "cluster", "distance", "upper", "lower"])

    return state.mapInArrow(assign, _STATE.format(kind=kind))


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int = GROUPS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    spark = embeddings.sparkSession
    small_batches(spark, 4096)
    tables, kind = Tables(spark), embeddings.schema["vec_id"].dataType.simpleString()
    state = vectors(embeddings)
    drawn = state.where("vec_id is not null").select(_order().alias("place"), "v").orderBy("place", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in drawn], np.int64).reshape(-1, DIMS)
    if not len(centroids):
        told = "vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
        return spark.createDataFrame([], told.format(kind=kind))
    group, before = grouped(centroids, groups), None
    for at in range(rounds + 1):
        state = tables.write(_round(state, kind, Yinyang(centroids, group, before), at == rounds), "state")
        if at < rounds:
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(DIMS)]).alias("sums"))
            before, centroids = centroids, centroids.copy()
            for r in sums.collect():
                centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    totals = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    whole = None if None in totals.values() or sum(totals.values()) >= 1 << 63 else sum(totals.values())
    told = [(c, totals.get(c), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(), row) for c, row in enumerate(centroids.tolist())]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def _oracle() -> str:
    near = """
a{r} AS MATERIALIZED (
  SELECT rid, any_value(v) AS v, arg_min(c, struct_pack(d := d, c := c)) AS cluster, min(d) AS distance
  FROM (SELECT rid, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM kept, c{r}) GROUP BY rid)"""
    moved = """
c{n} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(s.m, c{r}.m) AS m
  FROM c{r} LEFT JOIN (SELECT cluster, list((sum_ // n + CASE WHEN sum_ % n < 0 THEN -1 ELSE 0 END)::BIGINT ORDER BY i) AS m
    FROM (SELECT cluster, i, sum(v[i])::HUGEINT AS sum_, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) s ON s.cluster = c{r}.c)"""
    steps = ",".join(near.format(r=r) + ("," + moved.format(r=r, n=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m
  FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT {K})),{steps}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (rid) JOIN c{ROUNDS} ON c = cluster
"""


ORACLE = _oracle()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")
