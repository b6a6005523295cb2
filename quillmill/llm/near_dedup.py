"""Near-duplicates by HyperMinHash sketches, banding, collision-corrected estimates and exact verification.

A document's set is its distinct five-word shingles (64-bit hashes). The sketch has 256 registers; each keeps, of the
smallest hash in its bucket, the count of leading zeros (6 bits) and ten bits of mantissa. Five registers make a band.
Documents that agree in a band are candidates; a candidate pair whose Jaccard estimate, corrected for chance agreement
of compressed registers, or whose smallest hashes lie more than six standard errors under the threshold is dropped; all
others are verified on the full sets with 100 * intersection >= 75 * union. At Jaccard 0.75 a pair agrees in one of 51
bands except with probability (1 - 0.75^5)^51 = 1e-6, above it less; the six standard errors add about 1e-9 by the normal law.

No group is ever expanded into rows for its pairs:
* documents with the same set are one node from the start (grouped with partial aggregation);
* in every bucket all members are compared with one centre (drawn by a hash), then with another; members that are
  by then in one component need no comparison;
* buckets of more than LARGE members that still join several components are first cut by further bands (agreement in
  two, three ... bands, taken in ascending order), which joins most of their components early;
* what is left, these buckets of the first level included, is compared in blocks of at most BLOCK rows a side inside
  tasks, on sketches: register rows, then the smallest hashes of both sets (the whole set up to LOWEST shingles). A pair of different components is looked at in
  the bucket of its first common bands only, and leaves the task only if its estimate allows the threshold. Sets held
  whole are decided there, and only a spanning forest of their links leaves the task.
Components grow by min-label propagation with pointer jumping. Every table between rounds is written to the shared
folder and deleted once it is superseded; registers are stored for the distinct sets alone, and only while they can still
meet, whole sets only for documents that share a band. Nothing but row counts reaches the driver. Joins on keys that may
be hot (bucket, set, component) are plain sort-merge joins of written tables, which adaptive execution splits.

Null, empty and wordless texts have an empty set, linked with nothing. Under five words the whole sequence is the only
shingle. Rows given twice get the same result. Where rows share a doc_id but not their words, each row follows its own
set, and every set is compared. A row with a null doc_id is linked with nothing; its component_id is null and it is kept.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, WordHashes, documents, gram_hashes, mixed, small_batches

WORDS, PERCENT = 5, 75
REGISTERS, MANTISSA = 256, 10
ROWS, BANDS = 5, 51
#: Centres tried per level; rows a side of a block; members from which a bucket is cut further, and how often; hashes compared.
CENTRES, BLOCK, LARGE, LEVELS, LOWEST = 2, 512, 4096, 4, 256
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower() changes A-Z alone, and bytes.split() parts at ASCII white space alone."""
    words = hashes.of(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(WORDS, len(words)))) if len(words) else words


def _probes() -> np.ndarray:
    """For each register, the place of every register in a fixed random order that begins with itself."""
    order = np.argsort(mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)
    place = np.argsort(order, axis=1) + 1
    np.fill_diagonal(place, 0)
    return place.astype(np.uint16)


_PLACE = _probes()


def registers(found: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted, non-empty set: leading zeros and mantissa of each bucket's smallest hash.

    A register whose bucket is empty takes over the first full one in its own fixed random order (densification), so
    registers of small sets agree with the probability of the Jaccard similarity as well.
    """
    at = np.searchsorted(found, _BOUNDS)
    least = found[np.minimum(at, len(found) - 1)]
    full = np.flatnonzero((at < len(found)) & (least >> np.uint64(56) == np.arange(REGISTERS, dtype=np.uint64)))
    rest = least[full] << np.uint64(8)
    zeros = np.minimum(63, 64 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    told = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return told if len(full) == REGISTERS else told[_PLACE[:, full].argmin(1)]


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows, and their standard errors at the threshold.

    Chance agreement of compressed registers is taken off. Registers of small sets repeat one another, so the error goes
    by the buckets that the smaller set fills.
    """
    same = (a == b).sum(1)
    z = np.arange(56)

    def of_zeros(n: np.ndarray) -> np.ndarray:
        load = n[:, None] / REGISTERS
        return np.exp(-load * 2.0 ** -(z + 1)) - np.exp(-load * 2.0**-z)

    by_chance = REGISTERS * (of_zeros(n_a) * of_zeros(n_b)).sum(1) / 2**MANTISSA
    filled = REGISTERS * -np.expm1(-np.minimum(n_a, n_b) / REGISTERS)
    error = 1.5 * np.sqrt(PERCENT * (100 - PERCENT) / 1e4 / np.maximum(filled, 1))
    return np.clip((same - by_chance) / REGISTERS, 0, 1), error


def _set_key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (128-bit hash of the set), registers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, rows = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), hashes)
                sizes.append(len(found))
                keys.append(_set_key(found))
                rows.append(registers(found).astype(">u2").tobytes() if len(found) else None)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "registers"])

    return _hashed(docs).mapInArrow(sketch, f"doc_id {kind}, text_hash bigint, n_shingles bigint, set_key binary, registers binary")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash: the hash tells rows that share a doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes, for the rows of docs (node, text, set_key) that have this set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                rows = [shingle_set(t.as_py(), hashes) for t in part.column(1)]
                same = pa.array([_set_key(r) == k for r, k in zip(rows, part.column(2).to_pylist())], pa.bool_())
                made = [part.column(0), pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["node", "hashes"]).filter(same)

    return docs.select("node", "text", "set_key").mapInArrow(sets, "node bigint, hashes array<bigint>")


def banded(nodes: DataFrame) -> DataFrame:
    """(key, bands, node, n) for each band of each node; given bands, for each further one with the key bound to all of them."""
    width = 2 * ROWS
    value = F.substring("registers", F.col("band") * width + 1, F.lit(width))
    if "bands" not in nodes.columns:
        rows = nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
        return rows.select(F.xxhash64("band", value).alias("key"), F.array("band").alias("bands"), "node", "n")
    last = F.element_at("bands", -1)
    rows = nodes.where(last < BANDS - 1).withColumn("band", F.explode(F.sequence(last + 1, F.lit(BANDS - 1))))
    return rows.select(F.xxhash64("key", "band", value).alias("key"), F.concat("bands", F.array("band")).alias("bands"), "node", "n")


def _agree(low_a: np.ndarray, low_b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether the smallest hashes leave the threshold possible; up to LOWEST shingles they are the whole sets, and the answer is exact."""
    last = np.uint64(2**64 - 1)
    limit = min(low_a[-1] if n_a > LOWEST else last, low_b[-1] if n_b > LOWEST else last)
    a, b = low_a[: np.searchsorted(low_a, limit, "right")], low_b[: np.searchsorted(low_b, limit, "right")]
    if not len(a) or not len(b):
        return True
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    union = len(a) + len(b) - common
    if max(n_a, n_b) <= LOWEST:
        return 100 * common >= PERCENT * union
    return common / union >= PERCENT / 100 - 6 * (PERCENT * (100 - PERCENT) / 1e4 / union) ** 0.5


class _Forest:
    """Union-find over the components met in one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (above := self.up.get(c, c)) != c:
            self.up[c] = c = self.up.get(above, above)
        return c

    def unite(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), REGISTERS)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule them out."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("registers").alias(f"r_{c}"), F.col("n").alias(f"n_{c}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
    kind = nodes.schema["node"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                guess, error = estimates(_register_rows(part.column(2)), _register_rows(part.column(3)), part.column(4).to_numpy(), part.column(5).to_numpy())
                yield part.select(["a", "b"]).filter(pa.array(guess >= PERCENT / 100 - 4 * error))

    return joined.mapInArrow(keep, f"a {kind}, b {kind}")


def _likely_in_blocks(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): likely pairs of different components among the rows (key, bands, node, n, comp, members) of each bucket.

    A bucket of m members makes ceil(m / BLOCK) parts; each row is sent to the blocks its part takes part in, so a block
    has at most about twice BLOCK rows, whatever the bucket's size.
    """
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int")
    each = rows.withColumn("parts", parts).withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = each.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "comp", "bands")
    low = sets.select("node", F.slice("hashes", 1, LOWEST).alias("low"))
    told = nodes.select("node", "registers").join(low, "node")
    full = dealt.join(told, "node").select("key", "i", "j", "part", "node", "n", "comp", "bands", "registers", "low")
    kind = nodes.schema["node"].dataType.simpleString()
    spread = full.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def likely(held: pa.Table) -> pa.RecordBatch:
            """Pairs inside each block of whole blocks."""
            i, j, part, node, n, comp = (held.column(c).to_numpy() for c in ("i", "j", "part", "node", "n", "comp"))
            key = held.column("key").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            registers = _register_rows(held.column("registers").combine_chunks())
            lows = held.column("low").combine_chunks()
            low = np.split(lows.flatten().to_numpy().view(np.uint64), (lows.offsets.to_numpy() - lows.offsets[0].as_py())[1:-1])
            bands = held.column("bands").to_pylist()
            out_a, out_b = [], []
            for start, end in zip(np.append(0, cuts), np.append(cuts, len(key))):
                if i[start] == j[start]:
                    left, right = np.triu_indices(end - start, 1)
                else:
                    first = part[start:end] == i[start]
                    left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
                left, right = left + start, right + start
                ok = (comp[left] != comp[right]) & (100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right]))
                left, right, mine = left[ok], right[ok], np.array(bands[start])
                forest = _Forest()
                for k in range(0, len(left), 8192):
                    a, b = left[k : k + 8192], right[k : k + 8192]
                    guess, error = estimates(registers[a], registers[b], n[a], n[b])
                    same = (registers[a, : ROWS * BANDS] == registers[b, : ROWS * BANDS]).reshape(len(a), BANDS, ROWS).all(2)
                    order = np.cumsum(same, 1)
                    here = same[:, mine].all(1) & (order[:, mine] == np.arange(1, len(mine) + 1)).all(1)
                    good = here & (guess >= PERCENT / 100 - 4 * error)
                    for x, y in zip(a[good], b[good]):
                        if forest.root(comp[x]) != forest.root(comp[y]) and _agree(low[x], low[y], n[x], n[y]):
                            if max(n[x], n[y]) <= LOWEST:  # held whole: the link is sure
                                forest.unite(comp[x], comp[y])
                            out_a.append(min(node[x], node[y]))
                            out_b.append(max(node[x], node[y]))
            return pa.RecordBatch.from_arrays([pa.array(out, held.schema.field("node").type) for out in (out_a, out_b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                key, i, j = (part.column(c).to_numpy() for c in (0, 1, 2))
                changes = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py(), held[-1].column(2)[-1].as_py()) != (key[0], i[0], j[0]):
                    changes = np.append(0, changes)
                if len(changes):  # the last block may go on in the next rows
                    held.append(part.slice(0, changes[-1]))
                    if any(map(len, held)):
                        yield likely(pa.Table.from_batches([h for h in held if len(h)]))
                    held = [part.slice(changes[-1])]
                else:
                    held.append(part)
        if held:
            yield likely(pa.Table.from_batches(held))

    return spread.mapInArrow(compare, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return both.where(100 * common >= PERCENT * (F.size("h_a") + F.size("h_b") - common)).select("a", "b")


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) reaches; a table of the given name."""
    both = tables.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = tables.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        jump = labels.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump")), "comp").select("node", F.col("comp").alias("was"), "jump")
        moved = tables.write(jump.join(near, "node").select("node", "was", F.least("jump", "near").alias("comp")), name)
        labels = moved.select("node", "comp")
        if moved.where("comp != was").isEmpty():
            tables.drop("edges")
            return labels


class _Linker:
    def __init__(self, tables: Tables, nodes: DataFrame, sets: DataFrame):
        self.tables, self.nodes, self.sets, self.comps = tables, nodes, sets, None

    def labelled(self, buckets: DataFrame) -> DataFrame:
        rows = buckets.select("key", "bands", "node", "n")
        if self.comps is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def open(self, buckets: DataFrame, order, name: str = "open") -> DataFrame:
        """Rows of the buckets that join several components, with the bucket's size and centre (least by order)."""
        rows = self.tables.write(self.labelled(buckets), "rows")
        lead = F.min(F.struct(order.alias("order"), "node", "comp", "n")).alias("centre")
        stats = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"), lead)
        stats = self.tables.write(stats.where("low < high").select("key", "members", "centre"), "stats")
        told = rows.join(stats, "key").select("key", "bands", "node", "n", "comp", "members", F.col("centre.node").alias("c_node"), F.col("centre.comp").alias("c_comp"), F.col("centre.n").alias("c_n"))
        found = self.tables.write(told, name)
        self.tables.drop("rows", "stats")
        return found

    def link(self, likely: DataFrame) -> None:
        """Verifies the pairs (a, b) and joins the components of those that hold."""
        links = _verified(likely, self.sets)
        if self.comps is None:
            links = self.tables.write(links, "links")
            if not links.isEmpty():
                self.comps = components(links, self.tables, "comps")
            return
        of = lambda c: self.comps.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}"))
        joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))
        joined = self.tables.write(joined, "links")
        edges = joined.where("c_a != c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        if edges.isEmpty():
            return
        merged = components(edges, self.tables, "merged").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        fresh = joined.select(F.col("a").alias("node"), F.col("c_a").alias("comp")).unionByName(joined.select(F.col("b").alias("node"), F.col("c_b").alias("comp")))
        everyone = self.comps.unionByName(fresh).distinct()
        self.comps = self.tables.write(everyone.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")
        self.tables.drop("merged")

    def settle(self, buckets: DataFrame) -> None:
        """Finer buckets only join components early: the large buckets of the first level are compared whole at the end."""
        whole = None
        for level in range(1, LEVELS + 1):
            for t in range(CENTRES):
                rows = buckets = self.open(buckets, F.xxhash64("node", F.lit(t)))  # the table it was made from is gone by now
                if rows.isEmpty():
                    break
                alike = 100 * F.least("n", "c_n") >= PERCENT * F.greatest("n", "c_n")
                pairs = rows.where(F.col("comp") != F.col("c_comp")).where(alike).select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()
                self.link(_likely(pairs, self.nodes))
            rows = self.open(buckets, F.col("node"))
            if rows.isEmpty():
                break
            large = F.col("members") > LARGE
            self.link(_likely_in_blocks(rows.where(~large), self.nodes, self.sets))
            rest = self.tables.write(rows.where(large), "large" if level == 1 else "rest")
            if level == 1:
                whole = rest
            if level == LEVELS or rest.isEmpty():
                break
            finer = rest.select("key", "bands", "node").join(self.nodes, "node")
            buckets = self.tables.write(banded(finer.select("key", "bands", "node", "n", "registers")), "buckets")
        if whole is None or whole.isEmpty():
            return
        rows = self.open(whole, F.col("node"))
        self.link(_likely_in_blocks(rows, self.nodes, self.sets))


def _classed(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    drawn = tables.write(sketches(docs), "sketches")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    of_set = drawn.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(first)
    of_set = tables.write(of_set.select("set_key", "first.*", F.monotonically_increasing_id().alias("node")), "of_set")
    nodes = drawn.join(of_set, ["set_key", "doc_id", "text_hash"]).dropDuplicates(["node"])
    nodes = tables.write(nodes.select("node", F.col("n_shingles").alias("n"), "registers"), "nodes")
    slim = tables.write(drawn.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), "slim")
    tables.drop("sketches")
    rows = banded(nodes)
    shared = tables.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
    buckets = tables.write(rows.join(shared, "key", "left_semi"), "buckets")
    meeting = tables.write(nodes.join(buckets.select("node").distinct(), "node", "left_semi"), "meeting")
    tables.drop("nodes", "keys")
    wanted = of_set.join(meeting.select("node"), "node", "left_semi")
    sets = tables.write(shingle_sets(_hashed(docs).join(wanted, ["doc_id", "text_hash"])).dropDuplicates(["node"]), "sets")
    linker = _Linker(tables, meeting, sets)
    linker.settle(buckets)
    least = of_set.select("set_key", F.col("doc_id").alias("component_id"))
    if linker.comps is not None:
        linked = of_set.join(linker.comps, "node")
        lowest = linked.groupBy("comp").agg(F.min("doc_id").alias("lowest"))
        least = of_set.join(linked.join(lowest, "comp").select("node", "lowest"), "node", "left").select("set_key", F.coalesce("lowest", "doc_id").alias("component_id"))
    told = ["doc_id", "text_hash", "n_shingles", "component_id"]
    placed = slim.where("set_key is not null").join(least, "set_key").select(told)
    alone = slim.where("set_key is null").withColumn("component_id", F.col("doc_id")).select(told)
    found = tables.write(placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "found")
    tables.drop_all_but("found")
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return _classed(docs).drop("text_hash")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; of the kept rows that share a doc_id one stays."""
    stay = _classed(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))
    found = rows.join(stay, ["doc_id", "text_hash"], "left_semi").withColumn("place", place).where("place = 1")
    return found.select("row.*").unionByName(docs.where("doc_id is null"))


ORACLE = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= {PERCENT} * (m.n + n.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
components AS (SELECT doc_id, min(other) AS c FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM docs d JOIN components USING (doc_id) LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
