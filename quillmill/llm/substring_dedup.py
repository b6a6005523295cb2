"""Repeated passages by compressed FM-indexes over content-defined shards.

A window is WINDOW consecutive words. It repeats if its word sequence starts anywhere else as well.

1. Every window has a least GRAM-word hash (its anchor); consecutive windows with one anchor make a segment. Equal
   windows have equal anchors, so they can only be found among the segments of one anchor. Anchors that occur once
   cannot hold a repeated window; they are left behind by a count with partial aggregation.
2. Segments with the same words are one from there on, with a count: a passage that a third of all rows carry is one
   row. An anchor that still has more than MOST different segments (what stands before and after a very common passage)
   is cut further: its windows take the place of the segments and their own hash that of the anchor, so they spread over
   the shards; those whose hash occurs once are left behind like anchors that occur once.
3. The segments are dealt by anchor to index shards. Each shard is a suffix array turned into a Burrows-Wheeler
   transform in a wavelet matrix of packed bits; backward search over it gives, for the segments streamed through it,
   the intervals whose windows all occur twice or more (occurrences weighted by the segments' counts). A shard takes
   whole anchors until it has SHARD_WORDS words.
4. Intervals go back to the rows that have the segments, are merged per row, and the covered words are removed.

Words are known by 64-bit hashes, rows by a hash of doc_id and text; rows given twice therefore have all their windows
repeated. Null, empty and short texts lose nothing. Empty tables give empty results. Tables between the steps lie in the
shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, gram_hashes, small_batches, written

WINDOW, GRAM = 35, 12
#: Windows of a segment, different segments of an anchor, and words of an index shard, at most.
SEGMENT_WINDOWS, MOST, SHARD_WORDS = 64, 500, 1_500_000
#: Words at a run's end whose interval is known when a search begins.
SEED = 16
_SPAN = WINDOW - GRAM + 1


def anchors(words: np.ndarray) -> np.ndarray:
    """Least gram hash of each window, by the window's first word."""
    least = gram_hashes(words, GRAM)
    if len(least) < _SPAN:
        return np.empty(0, np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _SPAN - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each segment."""
    anchor = anchors(words)
    if not len(anchor):
        return np.empty(0, np.int64), np.empty(0, np.int64), anchor
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    if sizes.max() > SEGMENT_WINDOWS:
        starts = np.concatenate([np.arange(s, s + n, SEGMENT_WINDOWS) for s, n in zip(starts, sizes)])
        sizes = np.diff(np.append(starts, len(anchor)))
    return starts, sizes, anchor[starts]


def _times_inside(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """How often each segment's anchor stands in it: more than once only where text repeats within WINDOW words or so."""
    grams = gram_hashes(words, GRAM)
    if len(np.unique(grams)) == len(grams):
        return np.ones(len(starts), np.int32)
    return np.array([np.count_nonzero(grams[s : s + n + _SPAN - 1] == a) for s, n, a in zip(starts, sizes, anchor)], np.int32)


def _segments(docs: DataFrame) -> DataFrame:
    """rid, anchor, content (hash of the segment's words), first, windows, inside (times the anchor stands in it)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rids = batch.column(0).to_numpy()
            found = []
            for rid, text in zip(rids, batch.column(1)):
                parts = (text.as_py() or "").encode().split()
                if len(parts) < WINDOW:
                    continue
                words = hashes.of(parts)
                starts, sizes, anchor = segments_of(words)
                raw = words.tobytes()
                content = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * s : 8 * (s + n + WINDOW - 1)]) for s, n in zip(starts.tolist(), sizes.tolist())), np.uint64, len(starts))
                found.append((np.full(len(starts), rid), anchor.view(np.int64), content.view(np.int64), starts.astype(np.int32), sizes.astype(np.int32), _times_inside(words, starts, sizes, anchor)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["rid", "anchor", "content", "first", "windows", "inside"])

    return docs.select("rid", "text").mapInArrow(cut, "rid bigint, anchor bigint, content bigint, first int, windows int, inside int")


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, content, times, words: wanted segments with their words (hashes), taken from the rows they were first seen in."""
    per_row = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "content", "times", "first", "windows")).alias("parts"))
    kind = "anchor bigint, content bigint, times bigint, words array<bigint>"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = []
                for text, parts in zip(batch.column(0).slice(start, 256), batch.column(1).slice(start, 256).to_pylist()):
                    words = hashes.of(text.as_py().encode().split()).view(np.int64)
                    rows += [(p["anchor"], p["content"], p["times"], words[p["first"] : p["first"] + p["windows"] + WINDOW - 1]) for p in parts]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.list_(pa.int64()))], ["anchor", "content", "times", "words"])

    return docs.join(per_row, "rid").select("text", "parts").mapInArrow(take, kind)


class FmIndex:
    """Counts of word runs in a set of segments, by backward search over a wavelet matrix."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, times: np.ndarray):
        """words: all segments' words in a row; times: what each segment counts."""
        self.alphabet, symbols = np.unique(words, return_inverse=True)
        n_segments, n = len(lengths), len(words) + len(lengths)
        # Text: each segment, then its end mark. End marks sort first, by place; symbol 0 stands for all of them.
        self.ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        text[inside] = symbols + 1
        self.starts = self.ends - lengths
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        # Ranks are the first places of groups in suffix order, so a group at any depth is an interval of the final order.
        rank = self.before[text]
        rank[self.ends] = np.arange(n_segments)
        order, step, longest = np.argsort(rank), 1, int(lengths.max(initial=0)) + 1
        self.seeds = None
        while step < longest:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key)
            fresh = key[order]
            starts = np.flatnonzero(np.concatenate([[True], fresh[1:] != fresh[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
            step *= 2
            done = len(starts) == n
            if self.seeds is None and (step >= SEED or done):
                self.seeds = rank
            if done:
                break
        small = lambda of: of.astype(np.uint32 if n < 1 << 32 else np.int64)
        self.seeds, self.seed_sizes = small(self.seeds), small(np.bincount(self.seeds, minlength=n))
        segment = np.repeat(np.arange(n_segments), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(times[segment[order]])])
        if self.weight[-1] < 1 << 32:
            self.weight = self.weight.astype(np.uint32)
        last = text[order - 1]
        self.text, self.n = small(text), n
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(small(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[: len(packed)]))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        # Where each symbol's run begins below the last level: rank queries subtract it.
        symbols, place = np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, np.int64)
        self.offset = self.before[:-1] - self._down(symbols, place)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places followed through all levels along each symbol's bits."""
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.bits[level][block] & mask)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol followed by what the given intervals stand for."""
        at = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.offset[symbol] + at[: len(low)], self.offset[symbol] + at[len(low) :]

    def longest(self, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For runs that end before `end` (places in the text): a start, not under `least`, from which the run occurs twice or more.

        It is the smallest one if the last SEED words occur twice; else the run's last SEED words are unique, and the
        answer is the word after their first. Runs have SEED words or more. The search begins with the interval of the
        last SEED words, which the suffix sort has told.
        """
        reached = end - SEED
        low = self.seeds[reached].astype(np.int64)
        high = low + self.seed_sizes[low]
        good = self.weight[high] - self.weight[low] >= 2
        reached[~good] += 1
        live = np.flatnonzero(good & (reached > least))
        low, high = low[live], high[live]
        while len(live):
            low, high = self.extend(self.text[reached[live] - 1].astype(np.int64), low, high)
            good = self.weight[high] - self.weight[low] >= 2
            live, low, high = live[good], low[good], high[good]
            reached[live] -= 1
            more = reached[live] > least[live]
            live, low, high = live[more], low[more], high[more]
        return reached

    def repeated(self, single: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays (segment, from, to): word intervals of the given segments all of whose windows occur twice or more; together they hold every such window.

        Matching statistics from the segment's end cover most at once; then windows are tried from the left, and one
        whose part from s on is unique rules out every window up to s.
        """
        out = []
        start, end = self.starts[single], self.ends[single]
        reached = self.longest(end, start)
        far = end - reached >= WINDOW
        out.append((single[far], (reached - start)[far], (end - start)[far]))
        at, limit = start.copy(), np.minimum(reached, end - WINDOW + 1)
        live = np.flatnonzero(at < limit)
        while len(live):
            here = at[live]
            s = self.longest(here + WINDOW, here)
            found = s == here
            out.append((single[live[found]], (here - start[live])[found], (here - start[live])[found] + WINDOW))
            at[live] = np.where(found, here + 1, s)
            live = live[at[live] < limit[live]]
        return out


def _searched(segments: DataFrame, n_shards: int) -> DataFrame:
    """anchor, content, spans (from, to): the repeated intervals of each segment; segments of one anchor meet in one shard."""

    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        words, times = part.column(3), part.column(2).to_numpy()
        lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
        index = FmIndex(words.flatten().to_numpy(), lengths, times)
        found = index.repeated(np.arange(len(lengths)))
        segment, start, end = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(segment, kind="stable")
        at, sizes = np.unique(segment, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array(start[order], pa.int32()), pa.array(end[order], pa.int32())], ["from", "to"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), spans)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), lists], ["anchor", "content", "spans"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            if size > SHARD_WORDS:
                # Rows of the anchor that is open still belong to the shard.
                others = np.flatnonzero(batch.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
                n = int(others[0]) if len(others) else len(batch)
                held += [batch.slice(0, n)] * (n > 0)
                if n == len(batch):
                    continue
                yield shard(held)
                held, size, batch = [], 0, batch.slice(n)
            held.append(batch)
            size += len(batch.column(3).flatten())
        if held:
            yield shard(held)

    dealt = segments.select("anchor", "content", "times", "words").repartition(n_shards, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(search, "anchor bigint, content bigint, spans array<struct<from:int,to:int>>")


def _windows(segments: DataFrame) -> DataFrame:
    """anchor, content, at, words: every window of the segments."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                rows = []
                part = batch.slice(start, 512)
                for anchor, content, times, words in zip(*(c.to_pylist() for c in part.columns)):
                    rows += [(anchor, content, times, i, words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
                a, c, t, i, w = zip(*rows)
                hashed = [xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes()) for x in w]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(t, pa.int64()), pa.array(i, pa.int32()), pa.array(np.array(hashed, np.uint64).view(np.int64)), pa.array(w, pa.list_(pa.int64()))], ["anchor", "content", "times", "at", "window", "words"])

    return segments.select("anchor", "content", "times", "words").mapInArrow(split, "anchor bigint, content bigint, times bigint, at int, window bigint, words array<bigint>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """rid, spans: word intervals of each row that repeated windows cover; docs: rid and text."""
    spark = docs.sparkSession
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(_segments(docs), "segments")
    shared = cut.groupBy("anchor").agg(F.sum("inside").alias("c")).where("c > 1").select("anchor")
    cut = written(cut.join(shared, "anchor", "left_semi"), "shared")
    first = F.min(F.struct("rid", "first", "windows")).alias("s")
    distinct = cut.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), first).select("anchor", "content", "times", "s.rid", "s.first", "s.windows")
    distinct = written(distinct, "distinct")
    crowded = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MOST).select("anchor"), "crowded")
    words = written(_with_words(docs, distinct).dropDuplicates(["anchor", "content"]), "words")
    found = _searched(words.join(crowded, "anchor", "left_anti"), n_shards)
    if not crowded.isEmpty():
        found = found.unionByName(_of_crowded(words.join(crowded, "anchor", "left_semi"), n_shards))
    found = written(found, "found")
    spans = F.transform("spans", lambda s: F.struct((F.col("first") + s["from"]).alias("from"), (F.col("first") + s["to"]).alias("to")))
    back = cut.select("rid", "anchor", "content", "first").join(found, ["anchor", "content"]).select("rid", spans.alias("spans"))
    return back.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _of_crowded(segments: DataFrame, n_shards: int) -> DataFrame:
    """The same for anchors with very many different segments, through their windows."""
    windows = written(_windows(segments), "windows")
    grouped = windows.groupBy("window").agg(F.sum("times").alias("times"), F.first("words").alias("words")).where("times > 1")
    kept = grouped.select(F.col("window").alias("anchor"), F.col("window").alias("content"), "times", "words")
    found = _searched(kept, n_shards).select(F.col("content").alias("window"))
    each = windows.select("anchor", "content", "at", "window").join(found, "window")
    span = F.struct(F.col("at").alias("from"), (F.col("at") + WINDOW).alias("to"))
    return each.groupBy("anchor", "content").agg(F.collect_list(span).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by one space)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    marked = keyed.join(repeated_spans(keyed), "rid", "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                totals, gone, digests, texts = [], [], [], []
                for text, spans in zip(part.column(1), part.column(2).to_pylist()):
                    words = (text.as_py() or "").encode().split()
                    kept = words
                    if spans:
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, [s["from"] for s in spans], 1)
                        np.add.at(edges, [s["to"] for s in spans], -1)
                        kept = [w for w, c in zip(words, np.cumsum(edges).tolist()) if not c]
                    joined = b" ".join(kept)
                    totals.append(len(words))
                    gone.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return marked.mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT rid, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM docs) t),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN repeated USING (h)),
lost AS (SELECT rid, count(*) AS n, list(p) AS places FROM gone GROUP BY rid),
kept AS (
  SELECT d.rid, sha256(coalesce(string_agg(d.x, ' ' ORDER BY d.p), '')) AS h
  FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs) d LEFT JOIN gone g ON g.rid = d.rid AND g.p = d.p WHERE g.rid IS NULL GROUP BY d.rid)
SELECT doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, coalesce(kept.h, sha256('')) AS kept_sha256
FROM docs LEFT JOIN lost ON lost.rid = docs.rid LEFT JOIN kept ON kept.rid = docs.rid
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
