"""Spelling variants: distance-one Levenshtein automata of all words, intersected with broadcast trie shards.

Words are counted with a partial count per Arrow batch. The vocabulary, sorted by length class and word, is cut into
shards of at most SHARD_WORDS words and SHARD_CELLS letters (one longer word is a shard of its own); each shard is a
compact trie, stored in a table. Shards are broadcast a few at a time, in groups of at most GROUP_BYTES (or one shard);
every word meets every shard whose lengths allow it. Inside a task the automata of a block of words walk the tries
depth-first, block by block: a state is (word, letters read, node, errors), a state without an error goes to every child,
a state with one follows the one child that matches. Only the count of near words and the best one leave the task, never
the pairs; groups of shards are then reduced by word. Roots come from pointer doubling: a form is at least twice as
frequent as its word, so chains are short.

Null and empty texts have no words. A null doc_id counts as the empty string in the hash. Repeated rows count as often as
they stand there. Ties go to the word that is smallest in code-point order. Very long runs are words like others. Empty
tables give empty results.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, gathered, small_batches

EVERY, LETTERS, TIMES, RATIO = 97, 5, 3, 2
#: Words and letter cells of a shard; bytes of the shards broadcast together; words and letter cells of a block; bytes of text at once; words of a task.
SHARD_WORDS, SHARD_CELLS, GROUP_BYTES = 1 << 17, 1 << 22, 32 << 20
BLOCK_WORDS, BLOCK_CELLS, CHUNK_BYTES, WORDS_A_TASK = 1024, 1 << 20, 4 << 20, 1 << 15
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def observed(doc_id: object, text: str, found: Counter) -> None:
    """Adds a text's words: its lower-cased runs, of which one code point goes where the hash of document and run says so."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), head)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LETTERS:
            found[run] += n


def counts(docs: DataFrame) -> DataFrame:
    """word, n of the words of at least TIMES occurrences."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, CHUNK_BYTES):
            found: Counter = Counter()
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    observed(doc_id, text, found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    told = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of Latin-1 words, filled up with zeros, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    width = int(sizes.max(initial=1))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), sizes


class Trie:
    """A forest of tries of sorted words in level order: children of a node stand together, in the order of their letters.

    parent and letter are given for all nodes but roots; word is the number of the word that ends in a node, else -1.
    """

    def __init__(self, parent: np.ndarray, letter: np.ndarray, word: np.ndarray, n: np.ndarray, words: list[bytes], roots: np.ndarray, sizes: np.ndarray):
        self.word, self.n, self.words, self.roots, self.sizes = word, n, words, roots, sizes
        inner = np.flatnonzero(parent >= 0)
        self.keys, self.child = parent[inner].astype(np.int64) << 8 | letter[inner], inner.astype(np.int32)
        self.letter, self.n_children = letter, np.bincount(parent[inner], minlength=len(word)).astype(np.int32)
        self.first = np.zeros(len(word), np.int32)
        at = np.flatnonzero(np.diff(self.keys >> 8, prepend=-1))
        self.first[self.keys[at] >> 8] = self.child[at]

    @staticmethod
    def packed(words: list[bytes], n: list[int]) -> dict[str, bytes]:
        """The shard of sorted, distinct words as bytes: parents, letters, words of the nodes, counts, words, shortest and longest length."""
        letters, sizes = _matrix(words)
        m, width = letters.shape
        depth = np.arange(width)
        same = np.zeros((m, width), bool)
        same[1:] = np.logical_and.accumulate((letters[1:] == letters[:-1]) & (depth < sizes[:-1, None]) & (depth < sizes[1:, None]), axis=1)
        new = ~same & (depth < sizes[:, None])
        level = np.append(0, np.cumsum(new.sum(0)))  # nodes of a level, behind the root and the levels before
        parents, told, ends = [np.array([-1])], [np.zeros(1, np.uint8)], np.full(1 + level[-1], -1, np.int32)
        above = np.zeros(m, np.int64)
        for d in range(width):
            mine = np.cumsum(new[:, d]) + level[d]  # the node of each word at this depth, if it has one
            parents.append(above[new[:, d]])
            told.append(letters[new[:, d], d])
            over = np.flatnonzero(sizes == d + 1)
            ends[mine[over]] = over
            above = mine
        packed = {"parent": np.concatenate(parents).astype(np.int32), "letter": np.concatenate(told), "ends": ends, "n": np.array(n, np.int64), "sizes": np.array([sizes.min(), sizes.max()], np.int32)}
        return {k: v.tobytes() for k, v in packed.items()} | {"words": b"\n".join(words)}

    @classmethod
    def forest(cls, shards: list[dict[str, bytes]]) -> Trie:
        parent, letter, ends, n, words, roots, nodes = [], [], [], [], [], [], 0
        for s in shards:
            up, last = np.frombuffer(s["parent"], np.int32), np.frombuffer(s["ends"], np.int32)
            parent.append(np.where(up < 0, -1, up + nodes))
            letter.append(np.frombuffer(s["letter"], np.uint8))
            ends.append(np.where(last < 0, -1, last + len(words)))
            n.append(np.frombuffer(s["n"], np.int64))
            roots.append(nodes)
            words += s["words"].split(b"\n")
            nodes += len(up)
        sizes = np.array([np.frombuffer(s["sizes"], np.int32) for s in shards])
        return cls(np.concatenate(parent), np.concatenate(letter), np.concatenate(ends), np.concatenate(n), words, np.array(roots, np.int32), sizes)

    def follow(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children under the letters, -1 where there is none."""
        keys = node.astype(np.int64) << 8 | letter
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.child[at], -1)

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the given words and of the forest's words at distance one, each pair once."""
        letters, sizes = _matrix(words)
        w, shard = np.nonzero((self.sizes[:, 0] <= sizes[:, None] + 1) & (self.sizes[:, 1] >= sizes[:, None] - 1))
        states = [(w.astype(np.int32), np.zeros(len(w), np.int32), self.roots[shard])]
        found_a, found_b = [], []

        def rest_matches(w: np.ndarray, i: np.ndarray, node: np.ndarray) -> None:
            """States with an error: what is left of the word must follow exactly."""
            while len(w):
                over = i == sizes[w]
                end = self.word[node[over]]
                found_a.append(w[over][end >= 0])
                found_b.append(end[end >= 0])
                w, i, node = w[~over], i[~over], node[~over]
                node = self.follow(node, letters[w, i])
                on = node >= 0
                w, i, node = w[on], i[on] + 1, node[on]

        while states:
            w, i, node = states.pop()
            if len(w) > BLOCK_WORDS:
                states.append((w[BLOCK_WORDS:], i[BLOCK_WORDS:], node[BLOCK_WORDS:]))
                w, i, node = w[:BLOCK_WORDS], i[:BLOCK_WORDS], node[:BLOCK_WORDS]
            left = i < sizes[w]
            here = letters[w, np.minimum(i, letters.shape[1] - 1)]
            # A letter is deleted: of equal letters in a row, the first.
            gone = left & ((i == 0) | (here != letters[w, np.maximum(i - 1, 0)]))
            rest_matches(w[gone], i[gone] + 1, node[gone])
            # To every child: with the word's letter, with another instead, or with one inserted.
            many = self.n_children[node]
            of = np.repeat(np.arange(len(w)), many)
            child = self.first[node][of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
            cw, ci, clear = w[of], i[of], left[of]
            same = clear & (self.letter[child] == here[of])
            if same.any():
                states.append((cw[same], ci[same] + 1, child[same]))
            other = clear & ~same
            rest_matches(np.concatenate([cw[other], cw[~same]]), np.concatenate([ci[other] + 1, ci[~same]]), np.concatenate([child[other], child[~same]]))
        return np.concatenate(found_a or [np.empty(0, np.int32)]), np.concatenate(found_b or [np.empty(0, np.int32)])


def shards(words: DataFrame) -> DataFrame:
    """Tries over the words in the order of length class and word: parent, letter, ends, n, sizes, words, bytes."""
    parts = ["parent", "letter", "ends", "n", "sizes", "words"]
    spread = words.withColumn("class", F.floor(F.log2(F.length("word"))))
    spread = spread.repartitionByRange(max(1, -(-words.count() // SHARD_WORDS)), "class", "word")
    ordered = spread.sortWithinPartitions("class", "word").select("word", "n")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard() -> pa.RecordBatch:
            made = Trie.packed(held, n)
            columns = [pa.array([made[p]], pa.binary()) for p in parts]
            return pa.RecordBatch.from_arrays(columns + [pa.array([sum(map(len, made.values()))], pa.int64())], parts + ["bytes"])

        held, n, longest = [], [], 0
        for batch in batches:
            for word, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = word.encode("latin-1")
                if held and (len(held) == SHARD_WORDS or (len(held) + 1) * max(longest, len(word)) > SHARD_CELLS or word <= held[-1]):
                    yield shard()
                    held, n, longest = [], [], 0
                held.append(word)
                n.append(times)
                longest = max(longest, len(word))
        if held:
            yield shard()

    return ordered.mapInArrow(build, ", ".join(f"{p} binary" for p in parts) + ", bytes bigint")


def _blocks(words: list[bytes]) -> Iterator[list[bytes]]:
    held, longest = [], 0
    for w in words:
        if held and (len(held) == BLOCK_WORDS or (len(held) + 1) * max(longest, len(w)) > BLOCK_CELLS):
            yield held
            held, longest = [], 0
        held.append(w)
        longest = max(longest, len(w))
    if held:
        yield held


@functools.lru_cache(maxsize=1)
def _forest(token: str, shared: Broadcast) -> Trie:
    """The broadcast shards as one forest, built once a worker."""
    return Trie.forest(shared.value)


def _met(words: DataFrame, shared: Broadcast) -> DataFrame:
    """word, n_near, best_n, best: over the words near it in the broadcast shards."""
    token = uuid.uuid4().hex

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest = _forest(token, shared)
            for block in _blocks([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                a, b = forest.near(block)
                if not len(a):
                    continue
                # By word; the most frequent near word first, of these the smallest.
                best = forest.n[b]
                order = np.lexsort((-best, a))
                starts = np.flatnonzero(np.diff(a[order], prepend=-1))
                tops = np.repeat(best[order[starts]], np.diff(np.append(starts, len(order))))
                tied = order[best[order] == tops]
                least: dict[int, bytes] = {}
                for k, word in zip(a[tied].tolist(), map(forest.words.__getitem__, b[tied].tolist())):
                    if k not in least or word < least[k]:
                        least[k] = word
                sizes = np.diff(np.append(starts, len(order)))
                told = [[block[k].decode("latin-1") for k in a[order[starts]]], sizes.tolist(), best[order[starts]].tolist(), [least[k].decode("latin-1") for k in a[order[starts]].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    return words.select("word").mapInArrow(meet, "word string, n_near bigint, best_n bigint, best string")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    spark = docs.sparkSession
    tables = Tables(spark)
    words = tables.write(counts(docs), "words")
    dealt = words.repartition(-(-words.count() // WORDS_A_TASK) or 1)
    tries = tables.write(shards(words).withColumn("id", F.monotonically_increasing_id()), "tries")
    groups, room = [[]], 0
    for row in tries.select("id", "bytes").orderBy("id").collect():  # two numbers a shard
        if groups[-1] and room + row["bytes"] > GROUP_BYTES:
            groups.append([])
            room = 0
        groups[-1].append(row["id"])
        room += row["bytes"]
    met = []
    for k, ids in enumerate(groups):
        if ids:
            held = [r.asDict() for r in tries.where(F.col("id").isin(ids)).drop("id", "bytes").collect()]
            shared = spark.sparkContext.broadcast(held)
            met.append(tables.write(_met(dealt, shared), f"met{k}"))
            shared.unpersist()
    near = met[0] if met else words.selectExpr("word", "n as n_near", "n as best_n", "word as best").where("false")
    for other in met[1:]:
        near = near.unionByName(other)
    # Of equal counts the smallest word: Spark's string order is that of code points.
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), top)
    found = words.join(near, "word", "left")
    held = F.coalesce(-F.col("top.less") >= RATIO * F.col("n"), F.lit(False))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("top.best")).alias("form"), F.when(held, -F.col("top.less")).alias("form_n"))
    found = tables.write(found, "found")
    roots = tables.write(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = tables.write(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    out = tables.write(found.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
    tables.drop_all_but("variants")
    return out


#: CRC-32 of each byte, with which SQL works out the hash of document and run.
_CRC = ", ".join(str(zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0")) for b in range(256))
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT [{_CRC}] AS t),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY doc_id, run),
octets AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, strlen(coalesce(doc_id::VARCHAR, '') || ':' || run) AS size FROM runs),
hashed AS MATERIALIZED (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]::BIGINT)), 4294967295::BIGINT) AS h FROM octets, crc),
observed AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM observed WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(times) >= {TIMES}),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
without AS MATERIALIZED (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM places),
holes AS MATERIALIZED (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS hole FROM places),
pairs AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.short = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.short = b.word),
met AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, struct_pack(n := -near_n, w := near)) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
  FROM words LEFT JOIN met USING (word)),
walked AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walked w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, n, n_near, form_n FROM formed f JOIN walked w ON w.word = f.word AND w.next IS NULL
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
