"""Byte-level BPE encoding and decoding through a pair occurrence index.

Texts are split into pre-tokens; the distinct new pre-tokens of a partition's next CHUNK_BYTES of text are laid out as
one array of byte symbols. An index maps each mergeable pair's rank to the array of all its positions; active ranks are
taken in ascending order, each is applied to all its positions at once (left to right where a symbol pairs with itself),
and the pairs that appear next to the merges enter their own ranks' lists. A merge's own symbol only occurs in pairs of
higher rank, so ascending order over the array is ascending order within every pre-token. Encoded pre-tokens are kept in
two generations of at most about `most` each: what is met again outlives a change of generation. Decoding joins the
bytes of the tokens.

Special tokens of the file that stand in a text are tokens of their own, as in the tokenizers library's default.
Null text counts as empty: 0 tokens, the digests of the empty string. Repeated rows encode alike. Memory per task is
about CHUNK_BYTES of text (or one longer text) with its pre-tokens, and the kept pre-tokens. The vocabulary file's path
is a parameter; it must be readable on every executor.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, gathered, small_batches

#: Bytes of text whose new pre-tokens are encoded by one index.
CHUNK_BYTES = 2_000_000

#: The public split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, most: int = 100_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary = told["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.digits_of = {i: b"%d" % i for i in self.bytes_of}
        self.end = max(self.bytes_of) + 1  # the mark between pre-tokens; it is in no pair
        self.first = np.array([vocabulary[c] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        self.merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        keys = np.array([a * self.end + b for a, b, _ in self.merges] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.append(order[:-1], -1)
        self.pattern = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most = most
        self.forget()

    def _specials(self) -> tuple[dict[str, bytes], dict[str, bytes]]:
        return {t: self.digits_of[i] for t, i in self.special.items()}, {t: self.bytes_of[i] for t, i in self.special.items()}

    def forget(self) -> None:
        """Keeps no pre-token: a worker that goes on to other tasks holds the vocabulary alone."""
        self.ids_of, self.raw_of = self._specials()  # of pre-tokens: ids joined by commas, and the bytes they decode to
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; -1 where the two never merge."""
        key = left * self.end + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def ids(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in a row, and where each pre-token's ids begin (with the end), by one index over all of them."""
        raw = [p.encode() for p in pre_tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(sizes.sum()) + len(raw) + 1
        inside = np.ones(n, bool)  # an end mark stands before, between and after the pre-tokens
        inside[np.append(0, np.cumsum(sizes + 1))] = False
        symbols = np.full(n, self.end)
        symbols[inside] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            """Adds the places to the occurrence lists of their pairs' ranks."""
            known = ranks >= 0
            ranks, places = ranks[known], places[known]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(ranks)]):
                if start < end:
                    rank = int(ranks[start])
                    if rank in where:
                        where[rank].append(places[start:end])
                    else:
                        where[rank] = [places[start:end]]
                        heapq.heappush(active, rank)

        enter(self.ranks(symbols[:-1], symbols[1:]), np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            left, right, whole = self.merges[rank]
            lists = where.pop(rank)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[(symbols[i] == left) & (symbols[after[i]] == right)]
            if left == right and len(i) > 1:
                # In a run of the same symbol every second pair merges, from the left.
                follows = np.append(False, after[i[:-1]] == i[1:])
                count = np.arange(len(i))
                i = i[(count - np.maximum.accumulate(np.where(follows, 0, count))) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = whole, -1
            after[i], before[k] = k, i
            h = before[i]
            enter(np.concatenate([self.ranks(symbols[i], symbols[k]), self.ranks(symbols[h], symbols[i])]), np.concatenate([i, h]))
        left_over = symbols >= 0
        begins = np.cumsum(left_over & inside)[~inside]
        return symbols[left_over & inside], begins

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand as themselves."""
        if self.splits is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        return [p for part in self.splits.split(text) for p in ([part] if part in self.special else self.pattern.findall(part))]

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes what is new among the pre-tokens of the texts. What was not met again while `most` others came is forgotten."""
        if len(self.ids_of) > self.most:
            self.older = self.ids_of, self.raw_of
            self.ids_of, self.raw_of = self._specials()
        new = set().union(*texts).difference(self.ids_of)
        again = new.intersection(self.older[0])
        for of, older in zip((self.ids_of, self.raw_of), self.older):
            of.update(zip(again, map(older.__getitem__, again)))
        new = list(new - again)
        ids, begins = self.ids(new)
        ids, begins = ids.tolist(), begins.tolist()
        digits, raw = list(map(self.digits_of.__getitem__, ids)), list(map(self.bytes_of.__getitem__, ids))
        for p, start, end in zip(new, begins, begins[1:]):
            self.ids_of[p] = b",".join(digits[start:end])
            self.raw_of[p] = b"".join(raw[start:end])

    def encoded(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text: its ids joined by commas, and the bytes they decode to."""
        parts = [self.pre_tokens(t) for t in texts]
        self.learn(parts)
        for p in parts:
            yield b",".join(map(self.ids_of.__getitem__, p)), b"".join(map(self.raw_of.__getitem__, p))


def _as_text(raw: bytes) -> bytes:
    """The UTF-8 of the text that the bytes decode to: bytes that aren't UTF-8 become replacement characters."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and on request the ids themselves."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for part in gathered(batches, CHUNK_BYTES):
            counts, told, back, found = [], [], [], []
            for row, raw in bpe.encoded([t or "" for t in part.column(1).to_pylist()]):
                counts.append(row.count(b",") + 1 if row else 0)
                told.append(hashlib.sha256(row).hexdigest())
                back.append(hashlib.sha256(_as_text(raw)).hexdigest())
                if ids:
                    found.append(np.fromstring(row, np.int32, sep=","))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]
            if ids:
                columns.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    path = path or default_path()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _loaded(path).bytes_of
        for batch in batches:
            texts = [None if x is None else b"".join([bytes_of[i] for i in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
