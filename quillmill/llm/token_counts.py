"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct new pre-tokens of a batch are walked in byte order, which is a walk of their trie: the forward scores of
a shared prefix are worked out once and stay on a stack, and the terminal's count is stored for the pre-token. A text's
count is the sum over its pre-tokens.

The model: pieces of a public rank file (parameter); piece of rank r has probability proportional to 1 / (r + 1), so a
segmentation costs the sum of log(r + 1) plus one constant a piece. The cheapest segmentation counts; at equal cost the
one with fewest tokens. Costs are whole numbers (millionths), so ties are exact. Every byte is a piece, so every text
has a count.

Null and empty texts have 0 tokens. Repeated rows count alike. Memory per task is the Arrow batch, a bounded cache and
the longest pre-token.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import PATTERN
from .common import documents, small_batches

_TOKEN = 1 << 24  # costs are multiples of it; the rest counts tokens


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_costs(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: round(1e6 * (math.log(r + 1) + norm)) * _TOKEN + 1 for piece, r in ranks.items()}


class TrieCounts:
    def __init__(self, path: str, most: int = 500_000):
        self.costs = piece_costs(path)
        self.longest = max(map(len, self.costs))
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.most = most
        self.nodes = 0

    def learn(self, pre_tokens: set[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        cost_of, longest = self.costs.get, self.longest
        best, last = [0], b""
        for word, text in sorted((p.encode(), p) for p in pre_tokens.difference(self.known)):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                least = None
                for start in range(max(0, end - longest), end):
                    if (cost := cost_of(word[start:end])) is not None and (least is None or best[start] + cost < least):
                        least = best[start] + cost
                best.append(least)
            self.nodes += len(word) - shared
            self.known[text] = best[-1] % _TOKEN
            last = word


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> TrieCounts:
    return TrieCounts(path)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_pre_tokens, n_tokens."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _loaded(path)
        for batch in batches:
            pre_tokens, tokens = [], []
            for start in range(0, len(batch), 128):
                texts = [trie.pattern.findall(t.as_py() or "") for t in batch.column(1).slice(start, 128)]
                trie.learn(set().union(*texts))
                pre_tokens += map(len, texts)
                tokens += [sum(map(trie.known.__getitem__, t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre_tokens, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_pre_tokens bigint, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
