"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams (with word ends) of a text's distinct words. Each n-gram's value is its
log-count ratio between toxic and other training documents; n-grams whose ratio or support is small are left out. A
logistic regression is fitted on the scaled features; its threshold is the contract's.

Ratios and weights are fitted on the driver on a bounded sample of labelled rows: about `per_class` documents of each
class, drawn by a hash of doc_id and weighted back to the class counts of all labelled rows; texts of over `most_chars`
characters are not learned from. Scoring runs over whole
texts in Arrow batches.

Null, empty and wordless texts get the model's score of no feature. Without labels of both classes every score is the
rate of label 1 (0 without labels). A doc_id labelled twice counts as toxic if any label says so. Repeated rows score
alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .ngrams import WordRows, char_grams

PER_CLASS, MOST_CHARS = 3000, 200_000
THRESHOLD = 0.3
SIZES, BITS = (3, 4, 5, 6), 19
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Distinct words in order of their first place."""
    return list(dict.fromkeys(_WORD.findall(text.lower()))) if text else []


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


@dataclass
class NaiveBayesLinear:
    weights: np.ndarray  # by feature, ratio times coefficient
    bias: float

    def contributions(self, words: list[str]) -> np.ndarray:
        at, features = char_grams(words, SIZES, BITS)
        return np.bincount(at, self.weights[features], len(words))[:, None]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, least_ratio: float = 1.0, least_support: int = 3, rounds: int = 150, penalty: float = 1e-3) -> NaiveBayesLinear:
    """weight: what each row stands for."""
    rate = float(np.clip(np.average(toxic, weights=weight), 0, 1)) if len(toxic) else 0.0
    if not 0 < toxic.sum() < len(toxic):
        return NaiveBayesLinear(np.zeros(1 << BITS, np.float32), float(np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -20, 20)))
    place: dict[str, int] = {}
    pairs = [np.fromiter((place.setdefault(w, len(place)) for w in words_of(t)), np.int64) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in pairs])
    word = np.concatenate(pairs)
    at, features = char_grams(list(place), SIZES, BITS)
    # How often each class has an n-gram in a document's distinct words; the ratio is of the n-gram's shares of all.
    support = np.zeros((2, 1 << BITS))
    for label in (0, 1):
        docs_with = np.bincount(word, toxic[doc] == label, len(place))
        support[label] = np.bincount(features, docs_with[at], 1 << BITS)
    shares = (support + 1) / (support + 1).sum(1, keepdims=True)
    ratio = np.log(shares[1]) - np.log(shares[0])
    active = (np.abs(ratio) >= least_ratio) & (support.sum(0) >= least_support)
    keep = active[features]
    at, features = at[keep], features[keep]
    names, column = np.unique(features, return_inverse=True)
    scale, coefficient, bias = ratio[names], np.zeros(len(names)), 0.0
    first, second, share = np.zeros(len(names) + 1), np.zeros(len(names) + 1), weight / weight.sum()
    for i in range(1, rounds + 1):
        of_word = np.bincount(at, (scale * coefficient)[column], len(place))
        margin = np.clip(np.bincount(doc, of_word[word], len(texts)) + bias, -30, 30)
        error = (1 / (1 + np.exp(-margin)) - toxic) * share
        of_word = np.bincount(word, error[doc], len(place))
        slope = np.append(np.bincount(column, of_word[at], len(names)) * scale + penalty * coefficient, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.05 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
        coefficient, bias = coefficient - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = scale * coefficient
    return NaiveBayesLinear(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> NaiveBayesLinear:
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    part = F.when(F.col("toxic") > 0, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))
    drawn = known.where(place < part * (1 << 30)).orderBy(place, "doc_id").limit(4 * per_class)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= most_chars).join(drawn, "doc_id")
    rows = texts.orderBy(place, "doc_id", "text").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text").limit(8 * per_class).collect()
    rows = sorted((r["toxic"], r["text"] or "") for r in rows)
    toxic = np.array([t for t, _ in rows], int)
    stands_for = {k: counts.get(k, 0) / max(1, (toxic == k).sum()) for k in (0, 1)}
    return fit([t for _, t in rows], toxic, np.array([stands_for[t] for t in toxic], float))


def scores(docs: DataFrame, model: NaiveBayesLinear) -> DataFrame:
    """One row per row of docs: doc_id, score."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordRows(shared.value.contributions, 1)
        for batch in batches:
            margins = np.empty(len(batch))
            for start in range(0, len(batch), 256):
                texts = [words_of(t.as_py()) for t in batch.column(1).slice(start, 256)]
                places = cache.places([w for t in texts for w in t])
                owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                margins[start : start + len(texts)] = np.bincount(owner, cache.rows[places, 0], len(texts)) + shared.value.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
