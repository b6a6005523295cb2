"""A training-corpus pipeline of the operators in quillmill.llm.

STAGES are applied in order; each takes what its predecessor kept, whole. The first four return the columns of
documents, the last returns doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from quillmill.llm.common import Tables, documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose best language has a mean posterior under one half.

    Without a labelled row there is no model, and nothing is rejected.
    """
    return language_id.identified(docs, language_id.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal without white space."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component."""
    return near_dedup.without_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again."""
    return bpe.encoded(docs, ids=True)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: SQL cannot express the stages. tests/llm holds the operators of the last four against brute-force versions or the
#: tokenizers library, and the first against enumerated posteriors and held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's table is deleted once the next one stands."""
    docs, tables = documents(spark, sf_dir), Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop_all_but(name)
    return STAGES[-1][1](spark, docs, sf_dir)
