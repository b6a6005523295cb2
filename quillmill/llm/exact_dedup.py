"""Exact duplicates by progressive refinement: length, then a prefix hash, then the hash of the whole text.

Only DataFrame functions. Each level looks at less: rows are counted by length and prefix hash (pre-aggregated before
they are dealt, so a hot length is one row a task), a prefix counts only where its length repeats, and whole texts are
hashed only where length and prefix repeat. Texts travel once, to the survivors' join; where all digests are asked for
they are taken in the first pass instead and only the digests travel. Joins back to rows (on length and prefix, on the
digest, on the row) are plain sort-merge joins of written tables, so adaptive execution splits their hot keys.

Null text counts as empty. Rows with equal doc_id and equal text are one document given twice: one of them stays.
A null doc_id sorts after all others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Tables, documents, whole_text

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 64


def normalised(column: str = "text") -> Column:
    """The text without any ASCII white space."""
    return F.regexp_replace(whole_text(column), SPACE + "+", "")


def _signed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), text_hash, n_code_points, norm_len, prefix_hash of each row; more may use `norm`, the normalised text."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", whole_text()).alias("row_key"), F.xxhash64(whole_text()).alias("text_hash"), F.length(whole_text()).cast("long").alias("n_code_points"), normalised().alias("norm"))
    return rows.select("doc_id", "row_key", "text_hash", "n_code_points", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash"), *more)


def surviving_prefixes(signed: DataFrame) -> DataFrame:
    """(norm_len, prefix_hash) shared by two rows or more; prefixes count only where the length repeats."""
    counts = signed.groupBy("norm_len", "prefix_hash").agg(F.count(F.lit(1)).alias("rows"))
    lengths = counts.groupBy("norm_len").agg(F.sum("rows").alias("rows")).where("rows > 1")
    return counts.where("rows > 1").join(lengths, "norm_len", "left_semi").select("norm_len", "prefix_hash")


def exact_duplicates(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, full_hash, row_key, text_hash.

    full_hash (SHA-256 of the normalised text) is null for rows that no other row can equal, unless digest_all;
    row_key and text_hash are 64-bit hashes of doc_id with text and of the text. Of a group the longest original text
    stays, then the smallest doc_id.
    """
    tables = Tables(docs.sparkSession)
    full = F.sha2(F.col("norm"), 256)
    signed = tables.write(_signed(docs, full.alias("full_hash")) if digest_all else _signed(docs), "signed")
    survivors = tables.write(surviving_prefixes(signed).withColumn("survives", F.lit(True)), "survivors")
    texts = signed if digest_all else _signed(docs, F.col("norm"))
    hashed = texts.join(survivors, ["norm_len", "prefix_hash"], "left").select(
        "doc_id", "n_code_points", "row_key", "text_hash", F.coalesce("survives", F.lit(False)).alias("survives"),
        ("full_hash" if digest_all else F.when(F.col("survives"), full).alias("full_hash")),
    )
    rows = tables.write(hashed, "rows")
    tables.drop("signed", "survivors")
    alike = rows.where("survives")
    best = F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    groups = tables.write(alike.groupBy("full_hash").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    again = Window.partitionBy("full_hash", "doc_id", "n_code_points").orderBy("text_hash")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_code_points") == -F.col("best.n"))
    marked = alike.withColumn("copy", F.row_number().over(again)).join(groups, "full_hash")
    marked = marked.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (is_best & (F.col("copy") == 1)).alias("kept"), "full_hash", "row_key", "text_hash")
    single = rows.where("not survives").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", "row_key", "text_hash")
    return marked.unionByName(single)


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts."""
    stay = exact_duplicates(docs).where("kept").select(F.col("row_key").alias("stay_key"), F.col("text_hash").alias("stay_hash"))
    tagged = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", whole_text()).alias("row_key"), F.xxhash64(whole_text()).alias("row_hash"))
    found = tagged.join(stay, (F.col("row_key") == F.col("stay_key")) & (F.col("row_hash") == F.col("stay_hash")), "left_semi")
    given_twice = Window.partitionBy("row_key", "row_hash").orderBy("row_hash")
    return found.withColumn("copy", F.row_number().over(given_twice)).where("copy = 1").select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256
FROM rows
"""
