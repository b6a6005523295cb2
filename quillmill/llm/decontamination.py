"""Benchmark decontamination by SimHash of item-sized windows.

Only DataFrame functions. Words are letter and digit runs in lower case; shingles are five words. A window is as long
as a benchmark item (its size) and lies where it would put a shared shingle at the place it has in some item of that
size; windows without any benchmark shingle have similarity 0 with all items and are not laid out. Windows with the same
shingles are one from there on, so a passage that a third of the rows carry is fingerprinted and verified once. A
window's SimHash has 64 bits of weighted votes. Fingerprints are cut into RADIUS + 1 blocks: two that differ in at most
RADIUS bits agree in a whole block, so the join on size and block finds every pair within the radius among all items of
the window's size, whichever item it was laid out by. Pairs within it are verified by the exact weighted Jaccard
similarity of their shingle sets; a shingle's weight is one over the number of items that have it. Where items repeat one another that alone would push near copies under the
threshold, so windows and items are also fingerprinted and verified with equal weights: a pair is found if either
similarity allows, and told with the weighted one if that reaches the threshold, else with the plain one. At Jaccard 0.75
and equal sizes fingerprints differ in 11 bits on average; by the binomial law of 64 bits more than RADIUS differ with
probability 2e-7.

The benchmark side is counted first: up to MAX_INLINE distinct shingles it is matched in place, up to MAX_BROADCAST by a
broadcast of the shingles (8 bytes each), so no word of the documents is shuffled; beyond that by a shuffle join. Each
way gives the same rows.

Null, empty and short texts (under five words) have no window. An item of under five words has no shingle; it is found
in the texts that consist of its words alone (similarity 1). Items without a word match nothing. Items that are equal
match alike. Rows given twice are found once per doc_id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, whole_text

WORDS = 5
THRESHOLD = 0.75
BITS, RADIUS = 64, 28
#: Distinct item shingles that may stand as a literal set in the plan (0.2 MB), and that may be broadcast (16 MB).
MAX_INLINE, MAX_BROADCAST = 20_000, 2_000_000
_UNIT = 1_000_000  # weights are whole numbers, so sums don't hang on their order


def words(text: Column) -> Column:
    w = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(w != "", F.split(w, " ")).otherwise(F.array().cast("array<string>"))


def shingles(w: Column) -> Column:
    """Hash of the five words from each place on."""

    def hashed(bound: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(bound) - WORDS), lambda i: F.xxhash64(*[F.get(bound, i + k) for k in range(WORDS)]))
        return F.when(F.size(bound) >= WORDS, each).otherwise(F.array().cast("array<bigint>"))

    # The outer transform binds the words: else the optimizer may put their whole expression inside the inner one.
    return F.transform(F.array(w), hashed)[0]


def fingerprints(sets: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """key, total, size and fps (SimHash by weight, SimHash by count) of each set; sets: key and its distinct shingles h, a row each."""
    voted = sets.join(weights, "h", "left").withColumn("w", F.coalesce("w", F.lit(_UNIT)))
    for_bit = lambda b, w: F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(1) == 1, w).otherwise(-w))
    votes = [F.array(*[for_bit(b, w) for b in range(BITS)]).alias(name) for w, name in ((F.col("w"), "by_weight"), (F.lit(1), "by_count"))]
    summed = voted.groupBy(key).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("size"), *votes)
    # The binary digits of the signs, from the highest bit on.
    digits = lambda name: F.concat(*[F.when(F.col(name)[b] > 0, "1").otherwise("0") for b in range(BITS - 1, -1, -1)])
    fp = lambda name: F.conv(digits(name), 2, -10).cast("long")
    return summed.select(key, "total", "size", F.array(fp("by_weight"), fp("by_count")).alias("fps"))


def blocks(fp: Column) -> Column:
    """The RADIUS + 1 blocks of a fingerprint, with their numbers."""
    n = RADIUS + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _hits(docs: DataFrame, item_shingles: DataFrame) -> DataFrame:
    """rid, doc_id, hashes, places: rows of docs that share a shingle with an item, and where.

    The column `row` keeps the filter above the projection, so each text is taken apart once.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", shingles(F.col("words")).alias("hashes"), F.size("words").alias("n_words"), F.monotonically_increasing_id().alias("row"))
    distinct = item_shingles.select("h").distinct()
    if (n := distinct.count()) <= MAX_INLINE:
        if not n:
            return rows.withColumn("places", F.array().cast("array<int>")).where(F.lit(False))
        known = ",".join(f"{r['h']}L" if r["h"] != -(1 << 63) else "(-9223372036854775807L - 1L)" for r in distinct.collect())
        places = F.array_compact(F.expr(f"transform(hashes, (h, i) -> CASE WHEN h IN ({known}) THEN i END)"))
        return rows.withColumn("places", places).where(F.size("places") > 0)
    known = F.broadcast(distinct) if n <= MAX_BROADCAST else distinct
    shared = rows.select("rid", F.posexplode("hashes").alias("place", "h")).join(known, "h", "left_semi")
    return rows.join(shared.groupBy("rid").agg(F.sort_array(F.collect_set("place")).alias("places")), "rid")


def _near(sized: DataFrame, prints: DataFrame, item_sizes: DataFrame, item_prints: DataFrame) -> DataFrame:
    """set_key, item_id: windows and items of one size of which a fingerprint (by weight or by count) is within the radius."""
    blocked = sized.join(prints, "set_key").select("set_key", "of", F.posexplode("fps").alias("kind", "fp")).select("set_key", "of", "kind", "fp", F.inline(blocks(F.col("fp"))))
    item_blocked = item_sizes.join(item_prints, "item_id").select("item_id", "of", F.posexplode("fps").alias("kind", "item_fp")).select("item_id", "of", "kind", "item_fp", F.inline(blocks(F.col("item_fp"))))
    near = blocked.join(item_blocked, ["of", "kind", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return near.select("set_key", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rid (hash of doc_id and text), doc_id, item_id, similarity, first_word, n_words: the best window for each row and item."""
    every = benchmark.select("item_id", words(whole_text()).alias("words"))
    short = every.where((F.size("words") > 0) & (F.size("words") < WORDS)).select("item_id", "words").distinct()
    items = every.where(F.size("words") >= WORDS)
    tables = Tables(docs.sparkSession)
    items = tables.write(items.select("item_id", F.size("words").alias("n_words"), F.posexplode(shingles(F.col("words"))).alias("place", "h")), "items")
    item_sets = items.select("item_id", "h").distinct()
    weights = tables.write(item_sets.groupBy("h").agg((F.lit(_UNIT) / F.count(F.lit(1))).cast("long").alias("w")), "weights")
    item_prints = tables.write(fingerprints(item_sets, "item_id", weights), "item_prints")

    hits = tables.write(_hits(docs.select("doc_id", "text", words(whole_text()).alias("words")), items), "hits")
    anchors = hits.select("rid", F.explode("places").alias("at"), "hashes", "n_words").select("rid", "at", F.col("hashes")[F.col("at")].alias("h"), F.col("n_words").alias("doc_words"))
    place = [F.greatest(F.lit(0), F.col("at") - F.col("place")).alias("first"), F.least("doc_words", F.col("at") - F.col("place") + F.col("n_words")).alias("end")]
    aligned = anchors.join(items, "h").select("rid", F.col("n_words").alias("of"), *place).distinct()
    windows = aligned.join(hits.select("rid", "doc_id", "hashes").dropDuplicates(["rid"]), "rid")
    inside = F.array_sort(F.array_distinct(F.slice("hashes", F.col("first") + 1, F.col("end") - F.col("first") - WORDS + 1)))
    windows = windows.select("rid", "doc_id", "first", (F.col("end") - F.col("first")).alias("n_words"), "of", inside.alias("set"))
    windows = tables.write(windows.withColumn("set_key", F.xxhash64("set")), "windows")

    tables.drop("hits")
    sets = tables.write(windows.groupBy("set_key").agg(F.first("set").alias("set")).select("set_key", F.explode("set").alias("h")), "sets")
    prints = tables.write(fingerprints(sets, "set_key", weights), "prints")
    sized, item_sizes = windows.select("set_key", "of").distinct(), items.select("item_id", F.col("n_words").alias("of")).distinct()
    near = tables.write(_near(sized, prints, item_sizes, item_prints), "near")
    common = near.join(sets, "set_key").join(item_sets, ["item_id", "h"]).join(weights, "h")
    shared = common.groupBy("set_key", "item_id").agg(F.sum("w").alias("both"), F.count(F.lit(1)).alias("same"))
    shared = shared.join(prints.select("set_key", "total", F.col("size").alias("in_set")), "set_key")
    shared = shared.join(item_prints.select("item_id", F.col("total").alias("item_total"), F.col("size").alias("in_item")), "item_id")
    weighted = F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))
    plain = F.col("same") / (F.col("in_set") + F.col("in_item") - F.col("same"))
    found = shared.select("set_key", "item_id", (weighted >= THRESHOLD).alias("by_weight"), F.when(weighted >= THRESHOLD, weighted).otherwise(plain).alias("similarity")).where(F.col("similarity") >= THRESHOLD)
    found = tables.write(found, "found")
    best = F.max(F.struct("by_weight", "similarity", (-F.col("first")).alias("place"), "n_words"))
    by_window = (
        windows.select("rid", "doc_id", "first", "n_words", "set_key").join(found, "set_key")
        .groupBy("rid", "doc_id", "item_id").agg(best.alias("best"))
        .select("rid", "doc_id", "item_id", "best.similarity", (-F.col("best.place")).alias("first_word"), "best.n_words")
    )
    by_window = tables.write(by_window, "by_window")
    tables.drop_all_but("by_window")
    if short.isEmpty():
        return by_window
    texts = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", words(whole_text()).alias("words")).where((F.size("words") > 0) & (F.size("words") < WORDS)).distinct()
    whole = texts.join(short, "words").select("rid", "doc_id", "item_id", F.lit(1.0).alias("similarity"), F.lit(0).alias("first_word"), F.size("words").alias("n_words"))
    return by_window.unionByName(whole)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark item in them."""
    gone = contaminated(docs, benchmark).select(F.col("rid").alias("gone_rid")).distinct()
    return docs.join(gone, F.xxhash64("doc_id", "text") == F.col("gone_rid"), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "first_word", "n_words")).alias("b")).select("doc_id", "item_id", "b.similarity", "b.first_word", "b.n_words")
