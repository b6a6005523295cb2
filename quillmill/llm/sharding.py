"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Only DataFrame functions. A record's virtual slot is a hash of its doc_id and never changes. Bytes are summed per
slot (partial aggregation; the result has at most n_slots rows whatever the input), and a greedy pass over that
bounded table, largest slot first onto the lightest shard, gives the map. Maps are stored as a table partitioned by
version and read back by it. Rebalancing edits the last map into the next version: a shard keeps its slots up to its
share and gives up the rest. Sizes come out near equal (law `bytes`).

Null text has no bytes and counts 8; a null doc_id has a slot like any other value; repeated rows are records of
their own. An empty table gives an empty plan, and an empty map has no version.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, whole_text

SLOTS = 4096
SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def virtual_slot(column: str = "doc_id", n_slots: int = SLOTS) -> Column:
    """The first 32 bits of the value's MD5, modulo n_slots."""
    first = F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(first, 16, 10).cast("long") % n_slots).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, bytes, records: one row per slot that has records."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def _greedy(slots: DataFrame, loads: Column, n_shards: int) -> DataFrame:
    """Deals the slots (a bounded table), largest first, each to the shard with the least bytes so far."""
    by_size = F.sort_array(F.collect_list(F.struct("bytes", "records", "virtual_slot")), asc=False)
    one = slots.agg(by_size.alias("slots"), F.first(loads, ignorenulls=True).alias("loads"))
    empty = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,records:bigint>>)")

    def deal(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == lightest, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["dealt"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), lightest.alias("shard"), slot["records"].alias("records")))).alias("dealt"),
        )

    start = F.struct(F.coalesce("loads", F.array_repeat(F.lit(0).cast("long"), n_shards)).alias("loads"), empty.alias("dealt"))
    return one.select(F.inline(F.aggregate("slots", start, deal, lambda state: state["dealt"])))


def plan(slots: DataFrame, n_shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first map: version, virtual_slot, shard, records."""
    return _greedy(slots, F.lit(None).cast("array<bigint>"), n_shards).select(F.lit(version).alias("version"), "virtual_slot", "shard", "records")


def rebalanced(last: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version: shards keep their largest slots as long as they stay within their share; the rest is dealt anew.

    Slots that the last map doesn't know are dealt too. n_shards may grow or shrink.
    """
    version = F.coalesce(last.agg(F.max("version").alias("v")).select("v").scalar(), F.lit(0)) + 1
    share = slots.agg(F.sum("bytes").alias("b")).select(F.col("b") / n_shards).scalar()
    over = F.col("bytes") > F.col("share")  # slots larger than a shard's share stay alone and don't raise the others' target
    rest = slots.withColumn("share", share).agg(F.sum(F.when(~over, F.col("bytes"))).alias("b"), F.count_if(over).alias("n"))
    target = rest.select(F.ceil(F.coalesce("b", F.lit(0)) / F.greatest(F.lit(1), n_shards - F.col("n"))).alias("t")).scalar()
    placed = slots.join(last.select("virtual_slot", "shard"), "virtual_slot", "left").withColumn("shard", F.when(F.col("shard") < n_shards, F.col("shard")))
    filled = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("target", target).withColumn("sum", F.sum("bytes").over(filled))
    placed = placed.withColumn("stays", F.col("shard").isNotNull() & ((F.col("sum") <= F.col("target")) | (F.col("sum") == F.col("bytes"))))
    kept = placed.where("stays")
    sums = kept.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"))
    loads = sums.select(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("l"))
    moved = _greedy(placed.where("not stays"), loads.select("l").scalar(), n_shards)
    return kept.select("virtual_slot", "shard", "records").unionByName(moved).select(version.alias("version"), "virtual_slot", "shard", "records")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records with shard and slot, the place in the shard: gapless from 0.

    The map has one row per slot, so its offsets and the join are bounded; places are counted within virtual slots.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0).cast("long")).alias("first_place"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    counted = records.withColumn("place", F.row_number().over(within).cast("long") - 1)
    return counted.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("first_place") + F.col("place")).drop("first_place", "place")


def stored(slot_map: DataFrame, folder: str) -> None:
    """Writes the map's version into the folder; a version that stands there already is replaced, others stay."""
    slot_map.repartition(1).write.partitionBy("version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def loaded(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The given version of the stored map, else the last one."""
    found = spark.read.schema("virtual_slot int, shard int, records bigint, version int").parquet(folder)
    wanted = F.lit(version) if version is not None else found.agg(F.max("version").alias("v")).select("v").scalar()
    return found.where(F.col("version") == wanted).select("version", "virtual_slot", "shard", "records")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row."""
    return docs.select(
        "doc_id", (F.octet_length(whole_text()).cast("long") + OVERHEAD).alias("size"),
        F.crc32(whole_text()).alias("text_crc32"), virtual_slot().alias("virtual_slot"),
    )


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/quillmill-slot-map-{uuid.uuid4().hex}"


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the first map of the documents, reads it back and places every document by it."""
    records, folder = sized(documents(spark, sf_dir)), _folder(spark)
    stored(plan(slot_bytes(records)), folder)
    return placed(records, loaded(spark, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"),
    )


def slot_map_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored map before and after an edit for one more shard: virtual_slot, bytes, records, shard, next_shard, moved."""
    slots, folder = slot_bytes(sized(documents(spark, sf_dir))), _folder(spark)
    stored(plan(slots), folder)
    stored(rebalanced(loaded(spark, folder), slots, SHARDS + 1), folder)
    was, now = loaded(spark, folder, 1), loaded(spark, folder)
    told = now.select("virtual_slot", F.col("shard").alias("next_shard"), F.col("version").alias("map_version"))
    both = slots.join(was.select("virtual_slot", "shard"), "virtual_slot").join(told, "virtual_slot")
    return both.withColumn("moved", F.col("shard") != F.col("next_shard"))


#: CRC-32 of each byte, with which SQL works the text's out.
_CRC = ", ".join(str(zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0")) for b in range(256))
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT [{_CRC}] AS t),
texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
octets AS (SELECT rid, doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM texts),
records AS (
  SELECT rid, doc_id, n + {OVERHEAD} AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, n), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]::BIGINT)), 4294967295::BIGINT) AS text_crc32,
    (('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % {SLOTS})::INT AS virtual_slot
  FROM octets, crc),
slots AS (
  SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n,
         row_number() OVER (ORDER BY sum(size) DESC, count(*) DESC, virtual_slot DESC) AS i FROM records GROUP BY virtual_slot),
deal AS (
  SELECT 0::BIGINT AS i, list_transform(range(0, {SHARDS}), lambda k: 0::BIGINT) AS loads, NULL::INT AS virtual_slot, NULL::INT AS shard
  UNION ALL
  SELECT s.i, list_transform(d.loads, lambda x, k: CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN x + s.bytes ELSE x END),
         s.virtual_slot, (list_position(d.loads, list_min(d.loads)) - 1)::INT
  FROM deal d JOIN slots s ON s.i = d.i + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       NULL::INT AS grown_shard, virtual_slot, 1 AS map_version
FROM records JOIN deal USING (virtual_slot)
"""
