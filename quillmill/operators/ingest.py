"""Ingest: selection, validation, routing and fill-forward of scraped records. The clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from .matching import insert_missing, new_and_known


def two_tier(candidates: DataFrame, first: Column, limit: int) -> DataFrame:
    """The best-scored candidates of the first tier, filled up from the others to the limit."""
    return candidates.select("id", F.when(first, 1).otherwise(2).alias("tier"), "score").orderBy("tier", F.desc("score"), "id").limit(limit)


def stale_selection(persons: DataFrame, as_of: Column, days: int = 60, limit: int = 20) -> DataFrame:
    """Active persons to refresh, the longest unseen (never first) before the others; those in back-off wait."""
    waits = F.coalesce(F.try_to_timestamp(F.get_json_object("metadata", "$.nextStaleRefreshAfter")).cast("timestamp_ntz") > as_of, F.lit(False))
    due = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return persons.where(F.col("is_active") & due & ~waits).orderBy(F.asc_nulls_first("last_scraped_at"), "id").limit(limit)


def backlogs(persons: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """source, eligible, remaining of each enrichment over the active persons, counted in one pass.

    works: those with a name and an institution, less those with an h-index; papers: those with an institution, and of
    them those without an h-index or not seen for `days`; pinyin: all, and those whose name has no English form.
    """
    placed, named = F.col("institution").isNotNull(), F.coalesce(F.col("name_zh") != "", F.lit(False))
    ranked, old = F.col("h_index").isNotNull(), F.coalesce(F.col("last_scraped_at") < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    counts = {
        "works": (F.count_if(placed & named), F.count_if(placed & named) - F.count_if(ranked)),
        "papers": (F.count_if(placed), F.count_if(placed & (~ranked | old))),
        "pinyin": (F.count(F.lit(1)), F.count_if(named & F.col("name_en").isNull())),
    }
    each = F.array(*[F.struct(F.lit(s).alias("source"), eligible.alias("eligible"), remaining.alias("remaining")) for s, (eligible, remaining) in counts.items()])
    return persons.where("is_active").agg(each.alias("rows")).select(F.inline("rows"))


def refresh_failures(persons: DataFrame, failed: DataFrame, most: int = 4) -> DataFrame:
    """persons with one more failure for the failed ids: wait doubles from 14 days; at `most` failures they are switched off."""
    joined = persons.join(failed.select("id").withColumn("_failed", F.lit(True)), "id", "left")
    count = F.coalesce("failures", F.lit(0)) + F.when(F.col("_failed"), 1).otherwise(0)
    return joined.withColumn("failures", count).withColumn("wait_days", F.when(F.col("_failed"), scores.backoff_days(F.col("failures")))).withColumn("is_active", F.col("is_active") & (F.col("failures") < most)).drop("_failed")


def validated(scraped: DataFrame) -> DataFrame:
    """scraped rows whose Chinese or English name is a name."""
    ok = lambda c: text.filled(F.col(c)) & text.garbage_name(F.col(c)).isNull()
    return scraped.where(ok("name_zh") | ok("name_en"))


def route(scraped: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to insert, to update): valid rows whose (name_zh, institution) is new, and the others; one row per key."""
    institution = text.normal_institution(F.col("institution"))
    incoming = validated(scraped).withColumn("institution", institution).dropDuplicates(["name_zh", "institution"])
    return new_and_known(incoming, persons.withColumn("institution", institution), ["name_zh", "institution"])


def fill_forward(persons: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """persons whose nulls are filled from updates; values that they have stay."""
    fresh = updates.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = persons.join(fresh, keys, "left")
    return joined.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in columns else F.col(c) for c in persons.columns])


def capped(children: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each person, by the order: a new person's publications, updates and so on."""
    from .metrics import first_n

    return first_n(children, ["person_id"], order, most).drop("place")


def run(scraped: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons, audit) after one run: new persons added, known ones filled."""
    new, known = route(scraped, persons)
    columns = [c for c in persons.columns if c in scraped.columns and c not in ("name_zh", "institution", "id")]
    filled = fill_forward(persons, known, ["name_zh", "institution"], columns)
    fresh = new.select("name_zh", "institution", *columns).withColumn("id", F.sha2(F.concat_ws("|", "name_zh", "institution"), 256))
    kind = dict(persons.dtypes)["id"]
    fresh = fresh.withColumn("id", F.col("id") if kind == "string" else F.xxhash64("name_zh", "institution").cast(kind))
    audit = new.select(F.lit("INSERT").alias("action"), "name_zh").unionByName(known.select(F.lit("UPDATE").alias("action"), "name_zh"))
    return insert_missing(filled, fresh, ["name_zh", "institution"]), audit


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key, by the order."""
    from .metrics import first_n

    return first_n(rows, keys, order, most).drop("place")
