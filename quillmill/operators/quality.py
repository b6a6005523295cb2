"""Data-quality scans. Each gives issues: type, severity, entity_id, detail, action. Result caps are top-k features and arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import days_between

ISSUE = ("type", "severity", "entity_id", "detail", "action")


def _issues(found: DataFrame, kind: str, severity: Column, entity: Column, detail: Column, action: Column) -> DataFrame:
    return found.select(F.lit(kind).alias("type"), severity.alias("severity"), entity.cast("string").alias("entity_id"), detail.alias("detail"), action.alias("action"))


def not_seed(metadata: str = "metadata") -> Column:
    """Metadata with a source that isn't the seed; rows without the key are not chosen."""
    return F.get_json_object(metadata, "$.source") != "seed"


def garbage_names(persons: DataFrame) -> DataFrame:
    reason = F.coalesce(text.garbage_name(F.col("name_zh")), F.when(text.filled(F.col("name_en")), F.when(text.first_match(F.col("name_en"), text.GARBAGE_NAME_PATTERNS).isNotNull(), "english pattern")))
    known = F.coalesce(F.col("h_index") > 0, F.lit(False)) | F.coalesce(F.col("citation_count") > 0, F.lit(False))
    found = persons.where("is_active").withColumn("reason", reason).where("reason is not null").withColumn("known", known)
    return _issues(found, "GARBAGE_NAME", F.when(F.col("known"), "medium").otherwise("high"), F.col("id"), F.col("reason"), F.when(F.col("known"), "REVIEW").otherwise("AUTO_FIX"))


def junk_bios(persons: DataFrame) -> DataFrame:
    found = persons.where("is_active").withColumn("pattern", text.junk_bio(F.col("bio_zh"))).where("pattern is not null").withColumn("thin", text.info_density(F.col("bio_zh")) < 0.3)
    return _issues(found, "JUNK_BIO", F.when(F.col("thin"), "high").otherwise("medium"), F.col("id"), F.concat(F.lit("pattern "), F.col("pattern").cast("string")), F.when(F.col("thin"), "AUTO_FIX").otherwise("REVIEW"))


def missing_fields() -> Column:
    """Names of the critical columns that a person lacks; null and empty text are the same, a number lacks only when null."""
    told = [F.when(~text.filled(F.col(c)), c) for c in ("name_en", "title", "department", "email", "bio_zh")]
    return F.array_compact(F.array(*told, F.when(F.col("h_index").isNull(), "h_index")))


def incomplete_profiles(persons: DataFrame, least: int = 3) -> DataFrame:
    found = persons.where(F.col("is_active") & not_seed()).withColumn("missing", missing_fields()).where(F.size("missing") >= least)
    severity = F.when(F.size("missing") >= 5, "high").when(F.size("missing") >= 4, "medium").otherwise("low")
    return _issues(found, "INCOMPLETE_PROFILE", severity, F.col("id"), F.concat_ws(", ", "missing"), F.lit("NOTIFY"))


def duplicate_groups(persons: DataFrame, *keys: str) -> DataFrame:
    """Groups of active persons with equal keys: first id, copies."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return persons.where(F.col("is_active") & known).groupBy(*keys).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_persons(persons: DataFrame, keys: tuple[str, ...] = ("name_zh", "institution"), most: int = 100) -> DataFrame:
    found = duplicate_groups(persons, *keys).orderBy(F.desc("copies"), *keys).limit(most)
    return _issues(found, "DUPLICATE_PERSON", F.lit("high"), F.col("first_id"), F.concat(F.col("copies").cast("string"), F.lit(" copies")), F.lit("REVIEW"))


def stale_profiles(persons: DataFrame, as_of: Column, days: int = 90, most: int = 200) -> DataFrame:
    age = F.floor(days_between(F.col("last_scraped_at"), as_of))
    found = persons.where(F.col("is_active") & not_seed() & (F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < as_of - F.expr(f"INTERVAL {days} DAYS")))).withColumn("age", age)
    found = found.orderBy(F.asc_nulls_first("last_scraped_at"), "id").limit(most)
    severity = F.when(F.coalesce(F.col("age") > 180, F.lit(True)), "high").otherwise("medium")
    return _issues(found, "STALE_DATA", severity, F.col("id"), F.coalesce(F.col("age").cast("string"), F.lit("never")), F.when(text.filled(F.col("orcid_id")), "NOTIFY").otherwise("REVIEW"))


def orphaned_records(persons: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """One issue with the counts of child rows of inactive persons; none if there are none."""
    gone = persons.where("not is_active").select(F.col("id").alias("person_id"))
    counts = [c.join(gone, "person_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, c in children.items()]
    total = reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.concat_ws(": ", "name", F.col("n").cast("string")))).alias("parts")).where("n > 0")
    return _issues(total, "ORPHANED_RECORD", F.when(F.col("n") > 100, "high").when(F.col("n") > 10, "medium").otherwise("low"), F.lit("SYSTEM"), F.concat_ws(", ", "parts"), F.lit("AUTO_FIX"))


def suspicious_scores(persons: DataFrame, reports: DataFrame, low: float = 10, high: float = 200, most: int = 50) -> DataFrame:
    found = persons.where("is_active").where((F.col("score") < low) | (F.col("score") > high)).orderBy("score", "id").limit(most)
    counts = reports.join(found.select(F.col("id").alias("person_id")), "person_id", "left_semi").groupBy("person_id").agg(F.count(F.lit(1)).alias("reports"))
    joined = found.join(counts, F.col("id") == F.col("person_id"), "left")
    return _issues(joined, "SUSPICIOUS_SCORE", F.lit("high"), F.col("id"), F.concat(F.coalesce("reports", F.lit(0)).cast("string"), F.lit(" reports")), F.lit("REVIEW"))


def no_fields(persons: DataFrame, links: DataFrame, most: int = 100) -> DataFrame:
    found = persons.where("is_active").join(links.select(F.col("person_id").alias("id")), "id", "left_anti").orderBy("id").limit(most)
    return _issues(found, "EMPTY_FIELDS", F.lit("medium"), F.col("id"), F.col("name_zh"), F.lit("NOTIFY"))


def inactive_with_content(persons: DataFrame, as_of: Column, children: dict[str, DataFrame], days: int = 60) -> DataFrame:
    """One issue on rows that hang on persons inactive since more than `days` days."""
    old = persons.where(~F.col("is_active") & (F.col("last_scraped_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))).select(F.col("id").alias("person_id"))
    counts = [c.join(old, "person_id", "left_semi").agg(F.count(F.lit(1)).alias("n")) for c in children.values()]
    total = reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n")).where("n > 0")
    return _issues(total, "INACTIVE_WITH_CONTENT", F.lit("low"), F.lit("SYSTEM"), F.concat(F.col("n").cast("string"), F.lit(" records")), F.lit("AUTO_FIX"))


def full_scan(scans: list[DataFrame], most: int = 100) -> DataFrame:
    """All issues, at most `most` of each scan."""
    return reduce(DataFrame.unionByName, [s.orderBy("entity_id", "detail").limit(most) for s in scans])


def summary(issues: DataFrame) -> DataFrame:
    """type, severity, issues, auto_fixable, needs_review."""
    return issues.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("action") == "AUTO_FIX").alias("auto_fixable"), F.count_if(F.col("action") == "REVIEW").alias("needs_review"))


def keep_most_complete(persons: DataFrame, keys: list[str], completeness: Column) -> DataFrame:
    """persons with is_active off for all but the fullest row of each group of equal keys (ties: smallest id)."""
    best = Window.partitionBy(*keys).orderBy(F.desc("filled"), "id")
    ranked = persons.withColumn("filled", completeness).withColumn("place", F.row_number().over(best))
    return ranked.withColumn("is_active", F.col("is_active") & (F.col("place") == 1)).drop("place")
