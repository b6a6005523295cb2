"""Hot-spot feeds: reported persons (stain) and recent achievements (highlight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

OPEN_STATUSES = ("PENDING", "UNDER_REVIEW", "APPROVED")


def at_most_per_person(events: DataFrame, most: int = 2) -> DataFrame:
    """Each person's hottest events."""
    hottest = Window.partitionBy("person_id").orderBy(F.desc("heat"), "id")
    return events.withColumn("place", F.row_number().over(hottest)).where(F.col("place") <= most).drop("place")


def stain_feed(reports: DataFrame, persons: DataFrame, as_of: Column, limit: int = 20, newest: int = 100, least_reports: int = 2) -> DataFrame:
    """The newest open reports of the last 30 days, on persons with least_reports of them or more, hottest first.

    The limit to the newest comes before the count, as it defines the feed; it is a top-k, and the windows after it
    see at most `newest` rows.
    """
    recent = reports.where((F.col("created_at") >= as_of - F.expr("INTERVAL 30 DAYS")) & F.col("status").isin(*OPEN_STATUSES))
    recent = recent.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    counted = recent.withColumn("reports", F.count(F.lit(1)).over(Window.partitionBy("person_id"))).where(F.col("reports") >= least_reports)
    named = counted.join(persons.select(F.col("id").alias("person_id"), "name_zh", "institution", "score"), "person_id")
    heat = scores.stain_heat(F.col("reports"), F.col("severity"), F.col("created_at"), as_of, F.col("status") == "APPROVED")
    hot = at_most_per_person(named.withColumn("heat", heat))
    return hot.select("id", "person_id", "name_zh", "institution", "score", "category", "status", "severity", "reports", "heat", "created_at").orderBy(F.desc("heat"), "id").limit(limit)


def highlight_feed(updates: DataFrame, persons: DataFrame, as_of: Column, limit: int = 20, newest: int = 50) -> DataFrame:
    """The newest updates of each kind in the last 30 days, hottest first, at most two a person."""
    recent = updates.where(F.col("published_at") >= as_of - F.expr("INTERVAL 30 DAYS"))
    kinds = [recent.where(F.col("kind") == kind).orderBy(F.desc("published_at"), "id").limit(newest) for kind in ("competition", "evaluation", "research")]
    named = reduce(DataFrame.unionByName, kinds).join(persons.select(F.col("id").alias("person_id"), "name_zh", "score"), "person_id")
    hot = named.withColumn("heat", scores.update_heat(F.col("kind"), F.col("published_at"), as_of, F.col("score"), F.col("level")))
    return at_most_per_person(hot).select("id", "kind", "person_id", "name_zh", "title", "level", "heat", "published_at").orderBy(F.desc("heat"), "id").limit(limit)
