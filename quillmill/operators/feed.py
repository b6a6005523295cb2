"""Paper feeds: linking authors to persons, relevance, personal feeds, syncing to updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .matching import best_matches, token_matches


def linked_authors(papers: DataFrame, persons: DataFrame, first: int = 5, least: float = 0.5) -> DataFrame:
    """paper_id, person_id: the first of the paper's first authors that matches a person by its name's words."""
    authors = papers.select(F.col("id").alias("paper_id"), F.posexplode(F.slice("authors", 1, first)).alias("seq", "name"))
    distinct = authors.select(F.col("name").alias("id"), "name").distinct()
    names = persons.where("is_active").select("id", F.coalesce(F.nullif(F.col("name_en"), F.lit("")), F.col("name_zh")).alias("name"))
    # Ties go to the smallest id, so of persons with one name only that one can be matched.
    names = names.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    matched = best_matches(token_matches(distinct, names, least)).select(F.col("left_id").alias("name"), F.col("right_id").alias("person_id"))
    earliest = F.min(F.struct("seq", "person_id"))
    return authors.join(matched, "name").groupBy("paper_id").agg(earliest.alias("m")).select("paper_id", "m.person_id")


def feed(papers: DataFrame, links: DataFrame, as_of: Column, limit: int = 30, days: int | None = None) -> DataFrame:
    """Papers with their person and relevance, the most relevant first; a paper id comes once."""
    recent = papers if days is None else papers.where(F.col("published") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    once = recent.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("category", "title"))).where("copy = 1").drop("copy")
    joined = once.join(links, F.col("id") == F.col("paper_id"), "left")
    value = scores.relevance(F.col("doi"), F.col("journal"), F.size("authors"), F.col("person_id").isNotNull(), F.col("published"), as_of, F.size("categories"), F.col("comment"))
    return joined.select("id", "title", F.substring("summary", 1, 500).alias("description"), "person_id", value.alias("relevance"), "published").orderBy(F.desc("relevance"), "id").limit(limit)


def recent_papers(by_author: DataFrame, by_field: DataFrame, name: str, as_of: Column, days: int = 30, limit: int = 10) -> DataFrame:
    """Papers found by author, and those found by field whose author list has the name (either within the other); newest first."""
    low = F.lit(name.lower())
    named = by_field.where(F.exists("authors", lambda a: F.contains(F.lower(a), low) | F.contains(low, F.lower(a))))
    found = by_author.unionByName(named).dropDuplicates(["id"]).where(F.col("published") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return found.orderBy(F.desc("published"), "id").limit(limit)


def unsynced(feed_items: DataFrame, updates: DataFrame) -> DataFrame:
    """Feed items (person_id, url) that aren't updates of the person yet."""
    return feed_items.where("person_id is not null").join(updates.select("person_id", "url").distinct(), ["person_id", "url"], "left_anti")
