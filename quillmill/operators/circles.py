"""Circles: persons grouped by field, institution or region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import slug

#: Score ranges, lower end included; scores outside fall into none.
RANGES = ((0, 70, "< 70"), (70, 85, "70-85"), (85, 100, "85-100"), (100, 110, "100-110"), (110, 200, "> 110"))


def _top(column: str) -> Column:
    """The member with the highest score, then the smallest id."""
    return F.max_by(F.col(column), F.struct(F.col("score"), -F.col("id")))


def circles_by(persons: DataFrame, column: str, kind: str) -> DataFrame:
    """A row per value of the column among active persons: members, mean score, best member. One pass."""
    grouped = persons.where(F.col("is_active") & F.col(column).isNotNull()).groupBy(F.col(column).alias("name"))
    made = grouped.agg(F.count(F.lit(1)).alias("members"), half_up(F.avg("score"), 1).alias("avg_score"), _top("id").alias("top_id"), _top("name_zh").alias("top_name"))
    return made.select(F.concat(F.lit(f"{kind}-"), slug(F.col("name"))).alias("slug"), "name", "members", "avg_score", "top_id", "top_name")


def field_circles(fields: DataFrame, links: DataFrame, persons: DataFrame) -> DataFrame:
    """Circles of the top fields: distinct persons of the field and two levels under it, active or not; empty circles are left out."""
    parent = fields.select(F.col("id").alias("p_id"), F.col("parent_id").alias("p_parent"))
    tree = fields.join(parent, F.col("parent_id") == F.col("p_id"), "left").select("id", F.explode(F.array_compact(F.array("id", "parent_id", "p_parent"))).alias("root"))
    tops = fields.where("level = 0").select(F.col("id").alias("root"), F.col("slug").alias("name"))
    members = links.join(tree.withColumnRenamed("id", "field_id"), "field_id").select("root", "person_id").distinct()
    joined = members.join(persons.select("id", "score", "name_zh"), F.col("id") == F.col("person_id")).join(tops, "root")
    return joined.groupBy("name").agg(F.count(F.lit(1)).alias("members"), half_up(F.avg("score"), 1).alias("avg_score"), _top("id").alias("top_id"), _top("name_zh").alias("top_name"))


def descendants(fields: DataFrame) -> DataFrame:
    """root, id, depth: every field under every field, itself included. A tree is as deep as it is: recursion ends when no level is left."""
    fields.createOrReplaceTempView("quillmill_fields")
    return fields.sparkSession.sql("""
        WITH RECURSIVE under(root, id, depth) AS (
            SELECT id, id, 0 FROM quillmill_fields
            UNION ALL SELECT u.root, f.id, u.depth + 1 FROM under u JOIN quillmill_fields f ON f.parent_id = u.id)
        SELECT root, id, depth FROM under""")


def with_parent(fields: DataFrame) -> DataFrame:
    """id, slug, parent_slug: the trail above a field is its parent; null for a top field."""
    parent = fields.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return fields.select("id", "slug", "parent_id").join(parent, "parent_id", "left").select("id", "slug", "parent_slug")


def score_histogram(persons: DataFrame) -> DataFrame:
    """Members in each score range, empty ranges included."""
    ranges = persons.sparkSession.createDataFrame([(low, high, name) for low, high, name in RANGES], "low int, high int, range string")
    out = F
    for low, high, name in RANGES:
        out = out.when((F.col("score") >= low) & (F.col("score") < high), name)
    counts = persons.where("is_active").groupBy(out.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    return ranges.join(counts, "range", "left").select("range", F.coalesce("n", F.lit(0)).alias("members"))


def top_institutions(members: DataFrame, most: int = 5) -> DataFrame:
    return members.where("is_active and institution is not null").groupBy("institution").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "institution").limit(most)
