"""Lists, searches, pages and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_any(text: str, *columns: str) -> Column:
    """Case-insensitive, literal: one of the columns has the text in it."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return out


#: Sort orders of lists. Nulls of a descending order come first, as in the databases the domain comes from.
SORTS = {
    "score_desc": [F.desc_nulls_first, "score"], "score_asc": [F.asc_nulls_last, "score"], "name_asc": [F.asc_nulls_last, "name_zh"],
    "name_desc": [F.desc_nulls_first, "name_zh"], "h_index_desc": [F.desc_nulls_first, "h_index"],
}


def ordered(df: DataFrame, sort: str) -> DataFrame:
    direction, column = SORTS[sort]
    return df.orderBy(direction(column), "id")


def page(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page (from 1) of an ordered frame; sizes go from 1 to 100."""
    size = min(100, max(1, size))
    return df.offset((max(1, number) - 1) * size).limit(size)


def page_info(total: Column, number: int, size: int) -> list[Column]:
    return [total.alias("total"), F.lit(number).alias("page"), F.lit(size).alias("limit"), (F.lit(number * size) < total).alias("has_more")]


def persons(df: DataFrame, query: str | None = None, institution: str | None = None, region: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Active persons that meet every filter given."""
    found = df.where("is_active")
    if query:
        found = found.where(contains_any(query, "name_zh", "name_en"))
    if institution:
        found = found.where(contains_any(institution, "institution"))
    if region:
        found = found.where(F.col("region") == region)
    if least is not None:
        found = found.where(F.col("score") >= least)
    if most is not None:
        found = found.where(F.col("score") <= most)
    return found


def with_fields(found: DataFrame, links: DataFrame, fields: DataFrame) -> DataFrame:
    """found with primary_fields: sorted slugs of each person's primary fields."""
    slugs = links.where("is_primary").join(fields.select(F.col("id").alias("field_id"), "slug"), "field_id").groupBy("person_id").agg(F.array_sort(F.collect_set("slug")).alias("primary_fields"))
    joined = found.join(slugs, F.col("id") == F.col("person_id"), "left").drop("person_id")
    return joined.withColumn("primary_fields", F.coalesce("primary_fields", F.array().cast("array<string>")))


def newest_children(parents: DataFrame, children: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Each parent's first children by the order, with their place (from 1)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = children.withColumn("place", place).where(F.col("place") <= most)
    return kept.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def having(parents: DataFrame, children: DataFrame, key: str, some: bool = True) -> DataFrame:
    """Parents with (or without) a child."""
    return parents.join(children.select(F.col(key).alias("id")), "id", "left_semi" if some else "left_anti")
