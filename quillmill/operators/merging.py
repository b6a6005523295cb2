"""Persons merged into one another: chains of merges end in one person, whose gaps, names and metadata the others fill.

Merges are rows (source_id, target_id). What they join is one group; its target is the member that nobody merges away
(the smallest of several; of a circle the smallest member). Group members are taken in the order target, then sources by
id. Everything is aggregated by group: no chain is walked row by row, and children move once, straight to the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import components


def final_targets(merges: DataFrame) -> DataFrame:
    """source_id, target_id: where each merged person ends. Merges with a null and of a person into itself don't count."""
    edges = merges.where("source_id is not null and target_id is not null and source_id <> target_id").select("source_id", "target_id").distinct()
    groups = components(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    away = edges.select(F.col("source_id").alias("id"), F.lit(True).alias("away")).distinct()
    placed = groups.join(away, "id", "left")
    least = placed.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("away").isNull(), F.col("id"))), F.min("id")).alias("target_id"))
    return placed.join(least, "component").where("id <> target_id").select(F.col("id").alias("source_id"), "target_id")


def _filled(c: str, df: DataFrame) -> Column:
    return text.filled(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c).isNotNull()


def merged(
    persons: DataFrame, targets: DataFrame, fills: Sequence[str], external_ids: Sequence[str] = (), names: str | None = None, metadata: str | None = None, at: str | None = None,
) -> DataFrame:
    """persons (id, is_active, ...) after merging by targets (source_id, target_id).

    A target's empty `fills` and `external_ids` take the first filled value of its sources; an external id that moved is
    cleared at its source. `names` (array of strings) becomes the union, in order. `metadata` (JSON object) becomes the union
    of keys, the first member's value winning, with merged, mergedFrom (the last source) and mergedAt (`at`) set. Sources
    are switched off. Other persons and columns stay; metadata that is no object counts as empty. Keys stand in order.
    """
    member = targets.select(F.col("source_id").alias("id"), "target_id").unionByName(targets.select(F.col("target_id").alias("id"), "target_id").distinct())
    rows = persons.join(member, "id").withColumn("place", F.struct((F.col("id") != F.col("target_id")).alias("source"), "id"))
    first = [F.min(F.when(_filled(c, persons), F.struct("place", F.col(c).alias("v")))).alias(f"_{c}") for c in (*fills, *external_ids)]
    given = rows.groupBy("target_id").agg(*first, F.max(F.when(F.col("id") != F.col("target_id"), F.col("id"))).alias("_last"))
    if names:
        each = rows.select("target_id", "place", F.posexplode(names).alias("i", "name")).where("name is not null").groupBy("target_id", "name").agg(F.min(F.struct("place", "i")).alias("at"))
        union = each.groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("_names"))
        given = given.join(union, "target_id", "left")
    if metadata:
        entries = rows.select("target_id", "place", F.explode(F.from_json(F.col(metadata), "map<string,variant>")).alias("key", "value"))
        each = entries.groupBy("target_id", "key").agg(F.min(F.struct("place", F.to_json("value").alias("json"))).alias("at"))
        told = F.concat(F.regexp_extract(F.to_json(F.array("key")), r"^\[([\s\S]*)\]\z", 1), F.lit(":"), F.coalesce("at.json", F.lit("null")))
        kept = each.where("key not in ('merged', 'mergedFrom', 'mergedAt')")
        union = kept.groupBy("target_id").agg(F.array_join(F.array_sort(F.collect_list(told)), ",").alias("_keys"))
        given = given.join(union, "target_id", "left")

    joined = persons.join(given.withColumnRenamed("target_id", "id"), "id", "left").join(targets.select(F.col("source_id").alias("id"), F.col("target_id").alias("_into")), "id", "left")
    taken = given.select(F.col("target_id").alias("_into"), *[F.when(F.col(f"_{c}.place.source"), F.col(f"_{c}.place.id")).alias(f"_from_{c}") for c in external_ids])
    joined = joined.join(taken, "_into", "left") if external_ids else joined
    out = {c: F.when(F.col("_last").isNotNull(), F.coalesce(F.col(f"_{c}.v"), F.col(c))).otherwise(F.col(c)) for c in (*fills, *external_ids)}
    for c in external_ids:
        out[c] = F.when(F.col(f"_from_{c}") == F.col("id"), None).otherwise(out[c])
    if names:
        out[names] = F.when(F.col("_last").isNotNull(), F.coalesce("_names", F.col(names))).otherwise(F.col(names))
    if metadata:
        stamp = F.concat(F.lit('"merged":true,"mergedFrom":'), F.regexp_extract(F.to_json(F.array("_last")), r"^\[(.*)\]\z", 1), F.lit("" if at is None else f',"mergedAt":"{at}"'))
        out[metadata] = F.when(F.col("_last").isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", F.col("_keys"), stamp), F.lit("}"))).otherwise(F.col(metadata))
    out["is_active"] = F.col("is_active") & F.col("_into").isNull()
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in persons.columns])


def moved_children(children: DataFrame, targets: DataFrame, unique: str | None = None) -> DataFrame:
    """children (id, person_id, ...) moved to their persons' targets.

    With `unique`, a child stays with its old person where the target, or a child that moved before it (by person and id),
    has the same filled value; children without a value always move.
    """
    rows = children.join(targets.withColumnRenamed("source_id", "person_id"), "person_id", "left").withColumn("_end", F.coalesce("target_id", "person_id"))
    moves = F.col("target_id").isNotNull()
    if unique:
        order = Window.partitionBy("_end", unique).orderBy(moves, "person_id", "id")
        moves = moves & (~_filled(unique, children) | (F.row_number().over(order) == 1))
        # Rows without a value would all meet in one window; they take part by their own id.
        apart = rows.where(_filled(unique, children)).withColumn("_moves", moves).unionByName(rows.where(~_filled(unique, children)).withColumn("_moves", F.col("target_id").isNotNull()))
    else:
        apart = rows.withColumn("_moves", moves)
    return apart.withColumn("person_id", F.when(F.col("_moves"), F.col("_end")).otherwise(F.col("person_id"))).select(children.columns)
