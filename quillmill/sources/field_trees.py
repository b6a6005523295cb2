"""Research fields loaded from nested JSON: trees of any depth become rows, and rows are put into the table of fields by slug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = {"name_zh": ("nameZh", "string"), "name_en": ("nameEn", "string"), "level": ("level", "int"), "sort_order": ("sortOrder", "int")}


def field_nodes(trees: DataFrame) -> DataFrame:
    """path, slug, parent_slug, depth and VALUES of every node of trees (tree_id, tree: JSON text, a node or an array of nodes).

    A node's `children` is an array of nodes. `path` is the tree's id and the node's place among its siblings at each depth, so
    it orders a tree as it is read. Null and broken texts have no nodes; nodes without a slug are left out, and their children
    are top nodes. `level` is the depth where a node has none.
    """
    nodes = trees.sparkSession.sql(
        """
        WITH RECURSIVE node(tree_id, above, pos, value, parent_slug, depth) AS (
            SELECT tree_id, CAST(array() AS ARRAY<INT>), posexplode(CAST(whole AS ARRAY<VARIANT>)), CAST(NULL AS STRING), 0 FROM (
                SELECT tree_id, try_parse_json(CASE WHEN startswith(ltrim(tree), '{{') THEN concat('[', tree, ']') ELSE tree END) AS whole FROM {trees})
            WHERE schema_of_variant(whole) LIKE 'ARRAY%'
            UNION ALL
            SELECT tree_id, concat(above, array(pos)), posexplode(try_variant_get(value, '$.children', 'array<variant>')), try_variant_get(value, '$.slug', 'string'), depth + 1 FROM node)
        SELECT *, concat(above, array(pos)) AS place FROM node""",
        trees=trees.select("tree_id", "tree"),
    )
    value = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    told = nodes.select(F.struct("tree_id", "place").alias("path"), value("slug", "string").alias("slug"), "parent_slug", "depth", *[value(n, t).alias(c) for c, (n, t) in VALUES.items()])
    return told.where("slug is not null").withColumn("level", F.coalesce("level", "depth"))


def loaded(fields: DataFrame, nodes: DataFrame) -> DataFrame:
    """fields (id, slug, parent_id and VALUES) after nodes are put in by slug.

    A known field takes the values of the last node of its slug that tells them, and stays under its parent. A new one lies
    under the parent of its first node. New ids are hashes of slugs.
    """
    kind = fields.schema["id"].dataType
    hashed = F.sha2("slug", 256) if kind.typeName() == "string" else F.xxhash64("slug")
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("path", F.col(c).alias("v"))))["v"].alias(f"_{c}") for c in VALUES]
    given = nodes.groupBy("slug").agg(F.min(F.struct("path", "parent_slug"))["parent_slug"].alias("_parent"), *last)
    joined = fields.withColumn("_old", F.lit(True)).join(given, "slug", "full_outer").withColumn("_id", F.coalesce("id", hashed))
    parents = joined.select(F.col("slug").alias("_parent"), F.col("_id").alias("_parent_id"))
    out = {c: F.coalesce(f"_{c}", c).cast(fields.schema[c].dataType) for c in VALUES if c in fields.columns}
    out |= {"id": F.col("_id"), "slug": F.col("slug"), "parent_id": F.when(F.col("_old"), F.col("parent_id")).otherwise(F.col("_parent_id"))}
    return joined.join(parents, "_parent", "left").select(*[out.get(c, F.col(c)).alias(c) for c in fields.columns])
