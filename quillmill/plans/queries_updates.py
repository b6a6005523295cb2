"""Queries on known persons seen again, and their SQL.

Suppliers stand in for profiles of persons seen again, parts for stored publications and line items for theirs; even
events are stored updates and odd ones new; the nations of an order's suppliers are the fields inferred for its customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, updating
from ..operators.stored import Steps
from ..sources import field_trees
from .standins import Domain, with_

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PROFILE = {
    "person_id": "s_suppkey",
    "place": "0",
    "institution": "n_name",
    "department": "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('Dept. ', s_name) END",
    "email": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat(lower(s_name), '@x.org') END",
}
STORED = {"id": "p_partkey", "person_id": "p_partkey % 7", "title": "p_name", "doi": "concat('10.1/', CAST(p_partkey AS VARCHAR(20)))", "citation_count": "p_size", "abstract": "p_type", "source": "'SEED'"}
BROUGHT = {
    "person_id": "l_suppkey",
    "place": "l_orderkey * 10 + l_linenumber",
    "title": "concat(l_returnflag, ' ', CAST(l_partkey AS VARCHAR(20)))",
    "doi": "CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('10.1/', CAST(l_partkey AS VARCHAR(20))) END",
    "citation_count": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS INTEGER) END",
    "abstract": "CASE WHEN l_linestatus = 'O' THEN NULL ELSE concat(l_returnflag, CAST(l_linenumber AS VARCHAR(20))) END",
}
TITLED = {"id": "event_id", "place": "event_id", "person_id": "user_id", "title": "concat(event_type, ' ', CAST(CAST(floor(value / 40) AS INTEGER) AS VARCHAR(20)))"}


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in of.items())


@query(with_("person", "now") + f""", profile AS (SELECT {_columns(PROFILE)} FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT p.id, coalesce(nullif(q.institution, ''), p.institution) AS institution, coalesce(nullif(q.department, ''), p.department) AS department,
  coalesce(nullif(q.email, ''), p.email) AS email, CASE WHEN q.person_id IS NULL THEN p.last_scraped_at ELSE t END AS last_scraped_at,
  json_extract_string(p.metadata, '$.source') AS source, CASE WHEN q.person_id IS NOT NULL THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS last_updated
FROM person p CROSS JOIN now_at LEFT JOIN profile q ON q.person_id = p.id""")
def refreshed_persons(d: Domain):
    """Persons after their profiles were seen again: filled values win, metadata keeps its keys."""
    profiles = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(*[f"{e} AS {n}" for n, e in PROFILE.items()])
    after = updating.refreshed(d.persons, profiles, F.lit(d.now()))
    told = [F.get_json_object("metadata", f"$.{key}").alias(name) for key, name in (("source", "source"), ("lastUpdated", "last_updated"))]
    return after.select("id", "institution", "department", "email", "last_scraped_at", *told)


@query(f"""WITH stored AS (SELECT {_columns(STORED)} FROM part WHERE p_partkey % 3 <> 0), brought AS (SELECT {_columns(BROUGHT)} FROM lineitem),
offered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY place) AS seat FROM brought) WHERE seat <= 50 AND doi IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY person_id, seat) AS nth, min(person_id) OVER (PARTITION BY doi) AS bringer FROM offered),
telling AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY person_id, seat) AS turn FROM ranked WHERE citation_count IS NOT NULL AND (doi IN (SELECT doi FROM stored) OR person_id > bringer)),
told AS (SELECT doi, arg_max(citation_count, turn) AS c, arg_max(abstract, turn) FILTER (abstract IS NOT NULL) AS a FROM telling GROUP BY doi),
base AS (SELECT doi, person_id, title, citation_count, abstract, source FROM stored UNION ALL SELECT doi, person_id, title, citation_count, abstract, 'SCRAPER' FROM ranked WHERE nth = 1 AND doi NOT IN (SELECT doi FROM stored))
SELECT doi, person_id, title, coalesce(c, citation_count) AS citation_count, coalesce(a, abstract) AS abstract, source FROM base LEFT JOIN told USING (doi)""")
def refreshed_publications(d: Domain):
    """Publications after a batch: known DOIs updated, others added once."""
    stored = d.table("part").where("p_partkey % 3 <> 0").selectExpr(*[f"{e} AS {n}" for n, e in STORED.items()])
    brought = d.table("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in BROUGHT.items()])
    return updating.publications_after(stored, brought).drop("id")


@query(f"""WITH told AS (SELECT {_columns(TITLED)} FROM events)
SELECT id, person_id, title FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY place) AS n FROM told t
  WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM told o WHERE o.id % 2 = 0 AND o.person_id = t.person_id AND lower(o.title) = lower(t.title))) WHERE n <= 20""")
def refreshed_updates(d: Domain):
    """New updates of known persons: titles not stored yet, at most twenty a person."""
    told = d.table("events").selectExpr(*[f"{e} AS {n}" for n, e in TITLED.items()])
    return updating.new_titled(told.where("id % 2 = 0"), told.where("id % 2 = 1")).select("id", "person_id", "title")


@query(with_("field", "link") + """, inferred AS (SELECT o_custkey AS person_id, lower(n_name) AS slug, min(l_orderkey * 10 + l_linenumber) AS place
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
found AS (SELECT i.person_id, f.id AS field_id, row_number() OVER (PARTITION BY i.person_id ORDER BY i.place, f.id) AS nth FROM inferred i JOIN field f USING (slug)),
counted AS (SELECT o_custkey AS person_id, count(*) AS n FROM orders GROUP BY 1)
SELECT person_id, field_id, nth = 1 AND person_id NOT IN (SELECT person_id FROM link) AS is_primary FROM found JOIN counted USING (person_id)
WHERE (person_id NOT IN (SELECT person_id FROM link) OR n >= 12) AND NOT EXISTS (SELECT 1 FROM link l WHERE l.person_id = found.person_id AND l.field_id = found.field_id)""")
def reevaluated_links(d: Domain):
    """Field links to add: all for persons without any, what is lacking for persons with at least twelve new records."""
    orders = d.table("orders").select("o_orderkey", F.col("o_custkey").alias("person_id"))
    supplied = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("slug"))
    lines = d.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplied, F.col("l_suppkey") == F.col("s_suppkey"))
    inferred = lines.groupBy("person_id", "slug").agg(F.min(F.expr("l_orderkey * 10 + l_linenumber")).alias("place"))
    return updating.new_links(d.links, d.fields, inferred, orders.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")), 12)


@query(with_("field") + """, customers AS (SELECT lower(n_name) || '-' || lower(replace(c_mktsegment, ' ', '-')) AS slug, lower(n_name) AS parent_slug, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT f.slug, p.slug AS parent_slug, f.level, CAST(f.id AS INTEGER) AS sort_order FROM field f LEFT JOIN field p ON p.id = f.parent_id
UNION ALL SELECT slug, parent_slug, 2, CAST(n AS INTEGER) FROM customers""")
def loaded_fields(d: Domain):
    """The trees of regions, nations and their customers' segments, nested as JSON, put into the regions by slug."""
    counted = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name", "n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("int").alias("n"))
    leaf = F.struct(F.concat(F.lower("n_name"), F.lit("-"), F.lower(F.replace(F.col("c_mktsegment"), F.lit(" "), F.lit("-")))).alias("slug"), F.col("n").alias("sortOrder"))
    leaves = counted.groupBy("n_nationkey").agg(F.collect_list(leaf).alias("children"))
    nations = d.table("nation").join(leaves, "n_nationkey", "left")
    inner = nations.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.lower("n_name").alias("slug"), (F.col("n_nationkey") + 100).alias("sortOrder"), "children")).alias("children"))
    regions = d.table("region").join(inner, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    texts = regions.select(F.col("r_regionkey").alias("tree_id"), F.to_json(F.struct(F.lower("r_name").alias("slug"), F.col("r_regionkey").alias("sortOrder"), "children")).alias("tree"))
    stored = d.fields.where("level = 0").select("id", "slug", "parent_id", "level", F.lit(None).cast("int").alias("sort_order"))
    after = field_trees.loaded(stored.withColumn("id", F.col("id").cast("long")).withColumn("parent_id", F.col("parent_id").cast("long")), field_trees.field_nodes(texts))
    parents = after.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return after.join(parents, "parent_id", "left").select("slug", "parent_slug", "level", "sort_order")


APPLICANT = {
    "id": "p_partkey",
    "name_zh": "p_type",
    "name_en": "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN substring(p_name, 1, length(p_name) - 1) WHEN 3 THEN concat(upper(p_name), ' jr') WHEN 4 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) ELSE p_name END",
    "institution": "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END",
    "orcid_id": "CASE WHEN p_partkey % 17 < 2 THEN concat('o', CAST(CAST(floor(p_partkey / 40) AS INTEGER) AS VARCHAR(20))) ELSE NULL END",
    "scholar_id": "CASE WHEN p_partkey % 19 < 2 THEN concat('s', CAST(CAST(floor(p_partkey / 60) AS INTEGER) AS VARCHAR(20))) ELSE NULL END",
    "is_active": "p_partkey % 10 <> 3",
}


@query(f"""WITH every AS (SELECT *, lower(coalesce(nullif(name_en, ''), name_zh)) AS name, orcid_id IS NOT NULL OR scholar_id IS NOT NULL AS told FROM (SELECT {_columns(APPLICANT)} FROM part)),
shaped AS (SELECT *, string_split(name, ' ') AS parts, [substring('  ' || name || ' ', CAST(i AS INTEGER), 3) for i in generate_series(1, length(name) + 1)] AS grams FROM every),
pairs AS (SELECT a.id AS in_id, b.id, b.is_active, coalesce(a.orcid_id = b.orcid_id, false) AS o, coalesce(a.scholar_id = b.scholar_id, false) AS s, a.told,
  coalesce(lower(a.institution) = lower(b.institution), false) AS place,
  CASE WHEN a.name = b.name THEN 1.0 WHEN contains(a.name, b.name) OR contains(b.name, a.name) THEN 0.9
    WHEN len(a.parts) = 2 AND len(b.parts) = 2 AND a.parts[1] = b.parts[2] AND a.parts[2] = b.parts[1] THEN 0.85
    ELSE len([g for g in a.grams if list_contains(b.grams, g)]) / CAST(len(list_distinct(list_concat(a.grams, b.grams))) AS DOUBLE) END AS alike
  FROM shaped a JOIN shaped b ON (lower(a.institution) = lower(b.institution) OR a.orcid_id = b.orcid_id OR a.scholar_id = b.scholar_id) WHERE a.id % 4 = 0 AND b.id % 4 <> 0),
scored AS (SELECT *, least(1.0, (CASE WHEN o THEN 0.5 ELSE 0.0 END + CASE WHEN s THEN 0.4 ELSE 0.0 END + alike * CAST(0.4 AS DOUBLE) + CASE WHEN place THEN 0.1 ELSE 0.0 END) / CASE WHEN told THEN 1.0 ELSE 0.5 END) AS similarity FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY in_id ORDER BY decision, CASE WHEN decision = 1 THEN -similarity ELSE 0 END, id) AS n
  FROM (SELECT *, CASE WHEN is_active AND round(similarity, 9) >= 0.85 THEN 1 WHEN o THEN 2 WHEN s THEN 3 END AS decision FROM scored) WHERE decision IS NOT NULL)
SELECT a.id AS in_id, CASE decision WHEN 1 THEN 'duplicate' WHEN 2 THEN 'orcid_taken' WHEN 3 THEN 'scholar_taken' ELSE 'created' END AS decision, r.id, round(similarity, 6) AS similarity
FROM every a LEFT JOIN ranked r ON r.in_id = a.id AND n = 1 WHERE a.id % 4 = 0""")
def gate_decisions(d: Domain):
    """What the gate says of every fourth part as a new person, held against the others as the stored ones."""
    every = d.table("part").selectExpr(*[f"{e} AS {n}" for n, e in APPLICANT.items()])
    stored, new, steps = every.where("id % 4 <> 0"), every.where("id % 4 = 0"), Steps(d.spark)
    refused = gate.kept_out(new, stored, steps.write(gate.index_rows(stored), "index"), steps)
    told = new.select(F.col("id").alias("in_id")).join(refused, "in_id", "left")
    return told.select("in_id", F.coalesce("decision", F.lit("created")).alias("decision"), "id", F.round("similarity", 6).alias("similarity"))
