"""Queries on requests, pages' layouts, names in two languages, wrong encodings and backlogs, and their SQL.

Texts are made of a row's key; where a pattern can't be said in the oracle's dialect, it holds what each text should give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import ingest, metrics, rating, requests
from ..sources import pages
from .queries_upkeep import _q, _rotated
from .standins import Domain, with_

QUERIES: dict = {}
ORACLES: dict = {}


def _value(said: str | None) -> str:
    return "NULL" if said is None else _q(said)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PERSON = {
    "name_zh": _rotated("c_custkey", ["''", "repeat('n', 100)", "repeat('n', 101)"], "c_name"),
    "name_en": _rotated("c_custkey", [None, "repeat('e', 201)"], "c_name"),
    "email": _rotated("c_custkey", [None, "'a@b'", "'a b@c.edu'", "''"], "concat(lower(c_mktsegment), '@uni.edu')"),
    "website": _rotated("c_custkey", [None, "'uni.edu/x'", "'https://uni.edu/x y'"], "concat('https://uni.edu/', CAST(c_custkey AS VARCHAR(20)))"),
}
_EMAIL = r"^[A-Za-z0-9_+-]+([.'][A-Za-z0-9_+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\z"


def _failing(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in rules.items()) + ")"


@query(
    f"""WITH p AS (SELECT c_custkey AS id, {', '.join(f"{e} AS {c}" for c, e in PERSON.items())}, c_custkey % 3 AS n_fields FROM customer)
SELECT id, {_failing({
    'name_zh': 'length(name_zh) BETWEEN 1 AND 100', 'name_en': 'name_en IS NULL OR length(name_en) <= 200', 'email': f'email IS NULL OR regexp_matches(email, {_q(_EMAIL)})',
    'website': "website IS NULL OR regexp_matches(website, '^[A-Za-z][A-Za-z0-9+.\\-]*:[^\\s]+$')", 'field_ids': 'n_fields >= 1'})} AS problems FROM p"""
)
def person_request_problems(d: Domain):
    rows = d.table("customer").selectExpr("c_custkey AS id", *[f"{e} AS {c}" for c, e in PERSON.items()], "slice(array('a', 'b'), 1, CAST(c_custkey % 3 AS INT)) AS field_ids")
    return rows.select("id", F.concat_ws(",", requests.problems("create_person", {c: F.col(c) for c in [*PERSON, "field_ids"]})).alias("problems"))


REQUEST = {
    "person_id": "CASE WHEN o_custkey % 10 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR(20)) END",
    "category": "CASE o_orderkey % 3 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'RIGOROUS_RESEARCH' ELSE o_orderstatus END",
    "title": "substring(o_orderpriority, 3, 9)",
    "description": "repeat(o_orderpriority, CAST(o_orderkey % 14 AS INTEGER))",
    "severity": "CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE (o_orderkey % 14) / 2.0 END",
}


@query(
    f"""WITH r AS (SELECT o_orderkey AS id, {', '.join(f"{e} AS {c}" for c, e in REQUEST.items())}, o_orderkey % 8 AS n_evidence FROM orders)
SELECT id, {_failing({
    'person_id': "person_id <> ''", 'category': "category IN ('ACADEMIC_MISCONDUCT', 'RIGOROUS_RESEARCH', 'CONFLICT_OF_INTEREST', 'CITATION_MANIPULATION', 'OTHER')", 'title': 'length(title) BETWEEN 5 AND 200',
    'description': 'length(description) BETWEEN 50 AND 10000', 'severity': 'severity IS NULL OR (severity BETWEEN 1 AND 5 AND severity = floor(severity))', 'evidence_ids': 'n_evidence BETWEEN 1 AND 5'})} AS problems FROM r"""
)
def report_request_problems(d: Domain):
    rows = d.table("orders").selectExpr("o_orderkey AS id", *[f"{e} AS {c}" for c, e in REQUEST.items()], "slice(array(1, 2, 3, 4, 5, 6, 7), 1, CAST(o_orderkey % 8 AS INT)) AS evidence_ids")
    return rows.select("id", F.concat_ws(",", requests.problems("create_report", {c: F.col(c) for c in [*REQUEST, "evidence_ids"]})).alias("problems"))


ENCODED = "concat(" + ", ".join(
    f"repeat('{c}', CAST(o_orderkey % {n} AS INTEGER))" for c, n in (("Ã", 29), ("À", 11), ("中", 13), ("�", 7), ("鏄", 61), ("x", 331))
) + ")"


def _count(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))"


@query(
    f"""WITH t AS (SELECT o_orderkey AS id, {ENCODED} AS t FROM orders),
c AS (SELECT id, length(t) AS n, {_count('一-鿿')} AS cjk, {_count('À-ÿ')} AS accents, {_count(text.GBK_LATIN)} AS latin, {_count(chr(0xFFFD))} AS lost, {_count(text.GBK_CHINESE)} AS telltale FROM t)
SELECT id, n >= 100 AND ((accents > 20 AND cjk < 5) OR (latin > 15 AND cjk < 10) OR lost > 5 OR (cjk < 0.01 * n AND accents > 10) OR (cjk > 0.05 * n AND cjk < 0.2 * n AND telltale > 20) OR (cjk > 0.05 * n AND telltale > 50)) AS garbled FROM c"""
)
def garbled_texts(d: Domain):
    return d.table("orders").selectExpr("o_orderkey AS id", f"{ENCODED} AS t").select("id", text.garbled_chinese(F.col("t")).alias("garbled"))


# name_zh, name_en, valid, warning
NAMES = (
    ("王伟", "Wei Wang", True, None), ("王伟", "Department of Chemistry", True, "name_en"), ("王伟", "Physics", True, "name_en"), ("王伟", "A. B.", True, None),
    ("计算机学院", "Wei Wang", True, "name_zh"), (None, "Wei Wang", True, None), ("", None, False, None), ("计算机学院", "Physics", False, None), (None, "Department of Physics", False, None),
)


@query(f"SELECT c_custkey AS id, v.valid, v.warning FROM customer JOIN (VALUES {', '.join(f'({i}, {valid}, {_value(w)})' for i, (_, _, valid, w) in enumerate(NAMES))}) v(k, valid, warning) ON c_custkey % {len(NAMES)} = v.k")
def names_in_two_languages(d: Domain):
    def name(which: int) -> str:
        values = [n[which] for n in NAMES]
        return _rotated("c_custkey", [_value(v) for v in values[:-1]], _value(values[-1]))

    rows = d.table("customer").selectExpr("c_custkey AS id", f"{name(0)} AS zh", f"{name(1)} AS en")
    return rows.select("id", names.person_check(F.col("zh"), F.col("en")).alias("c")).select("id", "c.valid", "c.warning")


KEYS_A_TASK = 50_000
# A page and its sections as (layout, heading, content).
LAYOUTS = (
    ("<h1>X</h1><h2> Work </h2><p>Deep <b>nets</b></p><h3>Prizes</h3>none<h4><i>odd</i></h4>lost", (("heading", "Work", "Deep nets"), ("heading", "Prizes", "none"))),
    ('<div class="sec-title">Research</div><p>graphs and maps</p><span id="name2">Prizes</span>gold medal<b class="title">A</b>too short a head', (("title", "Research", "graphs and maps"), ("title", "Prizes", "gold medal"))),
    ("<p>研究方向：图论与网络 教育背景 : 武汉大学 获奖情况：无</p>", (("label", "研究方向", "图论与网络"), ("label", "教育背景 ", "武汉大学"))),
    ("<table><tr><th>职称</th><td>教授与导师</td></tr><tr><td>职务</td><td>无</td></tr><tr><td> 联系方式 </td> <td><a>a@b.cn</a></td></tr></table>", (("cell", "职称", "教授与导师"), ("cell", "联系方式", "a@b.cn"))),
    ("<h2>One</h2>研究方向：图论与网络", (("heading", "One", "研究方向：图论与网络"),)),
    ("<p>nothing here</p>", ()),
)


@query(
    f"""SELECT o_orderkey AS page_id, v.seq, v.layout, v.heading, v.content FROM orders
JOIN (VALUES {', '.join(f'({i}, {j}, {_q(layout)}, {_q(heading)}, {_q(content)})' for i, (_, found) in enumerate(LAYOUTS) for j, (layout, heading, content) in enumerate(found))}) v(k, seq, layout, heading, content)
 ON o_orderkey % {len(LAYOUTS) + 1} = v.k"""
)
def page_layouts(d: Domain):
    # A scan gives each row group to one task, however much its pages cost; the keys are dealt out, and pages made where they are read.
    keys = d.table("orders").select("o_orderkey")
    dealt = keys.repartition(-(-keys.count() // KEYS_A_TASK) or 1, "o_orderkey")
    return pages.sections(dealt.selectExpr("o_orderkey AS page_id", f"{_rotated('o_orderkey', [_q(html) for html, _ in LAYOUTS])} AS html"))


@query(
    with_("person", "now")
    + """, a AS (SELECT * FROM person WHERE is_active)
SELECT 'works' AS source, count(*) FILTER (institution IS NOT NULL AND name_zh <> '') AS eligible, count(*) FILTER (institution IS NOT NULL AND name_zh <> '') - count(h_index) AS remaining FROM a
UNION ALL SELECT 'papers', count(institution), count(*) FILTER (institution IS NOT NULL AND (h_index IS NULL OR last_scraped_at < t - INTERVAL 30 DAY)) FROM a, now_at
UNION ALL SELECT 'pinyin', count(*), count(*) FILTER (name_zh <> '' AND name_en IS NULL) FROM a"""
)
def enrichment_backlogs(d: Domain):
    return ingest.backlogs(d.persons, d.now())


@query("SELECT turn, key FROM (SELECT (n_nationkey - 15 + 25) % 25 AS turn, n_name AS key FROM nation WHERE n_nationkey % 4 <> 0) ORDER BY turn LIMIT 5")
def rotating_window_skipping(d: Domain):
    keys = d.table("nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("key"))
    return metrics.rotating_window(keys, run=3, skipped=keys.where("idx % 4 = 0"))


_DECISION = "CASE o_orderkey % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECT' ELSE 'NEED_MORE_INFO' END"
_DELTA = "CAST(o_orderkey % 5 - 2 AS DOUBLE)"


@query(
    with_("report")
    + f""", m AS (SELECT id AS report_id, person_id, category, {_DELTA.replace('o_orderkey', 'id')} AS delta FROM report WHERE status IN ('PENDING', 'UNDER_REVIEW') AND id % 3 = 0),
b AS (SELECT c_custkey AS person_id, 'OTHER' AS category, 90.0 AS value FROM customer),
r AS (SELECT m.*, CAST(coalesce(value, 100) AS DOUBLE) + sum(delta) OVER (PARTITION BY m.person_id, m.category ORDER BY report_id) AS new_value FROM m LEFT JOIN b USING (person_id, category) WHERE delta <> 0)
SELECT report_id, person_id, category, new_value - delta AS old_value, new_value, delta FROM r"""
)
def reviews_score_changes(d: Domain):
    """Reports are decided in turn; each moves the category it is about."""
    orders = d.table("orders")
    decisions = orders.selectExpr("o_orderkey AS report_id", f"{_DECISION} AS decision")
    deltas = d.reports.join(orders.selectExpr("o_orderkey AS id", f"{_DELTA} AS delta"), "id").select(F.col("id").alias("report_id"), "category", "delta")
    breakdowns = d.table("customer").selectExpr("c_custkey AS person_id", "'OTHER' AS category", "90.0D AS value")
    return rating.reviewed(d.reports, decisions, breakdowns, deltas)[2]


# A script's JSON and the publications it gives: title, authors, journal, doi, year, url, abstract.
JSON_LD = (
    ('{"@type": "ScholarlyArticle", "name": "On graphs", "author": [{"name": "Ann"}, "Bob", {"id": 1}], "publisher": {"name": "Press"}, "sameAs": "https://doi.org/10.1000/x", "datePublished": "2020-05-01", "url": "https://a.b"}',
     (("On graphs", "Ann; Bob", "Press", "10.1000/x", 2020, "https://a.b", None),)),
    ('[{"@type": ["Thing", "Book"], "headline": "Of maps", "author": "Ann", "publisher": "House", "identifier": ["isbn", "10.5/y"], "description": "All"}, {"@type": "Person", "name": "Ann Lee"}]',
     (("Of maps", "Ann", "House", "10.5/y", None, None, "All"),)),
    ('{"@graph": [{"@type": "Thesis", "name": "Nets one", "author": {"name": "Cy"}, "isPartOf": {"name": "Series"}, "identifier": {"@type": "PropertyValue", "propertyID": "DOI", "value": "10.7/z"}, "dateCreated": "May 1999"}, {"@type": "Article", "name": "Tiny"}, {"@type": "Article", "name": "Nets two", "url": {"id": 1}}]}',
     (("Nets one", "Cy", "Series", "10.7/z", 1999, None, None), ("Nets two", "", None, None, None, None, None))),
    ('{"@type": "Article", "name": "Broken"', ()),
    ('{"name": "No type at all"}', ()),
)


@query(
    f"""SELECT o_orderkey AS page_id, v.* EXCLUDE (k) FROM orders
JOIN (VALUES {', '.join('(' + ', '.join([str(i), *(str(x) if isinstance(x, int) else _value(x) for x in row)]) + ')' for i, (_, found) in enumerate(JSON_LD) for row in found)}) v(k, title, authors, journal, doi, year, url, abstract)
 ON o_orderkey % {len(JSON_LD) + 1} = v.k"""
)
def json_ld_publications(d: Domain):
    scripts = [_q(f'<script type="application/ld+json">{json}</script>') for json, _ in JSON_LD]
    rows = d.table("orders").selectExpr("o_orderkey AS page_id", f"{_rotated('o_orderkey', scripts)} AS html")
    return pages.json_ld_publications(rows).withColumn("authors", F.array_join("authors", "; "))
