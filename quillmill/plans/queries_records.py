"""Queries on data quality, text, matching, graphs, metrics and feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.numbers import half_up
from ..operators import cleanup, feed, graph, matching, metrics, quality
from ..operators.stored import Steps
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


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


_NOT_SEED = "json_extract_string(metadata, '$.source') <> 'seed'"
_MISSING = "list_filter([CASE WHEN coalesce(name_en, '') = '' THEN 'name_en' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(department, '') = '' THEN 'department' END, CASE WHEN coalesce(email, '') = '' THEN 'email' END, CASE WHEN coalesce(bio_zh, '') = '' THEN 'bio_zh' END, CASE WHEN h_index IS NULL THEN 'h_index' END], lambda x: x IS NOT NULL)"


@query(
    with_("person")
    + f""", m AS (SELECT id, {_MISSING} AS missing FROM person WHERE is_active AND {_NOT_SEED})
SELECT 'INCOMPLETE_PROFILE' AS type, CASE WHEN len(missing) >= 5 THEN 'high' WHEN len(missing) >= 4 THEN 'medium' ELSE 'low' END AS severity, CAST(id AS VARCHAR) AS entity_id, array_to_string(missing, ', ') AS detail, 'NOTIFY' AS action FROM m WHERE len(missing) >= 3"""
)
def incomplete_profiles(d: Domain):
    return quality.incomplete_profiles(d.persons)


@query(with_("person") + "SELECT 'DUPLICATE_PERSON' AS type, 'high' AS severity, CAST(min(id) AS VARCHAR) AS entity_id, concat(count(*), ' copies') AS detail, 'REVIEW' AS action FROM person WHERE is_active AND institution IS NOT NULL AND department IS NOT NULL GROUP BY institution, department HAVING count(*) > 1 ORDER BY count(*) DESC, institution, department LIMIT 100")
def duplicate_persons(d: Domain):
    return quality.duplicate_persons(d.persons, ("institution", "department"))


@query(with_("person") + "SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM person WHERE is_active AND institution IS NOT NULL AND department IS NOT NULL GROUP BY institution, department HAVING count(*) > 1)")
def duplicate_extra(d: Domain):
    return quality.duplicate_groups(d.persons, "institution", "department").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("copies") - 1).alias("extra"))


@query(
    with_("person", "now")
    + f"""SELECT 'STALE_DATA' AS type, CASE WHEN age IS NULL OR age > 180 THEN 'high' ELSE 'medium' END AS severity, CAST(id AS VARCHAR) AS entity_id, coalesce(CAST(age AS VARCHAR), 'never') AS detail, CASE WHEN coalesce(orcid_id, '') <> '' THEN 'NOTIFY' ELSE 'REVIEW' END AS action
FROM (SELECT *, CAST(floor(date_diff('microsecond', last_scraped_at, t) / 86400e6) AS BIGINT) AS age FROM person, now_at WHERE is_active AND {_NOT_SEED} AND (last_scraped_at IS NULL OR last_scraped_at < t - INTERVAL 90 DAY) ORDER BY last_scraped_at NULLS FIRST, id LIMIT 200)"""
)
def stale_profiles(d: Domain):
    return quality.stale_profiles(d.persons, d.now())


@query(
    with_("person", "report", "link")
    + """, n AS (SELECT (SELECT count(*) FROM report WHERE person_id IN (SELECT id FROM person WHERE NOT is_active)) AS r, (SELECT count(*) FROM link WHERE person_id IN (SELECT id FROM person WHERE NOT is_active)) AS l)
SELECT 'ORPHANED_RECORD' AS type, CASE WHEN r + l > 100 THEN 'high' WHEN r + l > 10 THEN 'medium' ELSE 'low' END AS severity, 'SYSTEM' AS entity_id, concat('person_field: ', l, ', report: ', r) AS detail, 'AUTO_FIX' AS action FROM n WHERE r + l > 0"""
)
def orphaned_records(d: Domain):
    return quality.orphaned_records(d.persons, {"report": d.reports, "person_field": d.links})


@query(with_("person", "report") + "SELECT 'SUSPICIOUS_SCORE' AS type, 'high' AS severity, CAST(id AS VARCHAR) AS entity_id, concat((SELECT count(*) FROM report WHERE person_id = p.id), ' reports') AS detail, 'REVIEW' AS action FROM (SELECT * FROM person WHERE is_active AND (score < 10 OR score > 190) ORDER BY score, id LIMIT 50) p")
def suspicious_scores(d: Domain):
    return quality.suspicious_scores(d.persons, d.reports, high=190)


@query(with_("person", "link") + "SELECT 'EMPTY_FIELDS' AS type, 'medium' AS severity, CAST(id AS VARCHAR) AS entity_id, name_zh AS detail, 'NOTIFY' AS action FROM person WHERE is_active AND id NOT IN (SELECT person_id FROM link) ORDER BY id LIMIT 100")
def no_fields(d: Domain):
    return quality.no_fields(d.persons, d.links)


@query(
    with_("person", "link", "report", "now")
    + """, old AS (SELECT id FROM person, now_at WHERE NOT is_active AND last_scraped_at < t - INTERVAL 60 DAY), n AS (SELECT (SELECT count(*) FROM link WHERE person_id IN (SELECT id FROM old)) + (SELECT count(*) FROM report WHERE person_id IN (SELECT id FROM old)) AS n)
SELECT 'INACTIVE_WITH_CONTENT' AS type, 'low' AS severity, 'SYSTEM' AS entity_id, concat(n, ' records') AS detail, 'AUTO_FIX' AS action FROM n WHERE n > 0"""
)
def inactive_with_content(d: Domain):
    return quality.inactive_with_content(d.persons, d.now(), {"person_field": d.links, "report": d.reports})


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _first_match(column: str, patterns: tuple[str, ...], told: str) -> str:
    """CASE of the first pattern that is found, by its place."""
    return " ".join(f"WHEN regexp_matches({column}, {_quoted(p)}) THEN {told.format(i)}" for i, p in enumerate(patterns))


@query(
    f"""SELECT doc_id, reason FROM (SELECT doc_id, CASE {_first_match('w', text.GARBAGE_NAME_PATTERNS, "'pattern {}'")} WHEN length(w) < 2 THEN 'short' WHEN length(w) > 80 THEN 'long' END AS reason
FROM (SELECT doc_id, split_part(replace(coalesce(text, ''), chr(10), ' '), ' ', 1) AS w FROM documents)) WHERE reason IS NOT NULL"""
)
def garbage_first_words(d: Domain):
    first = F.split_part(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(1))
    return d.table("documents").select("doc_id", text.garbage_name(first).alias("reason")).where("reason is not null")


@query("SELECT doc_id, floor(length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) * 1.0 / length(text) * 10000 + 0.5) / 10000 AS density FROM documents WHERE length(text) > 0")
def info_density(d: Domain):
    return d.table("documents").where(F.length("text") > 0).select("doc_id", half_up(text.info_density(F.col("text")), 4).alias("density"))


@query(f"SELECT page_id, CASE WHEN length(html) >= 10 THEN CASE {_first_match('html', text.JUNK_BIO_PATTERNS, '{}')} END END AS pattern FROM pages")
def junk_pages(d: Domain):
    """The junk-biography rule over pages."""
    return d.table("pages").select("page_id", text.junk_bio(F.col("html")).alias("pattern"))


_STRIP = "html"
for _pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>"):
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', ' ', 'g')"
for _entity, _instead in text.ENTITIES:
    _STRIP = f"replace({_STRIP}, '{_entity}', {_quoted(_instead)})"
_STRIP = rf"trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_STRIP} AS text FROM pages")
def strip_html(d: Domain):
    return d.table("pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"SELECT doc_id, email FROM (SELECT doc_id, nullif(lower(regexp_extract(regexp_replace(regexp_replace(text, '\s*(\[at\]|\(at\)|#)\s*', '@', 'g'), '\s*(\[dot\]|\(dot\))\s*', '.', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0)), '') AS email FROM documents) WHERE email IS NOT NULL")
def email_extract(d: Domain):
    return d.table("documents").select("doc_id", text.email(F.col("text")).alias("email")).where("email is not null")


@query("SELECT host, count(*) AS links FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) AS href, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) GROUP BY 1")
def discovered_links(d: Domain):
    from ..sources.pages import links

    return links(d.table("pages")).where(F.col("internal")).groupBy("host").agg(F.count(F.lit(1)).alias("links"))


@query(
    r"""WITH k AS (SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')), 1, 120) AS key FROM conversations)
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS place FROM k) WHERE place = 1"""
)
def normalise_title_dedup(d: Domain):
    pubs = d.table("conversations").select(F.col("conv_id").alias("person_id"), F.col("turn").alias("seq"), F.col("text").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("journal"))
    return matching.distinct_publications(pubs).select(F.col("person_id").alias("conv_id"), F.col("seq").alias("turn"))


@query(
    """WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS a FROM part),
s AS (SELECT s_suppkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS b FROM supplier JOIN part ON p_partkey = s_suppkey),
j AS (SELECT w.id AS left_id, s.id AS right_id, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS similarity FROM w, s)
SELECT left_id, right_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS place FROM j WHERE similarity >= 0.5) WHERE place = 1"""
)
def token_best_match(d: Domain):
    left = d.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    right = d.table("supplier").join(d.table("part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.col("p_name").alias("name"))
    return matching.best_token_matches(left, right, 0.5)


_TRIGRAMS = "list_transform(generate_series(1, length({0}) + 1), lambda i: substr('  ' || {0} || ' ', i, 3))"


@query(
    f"""WITH p AS (SELECT DISTINCT ON (p_brand, p_type, p_name) p_partkey AS id, concat(p_brand, p_type) AS institution, lower(p_name) AS name FROM part ORDER BY p_brand, p_type, p_name, p_partkey),
g AS (SELECT *, {_TRIGRAMS.format('name')} AS g FROM p),
pairs AS (SELECT a.id AS a_id, b.id AS b_id, CASE WHEN contains(a.name, b.name) OR contains(b.name, a.name) THEN 0.9
  WHEN split_part(a.name, ' ', 1) = split_part(b.name, ' ', 2) AND split_part(a.name, ' ', 2) = split_part(b.name, ' ', 1) THEN 0.85
  ELSE len(list_filter(a.g, lambda t: list_contains(b.g, t))) * 1.0 / len(list_distinct(list_concat(a.g, b.g))) END AS s FROM g a JOIN g b ON a.institution = b.institution AND a.id < b.id)
SELECT a_id, b_id, {_half_up('s', 4)} AS similarity FROM pairs WHERE {_half_up('s', 4)} >= 0.5"""
)
def similar_names(d: Domain):
    first = F.row_number().over(Window.partitionBy("p_brand", "p_type", "p_name").orderBy("p_partkey"))
    rows = d.table("part").withColumn("place", first).where("place = 1").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("institution"), F.col("p_name").alias("name"))
    return matching.similar_names(rows, 0.5)


def _edges(d: Domain):
    return graph.coauthor_edges(d.publications.select("paper_id", "person_id"))


def _nodes(d: Domain):
    return d.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("int").alias("citations"), (F.col("s_suppkey") % 40).cast("int").alias("h_index"))


_EDGES = """WITH who AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS person_id FROM lineitem),
edge AS (SELECT a.person_id AS from_id, b.person_id AS to_id, count(*) AS papers, floor(least(1.0, ln(count(*) + 1.0) / ln(8.0)) * 1000000.0 + 0.5) / 1000000.0 AS weight FROM who a JOIN who b ON a.paper_id = b.paper_id AND a.person_id <> b.person_id GROUP BY 1, 2)
"""


def _over_stored_edges(d: Domain, result):
    """result (from stored edges to a table of nodes) as a table; the edges are written once and deleted after it."""
    steps = Steps(d.spark)
    out = steps.write(result(graph.stored_coauthor_edges(d.publications.select("paper_id", "person_id"), steps)), "result")
    steps.keep_only("result")
    return out


def _one_iteration(d: Domain, edges):
    nodes = _nodes(d).select("id")
    n = nodes.count()
    return graph.pagerank_step(nodes.withColumn("rank", F.lit(1.0 / n)), edges, n).select("id", half_up(F.col("rank"), 9).alias("rank"))


@query(_EDGES + "SELECT from_id, to_id, papers, weight FROM edge")
def coauthor_edges(d: Domain):
    return _edges(d)


@query(
    _EDGES + """, degree AS (SELECT from_id, count(*) AS degree FROM edge GROUP BY 1), n AS (SELECT count(*) AS n FROM supplier),
received AS (SELECT to_id, sum((1.0 / n) / degree * weight) AS x FROM edge JOIN degree USING (from_id), n GROUP BY 1)
SELECT s_suppkey AS id, floor(((1 - 0.85) / n + 0.85 * coalesce(x, 0)) * 1e9 + 0.5) / 1e9 AS rank FROM supplier LEFT JOIN received ON to_id = s_suppkey, n"""
)
def pagerank_one_iteration(d: Domain):
    return _over_stored_edges(d, lambda edges: _one_iteration(d, edges))


@query()
def pagerank_converged(d: Domain):
    nodes = _nodes(d)
    return _over_stored_edges(d, lambda edges: graph.authority(nodes, edges, graph.pagerank(nodes, edges, stored=True)))


@query()
def label_propagation(d: Domain):
    return _over_stored_edges(d, lambda edges: graph.communities(_nodes(d), edges, stored=True))


@query("WITH last AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000) SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, count(*) AS samples FROM last")
def latency_percentiles(d: Domain):
    return metrics.latency_percentiles(d.table("events").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("latency")))


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def request_counters(d: Domain):
    return metrics.request_counters(d.table("events").withColumn("success", F.col("event_type") != "error"), "user_id")


@query("SELECT event_type, count(*) AS n, floor(avg(value) * 100.0 + 0.5) / 100.0 AS mean FROM events GROUP BY 1")
def mean_by_type(d: Domain):
    return metrics.mean_by(d.table("events"), "event_type", "value")


@query(
    with_("person", "link")
    + """, a AS (SELECT *, id IN (SELECT person_id FROM link) AS linked FROM person WHERE is_active), n AS (
SELECT count(*) AS total, count(*) FILTER (coalesce(name_en, '') <> '') AS e, count(*) FILTER (email IS NOT NULL) AS m, count(*) FILTER (h_index IS NOT NULL) AS h, count(*) FILTER (orcid_id IS NOT NULL) AS o, count(*) FILTER (linked) AS f FROM a)
SELECT metric, n, CASE WHEN total = 0 THEN '0%' ELSE format('{:.1f}%', n * 100.0 / total) END AS share FROM (SELECT total, unnest(['name_en', 'email', 'h_index', 'orcid', 'fields']) AS metric, unnest([e, m, h, o, f]) AS n FROM n)"""
)
def coverage_counters(d: Domain):
    linked = d.links.select("person_id").distinct().withColumn("linked", F.lit(True))
    persons = d.persons.join(linked, F.col("id") == F.col("person_id"), "left")
    return metrics.coverage(persons, {"name_en": text.filled(F.col("name_en")), "email": F.col("email").isNotNull(), "h_index": F.col("h_index").isNotNull(), "orcid": F.col("orcid_id").isNotNull(), "fields": F.col("linked")})


@query(with_("person") + "SELECT CASE WHEN n >= 100 THEN '>=100' WHEN n >= 50 THEN '>=50' WHEN n >= 20 THEN '>=20' WHEN n >= 5 THEN '>=5' ELSE '<5' END AS tier, count(*) AS groups FROM (SELECT institution, count(*) AS n FROM person GROUP BY 1) GROUP BY 1")
def size_tiers(d: Domain):
    return metrics.size_tiers(d.persons.groupBy("institution").agg(F.count(F.lit(1)).alias("n")))


@query(with_("person") + "SELECT coalesce(institution, 'Unknown') AS institution, count(*) AS n, count(email) AS with_email, count(h_index) AS with_h_index FROM person GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def nonnull_counts(d: Domain):
    grouped = d.persons.groupBy(F.coalesce("institution", F.lit("Unknown")).alias("institution"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count("email").alias("with_email"), F.count("h_index").alias("with_h_index")).orderBy(F.desc("n"), "institution").limit(20)


@query("SELECT (n_nationkey - 15 % 25 + 25) % 25 AS turn, n_name AS key FROM nation WHERE (n_nationkey - 15 + 25) % 25 < 5")
def rotating_window(d: Domain):
    return metrics.rotating_window(d.table("nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("key")), run=3)


@query("SELECT n_name AS key FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def missing_keys(d: Domain):
    rich = d.table("supplier").where("s_acctbal > 9000").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"))
    return metrics.missing_keys(d.table("nation").select(F.col("n_name").alias("key")), rich, "key")


@query(
    """WITH b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS person_id, coalesce(a.v, []) AS a, coalesce(b.v, []) AS b FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
SELECT person_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS removed, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS unchanged FROM j"""
)
def set_except_fields(d: Domain):
    side = lambda k: d.table("orders").where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("person_id")).agg(F.collect_set("o_orderpriority").alias("values"))
    changed = metrics.set_changes(side(0), side(1), "person_id")
    return changed.select("person_id", *[F.concat_ws(",", c).alias(c) for c in ("added", "removed", "unchanged")])


@query("SELECT event_type AS action, arg_max(props, ts) AS payload, max(ts) AS created_at FROM events GROUP BY 1")
def latest_checkpoint(d: Domain):
    return metrics.latest_of_type(d.table("events").select(F.col("event_type").alias("action"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), F.col("event_id").alias("id")))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT key, id, seq, ts AS start, 1 AS n FROM e WHERE seq = 1
  UNION ALL SELECT e.key, e.id, e.seq, CASE WHEN e.ts >= f.start + INTERVAL 86400 SECOND THEN e.ts ELSE f.start END, CASE WHEN e.ts >= f.start + INTERVAL 86400 SECOND THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.key = f.key AND e.seq = f.seq + 1)
SELECT key, id, n <= 3 AS allowed, greatest(0, 3 - n) AS remaining FROM f"""
)
def rate_limit_windows(d: Domain):
    return metrics.rate_limited(d.table("events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 3, 86400)


def _papers(d: Domain):
    """Stand-in papers: a document each; authors are its first words, categories come from its language."""
    words = F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, (F.col("doc_id") % 12 + 1).cast("int"))
    return d.table("documents").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("summary"), words.alias("authors"),
        F.when(F.col("doc_id") % 3 == 0, "10.1/x").alias("doi"), F.when(F.col("doc_id") % 4 == 0, "J").alias("journal"),
        F.when(F.col("doc_id") % 5 == 0, F.array("lang", "source")).otherwise(F.array("lang")).alias("categories"), F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 7 == 0, "Accepted at a venue").alias("comment"),
        (F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'") - F.make_dt_interval(days=(F.col("doc_id") % 60).cast("int"))).alias("published"),
    )


@query(
    """SELECT doc_id AS id, least(100, 50 + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN n >= 3 THEN 5 ELSE 0 END + CASE WHEN n >= 10 THEN 5 ELSE 0 END
  + CASE WHEN doc_id % 6 = 0 THEN 15 ELSE 0 END + CASE WHEN doc_id % 60 <= 7 THEN 10 WHEN doc_id % 60 <= 30 THEN 5 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 7 ELSE 0 END) AS relevance
FROM (SELECT doc_id, least(doc_id % 12 + 1, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS n FROM documents)"""
)
def relevance_score(d: Domain):
    papers = _papers(d)
    value = scores.relevance(F.col("doi"), F.col("journal"), F.size("authors"), F.col("id") % 6 == 0, F.col("published"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), F.size("categories"), F.col("comment"))
    return papers.select("id", value.cast("bigint").alias("relevance"))


@query()
def personal_feed(d: Domain):
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    persons = d.table("documents").select(F.col("doc_id").alias("id"), F.split(F.col("text"), " ")[0].alias("name_en"), F.lit(None).cast("string").alias("name_zh"), F.lit(True).alias("is_active"))
    return feed.feed(_papers(d), feed.linked_authors(_papers(d), persons), as_of, days=30)


@query(with_("person") + f"SELECT CASE WHEN metadata IS NULL THEN 'none' WHEN json_extract_string(metadata, '$.source') IS NULL THEN 'no source' ELSE json_extract_string(metadata, '$.source') END AS source, count(*) AS n, count(*) FILTER ({_NOT_SEED}) AS not_seed FROM person GROUP BY 1")
def json_source_filter(d: Domain):
    source = F.get_json_object("metadata", "$.source")
    kind = F.when(F.col("metadata").isNull(), "none").when(source.isNull(), "no source").otherwise(source)
    return d.persons.groupBy(kind.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(quality.not_seed(), F.lit(False))).alias("not_seed"))


@query(
    with_("person")
    + """, t1 AS (SELECT id, 1 AS tier, score FROM person WHERE is_active AND h_index IS NULL AND coalesce(name_en, '') <> '' ORDER BY score DESC, id LIMIT 30),
t2 AS (SELECT id, 2 AS tier, score FROM person WHERE is_active AND h_index IS NULL AND coalesce(name_en, '') = '' ORDER BY score DESC, id LIMIT 30)
SELECT id, tier, score FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) ORDER BY tier, score DESC, id LIMIT 30"""
)
def two_tier_candidates(d: Domain):
    from ..operators.ingest import two_tier

    return two_tier(d.persons.where("is_active and h_index is null"), text.filled(F.col("name_en")), 30)


@query(with_("report") + "SELECT 'new' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT 'known', count(*) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def doi_split(d: Domain):
    new, known = matching.new_and_known(d.table("orders").where("o_orderkey % 2 = 1"), d.table("orders").where("o_orderkey % 2 = 0"), ["o_custkey"])
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(new, "new").unionByName(count(known, "known"))


@query(r"SELECT count(*) AS new_titles FROM (SELECT DISTINCT substr(lower(text), 1, 60) AS k FROM conversations WHERE role = 'user') WHERE k NOT IN (SELECT substr(lower(text), 1, 60) FROM conversations WHERE role = 'assistant')")
def title_anti_join(d: Domain):
    key = F.substring(F.lower("text"), 1, 60).alias("k")
    rows = d.table("conversations")
    new, _ = matching.new_and_known(rows.where("role = 'user'").select(key).distinct(), rows.where("role = 'assistant'").select(key), ["k"])
    return new.agg(F.count(F.lit(1)).alias("new_titles"))


@query(
    with_("person")
    + """, s AS (SELECT *, CASE WHEN coalesce(h_index, 0) <> 0 THEN 3 ELSE 0 END + CASE WHEN coalesce(email, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(bio_zh, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(department, '') <> '' THEN 1 ELSE 0 END + CASE WHEN citation_count > 500 THEN 2 ELSE 0 END AS filled FROM person)
SELECT id, filled, is_active AND row_number() OVER (PARTITION BY institution, title ORDER BY filled DESC, id) = 1 AS is_active FROM s"""
)
def completeness_keep(d: Domain):
    filled = scores.completeness(F.col("h_index"), F.col("email"), F.col("bio_zh"), F.col("department"), F.col("citation_count") - 500, F.lit(0), F.lit(0))
    return quality.keep_most_complete(d.persons, ["institution", "title"], filled).select("id", F.col("filled").cast("int").alias("filled"), "is_active")


@query(
    with_("person", "publication")
    + """SELECT CAST(id AS VARCHAR) AS entity_id, 'GARBAGE_NAME' AS type, 'DEACTIVATE_PERSON' AS action FROM (SELECT * REPLACE (substr(name_zh, 1, CAST(1 + id % 3 AS INTEGER)) AS name_zh) FROM person)
WHERE is_active AND json_extract_string(metadata, '$.source') <> 'seed' AND length(coalesce(name_zh, '')) <= 1 AND coalesce(h_index, 0) = 0 AND id NOT IN (SELECT person_id FROM publication) ORDER BY id LIMIT 50"""
)
def garbage_cleanup(d: Domain):
    short = d.persons.withColumn("name_zh", F.substring(F.col("name_zh"), F.lit(1), (F.col("id") % 3 + 1).cast("int")))
    chosen = cleanup.garbage_persons({"person": short, "publication": d.publications})
    return chosen.select(F.col("id").cast("string").alias("entity_id"), F.lit("GARBAGE_NAME").alias("type"), F.lit("DEACTIVATE_PERSON").alias("action"))


_SPOILT = {
    "name_zh": "substring(name_zh, 1, CAST(1 + id % 3 AS INTEGER))",
    "bio_zh": "CASE id % 8 WHEN 1 THEN '<div>' || bio_zh || '</div>' WHEN 2 THEN '<p>' || repeat('-', 60) || bio_zh WHEN 3 THEN bio_zh || ' &nbsp; ' || bio_zh ELSE bio_zh END",
}
_SCANS = ("incomplete_profiles", "stale_profiles", "no_fields", "suspicious_scores", "duplicate_persons", "orphaned_records", "inactive_with_content")
_GARBAGE = (
    with_("person")
    + f""", spoilt AS (SELECT * REPLACE ({_SPOILT["name_zh"]} AS name_zh) FROM person WHERE is_active), told AS (SELECT *, coalesce(h_index, 0) > 0 OR coalesce(citation_count, 0) > 0 AS known,
  coalesce(CASE {_first_match("coalesce(name_zh, '')", text.GARBAGE_NAME_PATTERNS, "'pattern {}'")} WHEN length(coalesce(name_zh, '')) < 2 THEN 'short' WHEN length(name_zh) > 80 THEN 'long' END,
    CASE WHEN coalesce(name_en, '') = '' THEN NULL {_first_match("name_en", text.GARBAGE_NAME_PATTERNS, "'english pattern'")} END) AS reason FROM spoilt)
SELECT 'GARBAGE_NAME' AS type, CASE WHEN known THEN 'medium' ELSE 'high' END AS severity, CAST(id AS VARCHAR) AS entity_id, reason AS detail, CASE WHEN known THEN 'REVIEW' ELSE 'AUTO_FIX' END AS action FROM told WHERE reason IS NOT NULL"""
)
_JUNK = (
    with_("person")
    + f""", spoilt AS (SELECT * REPLACE ({_SPOILT["bio_zh"]} AS bio_zh) FROM person WHERE is_active), told AS (SELECT *, CASE WHEN length(bio_zh) >= 10 THEN CASE {_first_match("bio_zh", text.JUNK_BIO_PATTERNS, "{}")} END END AS pattern,
  length(regexp_replace(bio_zh, '[^a-zA-Z0-9]', '', 'g')) / CAST(length(bio_zh) AS DOUBLE) < 0.3 AS thin FROM spoilt)
SELECT 'JUNK_BIO' AS type, CASE WHEN thin THEN 'high' ELSE 'medium' END AS severity, CAST(id AS VARCHAR) AS entity_id, concat('pattern ', pattern) AS detail, CASE WHEN thin THEN 'AUTO_FIX' ELSE 'REVIEW' END AS action FROM told WHERE pattern IS NOT NULL"""
)
_ALL_ISSUES = " UNION ALL ".join(f"(SELECT type, severity, action FROM ({sql}) ORDER BY entity_id, detail LIMIT 100)" for sql in (_GARBAGE, _JUNK, *(ORACLES[n] for n in _SCANS)))


@query(f"""SELECT type, severity, count(*) AS issues, count(*) FILTER (action = 'AUTO_FIX') AS auto_fixable, count(*) FILTER (action = 'REVIEW') AS needs_review
FROM ({_ALL_ISSUES}) GROUP BY type, severity""")
def full_scan_summary(d: Domain):
    """All nine scans over the persons, at most a hundred issues of each; names and biographies are spoilt for the two scans that look for it."""
    p, children = d.persons, {"report": d.reports, "person_field": d.links}
    spoilt = {c: p.withColumn(c, F.expr(e)) for c, e in _SPOILT.items()}
    scans = [
        quality.garbage_names(spoilt["name_zh"]), quality.junk_bios(spoilt["bio_zh"]), quality.incomplete_profiles(p), quality.stale_profiles(p, d.now()), quality.no_fields(p, d.links),
        quality.suspicious_scores(p, d.reports, high=190), quality.duplicate_persons(p, ("institution", "department")), quality.orphaned_records(p, children), quality.inactive_with_content(p, d.now(), children),
    ]
    return quality.summary(quality.full_scan(scans))


_SOURCES = ("ORCID", "CN_UNIVERSITY", "GOOGLE_SCHOLAR")
_SOURCED = {
    "person_id": "id",
    "source": "source",
    "source_id": "source || ':' || CAST(id AS VARCHAR(20))",
    "name_zh": "name_zh",
    "name_en": "CASE WHEN (id + k) % 4 = 0 THEN '' ELSE name_en || ' ' || CAST(k AS VARCHAR(2)) END",
    "institution": "institution || CASE k WHEN 1 THEN ', China' WHEN 2 THEN ' (MIT)' ELSE '' END",
    "department": "CASE WHEN (id + k) % 3 = 0 THEN NULL ELSE department || ' ' || CAST(k AS VARCHAR(2)) END",
    "email": "CASE WHEN (id + k) % 5 = 0 THEN '' ELSE CAST(k AS VARCHAR(2)) || email END",
    "h_index": "CASE WHEN (id + k) % 6 = 0 THEN 0 ELSE h_index + k END",
}
_SOURCED_SQL = ", ".join(f"{e} AS {n}" for n, e in _SOURCED.items())
#: Which source is asked first, of the three that stand in.
_ASKED = {"name_zh": (0, 1, 2), "name_en": (0, 1, 2), "institution": (1, 0, 2), "department": (1, 0), "email": (1, 0, 2), "h_index": (2,)}


def _asked(column: str) -> str:
    told = [f"max({column}) FILTER (source = '{_SOURCES[i]}' AND CAST({column} AS VARCHAR) NOT IN ('', '0'))" for i in _ASKED[column]]
    return f"coalesce({', '.join(told)}) AS {column}"


@query(
    with_("person")
    + f""", told AS (SELECT {_SOURCED_SQL} FROM person, (VALUES (0, 'ORCID'), (1, 'CN_UNIVERSITY'), (2, 'GOOGLE_SCHOLAR')) s(k, source) WHERE k <= id % 3),
one AS (SELECT person_id, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, {", ".join(_asked(c) for c in _ASKED)},
  max(source_id) FILTER (source = 'ORCID') AS orcid_id, max(source_id) FILTER (source = 'GOOGLE_SCHOLAR') AS scholar_id FROM told GROUP BY person_id)
SELECT * REPLACE (CASE WHEN n_sources = 1 THEN institution WHEN institution LIKE '% (MIT)' THEN 'Massachusetts Institute of Technology' ELSE regexp_replace(institution, ', China$', '') END AS institution),
  CASE WHEN n_sources = 1 THEN 1.0::DOUBLE ELSE least(100, CASE n_sources WHEN 2 THEN 60 ELSE 70 END + CASE WHEN email IS NULL THEN 0 ELSE 5 END + CASE WHEN h_index IS NULL THEN 0 ELSE 4 END
    + CASE WHEN institution IS NULL THEN 0 ELSE 3 END + CASE WHEN department IS NULL THEN 0 ELSE 2 END + CASE WHEN orcid_id IS NULL THEN 0 ELSE 2 END) / 100::DOUBLE END AS confidence FROM one"""
)
def merge_sources(d: Domain):
    """Stand-in sources: a customer is told of by up to three, which differ and have gaps."""
    names = F.array(*[F.lit(s) for s in _SOURCES])
    rows = d.persons.select("*", F.posexplode(F.slice(names, 1, (F.col("id") % 3 + 1).cast("int"))).alias("k", "source")).selectExpr(*[f"{e} AS {n}" for n, e in _SOURCED.items()])
    return matching.merge_sources(rows).withColumn("sources", F.concat_ws(",", "sources"))


@query()
def cleanup_actions(d: Domain):
    frames = {"person": d.persons, "publication": d.publications, "report": d.reports, "person_field": d.links}
    return cleanup.run_cleanup(frames, d.now())[1]
