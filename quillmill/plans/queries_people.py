"""Queries on persons, reports, circles and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numbers import half_up, months_between_calendar
from ..operators import circles, hotspots, rating, search
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


_DAYS = "date_diff('microsecond', {0}, {1}) / 86400e6"


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


@query(
    with_("person", "report", "now")
    + f""", recent AS (
  SELECT * FROM report, now_at WHERE created_at >= t - INTERVAL 30 DAY AND status IN ('PENDING', 'UNDER_REVIEW', 'APPROVED')
  ORDER BY created_at DESC, id DESC LIMIT 100),
counted AS (SELECT *, count(*) OVER (PARTITION BY person_id) AS reports FROM recent),
heated AS (
  SELECT c.id, person_id, name_zh, institution, score, category, status, severity, reports, created_at,
         {_half_up("least(1.0, reports / 10.0) * 4 + coalesce(nullif(severity, 0), 1) / 5.0 * 3 + greatest(0.0, 1 - greatest(0.0, " + _DAYS.format("created_at", "t") + ") / 30) * 2 + CASE WHEN status = 'APPROVED' THEN 1 ELSE 0 END", 2)} AS heat
  FROM counted c JOIN person p ON p.id = c.person_id WHERE reports >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY heat DESC, id) AS place FROM heated)
SELECT id, person_id, name_zh, institution, score, category, status, coalesce(CAST(severity AS VARCHAR), 'null') AS severity, reports, heat, created_at FROM ranked WHERE place <= 2 ORDER BY heat DESC, id LIMIT 20"""
)
def stain_feed(d: Domain):
    return hotspots.stain_feed(d.reports, d.persons, d.now()).withColumn("severity", F.coalesce(F.col("severity").cast("string"), F.lit("null")))


@query(
    with_("person", "update", "event_now")
    + f""", recent AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY published_at DESC, id) AS newest FROM updates, now_at WHERE published_at >= t - INTERVAL 30 DAY),
heated AS (
  SELECT u.id, kind, person_id, name_zh, u.title, u.level, published_at,
         {_half_up("greatest(0.0, 1 - " + _DAYS.format("published_at", "t") + " / 30) * 5 + greatest(0.0, least(3.0, (score - 90) / 20)) + CASE kind WHEN 'competition' THEN CASE level WHEN '国际级' THEN 3.0 WHEN '国家级' THEN 2.0 WHEN '省部级' THEN 1.0 ELSE 0.0 END WHEN 'evaluation' THEN 1.0 ELSE 0.5 END", 2)} AS heat
  FROM recent u JOIN person p ON p.id = u.person_id WHERE newest <= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY heat DESC, id) AS place FROM heated)
SELECT id, kind, person_id, name_zh, title, level, heat, published_at FROM ranked WHERE place <= 2 ORDER BY heat DESC, id LIMIT 20"""
)
def highlight_feed(d: Domain):
    return hotspots.highlight_feed(d.updates, d.persons, d.event_now())


@query(with_("person") + "SELECT id, name_zh, name_en, institution, score FROM person WHERE is_active AND (contains(lower(name_zh), '#0000001') OR contains(lower(coalesce(name_en, '')), '#0000001')) AND score >= 50 AND score <= 150 ORDER BY score DESC, id LIMIT 20")
def person_search(d: Domain):
    found = search.persons(d.persons, query="#0000001", least=50, most=150)
    return search.page(search.ordered(found.select("id", "name_zh", "name_en", "institution", "score"), "score_desc"))


@query(
    with_("person", "field", "link")
    + """SELECT p.id, p.name_zh, coalesce(CAST(p.h_index AS VARCHAR), 'unknown') AS h_index, coalesce((SELECT string_agg(DISTINCT slug, ',' ORDER BY slug) FROM link JOIN field ON field.id = field_id WHERE person_id = p.id AND is_primary), '') AS primary_fields
FROM person p WHERE is_active ORDER BY p.h_index DESC NULLS FIRST, id LIMIT 20 OFFSET 20"""
)
def person_page(d: Domain):
    found = search.page(search.ordered(search.persons(d.persons).select("id", "name_zh", "h_index"), "h_index_desc"), number=2)
    named = search.with_fields(found, d.links, d.fields)
    return named.select("id", "name_zh", F.coalesce(F.col("h_index").cast("string"), F.lit("unknown")).alias("h_index"), F.concat_ws(",", "primary_fields").alias("primary_fields"))


@query(with_("person") + "SELECT count(*) AS total, 2 AS page, 20 AS \"limit\", 40 < count(*) AS has_more FROM person WHERE is_active AND region = 'ASIA'")
def person_page_info(d: Domain):
    return search.persons(d.persons, region="ASIA").agg(F.count(F.lit(1)).alias("n")).select(*search.page_info(F.col("n"), 2, 20))


@query(with_("person") + "SELECT * FROM (SELECT 'top' AS side, id, score FROM person WHERE is_active ORDER BY score DESC, id LIMIT 9) UNION ALL SELECT * FROM (SELECT 'bottom', id, score FROM person WHERE is_active ORDER BY score, id LIMIT 9)")
def top_and_bottom(d: Domain):
    active = d.persons.where("is_active").select("id", "score")
    top = active.orderBy(F.desc("score"), "id").limit(9).select(F.lit("top").alias("side"), "id", "score")
    return top.unionByName(active.orderBy("score", "id").limit(9).select(F.lit("bottom").alias("side"), "id", "score"))


@query(
    with_("person", "report")
    + """, ranked AS (SELECT person_id, id, created_at, row_number() OVER (PARTITION BY person_id ORDER BY created_at DESC, id DESC) AS place FROM report)
SELECT person_id, id, created_at, place FROM ranked WHERE place <= 3 AND person_id IN (SELECT id FROM person WHERE is_active)"""
)
def person_detail_topk(d: Domain):
    newest = [F.desc("created_at"), F.desc("id")]
    return search.newest_children(d.persons.where("is_active"), d.reports.select("id", "person_id", "created_at"), "person_id", newest, 3).select("person_id", "id", "created_at", "place")


@query(with_("publication") + "SELECT p.id, person_id, s_name, p.citation_count, published_at FROM publication p JOIN supplier ON s_suppkey = person_id WHERE contains(lower(s_name), '#00000001') ORDER BY published_at DESC, p.id LIMIT 50")
def publication_search(d: Domain):
    who = d.table("supplier").where(search.contains_any("#00000001", "s_name")).select(F.col("s_suppkey").alias("person_id"), "s_name")
    return d.publications.join(who, "person_id").select("id", "person_id", "s_name", "citation_count", "published_at").orderBy(F.desc("published_at"), "id").limit(50)


@query(with_("person", "report") + "SELECT 'with' AS kind, count(*) AS n FROM person WHERE id IN (SELECT person_id FROM report) UNION ALL SELECT 'without', count(*) FROM person WHERE id NOT IN (SELECT person_id FROM report)")
def relation_predicates(d: Domain):
    count = lambda some: search.having(d.persons, d.reports, "person_id", some).agg(F.count(F.lit(1)).alias("n"))
    return count(True).select(F.lit("with").alias("kind"), "n").unionByName(count(False).select(F.lit("without").alias("kind"), "n"))


def _circle_sql(column: str, kind: str) -> str:
    top = "first(p.{0} ORDER BY score DESC, id)"
    return with_("person") + f"""SELECT concat('{kind}-', regexp_replace(regexp_replace(lower({column}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')) AS slug, {column} AS name, count(*) AS members,
  {_half_up('avg(score)', 1)} AS avg_score, {top.format('id')} AS top_id, {top.format('name_zh')} AS top_name
FROM person p WHERE is_active AND {column} IS NOT NULL GROUP BY {column}"""


@query(_circle_sql("institution", "institution"))
def institution_circles(d: Domain):
    return circles.circles_by(d.persons, "institution", "institution")


@query(_circle_sql("region", "region"))
def region_circles(d: Domain):
    return circles.circles_by(d.persons, "region", "region")


@query(
    with_("person", "field", "link")
    + f""", tree AS (SELECT f.id, f.id AS root FROM field f UNION SELECT f.id, f.parent_id FROM field f WHERE f.parent_id IS NOT NULL UNION SELECT f.id, p.parent_id FROM field f JOIN field p ON p.id = f.parent_id WHERE p.parent_id IS NOT NULL),
members AS (SELECT DISTINCT root, person_id FROM link JOIN tree ON tree.id = field_id)
SELECT slug AS name, count(*) AS members, {_half_up('avg(score)', 1)} AS avg_score, first(p.id ORDER BY score DESC, p.id) AS top_id, first(p.name_zh ORDER BY score DESC, p.id) AS top_name
FROM members JOIN person p ON p.id = person_id JOIN field f ON f.id = root WHERE f.level = 0 GROUP BY slug"""
)
def field_circles(d: Domain):
    return circles.field_circles(d.fields, d.links, d.persons)


@query(with_("field") + ", under AS (SELECT id AS root, id, 0 AS depth FROM field UNION ALL SELECT u.root, f.id, u.depth + 1 FROM under u JOIN field f ON f.parent_id = u.id) SELECT root, id, depth FROM under")
def field_closure(d: Domain):
    return circles.descendants(d.fields)


@query(
    with_("person")
    + """SELECT r.range, count(id) AS members FROM (VALUES (0, 70, '< 70'), (70, 85, '70-85'), (85, 100, '85-100'), (100, 110, '100-110'), (110, 200, '> 110')) r(low, high, range)
LEFT JOIN person ON is_active AND score >= low AND score < high GROUP BY r.range"""
)
def score_histogram(d: Domain):
    return circles.score_histogram(d.persons)


@query(with_("person") + "SELECT institution, count(*) AS members FROM person WHERE is_active AND institution IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_institutions(d: Domain):
    return circles.top_institutions(d.persons)


@query(with_("field", "link") + "SELECT f.id, f.slug, f.level, p.slug AS parent_slug, (SELECT count(*) FROM link WHERE field_id = f.id) AS persons, (SELECT count(*) FROM field c WHERE c.parent_id = f.id) AS children FROM field f LEFT JOIN field p ON p.id = f.parent_id")
def field_tree(d: Domain):
    persons = d.links.groupBy(F.col("field_id").alias("id")).agg(F.count(F.lit(1)).alias("persons"))
    children = d.fields.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    parents = d.fields.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    joined = d.fields.join(parents, "parent_id", "left").join(persons, "id", "left").join(children, "id", "left")
    return joined.select("id", "slug", "level", "parent_slug", F.coalesce("persons", F.lit(0)).alias("persons"), F.coalesce("children", F.lit(0)).alias("children"))


_WEIGHT = "CASE category " + " ".join(f"WHEN '{k}' THEN {round(100 * v)}" for k, v in scores.CATEGORY_WEIGHTS.items()) + " ELSE 0 END"


def _changes(d: Domain):
    """Stand-in changes: a delta for each report, on one of the weighted categories."""
    return d.reports.select("person_id", _category(), F.col("id").alias("seq"), ((F.col("id") % 23 - 11) * 7).cast("double").alias("delta"))


def _category():
    return F.expr("CASE id % 6 WHEN 0 THEN 'RESEARCH_QUALITY' WHEN 1 THEN 'METHODOLOGY_RIGOR' WHEN 2 THEN 'COLLABORATION_ETHICS' WHEN 3 THEN 'CITATION_INTEGRITY' WHEN 4 THEN 'PEER_RECOGNITION' ELSE 'OTHER' END").alias("category")


_CHANGE = """, change AS (SELECT person_id, CASE id % 6 WHEN 0 THEN 'RESEARCH_QUALITY' WHEN 1 THEN 'METHODOLOGY_RIGOR' WHEN 2 THEN 'COLLABORATION_ETHICS' WHEN 3 THEN 'CITATION_INTEGRITY' WHEN 4 THEN 'PEER_RECOGNITION' ELSE 'OTHER' END AS category,
  id AS seq, CAST((id % 23 - 11) * 7 AS DOUBLE) AS delta FROM report),
clamped AS (SELECT * REPLACE (greatest(-50.0, least(50.0, delta)) AS delta) FROM change WHERE delta <> 0)"""


@query(with_("report") + _CHANGE + " SELECT person_id, category, seq, delta, 100 + sum(delta) OVER w - delta AS old_value, 100 + sum(delta) OVER w AS new_value FROM clamped WINDOW w AS (PARTITION BY person_id, category ORDER BY seq)")
def rating_log(d: Domain):
    return rating.rating_log(_changes(d)).select("person_id", "category", "seq", "delta", "old_value", "new_value")


@query(
    with_("report") + _CHANGE + f""", breakdown AS (SELECT person_id, category, 100 + sum(delta) AS value FROM clamped GROUP BY 1, 2)
SELECT person_id, coalesce({_half_up(f'sum(value * {_WEIGHT}) / nullif(sum({_WEIGHT}), 0)', 2)}, 100.0) AS score FROM breakdown GROUP BY 1"""
)
def aggregate_score(d: Domain):
    last = rating.rating_log(_changes(d)).groupBy("person_id", "category").agg(F.max_by("new_value", "seq").alias("value"))
    return rating.aggregate_scores(last)


@query(with_("report", "now") + "SELECT id, (year(t) * 12 + month(t)) - (year(created_at) * 12 + month(created_at)) AS months, CASE WHEN months <= 6 THEN 1.0 WHEN months <= 12 THEN 0.85 WHEN months <= 24 THEN 0.7 WHEN months <= 36 THEN 0.5 ELSE 0.3 END::DOUBLE AS decay FROM report, now_at")
def time_decay(d: Domain):
    rows = d.reports.select("id", months_between_calendar(F.col("created_at"), d.now()).alias("months"))
    return rows.withColumn("decay", scores.time_decay(F.col("months")))


@query(
    """WITH e AS (SELECT user_id, CAST(floor(sum(value)) AS BIGINT) % 1300 AS exp FROM events GROUP BY 1)
SELECT user_id, exp, CASE WHEN exp >= 1000 THEN 5 WHEN exp >= 600 THEN 4 WHEN exp >= 300 THEN 3 WHEN exp >= 100 THEN 2 ELSE 1 END AS level,
  CASE WHEN exp >= 1000 THEN 100 WHEN exp >= 600 THEN floor((exp - 600) * 100.0 / 400 + 0.5) WHEN exp >= 300 THEN floor((exp - 300) * 100.0 / 300 + 0.5) WHEN exp >= 100 THEN floor((exp - 100) * 100.0 / 200 + 0.5) ELSE floor(exp * 100.0 / 100 + 0.5) END::INTEGER AS progress,
  CASE WHEN exp >= 1000 THEN 0 WHEN exp >= 600 THEN 1000 - exp WHEN exp >= 300 THEN 600 - exp WHEN exp >= 100 THEN 300 - exp ELSE 100 - exp END AS to_next FROM e"""
)
def level_progress(d: Domain):
    exp = d.table("events").groupBy("user_id").agg((F.floor(F.sum("value")) % 1300).alias("exp"))
    level = scores.level_of(F.col("exp"))
    return exp.select("user_id", "exp", level.alias("level"), scores.level_progress(F.col("exp")).alias("progress"), scores.exp_to_next(level, F.col("exp")).alias("to_next"))


@query(with_("report") + f"SELECT reporter_id, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected, coalesce({_half_up('approved / nullif(approved + rejected, 0)', 2)}, 0.0) AS accuracy FROM report GROUP BY 1")
def reporter_accuracy(d: Domain):
    return rating.reporter_accuracy(d.reports)


@query(
    """WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days)
SELECT user_id AS person_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM islands GROUP BY user_id, island"""
)
def streaks(d: Domain):
    return rating.streaks(d.table("events").select(F.col("user_id").alias("person_id"), F.col("ts").alias("at")))


@query(
    """WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days),
runs AS (SELECT user_id, max(day) AS last_day, count(*) AS days FROM islands GROUP BY user_id, island)
SELECT user_id AS person_id, max(days) AS longest, CASE WHEN (SELECT CAST(max(ts) AS DATE) FROM events) - max(last_day) > 1 THEN 0 ELSE arg_max(days, last_day) END AS current,
  CASE WHEN longest >= 30 THEN 200 WHEN longest >= 7 THEN 50 WHEN longest >= 3 THEN 20 ELSE 0 END AS bonus FROM runs GROUP BY 1"""
)
def current_streaks(d: Domain):
    runs = rating.current_streaks(d.table("events").select(F.col("user_id").alias("person_id"), F.col("ts").alias("at")), d.event_now())
    return runs.withColumn("bonus", scores.streak_bonus(F.col("longest")))


@query(
    with_("report")
    + """SELECT *, today < 5 AND lately < 2 AS allowed FROM (SELECT id, reporter_id, person_id,
  (SELECT count(*) FROM report e WHERE e.reporter_id = r.reporter_id AND CAST(e.created_at AS DATE) = CAST(r.created_at AS DATE) AND (e.created_at, e.id) < (r.created_at, r.id)) AS today,
  (SELECT count(*) FROM report e WHERE e.reporter_id = r.reporter_id AND e.person_id = r.person_id AND e.created_at >= r.created_at - INTERVAL 7 DAY AND (e.created_at, e.id) < (r.created_at, r.id)) AS lately FROM report r)"""
)
def report_limits(d: Domain):
    return rating.over_limits(d.reports.select("id", "reporter_id", "person_id", "created_at")).select("id", "reporter_id", "person_id", "today", "lately", "allowed")


@query(with_("report") + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('PENDING', 'UNDER_REVIEW') AND id % 3 < 2 THEN CASE WHEN id % 3 = 0 THEN 'APPROVED' ELSE 'REJECTED' END ELSE status END AS status FROM report) GROUP BY 1")
def review_outcomes(d: Domain):
    decisions = d.reports.where("id % 3 < 2").select(F.col("id").alias("report_id"), F.when(F.col("id") % 3 == 0, "APPROVE").otherwise("NEED_MORE_INFO").alias("decision"))
    return rating.review(d.reports, decisions).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(with_("person") + "SELECT id, CASE WHEN score > 110 THEN 'excellent' WHEN score >= 100 THEN 'good' WHEN score >= 85 THEN 'fair' WHEN score >= 70 THEN 'poor' ELSE 'critical' END AS grade FROM person")
def score_grades(d: Domain):
    return d.persons.select("id", scores.score_grade(F.col("score")).alias("grade"))


@query(
    with_("report", "now")
    + f"""SELECT person_id, count(*) AS reports, {_half_up("0.35 * least(1.0, log2(count(*) + 1.0) / log2(11.0)) + 0.25 * avg(coalesce(severity, 1)) / 5 + 0.20 * greatest(0.0, 1 - (" + _DAYS.format("max(created_at)", "max(t)") + ") / 30) + 0.20 * least(1.0, abs(count(*) * 2.0) / 50)", 4)} AS stain
FROM report, now_at GROUP BY 1"""
)
def stain_scores(d: Domain):
    from ..functions.numbers import days_between

    grouped = d.reports.groupBy("person_id").agg(F.count(F.lit(1)).alias("reports"), F.avg(F.coalesce("severity", F.lit(1))).alias("severity"), F.max("created_at").alias("last"))
    value = scores.stain_score(F.col("reports"), F.col("severity"), days_between(F.col("last"), d.now()), F.col("reports") * 2.0)
    return grouped.select("person_id", "reports", half_up(value, 4).alias("stain"))
