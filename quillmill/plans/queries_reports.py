"""Queries on reports, tasks, logs and request checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import matching, reports
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


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {column} END"


def _levels(exp: str) -> str:
    return "CASE " + " ".join(f"WHEN {exp} >= {scores.LEVEL_EXP[n - 1]} THEN {n}" for n in range(len(scores.LEVEL_EXP), 0, -1)) + " ELSE 1 END"


@query(
    with_("person", "report")
    + """SELECT r.id, reporter_id, person_id, name_zh AS person_name, category, status, severity, created_at, (SELECT count(*) FROM report WHERE status = 'PENDING') AS total
FROM report r LEFT JOIN person p ON p.id = r.person_id WHERE status = 'PENDING' ORDER BY created_at DESC, r.id DESC LIMIT 20 OFFSET 20"""
)
def report_list(d: Domain):
    """The second page of what an administrator sees of the pending reports."""
    return reports.report_page(reports.visible(d.reports, None, admin=True, status="PENDING"), d.persons, page=2)


@query(with_("report") + "SELECT id, person_id, category, status, severity, created_at FROM report WHERE reporter_id = 7")
def own_reports(d: Domain):
    return reports.visible(d.reports, 7).select("id", "person_id", "category", "status", "severity", "created_at")


@query(
    with_("report")
    + """SELECT r.id, status, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS evidences
FROM report r LEFT JOIN lineitem ON l_orderkey = r.id GROUP BY r.id, status"""
)
def report_detail(d: Domain):
    evidence = d.table("lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("kind"))
    shown = F.array_join(F.transform("evidences", lambda e: F.concat(e["id"], F.lit(":"), e["kind"])), ",")
    return reports.with_children(d.reports, evidence, "evidences").select("id", "status", shown.alias("evidences"))


@query(
    with_("report", "now")
    + """, moved AS (SELECT reporter_id, sum(-CAST(coalesce(severity, 1) AS BIGINT)) AS delta FROM report WHERE status = 'APPROVED' GROUP BY 1)
SELECT r.reporter_id, count(*) AS total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (created_at >= t) AS today,
  CAST(abs(coalesce(any_value(delta), 0)) AS BIGINT) AS score_impact,
  CASE WHEN count(*) FILTER (status IN ('APPROVED', 'REJECTED')) = 0 THEN 0.0 ELSE floor(count(*) FILTER (status = 'APPROVED') * 1.0 / count(*) FILTER (status IN ('APPROVED', 'REJECTED')) * 100 + 0.5) / 100 END AS accuracy
FROM report r CROSS JOIN now_at LEFT JOIN moved ON moved.reporter_id = r.reporter_id GROUP BY 1"""
)
def user_stats(d: Domain):
    changes = d.reports.where("status = 'APPROVED'").select("reporter_id", (-F.coalesce("severity", F.lit(1)).cast("bigint")).alias("delta"))
    return reports.user_stats(d.reports, changes, d.now())


_STREAK = "CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 0 THEN c_custkey % 40 WHEN c_custkey % 9 <> 0 AND c_custkey % 4 = 1 THEN c_custkey % 40 + 1 ELSE 1 END"
_BONUS = "CASE " + " ".join(f"WHEN streak >= {least} THEN {bonus}" for least, bonus in scores.STREAK_BONUS) + " ELSE 0 END"


@query(
    f"""WITH u AS (SELECT c_custkey AS id, c_custkey * 7 % 3000 AS level_exp, c_custkey % 40 AS current_streak, c_custkey % 40 + c_custkey % 3 AS longest_streak,
  CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 4 END AS gap, c_custkey % 5 <> 0 AS done, c_custkey % 3 AS kind FROM customer),
s AS (SELECT *, CASE WHEN NOT done OR gap = 0 THEN current_streak WHEN gap = 1 THEN current_streak + 1 ELSE 1 END AS streak FROM u),
g AS (SELECT *, CASE WHEN NOT done THEN longest_streak WHEN gap IS NULL THEN 1 WHEN gap = 1 THEN greatest(longest_streak, streak) ELSE longest_streak END AS longest,
  CASE WHEN done THEN CASE kind WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END * {scores.TASK_EXP} + CASE WHEN streak > current_streak THEN {_BONUS} ELSE 0 END ELSE 0 END AS gained FROM s)
SELECT id AS user_id, id AS task_id, gained AS exp_gained, streak, longest AS longest_streak, level_exp + gained AS level_exp, {_levels('level_exp + gained')} AS level FROM g"""
)
def task_completion(d: Domain):
    """Stand-in users: a customer each, active 0 to 3 days ago or never."""
    key, as_of = F.col("c_custkey"), F.expr("TIMESTAMP_NTZ '2024-01-31 10:00:00'")
    users = d.table("customer").select(
        key.alias("id"), (key * 7 % 3000).alias("level_exp"), (key % 40).alias("current_streak"), (key % 40 + key % 3).alias("longest_streak"),
        F.when(key % 9 != 0, F.expr("TIMESTAMP_NTZ '2024-01-31 09:00:00'") - F.make_dt_interval(days=(key % 4).cast("int"))).alias("last_active"),
    )
    kinds = F.when(key % 3 == 0, "REVIEW").when(key % 3 == 1, "VERIFY").otherwise("READ")
    tasks = d.table("customer").select(key.alias("user_id"), key.alias("task_id"), kinds.alias("task_type"), F.when(key % 5 == 0, "SKIPPED").otherwise("COMPLETED").alias("status"))
    return reports.completed_tasks(tasks, users, as_of)


@query(with_("field", "now") + "SELECT c_custkey AS user_id, f.id AS field_id FROM customer, (SELECT id FROM field WHERE level >= 1 ORDER BY level, id LIMIT 3) f WHERE c_custkey NOT IN (SELECT o_custkey FROM orders, now_at WHERE CAST(o_orderdate AS DATE) = CAST(t AS DATE))")
def daily_task_assignment(d: Domain):
    tasks = d.table("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("assigned_at"))
    return reports.daily_tasks(d.table("customer").select(F.col("c_custkey").alias("id")), d.fields, tasks, d.now())


@query(with_("field") + "SELECT s_name AS slug, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey + 100 END AS parent_id, coalesce(level + 1, 0) AS level FROM supplier LEFT JOIN field ON field.id = CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey + 100 END")
def field_levels(d: Domain):
    new = d.table("supplier").select(F.col("s_name").alias("slug"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") + 100).alias("parent_id"))
    return reports.placed_fields(new, d.fields).select("slug", "parent_id", "level")


@query(
    """WITH f AS (SELECT event_id AS id, event_type AS action, ts AS created_at FROM events WHERE event_type IN ('purchase', 'signup')), c AS (SELECT action, count(*) AS of_action FROM f GROUP BY 1)
SELECT id, action, created_at, of_action FROM f JOIN c USING (action) ORDER BY created_at DESC, id DESC LIMIT 50"""
)
def activity_log(d: Domain):
    log = d.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    return reports.activity(log, ["purchase", "signup"])


@query(with_("report") + f"SELECT {_case('category', reports.CATEGORY_LABELS)} AS category, {_case('status', reports.STATUS_LABELS)} AS status, count(*) AS n FROM report GROUP BY 1, 2")
def report_labels(d: Domain):
    kind = [reports.label(F.col("category"), reports.CATEGORY_LABELS).alias("category"), reports.label(F.col("status"), reports.STATUS_LABELS).alias("status")]
    return d.reports.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')) AS safe, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS url FROM pages"
)
def sanitized_pages(d: Domain):
    """A third of the URLs is given another scheme, which is refused."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return d.table("pages").select("page_id", F.sha2(reports.sanitized_html(F.col("html")), 256).alias("safe"), reports.sanitized_url(url).alias("url"))


@query(
    with_("person")
    + r"""SELECT id, coalesce(regexp_matches(email, '^[A-Za-z0-9_+-]+([.''][A-Za-z0-9_+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$'), false) AS email_ok,
  coalesce(regexp_matches(lower(split_part(email, '@', 2)), '\.edu(\.cn)?$'), false) AS edu FROM person"""
)
def email_checks(d: Domain):
    return d.persons.select("id", reports.valid_email(F.col("email")).alias("email_ok"), reports.edu_domain(F.col("email")).alias("edu"))


@query(with_("person") + "SELECT id, floor((0.4 * least(1.0, greatest(0.0, (score - 70) / 60.0)) + 0.35 * least(1.0, id % 7 / 5.0) + 0.25 * least(1.0, id % 13 / 10.0)) * 100.0 + 0.5) / 100.0 AS heat FROM person")
def highlight_scores(d: Domain):
    return d.persons.select("id", reports.highlight_score(F.col("score"), F.col("id") % 7, F.col("id") % 13).alias("heat"))


@query("SELECT lower(p_name) AS name, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ', ' ORDER BY p_partkey) AS ids FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(d: Domain):
    """Ids of the rows that share a name."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda i: i.cast("string")), ", ")
    return d.table("part").groupBy(F.lower("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).where("n > 1")


@query(
    with_("person")
    + "SELECT id, CASE WHEN contains(i, 'united states') THEN 'us' WHEN contains(i, 'united') THEN 'uk' WHEN contains(i, 'an') THEN 'an' END AS key FROM (SELECT id, lower(institution) AS i FROM person)"
)
def institution_keys(d: Domain):
    return d.persons.select("id", matching.key_by_part(F.col("institution"), [("United States", "us"), ("United", "uk"), ("an", "an")]).alias("key"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'TIMEOUT' WHEN status = 404 THEN 'HTTP_404' WHEN status >= 500 THEN 'HTTP_500' WHEN event_id % 5 = 1 THEN 'DNS_FAILURE' ELSE 'NETWORK_ERROR' END AS kind,
  event_id % 5 = 0 OR NOT (status = 404 OR (status < 500 AND event_id % 5 = 1)) AS retryable
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 200 ELSE 0 END AS status FROM events)"""
)
def failure_kinds(d: Domain):
    """Stand-in failures: a status and a message for each event."""
    key = F.col("event_id")
    status = F.when(key % 7 == 0, 404).when(key % 7 == 1, 503).when(key % 7 == 2, 200).otherwise(0)
    told = F.when(key % 5 == 0, "aborted").when(key % 5 == 1, "getaddrinfo ENOTFOUND x").when(key % 5 == 2, "fetch failed").otherwise("odd")
    failure = text.fetch_failure(F.when(status > 0, status), told, key % 5 == 0)
    return d.table("events").select("event_id", failure["kind"].alias("kind"), failure["retryable"].alias("retryable"))
