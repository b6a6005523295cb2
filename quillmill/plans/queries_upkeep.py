"""Queries on publication lines, name and field rules, pages' departments, repairs and upkeep, and their SQL.

The test tables have no Chinese text, so texts are made of a row's key by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import achievements, names, publications
from ..functions.numbers import half_up
from ..operators import circles, fields, graph, matching, merging, metrics, upkeep
from ..operators.stored import Steps
from ..sources import pages
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


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({column}, {_q(p)}), false)" for p in patterns) + ")"


def _like(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {_q('(?i)' + pattern)}), false)"


def _rotated(key: str, values: list[str | None], otherwise: str = "NULL") -> str:
    """An expression that gives the values in turn by a key."""
    return f"CASE {key} % {len(values) + 1} " + " ".join(f"WHEN {i} THEN {v or 'NULL'}" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


_KEY, _YEAR = "CAST(o_orderkey AS VARCHAR(20))", "CAST(year(o_orderdate) AS VARCHAR(20))"
LINE = _rotated(
    "o_orderkey",
    [
        "'近五年发表论文40余篇'", f"concat('[', {_KEY}, '] Deep nets for images, IEEE Transactions, vol. 12, ', {_YEAR})", "'基于图的方法研究, 计算机学报, 2019, 42(3): 12-25'",
        f"concat('Ann Lee, Bob Ray. On graphs. Journal of Tests ', {_YEAR}, ' doi: 10.1000/abc', {_KEY}, '.')", "'他长期从事教学与科研工作并取得了显著成绩受到好评'",
        "'主持国家自然科学基金项目三项并参与多项课题研究'", "'Bulletin of Maps 2001, pp. 3'", "'著作：'", None, f"concat('合计在国内外核心期刊上先后发表文章', {_KEY}, '与专著若干')",
        "'A study of things by Smith et al'", "'出版专著和译著一共 12 部受到读者好评'", "'出版社的书与论文介绍文章若干与其他'", "'图像识别与自然语言处理方法研究X基于Y应用'", "''",
    ],
    "concat('第3卷 ', o_orderpriority)",
)
CONTEST = _rotated(
    "event_id",
    [
        "'全国大学生数学竞赛一等奖'", "'级别：省级 奖项：金奖'", "'国际级比赛 银奖'", "'校赛 三等奖'", "'特等奖 一等奖'", "'级别：国际 省级竞赛 校级'", "'级别：国家级 校赛'", "'奖项：特等一等'",
        "'省部级 gold'", "'级别：省级 学校比赛 优秀奖'", None, "'名次：second 三等'", "'international first prize'", "'级别：国际 学校'",
    ],
    "event_type",
)


def _journal(column: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({column}, {_q(p)}, 1)), '')" for p in publications.JOURNALS) + ")"


_DOI = r"(?i)(?:doi\s*[:：]?\s*)?(10\.[0-9]{4,}/\S+)"


@query(
    f"""WITH l AS (SELECT o_orderkey AS id, {LINE} AS line FROM orders)
SELECT id, length(coalesce(line, '')) <= 400 AND NOT {_any('line', publications.NOT_REFERENCES)} AND {_any('line', publications.REFERENCES)} AS valid,
 nullif(regexp_replace(regexp_extract(line, {_q(_DOI)}, 1), '[.,;]+\\z', ''), '') AS doi, {_journal('line')} AS journal,
 CAST(nullif(regexp_extract(line, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|\\z)', 1), '') AS INTEGER) AS year FROM l"""
)
def reference_lines(d: Domain):
    rows = d.table("orders").selectExpr("o_orderkey AS id", f"{LINE} AS line").withColumn("r", publications.reference(F.col("line")))
    return rows.select("id", publications.is_reference(F.col("line")).alias("valid"), "r.doi", "r.journal", "r.year")


@query(
    f"""WITH l AS (SELECT o_orderkey AS id, {LINE} AS line FROM orders)
SELECT id, CASE WHEN line IS NULL THEN NULL WHEN length(line) < 15 THEN 'short' WHEN {_any('line', achievements.PAPER_MARKS)} THEN NULL WHEN {_any('line', achievements.COUNT_LINES)} THEN 'count'
 WHEN length(line) < 60 AND length(regexp_replace(line, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) * 1.0 / length(line) > 0.75 AND NOT {_any('line', achievements.PAPER_CLUES)} THEN 'prose' END AS reason FROM l"""
)
def garbage_titles(d: Domain):
    return d.table("orders").selectExpr("o_orderkey AS id", f"{LINE} AS line").select("id", achievements.garbage_publication(F.col("line")).alias("reason"))


def _told(label: str, rules) -> str:
    said = f"nullif(regexp_extract(t, '(?:{label})[：:]\\s*([^\\s,，;；]+)', 1), '')"
    return "CASE " + " ".join(f"WHEN {_like(said, r[1])} THEN {_q(r[0])}" for r in rules if r[1]) + " END"


def _found(rules) -> str:
    return "CASE " + " ".join(f"WHEN {_like('t', r[-1])} THEN {_q(r[0])}" for r in rules) + " END"


@query(
    f"""WITH t AS (SELECT event_id AS id, {CONTEST} AS t FROM events),
n AS (SELECT *, {_like('t', '国际|international')} AS w, {_like('t', '国家[^)]|全国|national')} AS n, {_like('t', '省[^份内外]|province')} AS p, {_like('t', '校[^园]|school|university')} AS s,
 {_like('t', '一等|金奖|gold')} AS a1, {_like('t', '二等|银奖|silver')} AS a2, {_like('t', '三等|铜奖|bronze')} AS a3,
 coalesce({_told('等级|级别|竞赛级别', achievements.LEVELS)}, {_found(achievements.LEVELS)}, {_found(achievements.WEAK_LEVELS)}) AS l0,
 coalesce({_told('获奖|奖项|名次', achievements.LABELLED_AWARDS)}, {_found(achievements.AWARDS)}) AS award0 FROM t),
l1 AS (SELECT *, CASE WHEN l0 = '国际级' AND NOT w THEN CASE WHEN n THEN '国家级' WHEN p THEN '省部级' WHEN s THEN '校级' ELSE l0 END ELSE l0 END AS l1 FROM n),
l2 AS (SELECT *, CASE WHEN l1 = '国家级' AND p AND NOT n THEN '省部级' ELSE l1 END AS l2 FROM l1)
SELECT id, CASE WHEN l2 = '省部级' AND s AND NOT p THEN '校级' ELSE l2 END AS level,
 CASE WHEN award0 = '特等奖' AND (a1 OR a2 OR a3) THEN NULL WHEN award0 = '一等奖/金奖' AND a2 AND NOT a1 THEN '二等奖/银奖' WHEN award0 = '一等奖/金奖' AND a3 AND NOT a1 AND NOT a2 THEN '三等奖/铜奖' WHEN award0 = '二等奖/银奖' AND a3 AND NOT a2 THEN '三等奖/铜奖' ELSE award0 END AS award FROM l2"""
)
def contest_marks(d: Domain):
    t = F.col("t")
    return d.table("events").selectExpr("event_id AS id", f"{CONTEST} AS t").select("id", achievements.competition_level(t).alias("level"), achievements.competition_award(t).alias("award"))


IDENTITY = {
    "id": "c_custkey",
    "name_zh": _rotated("c_custkey", ["'王伟'", "'Science'", "''"], "c_name"),
    "name_en": _rotated("c_custkey", [None, "'A. M.Tech'", "'Journal of Maps'", "'Physics'", "'B. Dept.'"], "lower(c_name)"),
    "institution": _rotated("c_custkey", [None, "'北京大学'", "'tsinghua university'", "'cs.pku.edu.cn'", "''", None, "'Ohio'"], "c_mktsegment"),
    "email": _rotated("c_custkey", ["'a@b.EDU.cn'", None, None, None, None, None, None, "''"], "NULL"),
    "orcid": _rotated("c_custkey", ["'0000-1'", "''", None, None, None, None], "NULL"),
    "metadata": _rotated("c_custkey", ["'{\"seeded\": true}'", "'{\"seeded\": false}'", None, None, None, None, None, None, None, None, None], "NULL"),
}
_IDENTITY = ", ".join(f"{e} AS {c}" for c, e in IDENTITY.items())
_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
_HOME = "(" + " OR ".join(f"contains(lower(coalesce(institution, '')), {_q(n.lower())})" for n in (*names.HOME_INSTITUTIONS, ".edu.cn")) + ")"


@query(
    f"""WITH p AS (SELECT {_IDENTITY} FROM customer), f AS (SELECT *, {_any('name_zh', [_CJK])} AS zh, coalesce(orcid, '') <> '' AS o, {_HOME} AS h, coalesce(nullif(name_en, ''), name_zh, '') AS n FROM p),
r AS (SELECT id, CASE WHEN coalesce(json_extract_string(metadata, '$.seeded'), '') = 'true' THEN 'definitely-chinese|种子数据' WHEN contains(lower(coalesce(email, '')), '.edu.cn') THEN concat('definitely-chinese|邮箱 .edu.cn: ', email)
 WHEN {_any('institution', [_CJK])} THEN concat('definitely-chinese|机构含中文: ', institution) WHEN zh AND o THEN concat('probably-chinese|中文名+ORCID: ', name_zh) WHEN zh AND h THEN concat('definitely-chinese|中文名+中国机构: ', institution)
 WHEN zh THEN concat('probably-chinese|中文名无ORCID: ', name_zh) WHEN h THEN concat('definitely-chinese|中国机构: ', institution) WHEN o THEN concat('probably-chinese|有ORCID: ', orcid)
 {" ".join(f"WHEN {_like('n', p)} THEN concat('junk|{reason}: ', n)" for p, reason in names.JUNK_CLASSES)} ELSE concat('foreign|无中文标识, 机构: ', coalesce(nullif(institution, ''), '(无)')) END AS r FROM f)
SELECT id, split_part(r, '|', 1) AS kind, split_part(r, '|', 2) AS reason FROM r"""
)
def nationalities(d: Domain):
    columns = [F.col(c) for c in ("name_zh", "name_en", "institution", "email", "orcid", "metadata")]
    told = d.table("customer").selectExpr(*[f"{e} AS {c}" for c, e in IDENTITY.items()]).select("id", names.nationality(*columns).alias("n"))
    return told.select("id", "n.kind", "n.reason")


_NAME_EN = _rotated("p_partkey", ["'Data Lab'", "'Wei Computer'", "'Computing Wang'", "'Lincoln'", None], "concat(p_name, ' ', p_type)")


@query(f"WITH p AS (SELECT p_partkey AS id, {_NAME_EN} AS n FROM part) SELECT id, CASE WHEN {' OR '.join(f'contains(lower(n), {_q(w)})' for w in achievements.NOT_NAMES_EN)} THEN NULL ELSE n END AS name_en FROM p")
def cleaned_english_names(d: Domain):
    return d.table("part").selectExpr("p_partkey AS id", f"{_NAME_EN} AS n").select("id", achievements.english_name_or_null(F.col("n")).alias("name_en"))


_TOPIC = (_rotated("p_partkey", ["'人工智能'", "'网络空间安全与密码'", "'Deep Learning'", "'machine-learning'", "'哲学'", None], "p_type"), _rotated("p_partkey", ["'机器人学'", "p_name", "'NLP'"], "''"))


def _slug(column: str) -> str:
    case = lambda table, key: f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END"
    held = "CASE " + " ".join(f"WHEN contains({column}, {_q(k)}) THEN {_q(v)}" for k, v in fields.SLUGS_ZH.items()) + " END"
    key = f"regexp_replace(regexp_replace(lower({column}), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
    return f"coalesce({case(fields.SLUGS_ZH, column)}, {held}, {case(fields.SLUGS_EN, key)}, nullif({key}, ''))"


@query(
    f"""WITH t AS (SELECT p_partkey AS id, {_TOPIC[0]} AS a, {_TOPIC[1]} AS b FROM part), s AS (SELECT id, {_slug('a')} AS a, {_slug('b')} AS b FROM t)
SELECT id, concat_ws(',', a, CASE WHEN a IS NOT DISTINCT FROM b THEN NULL ELSE b END) AS slugs FROM s"""
)
def field_slugs(d: Domain):
    rows = d.table("part").selectExpr("p_partkey AS id", f"{_TOPIC[0]} AS a", f"{_TOPIC[1]} AS b")
    return rows.select("id", F.concat_ws(",", fields.slugs(F.array("a", "b"))).alias("slugs"))


_HTML = _rotated(
    "o_orderkey",
    [
        "'<title>蔡明-武汉大学计算机学院</title>'", "'<title>Home | 数学系</title>'", "'<title>x</title><div class=\"breadcrumb\"><a>首页</a> &gt; <a>物理学院</a> &gt; 张三</div>'",
        "'<p>他在 化学学院 工作, 首页中心</p>'", "'<nav aria-label=\"breadcrumb\">Home / 生物中心 / x</nav>'", None, "'<p>东南 教务教研室 与 文化学院</p>'",
    ],
    "'<p>人工智能系</p>'",
)
_URL = f"concat('https://u.example/', {_rotated('o_orderkey', [_q('cs/szdw'), _q('Physics-dept/x'), _q('x'), _q('a/b/bioinfo/q'), _q('math'), _q('zz/music')], _q('x/y'))}, {_rotated('o_orderkey', [_q('?a=1')], _q(''))})"
_TITLE = "trim(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1))"
_PLAIN = "trim(regexp_replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&gt;', '>'), '\\s+', ' ', 'g'))"
_DEPARTMENT = "([\\x{4e00}-\\x{9fff}]{2,4})(?:学院|系|研究所|研究院|中心|实验室|教研室|学部|教学部|实验中心|研发中心|工程中心)"


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, {_HTML} AS html, {_URL} AS url FROM orders),
q AS (SELECT *, {_TITLE} AS title, string_split_regex({_TITLE}, '[\\s\\-—|]+') AS parts,
 coalesce({', '.join(f"nullif(regexp_extract(html, {_q(t)}, 1), '')" for t in pages.TRAILS)}) AS trail,
 list_transform(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[1:3], lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS words,
 len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth,
 list_filter(list_distinct(regexp_extract_all({_PLAIN.format('html')}, '{_DEPARTMENT}', 0)), lambda x: NOT regexp_full_match(regexp_extract(x, '{_DEPARTMENT}', 1), '{pages.MENU_WORDS}') AND x NOT IN ('人工智能系', '软件工程系', '信息安全系')) AS named FROM p),
r AS (SELECT *, list_transform(string_split_regex({_PLAIN.format('trail')}, '[>＞/\\\\|»→]'), lambda x: trim(x)) AS steps, MAP {{{', '.join(f"{_q(k)}: {_q(v)}" for k, v in pages.PATH_DEPARTMENTS.items())}}} AS m, [{', '.join(_q(k) for k in pages.PATH_DEPARTMENTS)}] AS keys FROM q),
s AS (SELECT id, CASE WHEN contains(title, '武汉大学') AND length(regexp_replace(substr(title, instr(title, '武汉大学') + 4), '^[\\s\\-—|]+', '')) BETWEEN 2 AND 29 THEN regexp_replace(substr(title, instr(title, '武汉大学') + 4), '^[\\s\\-—|]+', '')
  ELSE list_filter(list_reverse(parts[-2:]), lambda x: length(x) BETWEEN 2 AND 29 AND regexp_matches(x, '{pages.DEPARTMENT_LETTERS}'))[1] END AS by_title,
 list_filter(list_filter(steps, lambda x: x <> '')[:-2], lambda x: length(x) BETWEEN 2 AND 29 AND regexp_matches(x, '{pages.DEPARTMENT_WORDS}'))[-1] AS by_trail,
 CASE WHEN depth >= 2 THEN coalesce(list_filter(list_transform(words, lambda w: m[w]), lambda x: x IS NOT NULL)[1],
  m[list_filter(list_transform(words, lambda w: list_filter(keys, lambda k: length(w) >= 3 AND length(k) >= 3 AND (contains(w, k) OR contains(k, w)))[1]), lambda x: x IS NOT NULL)[1]]) END AS by_url,
 CASE WHEN len(named) = 1 THEN named[1] ELSE list_filter(named, lambda x: regexp_matches(x, '(?:学院|系|研究所|研究院|实验室|中心)$'))[1] END AS by_text FROM r)
SELECT id, by_title, by_trail, by_url, by_text, coalesce(by_title, by_trail, by_url, by_text) AS department FROM s"""
)
def page_departments(d: Domain):
    html, url, university = F.col("html"), F.col("url"), F.lit("武汉大学")
    rows = d.table("orders").selectExpr("o_orderkey AS id", f"{_HTML} AS html", f"{_URL} AS url")
    told = rows.select("id", pages.department_from_title(html, university).alias("by_title"), pages.department_from_trail(html).alias("by_trail"), pages.department_from_url(url).alias("by_url"), pages.department_from_text(pages.text.strip_html(html)).alias("by_text"))
    return told.withColumn("department", F.coalesce("by_title", "by_trail", "by_url", "by_text"))


_SECTION = {"page_id": "user_id", "seq": "event_id", "heading": "event_type", "content": _rotated("event_id", ["'ab'", "'view it：研究所 and more 论文 x'", "concat('error ', event_type, ' 12345 and the rest')", None], "event_type")}


@query(
    f"""WITH s AS (SELECT {', '.join(f"{e} AS {c}" for c, e in _SECTION.items())} FROM events),
i AS (SELECT *, regexp_extract(content, '(?i)(?:error|view)\\s*[：:]?\\s*([\\s\\S]{{5,999}}?)(?:{pages.PASSAGE_ENDS}|\\z)', 1) AS inside FROM s),
c AS (SELECT page_id, seq, content, 0 AS tier FROM i WHERE regexp_matches(heading, 'error|view') AND length(content) > 3
 UNION ALL SELECT page_id, seq, inside, 1 FROM i WHERE NOT (regexp_matches(heading, 'error|view') AND length(content) > 3) AND length(content) > 10 AND regexp_matches(content, 'error|view') AND inside <> '')
SELECT page_id, arg_min(content, tier * 1000000000 + seq) AS content FROM c GROUP BY 1"""
)
def page_sections_found(d: Domain):
    return pages.section(d.table("events").selectExpr(*[f"{e} AS {c}" for c, e in _SECTION.items()]), "error|view")


@query(
    with_("person")
    + """, k AS (SELECT lower(n_name) AS key FROM nation UNION ALL SELECT replace(n_name, ' ', '%20') FROM nation UNION ALL SELECT 'no such place'),
i AS (SELECT institution, min(id) AS id FROM person WHERE is_active AND institution IS NOT NULL GROUP BY 1),
b AS (SELECT key, arg_min(institution, tier * 1000000000 + id) AS institution FROM (SELECT key, institution, id, 0 AS tier FROM k JOIN i ON regexp_replace(regexp_replace(lower(institution), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') = key UNION ALL SELECT key, institution, id, 1 FROM k JOIN i ON institution = replace(key, '%20', ' ')) GROUP BY 1)
SELECT key, institution FROM k LEFT JOIN b USING (key)"""
)
def institution_slugs(d: Domain):
    nation = d.table("nation")
    keys = nation.select(F.lower("n_name").alias("key")).unionByName(nation.select(F.replace("n_name", F.lit(" "), F.lit("%20")).alias("key"))).unionByName(d.spark.range(1).select(F.lit("no such place").alias("key")))
    return matching.institutions_of_slugs(keys, d.persons)


@query(with_("field") + "SELECT f.id, f.slug, p.slug AS parent_slug FROM field f LEFT JOIN field p ON f.parent_id = p.id")
def field_trails(d: Domain):
    return circles.with_parent(d.fields)


_CHILDREN = {"papers": "publication", "research": "research", "contests": "competition", "evaluations": "evaluation"}


@query(
    with_("person", "publication", "update")
    + """, f AS (SELECT p.id, p.id IN (SELECT person_id FROM publication) AS a, p.id IN (SELECT person_id FROM updates WHERE kind = 'research') AS b, p.id IN (SELECT person_id FROM updates WHERE kind = 'competition') AS c, p.id IN (SELECT person_id FROM updates WHERE kind = 'evaluation') AS e FROM person p WHERE is_active AND json_extract_string(metadata, '$.source') IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (a) AS papers, count(*) FILTER (b) AS research, count(*) FILTER (c) AS contests, count(*) FILTER (e) AS evaluations, count(*) FILTER (a OR b OR c OR e) AS with_any, count(*) FILTER (a AND b AND c AND e) AS with_all FROM f"""
)
def content_counts(d: Domain):
    kinds = {name: d.updates.where(F.col("kind") == kind) for name, kind in _CHILDREN.items() if kind != "publication"}
    return upkeep.content_counts(d.persons, {"papers": d.publications, **kinds}, "source")


@query(
    """WITH m AS (SELECT o_custkey AS person_id, o_orderpriority AS v FROM orders UNION SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
SELECT person_id, string_agg(v, ',' ORDER BY v) AS names FROM m GROUP BY 1"""
)
def united_names(d: Domain):
    rows = d.table("orders").select(F.col("o_custkey").alias("person_id"), F.array("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))).alias("names"))
    return matching.united(rows, "person_id", "names").select("person_id", F.concat_ws(",", "names").alias("names"))


_GRAMS = "list_transform(generate_series(1, length({0}) + 1), lambda i: substr('  ' || {0} || ' ', i, 3))"


@query(
    with_("person")
    + f""", r AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Prof. ' || name_zh WHEN id % 7 = 1 THEN upper(name_zh) ELSE coalesce(nullif(name_en, ''), name_zh) END AS raw, institution FROM person),
n AS (SELECT id, CASE WHEN id % 7 = 0 THEN substr(raw, 7) ELSE raw END AS name, institution FROM r),
g AS (SELECT a.id, a.name AS na, b.name AS nb, lower(a.institution) AS ia, lower(b.institution) AS ib, {_GRAMS.format('lower(a.name)')} AS ta, {_GRAMS.format('lower(b.name)')} AS tb FROM n a JOIN n b ON b.id = a.id + 1)
SELECT id, floor((0.6 * CASE WHEN na = nb THEN 1.0 WHEN contains(na, nb) OR contains(nb, na) THEN 0.9 ELSE len(list_filter(ta, lambda t: list_contains(tb, t))) * 1.0 / len(list_distinct(list_concat(ta, tb))) END
 + CASE WHEN ia = ib THEN 0.4 WHEN contains(ia, ib) OR contains(ib, ia) THEN 0.25 ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS similarity FROM g"""
)
def duplicate_scores(d: Domain):
    """Every person against the one of the next id."""
    name = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Prof. "), "name_zh")).when(F.col("id") % 7 == 1, F.upper("name_zh")).otherwise(F.coalesce(F.nullif(F.col("name_en"), F.lit("")), "name_zh"))
    # Names are made ready once a person, before they meet.
    rows = d.people.select("id", matching.shown_name({"name_zh": F.col("name_zh"), "name_en": name}).alias("name"), "institution")
    other = rows.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b_{c}") for c in ("name", "institution")])
    record = lambda p: {c: F.col(f"{p}{c}") for c in ("name", "institution")}
    return rows.join(other, "id").select("id", half_up(matching.duplicate_similarity(record(""), record("b_")), 4).alias("similarity"))


@query(
    """WITH who AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS person_id FROM lineitem),
edge AS (SELECT a.person_id AS from_id, b.person_id AS to_id, floor(least(1.0, ln(count(*) + 1.0) / ln(8.0)) * 1000000.0 + 0.5) / 1000000.0 AS weight FROM who a JOIN who b ON a.paper_id = b.paper_id AND a.person_id <> b.person_id GROUP BY 1, 2),
degree AS (SELECT from_id, count(*) AS degree, avg(weight) AS mean FROM edge GROUP BY 1), n AS (SELECT count(*) AS n FROM supplier),
received AS (SELECT to_id, sum((1.0 / n) / degree * weight) AS x FROM edge JOIN degree USING (from_id), n GROUP BY 1),
node AS (SELECT s_suppkey AS id, CAST(trunc(s_acctbal) AS INTEGER) AS c, s_suppkey % 40 AS h, floor(((1 - 0.85) / n + 0.85 * coalesce(x, 0)) * 1e9 + 0.5) / 1e9 AS r, coalesce(degree, 0) AS d, coalesce(mean, 0) AS m FROM supplier LEFT JOIN received ON to_id = s_suppkey LEFT JOIN degree ON from_id = s_suppkey, n),
top AS (SELECT greatest(0.001, max(r)) AS tr, greatest(1, max(d)) AS td, greatest(1, max(c)) AS tc, greatest(1, max(h)) AS th FROM node),
scored AS (SELECT id, floor(r / tr * 10000.0 + 0.5) / 10000.0 AS pagerank, floor((0.35 * r / tr + 0.20 * d / td + 0.20 * c / tc + 0.15 * h / th + 0.10 * least(1.0, m)) * 1000.0 + 0.5) / 1000.0 AS authority, d AS coauthors FROM node, top),
label AS (SELECT s_suppkey AS id, coalesce((SELECT arg_min(to_id, (-CAST(weight AS DOUBLE), to_id)) FROM edge WHERE from_id = s_suppkey), s_suppkey) AS community FROM supplier),
number AS (SELECT community, dense_rank() OVER (ORDER BY community) - 1 AS community_id FROM (SELECT DISTINCT community FROM label))
SELECT id, pagerank, authority, coauthors, community_id FROM scored JOIN label USING (id) JOIN number USING (community) ORDER BY authority DESC, id LIMIT 50"""
)
def power_structure(d: Domain):
    """After one iteration of either walk, as SQL can follow it."""
    nodes = d.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("int").alias("citations"), (F.col("s_suppkey") % 40).cast("int").alias("h_index"))
    n, steps = nodes.count(), Steps(d.spark)
    edges = graph.stored_coauthor_edges(d.publications.select("paper_id", "person_id"), steps)
    ranks = graph.pagerank_step(nodes.select("id", F.lit(1.0 / n).alias("rank")), edges, n).select("id", half_up(F.col("rank"), 9).alias("rank"))
    authorities = steps.write(graph.authority(nodes, edges, ranks), "authorities")
    out = steps.write(graph.power_structure(authorities, graph.communities(nodes, edges, most=1, stored=True)), "result")
    steps.keep_only("result")
    return out


_META = (
    "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{\"openalexId\": \"A\", \"openalexHIndex\": 7, \"openalexCitations\": 90}' WHEN 2 THEN '{\"openalexId\": \"A\", \"openalexHIndex\": \"7\"}' "
    "WHEN 3 THEN '{\"openalexId\": \"A\", \"openalexCitations\": 5, \"rawMetadata\": {\"universityKey\": \"raw\"}, \"universityKey\": \"top\"}' WHEN 4 THEN '{\"openalexHIndex\": 3, \"sourceUrl\": \"u\", \"universityKey\": \"top\"}' ELSE '{\"openalexId\": null, \"sourceUrl\": \"u\"}' END"
)
_SPARSE = {
    "id": "c_custkey", "name_zh": "CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_name END", "institution": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END",
    "title": "CASE WHEN c_custkey % 2 = 0 THEN 'Dr' WHEN c_custkey % 3 = 0 THEN '' ELSE NULL END", "department": "CASE WHEN c_custkey % 5 = 0 THEN 'CS' ELSE NULL END", "email": "CASE WHEN c_custkey % 4 = 0 THEN 'e' ELSE NULL END",
    "bio_zh": "CASE WHEN c_custkey % 7 = 0 THEN concat(c_name, ' ', c_mktsegment, ' has a biography of some length here') WHEN c_custkey % 7 = 1 THEN c_name ELSE NULL END",
    "h_index": "CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 60 AS INTEGER) ELSE NULL END", "citation_count": "CAST(c_custkey % 997 AS INTEGER)", "score": "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_acctbal END",
    "is_active": "c_custkey % 10 <> 0", "metadata": _META,
}
_SPARSE_CTE = f"WITH p AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SPARSE.items())} FROM customer)\n"


def _sparse(d: Domain):
    return d.table("customer").selectExpr(*[f"{e} AS {c}" for c, e in _SPARSE.items()])


@query(
    _SPARSE_CTE
    + """SELECT id, institution, coalesce(json_extract_string(metadata, '$.rawMetadata.universityKey'), json_extract_string(metadata, '$.universityKey')) AS university_key, json_extract_string(metadata, '$.sourceUrl') AS source_url, array_to_string(missing, ',') AS missing
FROM (SELECT *, list_filter([CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN department IS NULL THEN 'department' END, CASE WHEN email IS NULL THEN 'email' END, CASE WHEN bio_zh IS NULL THEN 'bio' END], lambda x: x IS NOT NULL) AS missing FROM p WHERE is_active AND institution IS NOT NULL) WHERE len(missing) >= 3"""
)
def bare_persons(d: Domain):
    return upkeep.bare_persons(_sparse(d)).withColumn("missing", F.concat_ws(",", "missing"))


@query(
    _SPARSE_CTE
    + """SELECT id, coalesce(CASE WHEN f THEN h END, h_index) AS h_index, coalesce(CASE WHEN f THEN c END, citation_count) AS citation_count FROM (
SELECT *, is_active AND h_index IS NULL AND json_extract_string(metadata, '$.openalexId') IS NOT NULL AS f, CASE WHEN json_type(metadata, '$.openalexHIndex') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(metadata, '$.openalexHIndex') AS INTEGER) END AS h,
 CASE WHEN json_type(metadata, '$.openalexCitations') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(metadata, '$.openalexCitations') AS INTEGER) END AS c FROM p)"""
)
def metric_backfill(d: Domain):
    rows = _sparse(d)
    return upkeep.backfilled(rows, upkeep.metric_backfill(rows)).select("id", "h_index", "citation_count")


@query("SELECT 'publications' AS what, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' UNION ALL " + _SPARSE_CTE.replace("WITH p AS", "SELECT * FROM (WITH p AS").rstrip() + " SELECT 'metrics', count(*) FROM p WHERE NOT is_active AND (h_index IS NOT NULL OR citation_count IS NOT NULL))")
def rolled_back(d: Domain):
    kept, persons = upkeep.rolled_back(d.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("source")), _sparse(d), "R")
    left = persons.where("h_index is not null or citation_count is not null")
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("publications").alias("what"), "n").unionByName(left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("metrics").alias("what"), "n"))


@query(_SPARSE_CTE + "SELECT id, json_extract_string(metadata, '$.sourceUrl') AS url, score FROM p WHERE is_active AND json_extract_string(metadata, '$.sourceUrl') IS NOT NULL AND (bio_zh IS NULL OR length(bio_zh) < 50) AND h_index IS NULL")
def fetch_targets(d: Domain):
    return upkeep.fetch_targets(_sparse(d))


@query(_SPARSE_CTE + "SELECT id, score FROM p WHERE is_active AND h_index IS NULL AND name_zh <> '' AND institution <> '' ORDER BY score DESC NULLS FIRST, id LIMIT 50")
def within_budget(d: Domain):
    """What a tenth of a dollar pays for."""
    return upkeep.within_budget(_sparse(d), 0.1).select("id", "score")


@query(
    f"""WITH l AS (SELECT o_orderkey AS id, {LINE} AS title, CASE WHEN o_orderstatus = 'P' THEN 'OTHER' ELSE 'SCRAPER' END AS source FROM orders)
SELECT id, source FROM l WHERE source <> 'SCRAPER' OR (length(coalesce(title, '')) <= 250 AND NOT {_any('title', upkeep.REPAIR_GARBAGE)} AND {_any('title', upkeep.REPAIR_PAPERS)})"""
)
def repaired_publications(d: Domain):
    rows = d.table("orders").selectExpr("o_orderkey AS id", f"{LINE} AS title", "CASE WHEN o_orderstatus = 'P' THEN 'OTHER' ELSE 'SCRAPER' END AS source")
    return upkeep.kept_publications(rows).select("id", "source")


_INFERRED = "CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'law' END"


@query(
    with_("field", "link")
    + """, e AS (SELECT person_id, slug AS field FROM link JOIN field ON field_id = field.id), i AS (SELECT c_custkey AS person_id, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'law' END AS field FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT person_id, CASE WHEN i.field IS NULL THEN 'no_fields_inferred' WHEN i.field IS NOT DISTINCT FROM e.field THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN i.field IS DISTINCT FROM e.field THEN coalesce(i.field, '') ELSE '' END AS added,
 CASE WHEN i.field IS DISTINCT FROM e.field THEN coalesce(e.field, '') ELSE '' END AS removed, coalesce(i.field, e.field, '') AS fields FROM i LEFT JOIN e USING (person_id)"""
)
def repaired_fields(d: Domain):
    existing = d.links.join(d.fields.select(F.col("id").alias("field_id"), F.col("slug").alias("field")), "field_id").select("person_id", "field")
    named = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    inferred = named.select(F.col("c_custkey").alias("person_id"), F.array_compact(F.array(F.expr(_INFERRED))).alias("fields"))
    return fields.repaired(existing, inferred).select("person_id", "status", *[F.concat_ws(",", c).alias(c) for c in ("added", "removed", "fields")])


_RULES: fields.Rules = [("BUILD", "civil-engineering", 0.8), ("MACH|AUTO", "mechanical-engineering", 0.8), ("O", "economics", 0.6), ("E", "education", 0.6)]
_HITS = [f"CASE WHEN regexp_matches(c_mktsegment, '(?i){p}') THEN '{f}' END" for p, f, _ in _RULES]
_FIELDS = f"list_filter([{', '.join(_HITS)}], lambda x: x IS NOT NULL)"


@query(
    f"""WITH b AS (SELECT *, c_custkey IN (SELECT l_suppkey FROM lineitem) AS published FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 13 = 0),
h AS (SELECT c_custkey AS person_id, CASE WHEN published THEN 1 WHEN c_custkey % 2 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 3 END AS phase, CASE WHEN published OR c_custkey % 2 <> 0 THEN ['law'] ELSE {_FIELDS}[:2] END AS f FROM b)
SELECT person_id, phase, unnest(f) AS field, unnest(list_transform(f, lambda x, i: i = 1)) AS is_primary FROM h WHERE phase IS NOT NULL"""
)
def phased_fields(d: Domain):
    """Publications, then departments, then addresses."""
    wrote = d.publications.select(F.col("person_id").alias("id"), F.lit(True).alias("published")).distinct()
    persons = d.table("customer").selectExpr("c_custkey AS id", "c_custkey % 10 <> 0 AS is_active", "c_mktsegment AS department").join(wrote, "id", "left")
    law, department = F.array(F.lit("law")), F.slice(fields.all_fields(F.col("department"), _RULES), 1, 2)
    return fields.in_phases(persons, d.links, [(F.col("published"), law), (F.col("id") % 2 == 0, department), (F.col("id") % 3 == 0, law)])


@query(
    f"""WITH f AS (SELECT c_custkey AS person_id, unnest({_FIELDS}) AS field FROM customer WHERE c_custkey % 10 <> 0)
SELECT person_id, field FROM f WHERE NOT (field = 'economics' AND person_id % 3 = 0)"""
)
def added_fields(d: Domain):
    persons = d.table("customer").selectExpr("c_custkey AS id", "c_custkey % 10 <> 0 AS is_active", "c_mktsegment AS text")
    links = d.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("person_id"), F.lit("economics").alias("field"))
    return fields.addition(persons, links, _RULES)


_MERGES = "SELECT c_custkey AS source_id, c_custkey + 1 AS target_id FROM customer WHERE c_custkey % 7 IN (1, 2) UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 14 = 6"
_ENDS = f"""merges AS ({_MERGES}), known AS (SELECT m.* FROM merges m JOIN person p ON p.id = m.target_id),
walk AS (SELECT source_id, target_id FROM known UNION ALL SELECT w.source_id, k.target_id FROM walk w JOIN known k ON k.source_id = w.target_id),
ends AS (SELECT source_id, target_id FROM walk WHERE target_id NOT IN (SELECT source_id FROM known))"""


@query(
    with_("person")
    + f""", {_ENDS},
members AS (SELECT source_id AS id, target_id FROM ends UNION SELECT target_id, target_id FROM ends),
r AS (SELECT p.*, m.target_id, row_number() OVER (PARTITION BY m.target_id ORDER BY p.id <> m.target_id, p.id) AS place FROM person p JOIN members m USING (id)),
g AS (SELECT target_id, max(id) FILTER (WHERE id <> target_id) AS last, {', '.join(f"arg_min({c}, place) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '') AS {c}" for c in ('email', 'bio_zh', 'h_index', 'orcid_id'))},
  arg_min(id, place) FILTER (WHERE orcid_id IS NOT NULL) AS orcid_from, arg_min(json_extract_string(metadata, '$.source'), place) FILTER (WHERE json_extract_string(metadata, '$.source') IS NOT NULL) AS source,
  arg_min(json_extract_string(metadata, '$.k'), place) FILTER (WHERE json_extract_string(metadata, '$.k') IS NOT NULL) AS k FROM r GROUP BY target_id)
SELECT p.id, p.is_active AND e.target_id IS NULL AS is_active, coalesce(g.email, p.email) AS email, coalesce(g.bio_zh, p.bio_zh) AS bio_zh, coalesce(g.h_index, p.h_index) AS h_index,
  CASE WHEN h.orcid_from = p.id THEN NULL ELSE coalesce(g.orcid_id, p.orcid_id) END AS orcid_id,
  coalesce(g.source, json_extract_string(p.metadata, '$.source')) AS source, coalesce(g.k, json_extract_string(p.metadata, '$.k')) AS k, g.last AS merged_from
FROM person p LEFT JOIN ends e ON e.source_id = p.id LEFT JOIN g ON g.target_id = p.id LEFT JOIN g h ON h.target_id = e.target_id"""
)
def merged_persons(d: Domain):
    """Persons after chains of merges: every seventh and the next one go to the one behind them, some come to it directly."""
    key = F.col("c_custkey")
    stored = d.table("customer")
    merges = stored.where((key % 7).isin(1, 2)).select(key.alias("source_id"), (key + 1).alias("target_id"))
    merges = merges.unionByName(stored.where(key % 14 == 6).select(key.alias("source_id"), (key - 3).alias("target_id")))
    merges = merges.join(stored.select(key.alias("target_id")), "target_id", "left_semi")
    after = merging.merged(d.persons, merging.final_targets(merges), ["email", "bio_zh", "h_index"], ["orcid_id"], metadata="metadata")
    told = lambda k: F.get_json_object("metadata", f"$.{k}")
    return after.select("id", "is_active", "email", "bio_zh", "h_index", "orcid_id", told("source").alias("source"), told("k").alias("k"), told("mergedFrom").cast("long").alias("merged_from"))


@query("""SELECT user_id, CAST(sum(n) AS BIGINT) AS requests, CAST(coalesce(sum(n) FILTER (kind IS NULL), 0) AS BIGINT) AS succeeded, CAST(coalesce(sum(n) FILTER (kind IS NOT NULL), 0) AS BIGINT) AS failed,
  coalesce(string_agg(kind || '=' || n, ',' ORDER BY kind) FILTER (kind IS NOT NULL), '') AS errors
FROM (SELECT user_id, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS kind, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def errors_by_type(d: Domain):
    """Requests of every user with a map of errors by type; stand-in: events other than views and clicks are errors."""
    kind = F.when(~F.col("event_type").isin("view", "click"), F.col("event_type"))
    rows = metrics.errors_by_type(d.table("events").select("user_id", kind.alias("kind")), "user_id", "kind")
    return rows.withColumn("errors", F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))
