"""Queries over stored pages and whole documents, and their SQL: research fields by rules, link discovery, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import achievements, names, publications
from ..operators import keyword_rules
from ..sources import pages, profiles
from .queries_upkeep import _PLAIN, _any, _q
from .standins import Domain

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _fields(rules: tuple[keyword_rules.Rule, ...]) -> str:
    values = ", ".join(f"({i}, {_q(r.pattern)}, {_q('i' if r.ignore_case else 'c')}, {_q(r.field)}, {r.confidence})" for i, r in enumerate(rules))
    return f"""rules(i, pattern, flag, field, confidence) AS (VALUES {values}),
hits AS (
  SELECT doc_id, i, field, confidence FROM subjects JOIN rules ON CASE flag WHEN 'i' THEN regexp_matches(subject, pattern, 'i') ELSE regexp_matches(subject, pattern) END
  WHERE length(subject) >= 3),
best AS (SELECT doc_id, field, max(confidence) AS confidence, min(i) AS i, count(*) AS n FROM hits GROUP BY doc_id, field),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, i) AS place FROM best)
SELECT d.doc_id, coalesce(string_agg(field, ',' ORDER BY place) FILTER (WHERE place <= 3), '') AS fields, coalesce(sum(n), 0)::INT AS rules
FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


def _by_rules(d: Domain, rules: tuple[keyword_rules.Rule, ...]):
    hits = d.table("documents").select("doc_id", keyword_rules.rule_hits(F.col("text"), rules).alias("hits"))
    return hits.select("doc_id", F.concat_ws(",", keyword_rules.best_fields(F.col("hits"), rules)).alias("fields"), F.size("hits").alias("rules"))


@query(f"WITH subjects AS (SELECT doc_id, text AS subject FROM documents), {_fields(keyword_rules.research_rules())}")
def research_fields(d: Domain):
    """Fields of every document by the research rules, whole texts."""
    return _by_rules(d, keyword_rules.research_rules())


#: Rules over words that the documents have: whole words, cases, a class, wild cards.
_OWN = tuple(
    keyword_rules.Rule(*r)
    for r in (
        (r"\b(?:the|and|with|that)\b", True, "english", 0.8), (r"\b(?:der|die|nicht|und)\b", True, "german", 0.8), (r"\b(?:les|une|dans|avec)\b", True, "french", 0.8), (r"\b(?:los|una|como|para)\b", True, "spanish", 0.8),
        (r"The|Der|Les|Los", False, "opening", 0.6), (r"MIT|Apache|GPL|Creative Commons", False, "licence", 0.9), (r"\b(?:copyright|all rights.?reserved)\b", True, "licence", 0.95),
        (r"[äöüß]e|sch.n", False, "german", 0.7), (r"ción|ñ", False, "spanish", 0.85), (r"éa.?u|è[çê]", False, "french", 0.75), (r"@.....\.|\.com", True, "address", 0.5), (r"tion|ment", False, "latin", 0.3),
    )
)


@query(f"WITH subjects AS (SELECT doc_id, text AS subject FROM documents), {_fields(_OWN)}")
def text_fields(d: Domain):
    """Fields of every document by rules over its own words."""
    return _by_rules(d, _OWN)


# The pages have no labels: their own patterns stand in for a university's.
_PATTERNS = {
    "name_zh": (r"^([^\s.,]{2,12})",), "name_en": (r" (?:of|de) ([a-z]{3,20})\.", r" [Oo]f ([a-z]{3,20}) "), "title": (r"\. ([A-Z][a-z]{2,10}) ",), "department": (r" the ([a-z]{4,40}) ", r" de ([a-z]{4,40}) "),
    "bio": (r"\. ([^.]{40,900}\.)",), "publications": (r"[.] ([^.]{20,300}[.])",), "research": (r" and ([^.]{5,900}?)[.]", r" et ([^.]{5,900}?)[.]"),
    "competitions": (r" in ([^.]{3,400})[.]",), "evaluations": (r" to ([^.]{3,400})[.]",),
}


def _told(attribute: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(plain, {_q(p)}, 1)), '')" for p in _PATTERNS[attribute]) + ")"


_PAGE_TEXT = _PLAIN.format(r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')").replace("'&gt;', '>'", "'&nbsp;', ' '")
_NO_NAME = " OR ".join(f"contains(lower(labelled), {_q(w)})" for w in (*achievements.NOT_NAMES_EN, *profiles.NOT_NAMES_EN))
_BY_MAIL = f"""CASE WHEN length(split_part(email, '@', 1)) >= 5 AND len(mailed) >= 2 THEN array_to_string(list_transform(mailed, lambda p: upper(p[1]) || p[2:]), ' ') END"""


def _profile_sql(plain: str) -> str:
    topics = "list_transform(list_filter(list_transform(string_split_regex(research, '[,，;；、\\n]'), lambda x: trim(x)), lambda x: length(x) > 2)[1:15], lambda x: x[1:200])"
    mark = lambda c: f"list_transform(list_filter(list_transform(string_split_regex({c}, '[\\n;；]'), lambda x: trim(regexp_replace(x, '^\\s*[\\[(]?\\d+[\\])]?[.、\\s]*', ''))), lambda x: length(x) > 5)[1:10], lambda x: x[1:300])"
    return f"""WITH p AS (SELECT page_id, url, {plain} AS plain FROM pages WHERE html IS NOT NULL),
t AS (SELECT *, {', '.join(f'{_told(a)} AS {"labelled" if a == "name_en" else a}' for a in _PATTERNS)}, nullif(lower(regexp_extract(plain, {_q(profiles.EMAILS[0])}, 0)), '') AS email FROM p),
m AS (SELECT *, list_filter(string_split_regex(split_part(email, '@', 1), '[._-]'), lambda p: length(p) > 1 AND NOT regexp_full_match(p, '\\d+') AND p NOT IN ({', '.join(map(_q, names.MAILBOXES))})) AS mailed,
  trim(regexp_replace(publications, '^\\s*\\[?\\d+\\]?[.、\\s)]*', '')) AS line FROM t WHERE length(name_zh) >= 2)
SELECT page_id, name_zh, coalesce(CASE WHEN NOT ({_NO_NAME}) THEN labelled END, {_BY_MAIL}) AS name_en, title, department, email, bio[1:1000] AS bio,
  coalesce(array_to_string({topics}, '; '), '') AS research, coalesce(array_to_string({mark('competitions')}, '; '), '') AS competitions, coalesce(array_to_string({mark('evaluations')}, '; '), '') AS evaluations,
  CASE WHEN length(line) > 10 AND length(line) <= 400 AND NOT {_any('line', publications.NOT_REFERENCES)} AND {_any('line', publications.REFERENCES)} THEN 1 END AS publication_count
FROM m"""


def _entities(sql: str) -> str:
    for entity, instead in profiles.text.ENTITIES:
        sql = f"replace({sql}, {_q(entity)}, {_q(instead)})"
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


@query(_profile_sql(_entities(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")))
def profile_parse(d: Domain):
    """Profiles of the pages by patterns of their own; the labels of universities are pinned by tests."""
    rows = profiles.profiles(d.table("pages"), _PATTERNS, not_name=lambda c: F.lit(False))
    joined = lambda c: F.array_join(c, "; ")
    titles = lambda c: joined(F.transform(c, lambda x: x["title"]))
    return rows.select("page_id", "name_zh", "name_en", "title", "department", "email", "bio", joined("research_updates").alias("research"), titles("competition_updates").alias("competitions"), titles("evaluation_updates").alias("evaluations"), "publication_count")


_SHAPES = ((r"^[^?#]*/[A-Za-z]", "any"),)
_ALLOWED = "SELECT regexp_extract(url, '^https?://(?:[^/?#]*\\.)?([^./?#]+\\.example\\.[a-z]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 2"


@query(
    f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"[^>]*>', 1)) AS href, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"[^>]*>([\\s\\S]*?)</a>', 1)) AS inner_text FROM pages),
t AS (SELECT DISTINCT page_id, url, trim(href) AS href FROM a WHERE regexp_matches(href, '^[^?#]*/[A-Za-z]') AND length(trim(regexp_replace(inner_text, '<[^>]+>', '', 'g'))) <= 20 AND NOT regexp_matches(inner_text, 'English|ENGLISH') AND NOT ({' OR '.join(f"regexp_matches(href, {_q(p)})" for p in pages.NO_PROFILE_PATHS)})),
l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM t),
allowed AS ({_ALLOWED})
SELECT DISTINCT page_id, link FROM l JOIN allowed ON domain <> '' AND (host = domain OR ends_with(host, '.' || domain))"""
)
def profile_links(d: Domain):
    """Links of every page, made whole, to hosts under domains that two pages or more lie under."""
    stored = d.table("pages")
    domain = F.regexp_extract("url", r"^https?://(?:[^/?#]*\.)?([^./?#]+\.example\.[a-z]+)", 1)
    allowed = stored.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return pages.discovered(stored, allowed.where("domain <> ''"), _SHAPES)
