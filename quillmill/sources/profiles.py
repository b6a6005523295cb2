"""A person's profile out of a stored page: every attribute by an ordered chain of places to look, in one pass over the page.

Chains go from labels in the text to the page's title, breadcrumb, address, image and meta tags, sections and free text; the
first place that tells decides, and later ones are not evaluated. Pages that are no profile have no row. Patterns are a
parameter: default_patterns() are the defaults, a dict of attributes overrides them per university.
"""

from __future__ import annotations

import functools
import importlib.resources
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import achievements, names, publications, text
from ..operators import fields, keyword_rules
from .pages import department_from_text, department_from_title, department_from_trail, department_from_url, json_ld_publications_of, with_sections

Patterns = Mapping[str, tuple[str, ...]]
#: Links beyond which a page is a list; characters of a biography; items of each kind that are kept.
MOST_LINKS, LONGEST_BIO = 500, 1000
MOST_LINES, MOST_TOPICS, MOST_MARKS = 50, 15, 10

# Titles of pages that are no profile.
NOT_PROFILES = (
    "^(?:首页|导航|列表|目录|汇总|搜索|登录|注册)\\z",
    "^(?:学院概况|学院简介|历史沿革|规章制度|通知公告|招生信息|就业信息|下载中心|联系方式|网站地图)\\z",
)
# Offices before a name, of which the first that fits is taken off, and ranks behind it.
OFFICES = ("副主任", "主任", "副院长", "院长", "系主任", "副系主任", "党委书记", "党委副书记", "团委书记", "支部书记", "所长", "副所长", "处长", "副处长", "秘书长")
RANKS = "(?:教授|副教授|讲师|研究员|副研究员|高级工程师|工程师|助理教授|博士后)\\z"
# How menus begin that are read as biographies, and what stands in menus.
MENU_BIOS = ("竞价公示", "学院概况", "学院简介 学院介绍", "导航痕迹", "党政领导", "行政办公", "党建工会", "师资队伍 专任教师", "师资队伍 全体教师", "组织机构 历任领导")
MENU_WORDS = "首页|登录|English|旧版|网站地图|院长信箱|学院概况|学院简介|导航痕迹|竞价公示"
# Research as a biography's substitute, and headings of sections.
RESEARCH_BIOS = (
    r"研究方向[：:]\s*([\s\S]{20,1200}?)(?:教育背景|工作经历|联系方式|招生|所属机构|学院教师|学术论文|科研课题)",
    r"研究领域[：:]\s*([\s\S]{20,1200}?)(?:教育背景|工作经历|联系方式|招生|研究方向|论文)",
)
HEADINGS = {
    "publications": "论文|发表|著作|期刊|代表性论著|学术成果", "research": "研究[方向领域]|科研项目|在研|研究兴趣",
    "competitions": "竞赛|大赛|比赛|科创", "evaluations": "评比|获奖|荣誉|人才称号|奖励",
}
PASSAGE_ENDS = "研究方向|研究领域|科研项目|论文|获奖|竞赛|教育|工作|联系|教学|个人|主讲|社会"
# More words that are no part of a person's English name.
NOT_NAMES_EN = (
    "workshop", "manipulation", "detection", "recognition", "analysis", "system", "method", "approach", "network", "model", "algorithm", "framework", "design",
    "implementation", "application", "development", "processing", "generation", "optimization", "simulation", "evaluation", "prediction", "classification", "segmentation",
    "extraction", "synthesis", "monitoring", "management", "security", "control", "automation", "machine", "deep", "neural", "reinforcement", "supervised", "unsupervised",
    "natural language", "computer vision",
)
# Ways to write an address.
EMAILS = (
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"[a-zA-Z0-9._%+-]+\s*\[at\]\s*[a-zA-Z0-9.-]+\s*\[dot\]\s*[a-zA-Z]{2,}",
    r"[a-zA-Z0-9._%+-]+\s*\(at\)\s*[a-zA-Z0-9.-]+\s*\(dot\)\s*[a-zA-Z]{2,}",
    r"[a-zA-Z0-9._%+-]+#[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
)


@functools.cache
def default_patterns() -> Patterns:
    """The patterns of each attribute, in order; those without a group are left out, for they find nothing."""
    found: dict[str, list[str]] = {}
    for line in importlib.resources.files("quillmill.data").joinpath("profile_patterns.tsv").read_text("utf-8").splitlines():
        if line and not line.startswith("# "):
            attribute, flag, pattern = line.split("\t")
            if re.compile(pattern).groups:
                found.setdefault(attribute, []).append(("(?i)" if flag == "i" else "") + pattern.replace(r"\b", "(?<![A-Za-z0-9_])"))
    return {k: tuple(v) for k, v in found.items()}


def _kept(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with more columns, each worked out once: as rows of a generator they are not written out again wherever they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """A column that uses a value several times, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _first(subject: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that tells something tells; null if none does."""
    return F.coalesce(F.lit(None).cast("string"), *[_some(F.regexp_extract(subject, p, 1)) for p in patterns])


def clean_name(name: Column) -> Column:
    """A Chinese name without one office before it and one rank behind it; null under two characters."""
    # The offices are tried in order; two characters stay at least.
    bare = F.regexp_replace(F.regexp_replace(name, "^(?:" + "|".join(OFFICES) + r")(?=[\s\S]{2})", ""), RANKS, "")
    return _bound(F.struct(name.alias("name"), bare.alias("bare")), lambda n: F.when((F.length(n["name"]) >= 2) & (F.length(n["bare"]) >= 2), n["bare"]))


def email(plain: Column) -> Column:
    """The first address, lower case, by the first way of writing that occurs; null if none."""
    found = [F.nullif(F.regexp_extract(plain, p, 0), F.lit("")) for p in EMAILS]
    at = lambda c, a, dot: F.regexp_replace(F.regexp_replace(c, rf"\s*{a}\s*", "@"), rf"\s*{dot}\s*", ".")
    return F.lower(F.coalesce(found[0], at(found[1], r"\[at\]", r"\[dot\]"), at(found[2], r"\(at\)", r"\(dot\)"), F.replace(found[3], F.lit("#"), F.lit("@"))))


def english_name(told: Column, mail: Column, url: Column, html: Column, name_zh: Column, letters: dict[str, str] | None) -> Column:
    """By label, unless that is no name; then by mail address, page address, image, meta tags and, given a table of characters, by pinyin."""
    person = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"
    labelled = _bound(told, lambda t: F.when((F.size(F.split(t, r"\s+")) <= 4) & ~F.regexp_like(t, F.lit("(?i)" + "|".join(NOT_NAMES_EN))), achievements.english_name_or_null(t)))
    image = F.nullif(F.regexp_extract(html, rf'<img[^>]*alt="((?=[A-Z][a-z]+ [A-Z][a-z]+){person})"[^>]*>', 1), F.lit(""))
    content = [F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]+{key}[^>]+content="([^"]+)"[^>]*>', 1), F.lit("")) for key in ('property="og:title"', 'name="description"')]
    meta = F.nullif(F.regexp_extract(F.coalesce(*content), person, 0), F.lit(""))
    meta = _bound(meta, lambda m: F.when(~F.regexp_like(m, F.lit("(?i)University|College|School|Institute|Department")), F.trim(m)))
    chain = [labelled, names.name_from_email(mail), names.name_from_url(url), F.trim(image), meta]
    if letters:
        chain.append(F.when(F.length(name_zh).between(2, 4), names.pinyin_given_first(name_zh, letters)))
    return F.coalesce(*chain)


def biography(plain: Column, name_zh: Column, patterns: tuple[str, ...]) -> Column:
    """By label, unless that is a menu; then research as a substitute; then the first long passage behind the name that is no menu and over 30 % Chinese."""
    cut = lambda c: F.substring(c, 1, LONGEST_BIO)
    starts = lambda c, words: F.regexp_like(c, F.lit("^(?:" + "|".join(words) + ")"))
    word = f"[{text.CJK}]{{2,6}}"
    menu = lambda c: starts(c, MENU_BIOS) | F.regexp_like(F.substring(c, 1, 60), F.lit(rf"^{word}(?:\s{word}){{9}}"))
    labelled, research = cut(_first(plain, patterns)), cut(_first(plain, RESEARCH_BIOS))
    behind = F.substr(plain, F.position(name_zh, plain) + F.length(name_zh))
    passage = F.trim(F.regexp_extract(behind, rf"([{text.CJK}\w\s，。、；：\"'！？（）—…·]{{80,800}})", 1))
    chinese = lambda p: F.regexp_count(p, F.lit(f"[{text.CJK}]")) > 0.3 * F.length(p)
    prose = lambda p: F.when((F.length(p) >= 50) & chinese(p) & ~F.regexp_like(F.substring(p, 1, 120), F.lit(MENU_WORDS)), cut(p))
    free = F.when(F.position(name_zh, plain) > 0, _bound(passage, prose))
    return F.coalesce(_bound(labelled, lambda b: F.when(~menu(b), b)), _bound(research, lambda b: F.when(~starts(b, ("学院概况", "竞价公示")), b)), free)


def section_of(found: Column, heading: str) -> Column:
    """The content of the first section whose heading matches, else the passage behind the pattern in the first content that holds it; null if none."""
    headed = F.filter(found, lambda s: F.regexp_like(s["heading"], F.lit(heading)) & (F.length(s["content"]) > 3))
    inside = lambda s: F.regexp_extract(s["content"], rf"(?i)(?:{heading})\s*[：:]?\s*([\s\S]{{5,2000}}?)(?:{PASSAGE_ENDS}|\z)", 1)
    held = F.filter(F.transform(F.filter(found, lambda s: (F.length(s["content"]) > 10) & F.regexp_like(s["content"], F.lit(heading))), inside), lambda c: c != "")
    return F.coalesce(F.get(headed, F.lit(0))["content"], F.get(held, F.lit(0)))


def _either(told: Column, section: Column, items: Callable[[Column], Column]) -> Column:
    """Items of the labelled passage, else of the section."""
    none = F.array().cast("array<string>")
    return _bound(F.coalesce(items(told), none), lambda first: F.when(F.size(first) > 0, first).otherwise(F.coalesce(items(section), none)))


def _lines(c: Column, cuts: str, numbers: str, longer: int, most: int) -> Column:
    """Of the first `most` pieces that are longer than `longer` the text behind their numbers, if that is still longer."""
    bare = F.transform(F.split(c, cuts), lambda x: F.trim(F.regexp_replace(x, numbers, "")))
    return F.slice(F.filter(bare, lambda x: F.length(x) > longer), 1, most)


def references(c: Column) -> Column:
    """The lines of a passage that are references, of the first fifty."""
    lines = F.slice(F.split(c, r"[\n；]|;(?=\s*(?:\d+[.、\])]|\[?\d+\]?))"), 1, MOST_LINES)
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*\[?\d+\]?[.、\s)]*", "")))
    return F.filter(bare, lambda x: (F.length(x) > 10) & publications.is_reference(x))


def topics(c: Column) -> Column:
    items = F.filter(F.transform(F.split(c, r"[,，;；、\n]"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    return F.transform(F.slice(items, 1, MOST_TOPICS), lambda x: F.substring(x, 1, 200))


def marks(c: Column) -> Column:
    items = _lines(c, r"[\n;；]", r"^\s*[\[(]?\d+[\])]?[.、\s]*", 5, MOST_MARKS)
    return F.transform(items, lambda x: F.substring(x, 1, 300))


def profiles(
    pages: DataFrame, patterns: Patterns | None = None, university: Column | None = None, not_name: Callable[[Column], Column] | None = None,
    letters: dict[str, str] | None = None, rules: tuple[keyword_rules.Rule, ...] | None = None,
) -> DataFrame:
    """One row per page that is a profile: its attributes, and its publications and updates as arrays.

    page_id, name_zh, name_en, title, institution, department, email, bio, publications (title, authors, journal, doi, year,
    url, abstract), research_updates, competition_updates (title, level, award), evaluation_updates (title, eval_type,
    result), publication_count, fields, source_url. Rows of `pages` (page_id, url, html) with a null page, with a menu's
    title, with over 500 links, without a name or with a name that `not_name` holds of give no row. `university`: a column
    of the page's university. Further columns of `pages` are left out.
    """
    patterns = {**default_patterns(), **(patterns or {})}
    university = F.lit(None).cast("string") if university is None else university
    not_name = not_name or (lambda c: names.name_problem(c).isNotNull())
    html, plain, url = F.col("html"), F.col("plain"), F.col("url")
    said = F.col("page_title")

    rows = pages.select("page_id", "url", "html", university.alias("institution")).where("html is not null")
    rows = rows.where(F.regexp_count(html, F.lit('(?i)<a\\s[^>]*href="[^"]*"[^>]*>')) <= MOST_LINKS)
    rows = _kept(rows, {"plain": text.strip_html(html), "page_title": F.trim(F.regexp_extract(html, "(?i)<title>([^<]+)</title>", 1))})
    person = F.length(said).between(2, 30) & F.regexp_like(said, F.lit(f"[{text.CJK}]{{2,6}}"))
    rows = rows.where((said == "") | person | ~publications.matches_any(said, NOT_PROFILES))
    rows = _kept(rows, {"name_zh": clean_name(_first(plain, patterns["name_zh"]))}).where(F.col("name_zh").isNotNull() & ~F.coalesce(not_name(F.col("name_zh")), F.lit(False)))

    told = _kept(
        rows,
        {
            "email": email(plain), "title": _first(plain, patterns["title"]),
            "department": F.coalesce(
                _first(plain, patterns["department"]), department_from_title(html, F.coalesce("institution", F.lit(""))), department_from_trail(html), department_from_url(url), department_from_text(plain)
            ),
            "labelled": _first(plain, patterns["name_en"]), "bio": biography(plain, F.col("name_zh"), patterns["bio"]),
        },
    )
    told = with_sections(_kept(told, {"name_en": english_name(F.col("labelled"), F.col("email"), url, html, F.col("name_zh"), letters)}))
    told = _kept(told, {f"{k}_at": F.struct(_first(plain, patterns[k]).alias("label"), section_of(F.col("found"), v).alias("section")) for k, v in HEADINGS.items()})
    at = {k: (F.col(f"{k}_at.label"), F.col(f"{k}_at.section")) for k in HEADINGS}

    kind = "array<struct<title:string,authors:array<string>,journal:string,doi:string,year:int,url:string,abstract:string>>"
    none, null = F.array().cast(kind), F.lit(None).cast("string")
    cited = lambda c: F.transform(F.transform(references(c), publications.reference), lambda r: F.struct(*[r[k].alias(k) for k in ("title", "authors", "journal", "doi", "year")], null.alias("url"), null.alias("abstract")))
    short = lambda p: F.struct(F.substring(p["title"], 1, 300).alias("title"), *[p[k].alias(k) for k in ("authors", "journal", "doi", "year", "url", "abstract")])
    told = _kept(told, {
        "described": F.concat(F.coalesce(json_ld_publications_of(html).cast(kind), none), F.coalesce(cited(at["publications"][0]).cast(kind), none)),
        "research_updates": _either(*at["research"], topics), "contests": _either(*at["competitions"], marks), "honours": _either(*at["evaluations"], marks),
    })
    # Competitions in free text count where neither a label nor a section tells of any.
    told = _kept(told, {
        "publications": F.transform(F.when(F.size("described") > 0, F.col("described")).otherwise(F.coalesce(cited(at["publications"][1]).cast(kind), none)), short),
        "every_contest": F.when(F.size("contests") > 0, F.col("contests")).otherwise(F.slice(achievements.competitions(plain), 1, MOST_MARKS)),
    })
    told = _kept(told, {
        "competition_updates": F.transform("every_contest", lambda x: F.struct(x.alias("title"), achievements.competition_level(x).alias("level"), achievements.competition_award(x).alias("award"))),
        "evaluation_updates": F.transform("honours", lambda x: F.struct(x.alias("title"), achievements.evaluation_type(x).alias("eval_type"), achievements.evaluation_result(x).alias("result"))),
    })

    # Python columns of their own: what ranks the rules found is made of expressions again.
    subjects = {"research": F.array_join("research_updates", "; "), "publications": F.array_join(F.transform(F.slice("publications", 1, 5), lambda p: p["title"]), " "), "bio": F.when(F.length("bio") > 10, F.col("bio"))}
    told = told.withColumns({f"hits_{k}": keyword_rules.rule_hits(c, rules) for k, c in subjects.items()})
    by = {k: keyword_rules.best_fields(F.col(f"hits_{k}"), rules) for k in subjects} | {"department": fields.from_department(F.col("department"))}
    told = told.withColumns({f"by_{k}": v for k, v in by.items()})
    told = told.withColumn("fields", fields.combined({k: F.col(f"by_{k}") for k in by}))
    return told.select(
        "page_id", "name_zh", "name_en", "title", "institution", "department", "email", "bio", "publications", "research_updates", "competition_updates", "evaluation_updates",
        F.nullif(F.size("publications"), F.lit(0)).alias("publication_count"), "fields", F.col("url").alias("source_url"),
    )
