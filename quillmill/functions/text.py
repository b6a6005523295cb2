"""Text expressions: cleaning, classification, extraction.

Patterns keep to what Java and RE2 share unless a docstring says otherwise; word bounds are ASCII, written out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"

# Names that are navigation or labels, and texts that are not biographies.
GARBAGE_NAME_PATTERNS = (
    r"^首页\z", r"^登录\z", r"^注册\z", r"^返回\z", r"^导航\z", r"^菜单\z", r"首页\z",
    r"^<[^>]+>.*</[^>]+>\z",
    r"^(?i:Home|Login|Register|Back|Menu|Search|Contact|About)\z",
    r"^(?i:null|undefined|unknown|test|测试|无|暂无|匿名)\z",
    r"^[0-9]+\z",
    r"^[!@#$%^&*()_+\-=\[\]{};':\"\\|,.<>/?]+\z",
    r"^(姓名|名字|名称|人员|教师|老师|教授|学生)\z",
    r"^[\x00-\x1F\x7F-\x{9F}]+\z",
    r"[A-Za-z0-9+/]{40,}={0,2}",
)
JUNK_BIO_PATTERNS = (
    r"^<[^>]+>.*</[^>]+>",
    r"<div|<span|<p|<a\s|<li|<ul|<table",
    r"&[a-z]+;",
    r"^\{.*\}\z",
    r"^\[.*\]\z",
    r"(?m)^\s*$",
    r"^.{1000,}\z",
    r"^(首页|网站首页|学校首页|学院首页|部门首页)",
    r"^(?i:Copyright|©|All Rights Reserved|版权所有)",
    r"^function\s*\(",
    r"^import\s+|^export\s+|^require\(",
)
HTML_FRAGMENT = r"<div|<span|<p|<a\s|<li|<ul|<table|&[a-z]+;"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&ldquo;", '"'), ("&amp;", "&"))


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Number (from 0) of the first pattern that is found in the text; null if none is."""
    out = F
    for i, pattern in enumerate(patterns):
        out = out.when(F.regexp_like(text, F.lit(pattern)), i)
    return out.otherwise(F.lit(None).cast("int"))


def first_capture(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first group of the first pattern that gives any holds, without spaces around it; null if none does."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def garbage_name(name: Column, least: int = 2, most: int = 80) -> Column:
    """Why a name is no name: `pattern N`, `short`, `long`, or null."""
    said = F.coalesce(name, F.lit(""))
    found = first_match(said, GARBAGE_NAME_PATTERNS)
    return F.when(found.isNotNull(), F.concat(F.lit("pattern "), found.cast("string"))).when(F.length(said) < least, "short").when(F.length(said) > most, "long")


def info_density(text: Column) -> Column:
    """Share of CJK characters, ASCII letters and digits; null for empty text."""
    return F.try_divide(F.regexp_count(text, F.lit(f"[{CJK}a-zA-Z0-9]")).cast("double"), F.length(text))


def junk_bio(bio: Column) -> Column:
    """Number of the pattern that makes a text of ten characters or more no biography; else null."""
    return F.when(F.length(bio) >= 10, first_match(bio, JUNK_BIO_PATTERNS))


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles and tags, entities replaced, white space squeezed."""
    c = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, instead in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(instead))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Latin letters that GBK text read as Latin-1 is full of, and characters that hardly stand but in GBK text read as UTF-8.
GBK_LATIN = "ÃÂÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö"
GBK_CHINESE = "鏄鐨涓鏂鍏鑳鎵鐢闄鑷鍒浠榛"


def garbled_chinese(text: Column) -> Column:
    """Whether a text of 100 characters or more looks like Chinese read in a wrong encoding: accents in bulk with little CJK, lost characters, or telltale CJK."""
    count = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]"))
    counts = {"cjk": count(CJK), "accents": count(r"\x{C0}-\x{FF}"), "latin": count(GBK_LATIN), "lost": count(r"\x{FFFD}"), "telltale": count(GBK_CHINESE), "n": F.length(text)}

    def told(c: Column) -> Column:
        share = c["cjk"] / c["n"].cast("double")
        as_latin = ((c["accents"] > 20) & (c["cjk"] < 5)) | ((c["latin"] > 15) & (c["cjk"] < 10)) | ((share < 0.01) & (c["accents"] > 10))
        as_chinese = (share > 0.05) & (((share < 0.2) & (c["telltale"] > 20)) | (c["telltale"] > 50))
        return as_latin | (c["lost"] > 5) | as_chinese

    # The transform binds the counts, so each is taken once.
    bound = F.transform(F.array(F.struct(*[v.alias(k) for k, v in counts.items()])), told)[0]
    return F.when(F.length(text) < 100, False).otherwise(bound)


def email(text: Column) -> Column:
    """First e-mail address, also when written with [at], (at) or # for @; lower case; null if none."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\s*(\[at\]|\(at\)|#)\s*", "@"), r"\s*(\[dot\]|\(dot\))\s*", ".")
    found = F.regexp_extract(plain, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)
    return F.nullif(F.lower(found), F.lit(""))


def title_key(title: Column, length: int = 120) -> Column:
    """Key under which equal titles meet: lower case, letters and digits only, squeezed, cut."""
    c = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", "")
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, length)


def canonical_name(name: Column) -> Column:
    """A name without titles, degrees and a parenthesis at its end."""
    c = F.trim(name)
    for pattern in (r"(?i)Prof\.?\s*", r"(?i)Dr\.?\s*", r"(?i)Mr\.?\s*", r"(?i)Ms\.?\s*", r"(?i)Mrs\.?\s*", r"(?i)Ph\.?D\.?\s*", r"(?i)M\.?D\.?\s*", r"(?i)Sc\.?D\.?\s*", r"\s+\([^)]*\)"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_variants(name: Column) -> Column:
    """Up to six ways to write a name, distinct, the name itself first."""
    parts = F.split(name, r"\s+")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    initial = F.substring(first, 1, 1)
    more = F.array(
        name, F.concat_ws(" ", first, last), F.concat(last, F.lit(", "), first),
        F.when(F.length(first) > 0, F.concat(initial, F.lit(". "), last)), F.concat(last, F.lit(" "), initial, F.lit(".")),
        F.when(F.size(parts) == 2, F.concat(F.element_at(parts, -1), F.lit(" "), first)),
    )
    return F.when(F.size(parts) >= 2, F.array_distinct(F.array_compact(more))).otherwise(F.array(name))


#: Abbreviations of institutions.
INSTITUTIONS = {
    "mit": "Massachusetts Institute of Technology", "cmu": "Carnegie Mellon University", "ucb": "University of California, Berkeley",
    "ucla": "University of California, Los Angeles", "ucsd": "University of California, San Diego", "eth": "ETH Zurich",
    "epfl": "École Polytechnique Fédérale de Lausanne", "caltech": "California Institute of Technology", "tsinghua": "Tsinghua University",
    "pku": "Peking University", "zju": "Zhejiang University", "fudan": "Fudan University", "sjtu": "Shanghai Jiao Tong University",
    "ustc": "University of Science and Technology of China", "nus": "National University of Singapore", "ntu": "Nanyang Technological University",
    "hku": "University of Hong Kong", "cuhk": "Chinese University of Hong Kong",
}


def normal_institution(name: Column) -> Column:
    """Full name of a known institution, else the name without a country at its end."""
    cleaned = F.trim(name)
    low = F.lower(cleaned)
    out = F.when(~filled(name), F.lit(None).cast("string"))
    for short, full in INSTITUTIONS.items():
        out = out.when(F.regexp_like(low, F.lit(f"(^|[^a-z0-9_]){short}([^a-z0-9_]|\\z)")), full)
    bare = F.trim(F.regexp_replace(cleaned, r"(?i)\s*,\s*(USA|US|United States|UK|China|Germany|France|Japan|Canada)\z", ""))
    return out.otherwise(F.coalesce(F.nullif(bare, F.lit("")), cleaned))


def slug(name: Column) -> Column:
    """ASCII slug; names that leave none are URL-encoded."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+", "-"), r"[^a-z0-9-]", "")
    return F.when((s == "") | (s == "-"), F.url_encode(name)).otherwise(s)


def trigrams(s: Column) -> Column:
    padded = F.array(F.concat(F.lit("  "), s, F.lit(" ")))  # one element, so that it is made once and not for every trigram
    return F.element_at(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))), 1)


def shared_trigrams(a: Column, b: Column) -> Column:
    """Trigrams of a, repeats counted, that b has too, over the distinct ones of both.

    Both lists are bound as an array's one element, so they are made once a row and not once for every trigram.
    """
    both = F.array(F.struct(trigrams(a).alias("a"), F.array_distinct(trigrams(b)).alias("b")))
    of = lambda s: F.size(F.filter(s["a"], lambda t: F.array_contains(s["b"], t))) / F.size(F.array_union(s["a"], s["b"])).cast("double")
    return F.element_at(F.transform(both, of), 1)


def name_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.9 one in the other, 0.85 two parts swapped, else shared trigrams over all trigrams; case is ignored."""
    a, b = F.lower(a), F.lower(b)
    pa, pb = F.split(a, r"\s+"), F.split(b, r"\s+")
    swapped = (F.size(pa) == 2) & (F.size(pb) == 2) & (F.element_at(pa, 1) == F.element_at(pb, -1)) & (F.element_at(pa, -1) == F.element_at(pb, 1))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).when(swapped, 0.85).otherwise(shared_trigrams(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def any_contains(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text, as it is written."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# Beginnings of page menus that were taken for a biography.
MENU_BIOS = (
    r"^学院概况\s*学院简介", r"^学院概况\s*历史沿革", r"首页\s*学院概况", r"首页\s*旧版", r"^作\s*学术活动\s*学生工作", r"^学术活动\s*学生工作", r"^\s*学术活动\s*学生工作", r"招生信息\s*本科生招生",
)
# Short keys of universities by their full names.
UNIVERSITY_KEYS = {
    "武汉大学": "whu", "中山大学": "sysu", "吉林大学": "jlu", "湖南大学": "hnu", "哈尔滨工业大学": "hit", "上海交通大学": "sjtu", "复旦大学": "fudan",
    "清华大学": "tsinghua", "北京大学": "pku", "浙江大学": "zju", "南京大学": "nju", "中国科学技术大学": "ustc", "西安交通大学": "xjtu", "华中科技大学": "hust",
    "同济大学": "tongji", "北京航空航天大学": "beihang", "四川大学": "sichuan", "东南大学": "seu", "中国人民大学": "ruc", "南开大学": "nankai", "天津大学": "tianjin",
    "北京理工大学": "bit", "大连理工大学": "dlut", "山东大学": "sdu", "厦门大学": "xmu", "兰州大学": "lzu", "西北工业大学": "nwpu", "华南理工大学": "scut",
    "中南大学": "csu", "东北大学": "neu", "重庆大学": "cqu", "华东师范大学": "ecnu", "北京师范大学": "bnu", "电子科技大学": "uestc", "中国科学院": "cas",
}


def bio_or_null(bio: Column) -> Column:
    """null where a biography is a page's menu."""
    return F.when(first_match(bio, MENU_BIOS).isNull(), bio)


def university_key(institution: Column) -> Column:
    """Short key of a university; null for others."""
    table = F.create_map(*[F.lit(x) for pair in UNIVERSITY_KEYS.items() for x in pair])
    return F.try_element_at(table, institution)


def topics(text: Column, most: int = 15, length: int = 200) -> Column:
    """Parts of a list of research topics that have more than two characters, in order."""
    parts = F.transform(F.split(text, r"[,，;；、\n]"), lambda t: F.regexp_replace(t, r"^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+\z", ""))
    return F.transform(F.slice(F.filter(parts, lambda t: F.length(t) > 2), 1, most), lambda t: F.substring(t, 1, length))


def suspicious_title(title: Column) -> Column:
    """Whether a publication's title rather says how much was published."""
    said = F.coalesce(title, F.lit(""))
    has = lambda w: F.contains(said, F.lit(w))
    told = has("发表论文") | (has("发表") & has("篇")) | (said.startswith("在") & (has("发表") | has("论文")))
    return told | has("余篇") | has("多篇") | F.regexp_like(said, F.lit(r"^\D{0,10}\d+篇"))


def fetch_failure(status: Column, message: Column, aborted: Column) -> Column:
    """kind and retryable of a failed request: its status (null: none), its message, whether it was aborted.

    A missing page and a host without an address are not tried again. An abort goes before the status; everything that
    isn't told otherwise is a network error.
    """
    dns = F.regexp_like(F.coalesce(message, F.lit("")), F.lit("ENOTFOUND|getaddrinfo|DNS"))
    kind = F.when(F.coalesce(aborted, F.lit(False)), "TIMEOUT").when(F.coalesce(status == 404, F.lit(False)), "HTTP_404").when(F.coalesce(status >= 500, F.lit(False)), "HTTP_500")
    kind = kind.when(dns, "DNS_FAILURE").otherwise("NETWORK_ERROR")
    return F.struct(kind.alias("kind"), (~kind.isin("HTTP_404", "DNS_FAILURE")).alias("retryable"))


def publication_year(line: Column) -> Column:
    """First year of the 20th or 21st century that stands alone; null if none."""
    return F.nullif(F.regexp_extract(line, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|\z)", 1), F.lit("")).cast("int")


def doi(line: Column) -> Column:
    return F.nullif(F.rtrim(F.regexp_extract(line, r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), F.lit(".;,")), F.lit(""))
