"""Pages: links, profiles and JSON-LD out of stored HTML; charset decoding of raw bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def links(pages: DataFrame) -> DataFrame:
    """page_id, host, href, internal: distinct links of every page."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    rows = pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.explode(hrefs).alias("href"))
    return rows.withColumn("internal", F.col("href").startswith("/"))


def profile_links(rows: DataFrame) -> DataFrame:
    """(href, text) rows that may lead to a person: no navigation words, at most 30 characters, 2 to 5 CJK characters or a known URL shape."""
    nav = F.regexp_like("text", F.lit("首页|登录|注册|返回|更多|下一页|上一页|导航|English"))
    short = F.length("text") <= 30
    cjk = F.regexp_like("text", F.lit(f"[{text.CJK}]"))
    name = F.regexp_like("text", F.lit(f"^[{text.CJK}]{{2,5}}\\z"))
    return rows.where(~nav & short & cjk & (name | F.regexp_like("href", F.lit("(?i)(teacher|faculty|profile|people|szdw|jsxx)"))))


def absolute(base: str, href: str):
    """Column: href as an absolute URL on the page at column base."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(F.col(href).rlike("^https?://"), F.col(href)).when(F.col(href).startswith("/"), F.concat(root, F.col(href))).otherwise(F.concat(F.regexp_extract(base, r"^(https?://[^?#]*/)", 1), F.col(href)))


# What a page without headings shows sections by: elements named like titles, labels in the text, labels in a table's cells.
TITLED = r"""(?i)<(?:div|p|span|strong|b|font)\s[^>]*(?:class|id)\s*=\s*["'][^"']*?(?:title|section|heading|subtitle|caption|name)[^"']*?["'][^>]*>\s*([^<]{1,100})</(?:div|p|span|strong|b|font)>"""
LABELS = "研究方向|研究领域|科研项目|在研项目|教学成果|获奖情况|论文[著作发表]|竞赛[获奖]?|荣誉称号|人才称号|学术荣誉|教育背景|工作经历|个人简介|教师简介"
CELL_LABELS = "研究方向|研究领域|科研项目|获奖情况|荣誉称号|教育背景|个人简介|论文[著作发表]|竞赛获奖|人才称号|教学成果|联系方式|电子邮箱|职称|职务|所属单位|所在院系|所在学院|学术兼职|社会兼职|导师类别|招生专业"


def sections(pages: DataFrame) -> DataFrame:
    """page_id, seq, layout, heading, content of the sections of every page, by the first layout that gives any.

    `heading`: headings of level 2 to 4; `title`: elements whose class or id names a title; `label`: known labels before a
    colon; `cell`: known labels in a table's cell, with the next cell. Contents go to the next section or the end; those of
    at most 5, 3 and 2 characters don't count in the last three. Nulls have no section.
    """
    rows = with_sections(pages.select("page_id", "html"))
    # For a plain posexplode Spark adds a filter on the array, which works every layout out again, once for each place where the steps name it.
    each = rows.select("page_id", F.posexplode_outer("found").alias("seq", "s")).where("seq is not null")
    return each.select("page_id", "seq", "s.layout", "s.heading", "s.content")


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` segments; those beyond the root are dropped."""
    parts = F.split(path, "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == ".", held).when(p == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(p))))
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(walked, "/"), F.when(open_end, "/").otherwise(""))


def resolved(base: Column, href: Column) -> Column:
    """href as an absolute address on the page at `base`: whole, without scheme, from the root, query, fragment or relative, dot segments taken out.

    Null or empty bases leave relative ones null; white space around href doesn't count.
    """
    href = F.trim(href)
    scheme, root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole, path = F.regexp_extract(base, "^([^#]*)", 1), F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*([\s\S]*)\z", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    relative = (
        F.when(href == "", whole).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("#"), F.concat(whole, href))
        .when(href.startswith("?"), F.concat(root, path, href)).when(href.startswith("/"), F.concat(root, without_dots(own), rest)).otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )
    return F.when(F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(root != "", relative)


# Addresses of profile pages, each with what their text must hold: a name somewhere (cjk), nothing (any), a name alone (name), a word for more (more).
ANCHORS = (
    (r"/teacher/|/people/|/faculty/|/person/|/facultyDetail/", "cjk"),
    (r"/info/\d+/\d+\.html?", "cjk"),
    (r"/\d+/|(?:/|_)[a-z]+\d*\.html?|(?:/|_)\d+\.html?", "cjk"),
    (r"/\d{4}/\d{4}/.*\d+\.html?", "cjk"),
    (r"\.jsp", "cjk"),
    (r"/szdw/(?:js|info|zrjs|jsml|szll)/", "any"),
    (r"/[jt]id[=/]\d+|/teacher/\d+|/faculty/\d+", "any"),
    (r"/jsmc/|/jsml/|/szll/|/jzgml/|/zrjs/", "any"),
    (r"/redir\.php|_upload/tpl/", "cjk"),
    (r"\.(?:htm|html|php|jsp)", "name"),
    (r"\.aspx\?id=|\.aspx\?tid=|teacher_detail\.aspx|faculty_detail\.aspx", "any"),
    (r"/teacher/[a-z-]+|/faculty/[a-z-]+|/profile/[a-z-]+|/people/[a-z-]+", "any"),
    (r"/\?p=\d+|/archives/\d+|/\d{4}/\d{2}/.+", "cjk"),
    (r"%[A-F0-9]{2}%[A-F0-9]{2}", "any"),
    (r"/detail/|/view/|/show/|/content/|/read/", "more"),
)
# Words of menus that the classes of characters below don't tell, those classes, and what addresses of lists and menus hold.
MENU_TEXTS = "首页|上一页|下一页|尾页|末页|返回|更多|查看详情|登录|注册|English|ENGLISH|旧版|校友会|校友录|教育部|邮箱|下载区|历史沿革|杰出人才|人才梯队|各类人才|层次人才|资料汇编|最新动态"
MENU_CHARACTERS = "[教育新闻公告通知下载链接导航招聘组织制度党建工会校友交流合作邮箱采购招标规章活动动态专题登录注册院校系部处中心会网页版录栏表科研究项导师范生招培计]"
NO_PROFILE_PATHS = (
    r"/webmaster|/admin|/login|/logout|/user/|/contact|/about|/node/\d+\z|javascript:|mailto:|/(?:en|english)/",
    r"(?i)/list\.html?\z|/list_\d+\.html?\z|/list\.jsp|/index\.html?\z|/index\.jsp",
    r"/(?:xygk|xwzx|jyjx|kxyj|xsgz|djgz|dwjl|xyzx|tzgg|zsjy|xzzx|lxwm|wzdt|rczp|gjhd|gjjl|xyh|djwh|ghhd|txyl|rcpy|yjspy|bksjy|xsjy)/",
    r"(?i)[?&](?:page|p)=\d+|[?&](?:category|cat|search|keyword|tag)=",
    r"/topic/|/category/|/tag/|/archive/",
)
DOMAINS = ("edu.cn", "cas.cn", "ac.cn")


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, base, href, text of every link of every page; the base is the page's <base href> on its address, else its address."""
    href, inner = (F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>'), F.lit(i)) for i in (1, 2))
    told = F.nullif(F.regexp_extract("html", r'(?i)<base\s[^>]*href="([^"]*)"', 1), F.lit(""))
    # As a row of a generator the base is worked out once a page, not once for each use of every link.
    once = F.inline(F.array(F.struct(F.coalesce(resolved(F.col("url"), told), F.col("url")).alias("base"), F.arrays_zip(href.alias("href"), inner.alias("inner")).alias("links"))))
    rows = pages.select("page_id", once).select("page_id", "base", F.explode("links").alias("a"))
    return rows.select("page_id", "base", F.trim("a.href").alias("href"), F.trim(F.regexp_replace("a.inner", "<[^>]+>", "")).alias("text"))


def discovered(pages: DataFrame, allowed: DataFrame | None = None, shapes: tuple[tuple[str, str], ...] = ANCHORS, skipped: tuple[str, ...] = NO_PROFILE_PATHS) -> DataFrame:
    """page_id, link: distinct absolute links of pages (page_id, url, html) that may lead to a person.

    A link's address has one of the shapes and its text what that shape wants; its text is no menu's and at most 20
    characters long, its address none of those skipped; its host is one of `allowed` (domain) or lies under one, by
    default those of universities and academies. A link's text is what stands in its own element.
    """
    href, said = F.col("href"), F.col("text")
    cjk = lambda lo, hi: f"[{text.CJK}]{{{lo},{hi}}}"
    wanted = {
        "any": F.lit(True), "cjk": F.regexp_like(said, F.lit(cjk(2, 6))), "name": F.regexp_like(said, F.lit(f"^{cjk(2, 4)}\\z")),
        "more": F.regexp_like(said, F.lit("(?i)^(?:查看详情|详细信息|了解|more|detail|read more|查看)")),
    }
    shaped = F.lit(False)
    for shape, want in shapes:
        shaped = shaped | (F.regexp_like(href, F.lit(shape)) & wanted[want])
    menu = F.regexp_like(said, F.lit(MENU_TEXTS)) | (F.length(said) > 20) | ((F.length(said) >= 4) & F.regexp_like(said, F.lit(MENU_CHARACTERS)))
    no_page = (href == "") | (href == "/") | href.startswith("#") | (href == F.col("base"))
    for p in skipped:
        no_page = no_page | F.regexp_like(href, F.lit(p))
    rows = anchors(pages).where(shaped & ~menu & ~no_page).select("page_id", resolved(F.col("base"), href).alias("link")).distinct()
    if allowed is None:
        allowed = pages.sparkSession.createDataFrame([(d,) for d in DOMAINS], "domain string")
    host = F.lower(F.regexp_extract("link", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    # A host meets the list by itself and by each domain above it.
    under = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.select("page_id", "link", F.explode(under).alias("domain")).join(allowed.select(F.lower("domain").alias("domain")), "domain", "left_semi")
    return met.select("page_id", "link").distinct()


def with_sections(pages: DataFrame) -> DataFrame:
    """The rows with their sections in the array `found` (layout, heading, content)."""
    html, bare = F.col("html"), lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")

    none = F.array().cast("array<struct<layout:string,heading:string,content:string>>")

    def pieces(source: Column, head: str, group: int, layout: str, content) -> Column:
        """Each head with what follows it up to the next."""
        named = F.regexp_extract_all(source, F.lit(head), F.lit(group))
        after = F.slice(F.split(source, head, -1), 2, 1 << 30)
        each = F.zip_with(named, after, lambda h, c: F.struct(F.lit(layout).alias("layout"), h.alias("heading"), content(c).alias("content")))
        # A split reads its pattern anew for every row, so only texts with a head are split.
        return F.when(~F.regexp_like(source, F.lit(head)), none).otherwise(each)

    headed = pieces(html, r"(?i)<(h[234])[^>]*>\s*([^<]{1,100})</\1>", 2, "heading", lambda c: text.strip_html(F.regexp_replace(c, r"(?is)<h[234][^>]*>.*\z", "")))
    titled = pieces(html, TITLED, 1, "title", text.strip_html)
    labelled = pieces(F.col("_plain"), rf"((?:{LABELS})\s*)[：:]\s*", 1, "label", bare)
    row = rf"(?is)<t[dh][^>]*>\s*({CELL_LABELS})\s*</t[dh]>\s*<t[dh][^>]*>\s*(.*?)\s*</t[dh]>"
    cells = [F.regexp_extract_all(html, F.lit(row), F.lit(i)) for i in (1, 2)]
    celled = F.zip_with(*cells, lambda h, c: F.struct(F.lit("cell").alias("layout"), h.alias("heading"), text.strip_html(c).alias("content")))

    # A step each: a layout is only tried where those before it gave nothing, and none is tried twice.
    tried = lambda other: F.when(F.size("found") > 0, F.col("found")).otherwise(other)
    bare_heading = lambda s: F.struct(s["layout"].alias("layout"), bare(s["heading"]).alias("heading"), s["content"].alias("content"))
    rows = pages.withColumn("found", F.transform(headed, bare_heading))
    rows = rows.withColumn("found", tried(F.filter(F.transform(titled, bare_heading), lambda s: (F.length(s["heading"]) > 1) & (F.length(s["content"]) > 5))))
    rows = rows.withColumn("_plain", F.when(F.size("found") == 0, text.strip_html(html)))
    rows = rows.withColumn("found", tried(F.filter(labelled, lambda s: F.length(s["content"]) > 3)))
    rows = rows.withColumn("found", tried(F.filter(celled, lambda s: F.length(s["content"]) > 2))).drop("_plain")
    return rows


# Headings that end a passage which has no heading of its own.
PASSAGE_ENDS = "研究方向|研究领域|科研项目|论文|获奖|竞赛|教育|工作|联系|教学|个人|主讲|社会"


def section(sections: DataFrame, heading: str) -> DataFrame:
    """page_id, content: of sections (page_id, seq, heading, content) the first whose heading matches the pattern (without groups).

    Where none does, the passage behind the pattern in the first content that holds it, up to another heading's word.
    Contents of at most three (ten) characters don't count; pages without either have no row.
    """
    inside = F.regexp_extract("content", rf"(?i)(?:{heading})\s*[：:]?\s*([\s\S]{{5,2000}}?)(?:{PASSAGE_ENDS}|\z)", 1)
    headed = F.regexp_like("heading", F.lit(heading)) & (F.length("content") > 3)
    held = (F.length("content") > 10) & F.regexp_like("content", F.lit(heading)) & (inside != "")
    place = F.when(headed, F.struct(F.lit(0).alias("tier"), F.col("seq").alias("seq"), F.col("content").alias("content"))).when(held, F.struct(F.lit(1).alias("tier"), F.col("seq").alias("seq"), inside.alias("content")))
    return sections.select("page_id", place.alias("p")).where("p is not null").groupBy("page_id").agg(F.min("p").alias("p")).select("page_id", F.col("p.content").alias("content"))


# Departments by the first parts of a page's path, in the order in which parts of words are looked for.
PATH_DEPARTMENTS = {
    "cs": "计算机学院", "cse": "计算机科学与工程学院", "cst": "计算机科学与技术学院", "computer": "计算机学院", "computing": "计算机学院",
    "ee": "电子工程学院", "eie": "电子信息工程学院", "electronic": "电子学院", "physics": "物理学院", "phys": "物理学院",
    "math": "数学学院", "mathematics": "数学学院", "chemistry": "化学学院", "chem": "化学学院", "biology": "生命科学学院",
    "bio": "生物学院", "life": "生命科学学院", "medicine": "医学院", "med": "医学院", "law": "法学院", "economics": "经济学院",
    "econ": "经济学院", "management": "管理学院", "business": "商学院", "art": "艺术学院", "music": "音乐学院",
    "foreign": "外国语学院", "english": "外国语学院", "history": "历史学院", "philosophy": "哲学学院", "sociology": "社会学院",
    "psychology": "心理学院", "education": "教育学院", "environment": "环境学院", "materials": "材料学院", "mechanics": "力学学院",
    "civil": "土木工程学院", "architecture": "建筑学院", "aero": "航空航天学院", "nuclear": "核科学学院", "ocean": "海洋学院",
    "marine": "海洋学院", "pharmacy": "药学院", "public": "公共管理学院", "journalism": "新闻学院", "information": "信息学院",
    "informatics": "信息学院", "software": "软件学院", "ai": "人工智能学院", "data": "数据科学学院", "network": "网络空间安全学院",
    "security": "信息安全学院", "automation": "自动化学院", "control": "控制学院", "mechanical": "机械工程学院", "energy": "能源学院",
    "power": "电力学院", "optics": "光电学院", "optical": "光电学院", "telecom": "电信学院", "communication": "通信学院",
    "microelectronics": "微电子学院",
}
# Where pages keep the path that leads to them, and words of departments.
TRAILS = (
    r'(?is)<nav[^>]*aria-label="breadcrumb"[^>]*>(.*?)</nav>',
    r'(?is)<div[^>]*class="[^"]*breadcrumb[^"]*"[^>]*>(.*?)</div>',
    r'(?is)<div[^>]*class="[^"]*crumbs[^"]*"[^>]*>(.*?)</div>',
    r'(?is)<div[^>]*class="[^"]*position[^"]*"[^>]*>(.*?)</div>',
)
DEPARTMENT_WORDS = "学院|系|研究所|中心|实验室|学部|研究院"
DEPARTMENT_LETTERS = "[学院系所中心部院馆研究室]"


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def department_from_title(html: Column, university: Column) -> Column:
    """What the <title> says behind the university's name, else the last or last but one part that reads like a department; null if none."""
    title = F.trim(F.regexp_extract(html, r"(?i)<title>([^<]+)</title>", 1))
    at = F.position(university, title)
    behind = F.trim(F.regexp_replace(F.substr(title, at + F.length(university)), r"^[\s\-—|]+", ""))
    fits = lambda c: F.length(c).between(2, 29)
    parts = F.split(title, r"[\s\-—|]+")
    last_two = F.reverse(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
    named = F.filter(last_two, lambda p: fits(p) & F.regexp_like(p, F.lit(DEPARTMENT_LETTERS)))
    return F.when(F.coalesce((university != "") & (at > 0) & fits(behind), F.lit(False)), behind).otherwise(_first(named))


def department_from_trail(html: Column) -> Column:
    """The department in a page's breadcrumb: of all parts but the last, the last with a department's word; null if none."""
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in TRAILS]
    parts = F.filter(F.transform(F.split(text.strip_html(F.coalesce(*found)), r"[>＞/\\|»→]"), lambda p: F.trim(p)), lambda p: p != "")
    named = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p).between(2, 29) & F.regexp_like(p, F.lit(DEPARTMENT_WORDS)))
    return F.when(F.size(named) > 0, F.element_at(named, -1))


def department_from_url(url: Column) -> Column:
    """The department that one of the first three parts of a path of two or more names: whole words first, then parts of three letters or more."""
    table = F.create_map(*[F.lit(x) for pair in PATH_DEPARTMENTS.items() for x in pair])
    keys = F.array(*[F.lit(k) for k in PATH_DEPARTMENTS])
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1), "/"), lambda p: p != "")
    words = F.transform(F.slice(path, 1, 3), lambda p: F.regexp_replace(F.lower(p), "[^a-z]", ""))
    alike = lambda w, k: (F.length(w) >= 3) & (F.length(k) >= 3) & (F.contains(w, k) | F.contains(k, w))
    whole = _first(F.array_compact(F.transform(words, lambda w: F.try_element_at(table, w))))
    part = _first(F.array_compact(F.transform(words, lambda w: _first(F.filter(keys, lambda k: alike(w, k))))))
    return F.when(F.size(path) >= 2, F.coalesce(whole, F.try_element_at(table, part)))


# Departments that are items of menus, and words before a department's word that are.
MENU_DEPARTMENTS = ("人工智能系", "软件工程系", "信息安全系")
MENU_WORDS = "首页|新闻|通知|公告|下载|招生|就业|联系|组织|人才|校友|党建|工会|研究|教育|教学|培养|合作|交流|信息|数据|网络"


def department_from_text(plain: Column) -> Column:
    """The first department that a page's text names, menu words left out; of several, the first that is an academic one. Null if none."""
    one = r"([\x{4e00}-\x{9fff}]{2,4})(?:学院|系|研究所|研究院|中心|实验室|教研室|学部|教学部|实验中心|研发中心|工程中心)"
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(one), F.lit(0)))
    named = F.filter(found, lambda p: ~F.regexp_like(F.regexp_extract(p, one, 1), F.lit(f"^(?:{MENU_WORDS})\\z")) & ~p.isin(*MENU_DEPARTMENTS))
    academic = F.filter(named, lambda p: F.regexp_like(p, F.lit(r"(?:学院|系|研究所|研究院|实验室|中心)\z")) & ~F.regexp_like(p, F.lit("首页|通知|公告|新闻|下载|招生|就业|联系")))
    return F.when(F.size(named) == 1, _first(named)).otherwise(_first(academic))


def department(html: Column, url: Column, university: Column) -> Column:
    """By title, breadcrumb, address and text, the first that tells."""
    return F.coalesce(department_from_title(html, university), department_from_trail(html), department_from_url(url), department_from_text(text.strip_html(html)))


def scholar_profiles(pages: DataFrame) -> DataFrame:
    """page_id, scholar_id, name_en, institution, citation_count, h_index, i10_index, interests, publications of stored citation-index pages.

    Numbers that are missing or 0 are null, as are all three unless all are there; publications without a title are left out.
    """
    html = F.col("html")
    clean = lambda c: F.nullif(text.strip_html(c), F.lit(""))
    by_id = lambda key, tag: F.regexp_extract(html, rf'(?is)<{tag}[^>]*id="{key}"[^>]*>(.*?)</{tag}>', 1)
    number = lambda c: F.nullif(F.regexp_extract(F.replace(text.strip_html(c), F.lit(","), F.lit("")), "^[0-9]+", 0).try_cast("int"), F.lit(0))
    where = clean(by_id("gsc_prf_inw", "[a-z]+"))
    at = F.trim(F.regexp_extract(where, r"(?:at|in)\s+(.+?)(?:,|\z)", 1))
    lead = F.trim(F.split_part(where, F.lit(","), F.lit(1)))
    stats = F.regexp_extract_all(html, F.lit(r'(?is)<td[^>]*class="gsc_rsb_std"[^>]*>(.*?)</td>'), F.lit(1))
    stat = lambda i: F.when(F.size(stats) >= 3, number(F.get(stats, F.lit(i))))
    rows = F.regexp_extract_all(html, F.lit(r'(?is)<tr[^>]*class="gsc_a_tr"[^>]*>(.*?)</tr>'), F.lit(1))

    def publication(row: Column) -> Column:
        cell = F.regexp_extract(row, r'(?is)<td[^>]*class="gsc_a_t"[^>]*>(.*?)</td>', 1)
        gray = F.regexp_extract_all(cell, F.lit(r'(?is)<div[^>]*class="gs_gray"[^>]*>(.*?)</div>'), F.lit(1))
        venue = clean(F.get(gray, F.lit(1)))
        year = F.nullif(F.regexp_extract(venue, r"(?:^|[^A-Za-z0-9_])((?:19|20)\d{2})(?:[^A-Za-z0-9_]|\z)", 1), F.lit(""))
        named = F.when(year.isNull(), venue).otherwise(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(venue, r"(^|[^A-Za-z0-9_])(?:19|20)\d{2}([^A-Za-z0-9_]|\z)", "$1$2"), r"[,\s]*\z", "")), F.lit("")))
        cited = F.regexp_extract(row, r'(?is)<td[^>]*class="gsc_a_c"[^>]*>(.*?)</td>', 1)
        return F.struct(
            F.coalesce(clean(F.regexp_extract(cell, r"(?is)<a[^>]*>(.*?)</a>", 1)), F.lit("")).alias("title"), clean(F.get(gray, F.lit(0))).alias("authors"), named.alias("journal"),
            year.cast("int").alias("year"), number(F.replace(cited, F.lit("*"), F.lit(""))).alias("citation_count"), F.nullif(F.regexp_extract(cell, r'(?is)<a[^>]*href="([^"]*)"', 1), F.lit("")).alias("url"),
        )

    return pages.select(
        "page_id", F.regexp_extract("url", "user=([^&]+)", 1).alias("scholar_id"), clean(by_id("gsc_prf_in", "[a-z]+")).alias("name_en"),
        F.when(at != "", at).when(~F.contains(lead, F.lit("@")), F.nullif(lead, F.lit(""))).alias("institution"), stat(0).alias("citation_count"), stat(1).alias("h_index"), stat(2).alias("i10_index"),
        F.array_compact(F.transform(F.regexp_extract_all(by_id("gsc_prf_int", "div"), F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), clean)).alias("interests"),
        F.filter(F.transform(rows, publication), lambda p: p["title"] != "").alias("publications"),
    )


#: What a JSON-LD object may hold; unknown keys are ignored.
_LD = "struct<`@type`:string,name:string,headline:string,datePublished:string,url:string,author:array<struct<name:string>>>"


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, kind, title, published, authors of each JSON-LD object, in arrays and in @graph too."""
    scripts = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select("page_id", F.explode(scripts).alias("json"))
    each = F.concat(
        F.coalesce(F.from_json("json", f"array<{_LD}>"), F.array().cast(f"array<{_LD}>")),
        F.coalesce(F.from_json(F.get_json_object("json", "$.@graph"), f"array<{_LD}>"), F.array().cast(f"array<{_LD}>")),
    )
    one = rows.select("page_id", F.explode(each).alias("o")).where("o.`@type` is not null")
    return one.select("page_id", F.col("o.`@type`").alias("kind"), F.coalesce("o.headline", "o.name").alias("title"), F.col("o.datePublished").alias("published"), F.transform("o.author", lambda a: a["name"]).alias("authors"))


def json_ld_publications(pages: DataFrame) -> DataFrame:
    """page_id, title, authors, journal, doi, year, url, abstract of the publications that pages describe in JSON-LD."""
    return pages.select("page_id", F.explode(json_ld_publications_of(F.col("html"))).alias("p")).select("page_id", "p.*")


def json_ld_publications_of(html: Column) -> Column:
    """The publications that a page describes in JSON-LD, an array of structs.

    Objects, arrays of them and those under @graph are read; an author may be a text or have a name, alone or in a list; a
    DOI stands in sameAs or among the identifiers. Titles under five characters don't count. A script that is no JSON
    gives nothing; a value of an unexpected kind counts as missing.
    """
    told = lambda v, path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"

    def only_text(v: Column, path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(is_text(found), F.nullif(F.try_variant_get(found, "$", "string"), F.lit("")))

    def listed(v: Column, path: str) -> Column:
        one = F.try_variant_get(v, path, "variant")
        return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))

    author = lambda a: F.when(is_text(a), F.try_variant_get(a, "$", "string")).otherwise(told(a, "$.name"))
    by_property = lambda i: F.when((told(i, "$['@type']") == "PropertyValue") & (told(i, "$.propertyID") == "DOI"), told(i, "$.value"))
    doi_of = lambda i: F.when(is_text(i), F.nullif(F.regexp_extract(F.try_variant_get(i, "$", "string"), r"(?s)^10\..*\z", 0), F.lit(""))).otherwise(by_property(i))

    def publication(o: Column) -> Column:
        return F.struct(
            F.substring(F.coalesce(told(o, "$.name"), told(o, "$.headline")), 1, 300).alias("title"), F.array_compact(F.transform(listed(o, "$.author"), author)).alias("authors"),
            F.coalesce(told(o, "$.publisher.name"), told(o, "$.isPartOf.name"), told(o, "$.journal.name"), only_text(o, "$.publisher")).alias("journal"),
            F.coalesce(F.nullif(F.regexp_extract(only_text(o, "$.sameAs"), r"10\.[0-9]{4,}/\S+", 0), F.lit("")), _first(F.array_compact(F.transform(listed(o, "$.identifier"), doi_of)))).alias("doi"),
            F.nullif(F.regexp_extract(F.coalesce(told(o, "$.datePublished"), told(o, "$.dateCreated")), "[0-9]{4}", 0), F.lit("")).cast("int").alias("year"),
            only_text(o, "$.url").alias("url"), F.substring(only_text(o, "$.description"), 1, 2000).alias("abstract"),
        )

    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\s+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    blocks = F.array_compact(F.transform(scripts, F.try_parse_json))
    each = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$", "array<variant>"), F.try_variant_get(b, "$['@graph']", "array<variant>"), F.array(b))))
    kind = lambda o: F.regexp_like(told(o, "$['@type']"), F.lit("(?i)ScholarlyArticle|Article|CreativeWork|Book|Thesis|PublicationIssue"))
    return F.filter(F.transform(F.filter(each, kind), publication), lambda p: F.length(p["title"]) >= 5)


# Names of charsets, and the one that each is read by.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "gb2312": "GBK", "gb_2312-80": "GBK", "gbk": "GBK", "x-gbk": "GBK", "cp936": "GBK", "gb18030": "GB18030", "big5": "Big5", "big5-hkscs": "Big5-HKSCS",
    "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "us-ascii": "ISO-8859-1", "windows-1252": "windows-1252", "cp1252": "windows-1252", "shift_jis": "Shift_JIS", "euc-jp": "EUC-JP", "euc-kr": "EUC-KR",
}


def decoded(raw: DataFrame, default: str = "gbk") -> DataFrame:
    """key, text of rows (key, content bytes, charset): by the declared charset, else that of a <meta>, else UTF-8, else the default.

    A charset that is unknown or doesn't fit the bytes gives way to the next. Where the text looks garbled, GBK, UTF-8 and
    GB18030 are tried, and the first that doesn't is taken. The default loses what it can't read. Null content is null.
    Decoding stays in the JVM; the session is set to know Java's charsets and to mark what a charset can't read.
    """
    for name in ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"):
        raw.sparkSession.conf.set(name, "true")
    content = F.col("content")
    known = F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair])
    named = lambda c: F.try_element_at(known, F.lower(F.trim(c)))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    rows = raw.select("key", "content", named(F.col("charset")).alias("told"), named(F.regexp_extract(head, r"""charset=["']?([\w-]+)""", 1)).alias("meta"))

    def by(charset: str) -> Column:
        """The text, null where the charset doesn't fit."""
        if charset == "UTF-8":
            return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, charset))
        return bound(F.decode(content, charset), lambda t: F.when(~F.contains(t, F.lit("\ufffd")), t))

    def by_name(name: Column) -> Column:
        out = F
        for charset in dict.fromkeys(CHARSETS.values()):
            out = out.when(name == charset, by(charset))
        return out.otherwise(F.lit(None).cast("string"))

    last = F.decode(content, CHARSETS.get(default.lower(), default))
    first = F.coalesce(by_name(F.col("told")), by_name(F.col("meta")), by("UTF-8"), last)
    clear = lambda c: bound(c, lambda t: F.when(~text.garbled_chinese(t), t))
    others = F.coalesce(*[clear(by(c)) for c in ("GBK", "UTF-8", "GB18030")])
    return rows.select("key", bound(first, lambda t: F.when(text.garbled_chinese(t), F.coalesce(others, t)).otherwise(t)).alias("text"))
