"""Which persons to fetch again, and repairs of what was stored. Nothing is changed in place; limits are the callers'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import publications as lines
from ..functions import text
from ..functions.numbers import half_up
from . import cleanup, quality

#: Columns of which a bare person lacks three or more, and what they are called.
BARE = (("title", "title"), ("department", "department"), ("email", "email"), ("bio_zh", "bio"))
# Titles that are no publication, in the order of the repair.
REPAIR_GARBAGE = (
    r"发表了?\d+余?篇", r"共发表", r"发表论文", r"SCI.{0,5}收录", r"EI.{0,5}收录",
    r"引用.*次|被引.*次", r"代表性.*论文", r"近[三五]年", r"主要.*成果",
    r"包括[:：]", r"如下[:：]", r"论文列表", r"发表时间", r"著作[:：]",
    r"期刊.*论文", r"会议.*论文", r"第一作者", r"通讯作者",
    r"担任.*主编|担任.*编委", r"主持.*项目|承担.*项目",
    r"研究方向", r"研究领域", r"获奖|荣获|获得.*奖",
    r"博士学位|硕士学位|学士学位", r"邮箱[:：]|电话[:：]|地址[:：]",
    r"教授|副教授|讲师|研究员", r"博士生导师|硕士生导师",
    r"^\d{4}年", r"^\d{4}-\d{4}", r"个人主页|个人简介|教师简介",
    r"联系方式", r"教育背景", r"工作经历",
)
# What a title has that stays in the repair, one at least.
REPAIR_PAPERS = (
    r"(?:19|20)\d{2}",
    r"[\[\(].*[\]\)]",
    "[「『\"].*[」』\"]",
    r"学报|期刊|杂志|会议|Journal|Conference|Proc\.|IEEE|ACM|Springer",
    r"第[一二三四五六七八九十\d]+[卷期页]",
    r"(?i)DOI",
)
REPAIR_LONGEST = 250


def _json(column: str, *paths: str) -> Column:
    """The first of the paths in a JSON column that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(column, p), F.lit("")) for p in paths])


def bare_persons(persons: DataFrame, university: str | None = None, most: int | None = None) -> DataFrame:
    """id, institution, university_key, source_url, missing: active persons of an institution who lack three or more of BARE.

    `university`: those whose institution holds it. `most`: only the `most` persons that were fetched longest ago
    (never first, ties by id) are looked at, as the limit comes before the test.
    """
    place = F.contains("institution", F.lit(university)) if university else F.col("institution").isNotNull()
    rows = persons.where(F.col("is_active") & place)
    if most:
        rows = rows.orderBy(F.asc_nulls_first("last_scraped_at"), "id").limit(most)
    missing = F.array_compact(F.array(*[F.when(~text.filled(F.col(c)), F.lit(name)) for c, name in BARE]))
    key = _json("metadata", "$.rawMetadata.universityKey", "$.universityKey")
    url = _json("metadata", "$.rawMetadata.sourceUrl", "$.sourceUrl")
    if "website" in rows.columns:
        url = F.coalesce(F.nullif(F.col("website"), F.lit("")), url)
    return rows.select("id", "institution", key.alias("university_key"), url.alias("source_url"), missing.alias("missing")).where(F.size("missing") >= 3)


def metric_backfill(persons: DataFrame, id_key: str = "openalexId", h_key: str = "openalexHIndex", citations_key: str = "openalexCitations") -> DataFrame:
    """id, h_index, citation_count out of the metadata of active persons without an h-index who have the service's id.

    Only JSON numbers count, texts of digits don't; persons without either number are left out. A number that is missing
    is null and leaves the column as it is.
    """

    def number(key: str) -> Column:
        value = F.expr(f"try_variant_get(try_parse_json(metadata), '$.{key}', 'variant')")
        return F.when(F.regexp_like(F.schema_of_variant(value), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.get_json_object("metadata", f"$.{key}").try_cast("double").cast("long"))

    known = persons.where(F.col("is_active") & F.col("h_index").isNull() & F.get_json_object("metadata", f"$.{id_key}").isNotNull())
    return known.select("id", number(h_key).alias("h_index"), number(citations_key).alias("citation_count")).where("h_index is not null or citation_count is not null")


def backfilled(persons: DataFrame, found: DataFrame) -> DataFrame:
    """persons with the numbers of metric_backfill(); a null of it changes nothing."""
    new = found.select("id", F.col("h_index").alias("_h"), F.col("citation_count").alias("_c"))
    both = persons.join(new, "id", "left")
    kept = {"h_index": F.coalesce("_h", "h_index").cast(persons.schema["h_index"].dataType), "citation_count": F.coalesce("_c", "citation_count").cast(persons.schema["citation_count"].dataType)}
    return both.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in persons.columns])


def rolled_back(publications: DataFrame, persons: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """publications without the source's rows, and persons whose metrics are taken back, but for inactive and seed ones. A null source stays."""
    kept = publications.where(F.coalesce(F.col("source") != source, F.lit(True)))
    reset = F.col("is_active") & ~F.col("id").cast("string").startswith("seed-")
    metrics = ("h_index", "citation_count")
    return kept, persons.select(*[F.when(~F.coalesce(reset, F.lit(False)), F.col(c)).alias(c) if c in metrics else F.col(c) for c in persons.columns])


def fetch_targets(persons: DataFrame, url_key: str = "sourceUrl", shortest: int = 50) -> DataFrame:
    """id, url, score of active persons with a page, a biography under `shortest` characters and no h-index; to be read by score, highest first, nulls first."""
    rows = persons.select("id", F.get_json_object("metadata", f"$.{url_key}").alias("url"), "score", "bio_zh", "h_index", "is_active")
    chosen = rows.where(F.col("is_active") & F.col("url").isNotNull() & (F.col("bio_zh").isNull() | (F.length("bio_zh") < shortest)) & F.col("h_index").isNull())
    return chosen.select("id", "url", "score").orderBy(F.desc_nulls_first("score"), "id")


def within_budget(persons: DataFrame, remaining: float, cost: float = 0.002) -> DataFrame:
    """The active persons without an h-index, with a name and an institution, that a budget pays for, by score, highest first (nulls first, ties by id)."""
    eligible = persons.where(F.col("is_active") & F.col("h_index").isNull() & F.coalesce(F.col("name_zh") != "", F.lit(False)) & F.coalesce(F.col("institution") != "", F.lit(False)))
    return eligible.orderBy(F.desc_nulls_first("score"), "id").limit(int(remaining / cost + 1e-9))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """rate (rows a second, two places) and eta (whole minutes) of a run; null where nothing is done yet."""
    rate = F.try_divide(done.cast("double"), seconds)
    return F.struct(half_up(rate, 2).alias("rate"), half_up(F.try_divide(total - done, rate) / 60.0, 0).alias("eta"))


def kept_publications(publications: DataFrame, source: str = "SCRAPER") -> DataFrame:
    """publications without the source's rows whose title is too long, tells of publications or has nothing of a reference."""
    title = F.coalesce("title", F.lit(""))
    fine = (F.length(title) <= REPAIR_LONGEST) & ~lines.matches_any(title, REPAIR_GARBAGE) & lines.matches_any(title, REPAIR_PAPERS)
    return publications.where(F.coalesce(F.col("source") != source, F.lit(True)) | fine)


def content_counts(persons: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """total, one count per child table, with_any, with_all: active persons whose metadata have the key (a JSON null doesn't count)."""
    chosen = persons.where(F.col("is_active") & F.get_json_object("metadata", f"$.{key}").isNotNull()).select("id")
    for name, rows in children.items():
        chosen = chosen.join(rows.select(F.col("person_id").alias("id")).distinct().withColumn(name, F.lit(True)), "id", "left")
    flags = [F.col(name).isNotNull() for name in children]
    some, every = F.lit(False), F.lit(True)
    for f in flags:
        some, every = some | f, every & f
    return chosen.agg(F.count(F.lit(1)).alias("total"), *[F.count(name).alias(name) for name in children], F.count_if(some).alias("with_any"), F.count_if(every).alias("with_all"))


def maintenance(frames: cleanup.Frames, scans: list[DataFrame], as_of: Column) -> tuple[DataFrame, cleanup.Frames, DataFrame | None]:
    """The scan's summary, the frames and the actions: a cleanup follows only if the scan found something to be mended by itself."""
    found = quality.summary(quality.full_scan(scans))
    if found.agg(F.coalesce(F.sum("auto_fixable"), F.lit(0)).alias("n")).first()[0] == 0:
        return found, frames, None
    cleaned, actions = cleanup.run_cleanup(frames, as_of, dry_run=False)
    return found, cleaned, actions
