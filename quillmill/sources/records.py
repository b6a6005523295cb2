"""Readers of scholarly records and writers of results. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERSON_JSON = "nameZh string, nameEn string, title string, institution string, department string, email string, website string, bio string, hIndex int, fields array<string>"
OPENALEX_AUTHOR = "id string, display_name string, orcid string, works_count int, cited_by_count int, summary_stats struct<h_index:int>, last_known_institutions array<struct<display_name:string>>"
OPENALEX_WORK = "id string, doi string, title string, publication_year int, cited_by_count int, primary_location struct<source:struct<display_name:string>>, authorships array<struct<author:struct<id:string,display_name:string>>>"
S2_DETAIL = "authorId string, papers array<struct<paperId:string,title:string,year:int,venue:string,citationCount:int,externalIds:struct<DOI:string>>>"
S2_AUTHOR = "authorId string, name string, affiliations array<string>, paperCount int, citationCount int, hIndex int"


def persons_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of scraped persons."""
    return spark.read.schema(PERSON_JSON).option("multiLine", True).json(path)


def openalex_authors(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"results array<struct<{_as_struct(OPENALEX_AUTHOR)}>>").option("multiLine", True).json(path)
    one = rows.select(F.explode("results").alias("a"))
    return one.select("a.id", F.col("a.display_name").alias("name"), F.regexp_extract("a.orcid", r"([0-9X-]{19})", 1).alias("orcid_id"), F.col("a.works_count"), F.col("a.cited_by_count").alias("citation_count"), F.col("a.summary_stats.h_index").alias("h_index"), F.get("a.last_known_institutions", F.lit(0))["display_name"].alias("institution"))


def openalex_works(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"results array<struct<{_as_struct(OPENALEX_WORK)}>>").option("multiLine", True).json(path)
    one = rows.select(F.explode("results").alias("w"))
    doi = F.nullif(F.regexp_replace(F.lower("w.doi"), "^https?://(dx\\.)?doi\\.org/", ""), F.lit(""))
    return one.select("w.id", doi.alias("doi"), "w.title", F.col("w.publication_year").alias("year"), F.col("w.cited_by_count").alias("citation_count"), F.col("w.primary_location.source.display_name").alias("journal"), F.concat_ws("; ", F.transform("w.authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.transform("w.authorships", lambda a: a["author"]["id"]).alias("author_ids"))


def author_works(works: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    """author_id, place and the works on a page of each author's list, the most cited first (unknown counts last, then by id)."""
    each = works.withColumn("author_id", F.explode(F.array_distinct("author_ids"))).where("author_id is not null")
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc_nulls_last("citation_count"), "id")))
    return placed.where(F.col("place").between((page - 1) * per_page + 1, page * per_page)).drop("author_ids")


def semantic_scholar_authors(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"data array<struct<{_as_struct(S2_AUTHOR)}>>").option("multiLine", True).json(path)
    return rows.select(F.explode("data").alias("a")).select(F.col("a.authorId").alias("id"), "a.name", F.get("a.affiliations", F.lit(0)).alias("institution"), F.col("a.paperCount").alias("works_count"), F.col("a.citationCount").alias("citation_count"), F.col("a.hIndex").alias("h_index"))


def semantic_scholar_papers(spark: SparkSession, path: str) -> DataFrame:
    """author_id, id, title, year, journal, citation_count, doi of the papers in detail records of authors."""
    rows = spark.read.schema(S2_DETAIL).option("multiLine", True).json(path)
    one = rows.select(F.col("authorId").alias("author_id"), F.explode("papers").alias("p"))
    return one.select("author_id", F.col("p.paperId").alias("id"), "p.title", "p.year", F.nullif(F.col("p.venue"), F.lit("")).alias("journal"), F.col("p.citationCount").alias("citation_count"), F.lower("p.externalIds.DOI").alias("doi"))


def _as_struct(columns: str) -> str:
    """`a int, b array<x>` as the fields of a struct: `a:int, b:array<x>`."""
    out, depth, name = [], 0, True
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == " " and name and not depth and out and out[-1] != ",":
            out.append(":")
            name = False
        elif c == "," and not depth:
            out.append(c)
            name = True
        elif c != " ":
            out.append(c)
    return "".join(out)


def arxiv_papers(feeds: DataFrame) -> DataFrame:
    """Papers of Atom feeds (column xml): id, title, summary, authors, categories, doi, journal, comment, published."""
    tag = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"\s+", " ")), F.lit(""))
    entries = feeds.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("entry"))
    return entries.select(
        F.regexp_extract(F.coalesce(tag("id"), F.lit("")), r"abs/(.+?)(?:v[0-9]+)?\z", 1).alias("id"), tag("title").alias("title"), tag("summary").alias("summary"),
        F.regexp_extract_all("entry", F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), F.lit(1)).alias("authors"),
        F.regexp_extract_all("entry", F.lit(r'<category[^>]*term="([^"]+)"'), F.lit(1)).alias("categories"),
        tag("arxiv:doi").alias("doi"), tag("arxiv:journal_ref").alias("journal"), tag("arxiv:comment").alias("comment"),
        F.try_to_timestamp(tag("published")).cast("timestamp_ntz").alias("published"),
    )


def arxiv_query(authors: Column, categories: Column) -> Column:
    """Query text: any author and any category."""
    a = F.array_join(F.transform(authors, lambda x: F.concat(F.lit('au:"'), x, F.lit('"'))), " OR ")
    c = F.array_join(F.transform(categories, lambda x: F.concat(F.lit("cat:"), x)), " OR ")
    both = F.concat(F.lit("("), a, F.lit(") AND ("), c, F.lit(")"))
    return F.when(F.size(authors) == 0, c).when(F.size(categories) == 0, a).otherwise(both)


def orcid_records(rows: DataFrame) -> DataFrame:
    """Flat person and work rows of ORCID records (column json)."""
    at = lambda path: F.get_json_object("json", f"$.{path}")
    works = F.from_json(at("activities-summary.works.group"), "array<struct<`work-summary`:array<struct<title:struct<title:struct<value:string>>,`publication-date`:struct<year:struct<value:string>>>>>>")
    person = rows.select(at("orcid-identifier.path").alias("orcid_id"), F.concat_ws(" ", at("person.name.given-names.value"), at("person.name.family-name.value")).alias("name"), at("person.biography.content").alias("bio"), works.alias("works"))
    first = lambda w: w["work-summary"][0]
    return person.withColumn("titles", F.transform("works", lambda w: first(w)["title"]["title"]["value"])).withColumn("years", F.transform("works", lambda w: first(w)["publication-date"]["year"]["value"].cast("int"))).drop("works")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def sitemap(fields: DataFrame, persons: DataFrame, base: str, most_fields: int = 500, most_persons: int = 1000) -> DataFrame:
    """loc, priority: fields by id, then the best-scored persons."""
    f = fields.orderBy("id").limit(most_fields).select(F.concat(F.lit(f"{base}/field/"), "slug").alias("loc"), F.lit(0.7).alias("priority"))
    p = persons.where("is_active").orderBy(F.desc("score"), "id").limit(most_persons).select(F.concat(F.lit(f"{base}/person/"), F.col("id").cast("string")).alias("loc"), F.lit(0.6).alias("priority"))
    return f.unionByName(p)


def audit_rows(rows: DataFrame, action: str, entity: str, entity_id: Column, detail: list[str], as_of: Column) -> DataFrame:
    """Rows of the append-only audit log."""
    return rows.select(F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), entity_id.cast("string").alias("entity_id"), F.to_json(F.struct(*detail)).alias("new_data"), as_of.alias("created_at"))
