"""Known persons seen again: a batch of profiles changes persons, publications, updates and field links in one commit.

A profile is a row (person_id, place, ...); `place` orders the profiles of a person, and profiles of different persons
count as done in the order of their ids. Nothing walks them one by one: what the last of them would leave behind is taken
by aggregation. Rows without a person_id and profiles of unknown persons change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .metrics import first_n
from .snapshot import Store

FILLS = ("institution", "email", "department", "website", "bio_zh")
CHILDREN = ("research_updates", "competition_updates", "evaluation_updates")


def refreshed(persons: DataFrame, profiles: DataFrame, as_of: Column, fills: Sequence[str] = FILLS) -> DataFrame:
    """persons (id, last_scraped_at, metadata, ...) with the last filled value of each of `fills` that profiles tell.

    Empty text is no value; what no profile tells stays. A person with a profile gets last_scraped_at and lastUpdated in
    its metadata, whose other keys stay; metadata that is no object counts as empty.
    """
    told = [c for c in fills if c in profiles.columns and c in persons.columns]
    last = [F.max(F.when(text.filled(F.col(c)), F.struct("place", F.col(c).alias("v"))))["v"].alias(f"_{c}") for c in told]
    fresh = profiles.groupBy(F.col("person_id").alias("id")).agg(*last, F.lit(True).alias("_seen"))
    entries = F.coalesce(F.from_json(F.col("metadata"), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(entries, lambda k, v: k != "lastUpdated")
    stamp = F.create_map(F.lit("lastUpdated"), F.parse_json(F.date_format(as_of, "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'")))
    out = {c: F.coalesce(f"_{c}", c) for c in told}
    out["last_scraped_at"] = F.when(F.col("_seen"), as_of).otherwise(F.col("last_scraped_at"))
    out["metadata"] = F.when(F.col("_seen"), F.to_json(F.map_concat(others, stamp))).otherwise(F.col("metadata"))
    return persons.join(fresh, "id", "left").select(*[out.get(c, F.col(c)).alias(c) for c in persons.columns])


def publications_after(publications: DataFrame, incoming: DataFrame, most: int = 50) -> DataFrame:
    """publications (id, person_id, doi, citation_count, abstract, source, ...) after incoming ones (person_id, place, doi, ...).

    Of each person's incoming rows the first `most` count (of one place by DOI, then by what else they tell), and of these the ones with a DOI. A DOI that is stored, or that a
    person before has brought, is updated: the last citation count told, and the last abstract told with one. Any other DOI
    is added once, for the first person that brings it, with source SCRAPER. Rows without a DOI stay as they are.
    """
    ties = [F.col(c).asc_nulls_last() for c in ("doi", "title", "citation_count", "abstract") if c in incoming.columns]
    offered = first_n(incoming.where("person_id is not null"), ["person_id"], [F.col("place"), *ties], most).where(text.filled(F.col("doi")))
    shared = [c for c in publications.columns if c in incoming.columns and c not in ("id", "doi", "person_id")]
    cited = F.col("citation_count").isNotNull()
    # The last teller is another person than the first, or no one came after the first: one aggregation tells both.
    by_doi = offered.groupBy("doi").agg(
        F.min(F.struct("person_id", "place", *shared)).alias("_made"),
        F.max(F.when(cited, F.struct("person_id", "place", "citation_count"))).alias("_cited"),
        F.max(F.when(cited & F.col("abstract").isNotNull(), F.struct("person_id", "place", "abstract"))).alias("_told"),
    )
    last = {"citation_count": "_cited", "abstract": "_told"}
    kept = publications.join(by_doi, "doi", "left").select(*[F.coalesce(f"{last[c]}.{c}", c).alias(c) if c in last else F.col(c) for c in publications.columns])
    new = by_doi.join(publications.select("doi").distinct(), "doi", "left_anti")
    later = lambda c: F.when(F.col(f"{last[c]}.person_id") != F.col("_made.person_id"), F.col(f"{last[c]}.{c}"))
    out = {c: F.col(f"_made.{c}") for c in (*shared, "person_id")}
    out |= {c: F.coalesce(later(c), f"_made.{c}") for c in last if c in shared}
    kind = dict(publications.dtypes).get("id")
    out |= {"doi": F.col("doi"), "source": F.lit("SCRAPER"), "id": F.sha2("doi", 256) if kind == "string" else F.xxhash64("doi")}
    none = lambda c: F.lit(None).cast(publications.schema[c].dataType)
    return kept.unionByName(new.select(*[out.get(c, none(c)).alias(c) for c in publications.columns]))


def title_start(title: Column) -> Column:
    return F.substring(F.lower(F.coalesce(title, F.lit(""))), 1, 60)


def new_titled(existing: DataFrame, incoming: DataFrame, most: int = 20) -> DataFrame:
    """The incoming children (person_id, place, title, ...) whose title's first 60 letters, case aside, the person has not stored.

    At most `most` of a person, by place, then title. A null title counts as empty. Rows that repeat one another in the batch all stay.
    """
    have = existing.select("person_id", title_start(F.col("title")).alias("_start")).distinct()
    new = incoming.where("person_id is not null").withColumn("_start", title_start(F.col("title"))).join(have, ["person_id", "_start"], "left_anti")
    return first_n(new.withColumn("_place", F.col("place")), ["person_id"], [F.col("_place"), F.col("title")], most).withColumn("place", F.col("_place")).select(incoming.columns)


def new_links(links: DataFrame, fields: DataFrame, inferred: DataFrame, children: DataFrame, least: int = 5) -> DataFrame:
    """person_id, field_id, is_primary: links to add to links (person_id, field_id) for inferred fields (person_id, place, slug).

    A person without links gets all its known fields (id, slug), the first one primary. One with links is looked at again
    only where children (person_id, n) tells of `least` new records, and gets what it lacks, none primary.
    """
    known = links.select("person_id", F.lit(True).alias("_known")).distinct()
    found = inferred.join(fields.select("slug", F.col("id").alias("field_id")), "slug").groupBy("person_id", "field_id").agg(F.min("place").alias("place"))
    placed = found.join(known, "person_id", "left").join(children.groupBy("person_id").agg(F.sum("n").alias("_n")), "person_id", "left")
    first = F.row_number().over(Window.partitionBy("person_id").orderBy("place", "field_id")) == 1  # a person has few inferred fields
    chosen = placed.where(F.col("_known").isNull() | (F.col("_n") >= least)).withColumn("is_primary", first & F.col("_known").isNull())
    return chosen.select("person_id", "field_id", "is_primary").join(links.select("person_id", "field_id"), ["person_id", "field_id"], "left_anti")


def update_known(store: Store, profiles: DataFrame, slugs: Column, as_of: Column) -> int:
    """Commits what profiles change in the store's tables, all at once; the new version.

    profiles: person_id, place, FILLS, and arrays of structs `publications` and CHILDREN (with the columns of the tables of
    those names, but id and person_id); slugs: a profile's inferred fields, best first. Tables: persons, publications, CHILDREN, links, fields.
    """
    base = store.versions()[-1]
    read = lambda t: store.read(t, base)
    mine = profiles.join(read("persons").select(F.col("id").alias("person_id")), "person_id", "left_semi")

    def items(array: str) -> DataFrame:
        rows = mine.select("person_id", F.col("place").alias("_profile"), F.posexplode(array).alias("_at", "_item")).where("_item is not null")
        told = [c for c in rows.schema["_item"].dataType.names if c not in ("place", "person_id")]
        return rows.select("person_id", F.struct("_profile", "_at").alias("place"), *[F.col(f"_item.{c}").alias(c) for c in told])

    out = {"persons": refreshed(read("persons"), mine, as_of), "publications": publications_after(read("publications"), items("publications"))}
    for table in CHILDREN:
        fresh = new_titled(read(table), items(table)).drop("place")
        out[table] = read(table).unionByName(fresh, allowMissingColumns=True)
    n = F.coalesce(F.size("research_updates"), F.lit(0)) + F.coalesce(F.size("publications"), F.lit(0))
    inferred = mine.select("person_id", F.col("place").alias("_profile"), F.posexplode(slugs).alias("_at", "slug")).select("person_id", F.struct("_profile", "_at").alias("place"), "slug")
    added = new_links(read("links"), read("fields"), inferred, mine.select("person_id", n.alias("n")))
    out["links"] = read("links").unionByName(added.select(read("links").columns))
    return store.commit(out, base)
