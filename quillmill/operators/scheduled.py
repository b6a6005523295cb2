"""The scheduled run as phases over a store: each phase is one commit of its tables and of its place in the run.

A run that dies goes on where it stopped: what a phase changed and that it is done become visible by the same manifest, so no
phase is lost or done twice. What other services would be asked for is read from tables of the store.

Tables of the store:
    persons     id, name_zh, name_en, institution, department, email, h_index, last_scraped_at, is_active, metadata, failures, authority
    universities idx, key, name_zh, failures, tripped_until
    profiles    university, name_zh, name_en, institution, department, email (parsed pages)
    refreshed   name_zh, institution, department, email (pages of known persons seen again)
    works, scholar, papers   id, h_index, name_en, email (three services' answers)
    arxiv       person_id, title, published_at
    updates     person_id, title, published_at
    authorships paper_id, person_id; links person_id, field_id
    audit       run_id, action, n, at
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import graph, ingest
from .metrics import rotating_window
from .snapshot import Store

Read = Callable[[str], DataFrame]
PROGRESS = "_progress"


class Phase(NamedTuple):
    name: str
    work: Callable[[Read], dict[str, DataFrame]]


def progress(store: Store, run_id: str) -> list[str]:
    """The phases of a run that are done, in order."""
    if PROGRESS not in store.manifest():
        return []
    rows = store.read(PROGRESS).where(F.col("run_id") == run_id).orderBy("place").collect()
    return [r["phase"] for r in rows]


def run(store: Store, run_id: str, phases: list[Phase]) -> list[str]:
    """Does the phases of the run that aren't done; which those were. Only the run's phases are named in its progress table, a row each."""
    done, now = progress(store, run_id), []
    for place, phase in enumerate(phases):
        if phase.name in done:
            continue
        base = store.versions()[-1]
        read = lambda t, base=base: store.read(t, base)
        made = phase.work(read)
        mark = store.spark.createDataFrame([(run_id, place, phase.name)], "run_id string, place int, phase string")
        before = store.read(PROGRESS, base) if PROGRESS in store.manifest(base) else mark.where("false")
        store.commit({**made, PROGRESS: before.unionByName(mark).coalesce(1)}, base)
        now.append(phase.name)
    return now


def _audit(read: Read, run_id: str, action: str, counted: DataFrame, as_of: dt.datetime) -> DataFrame:
    row = counted.agg(F.count(F.lit(1)).alias("n")).select(F.lit(run_id).alias("run_id"), F.lit(action).alias("action"), "n", F.lit(as_of).cast("timestamp_ntz").alias("at"))
    return read("audit").unionByName(row)


def phases(
    run_id: str, as_of: dt.datetime, run_index: int = 0, universities: int = 5, profiles: int = 100, trips: int = 3, trip_hours: int = 24, stale: int = 20, pinyin: int = 500,
    enriched: tuple[int, int, int] = (200, 30, 80), arxiv_every: int = 3, arxiv_persons: int = 20, citation_days: int = 7, letters: dict[str, str] | None = None,
) -> list[Phase]:
    """The nine phases of a run at `as_of`. The caps are the feature: how much one run asks other services for."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def choose(read: Read) -> dict[str, DataFrame]:
        tripped = F.coalesce(F.col("tripped_until") > now, F.lit(False))
        return {"chosen": rotating_window(read("universities"), run_index, universities, read("universities").where(tripped))}

    def scrape(read: Read) -> dict[str, DataFrame]:
        mine = read("profiles").join(read("chosen").select(F.col("key").alias("university")), "university", "left_semi")
        found = ingest.first_of_each(mine, ["university"], [F.col("name_zh"), F.col("institution")], profiles)
        seen = found.groupBy(F.col("university").alias("key")).agg(F.count(F.lit(1)).alias("parsed"))
        told = read("universities").join(read("chosen").select("key", F.lit(True).alias("asked")), "key", "left").join(seen, "key", "left")
        # A university that gave nothing fails once more and is left alone after some failures; one that gave something is well.
        failures = F.when(F.col("asked").isNull(), F.col("failures")).when(F.col("parsed").isNull(), F.col("failures") + 1).otherwise(F.lit(0))
        until = F.when(F.col("asked").isNull(), F.col("tripped_until")).when(failures >= trips, now + F.expr(f"INTERVAL {trip_hours} HOURS"))
        return {"scraped": found, "universities": told.select("idx", "key", "name_zh", failures.alias("failures"), until.alias("tripped_until"))}

    def persist(read: Read) -> dict[str, DataFrame]:
        after, audit = ingest.run(read("scraped").drop("university"), read("persons"))
        fresh = after.withColumn("is_active", F.coalesce("is_active", F.lit(True))).withColumn("last_scraped_at", F.coalesce("last_scraped_at", now)).withColumn("failures", F.coalesce("failures", F.lit(0)))
        return {"persons": fresh, "audit": read("audit").unionByName(audit.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(run_id).alias("run_id"), "action", "n", now.alias("at")))}

    def refresh(read: Read) -> dict[str, DataFrame]:
        due = ingest.stale_selection(read("persons"), now, limit=stale).select("id", "name_zh", "institution")
        answers = read("refreshed").select("name_zh", "institution", F.lit(True).alias("seen")).distinct()
        asked = due.join(answers, ["name_zh", "institution"], "left").select("id", F.coalesce("seen", F.lit(False)).alias("seen"))
        filled = ingest.fill_forward(read("persons"), read("refreshed").join(due.select("name_zh", "institution"), ["name_zh", "institution"], "left_semi"), ["name_zh", "institution"], ["department", "email"])
        failed = ingest.refresh_failures(filled, asked.where("not seen")).drop("wait_days")
        told = failed.join(asked.where("seen").select("id", "seen"), "id", "left")
        return {"persons": told.withColumn("last_scraped_at", F.when(F.col("seen"), now).otherwise(F.col("last_scraped_at"))).withColumn("failures", F.when(F.col("seen"), 0).otherwise(F.col("failures"))).drop("seen").select(read("persons").columns)}

    def spell(read: Read) -> dict[str, DataFrame]:
        bare = read("persons").where("is_active and name_en is null and name_zh is not null").orderBy("id").limit(pinyin)
        spelt = bare.select("id", names.pinyin_given_first(F.col("name_zh"), letters or {}).alias("name_en"))
        return {"persons": ingest.fill_forward(read("persons"), spelt, ["id"], ["name_en"])}

    def enrich(read: Read) -> dict[str, DataFrame]:
        persons = read("persons")
        want = persons.where("is_active and (h_index is null or email is null)").select("id")
        for source, most in zip(("works", "scholar", "papers"), enriched):
            # In order of the services: a later one fills what the earlier ones left open.
            answers = read(source).join(want, "id", "left_semi").orderBy("id").limit(most)
            persons = ingest.fill_forward(persons, answers, ["id"], ["h_index", "name_en", "email"])
        return {"persons": persons}

    def sync(read: Read) -> dict[str, DataFrame]:
        if run_index % arxiv_every:
            return {}
        asked = read("persons").where("is_active and name_en is not null and h_index is not null").orderBy(F.desc_nulls_first("last_scraped_at"), "id").limit(arxiv_persons)
        mine = read("arxiv").join(asked.select(F.col("id").alias("person_id")), "person_id", "left_semi").dropDuplicates(["person_id", "title"])
        new = mine.join(read("updates"), ["person_id", "title"], "left_anti")
        return {"updates": read("updates").unionByName(new.select(read("updates").columns))}

    def analyse(read: Read) -> dict[str, DataFrame]:
        last = read("audit").where("action = 'CITATION_ANALYSIS'").agg(F.max("at").alias("at")).first()["at"]
        if last is not None and as_of - last < dt.timedelta(days=citation_days):
            return {}
        top = read("links").groupBy("field_id").agg(F.countDistinct("person_id").alias("n")).orderBy(F.desc("n"), "field_id").limit(5)
        members = read("links").join(top, "field_id", "left_semi").select(F.col("person_id").alias("id")).distinct()
        nodes = read("persons").join(members, "id").select("id", F.lit(None).cast("int").alias("citations"), "h_index")
        edges = graph.coauthor_edges(read("authorships").join(members.withColumnRenamed("id", "person_id"), "person_id", "left_semi"))
        scored = graph.authority(nodes, edges, graph.pagerank(nodes, edges)).select("id", F.col("authority").alias("new"))
        persons = read("persons").join(scored, "id", "left").withColumn("authority", F.coalesce("new", "authority")).drop("new")
        return {"persons": persons.select(read("persons").columns), "audit": _audit(read, run_id, "CITATION_ANALYSIS", scored, as_of)}

    def close(read: Read) -> dict[str, DataFrame]:
        return {"audit": _audit(read, run_id, "SCHEDULED_SCRAPE", read("scraped"), as_of)}

    work = (("universities", choose), ("profiles", scrape), ("persist", persist), ("stale", refresh), ("pinyin", spell), ("enrichment", enrich), ("arxiv", sync), ("citations", analyse), ("audit", close))
    return [Phase(*w) for w in work]
