"""Cleanups over a dict of frames. Nothing is changed in place: each returns new frames and the actions taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .quality import not_seed

Frames = dict[str, DataFrame]
CHILDREN = ("publication", "research_update", "competition_update", "evaluation_update")
RESIDUAL = ("score_breakdown", "person_field", "rating_log", "report")


def _actions(chosen: DataFrame, kind: str, action: str, entity: Column) -> DataFrame:
    return chosen.select(F.lit(kind).alias("type"), F.lit(action).alias("action"), entity.cast("string").alias("entity_id"))


def merged_metadata(column: str, key: str, value: str) -> Column:
    """The JSON object with one more key; keys that it has stay."""
    old = F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))


def deactivate(persons: DataFrame, chosen: DataFrame, reason: str) -> DataFrame:
    marked = persons.join(chosen.select("id").withColumn("gone", F.lit(True)), "id", "left")
    return marked.withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).withColumn("metadata", F.when(F.col("gone"), merged_metadata("metadata", "cleanupReason", reason)).otherwise(F.col("metadata"))).drop("gone")


def garbage_persons(frames: Frames, most: int = 50) -> DataFrame:
    name = F.coalesce("name_zh", F.lit(""))
    odd = (F.length(name) <= 1) | F.col("name_zh").isin("首页", "登录", "注册", "返回", "导航", "菜单", "测试", "无", "暂无", "匿名") | F.regexp_like(name, F.lit(r"^[0-9]+\z|^[!@#$%^&*()_+=\[\]{};\"'\\|,.<>/?]+\z|<[^>]+>.*</[^>]+>"))
    found = frames["person"].where(F.col("is_active") & not_seed() & odd & (F.coalesce("h_index", F.lit(0)) == 0))
    return found.join(frames["publication"].select(F.col("person_id").alias("id")), "id", "left_anti").orderBy("id").limit(most)


def definite_junk(frames: Frames, most: int = 50) -> DataFrame:
    bare = F.col("h_index").isNull() & F.col("name_en").isNull() & F.col("department").isNull() & F.col("email").isNull() & (F.length(F.coalesce("bio_zh", F.lit(""))) < 20)
    name = F.coalesce("name_zh", F.lit(""))
    odd = (F.length(name) <= 1) | (F.length(name) > 60) | F.regexp_like(name, F.lit("<[^>]+>"))
    found = frames["person"].where(F.col("is_active") & not_seed() & bare & odd)
    return found.join(frames["publication"].select(F.col("person_id").alias("id")), "id", "left_anti").orderBy("id").limit(most)


def junk_bios(persons: DataFrame, most: int = 200) -> DataFrame:
    """Of the first `most` persons with a biography, those whose text is HTML or says little."""
    looked_at = persons.where("is_active and bio_zh is not null").orderBy("id").limit(most)
    return looked_at.where((F.length("bio_zh") >= 10) & (F.regexp_like("bio_zh", F.lit(text.HTML_FRAGMENT)) | (text.info_density(F.col("bio_zh")) < 0.2)))


def long_inactive(persons: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    return persons.where(~F.col("is_active") & (F.col("last_scraped_at") < as_of - F.expr(f"INTERVAL {days} DAYS")))


def without(children: DataFrame, persons: DataFrame) -> DataFrame:
    """children of none of the persons."""
    return children.join(persons.select(F.col("id").alias("person_id")), "person_id", "left_anti")


def run_cleanup(frames: Frames, as_of: Column, dry_run: bool = True) -> tuple[Frames, DataFrame]:
    """Definite junk, garbage names, junk biographies, orphans, residual rows: in this order, each on what the last one left. (frames, actions)"""
    out, done = dict(frames), []
    junk = definite_junk(out)
    done.append(_actions(junk, "GARBAGE_NAME", "DEACTIVATE_PERSON", F.col("id")))
    out["person"] = deactivate(out["person"], junk, "DEFINITE_JUNK_AUTO")
    garbage = garbage_persons(out)
    done.append(_actions(garbage, "GARBAGE_NAME", "DEACTIVATE_PERSON", F.col("id")))
    out["person"] = deactivate(out["person"], garbage, "GARBAGE_NAME_AUTO")
    for name in CHILDREN:
        if name in out:
            out[name] = without(out[name], garbage)
    bios = junk_bios(out["person"])
    done.append(_actions(bios, "JUNK_BIO", "CLEAR_FIELD", F.col("id")))
    cleared = out["person"].join(bios.select("id").withColumn("cleared", F.lit(True)), "id", "left")
    out["person"] = cleared.withColumn("bio_zh", F.when(F.col("cleared").isNull(), F.col("bio_zh"))).drop("cleared")
    inactive = out["person"].where("not is_active")
    for name in CHILDREN:
        if name in out:
            gone = out[name].join(inactive.select(F.col("id").alias("person_id")), "person_id", "left_semi")
            done.append(_actions(gone.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "ORPHANED_RECORD", "DELETE_RECORDS", F.concat(F.lit(f"{name}: "), F.col("n").cast("string"))))
            out[name] = without(out[name], inactive)
    old = long_inactive(out["person"], as_of)
    for name in RESIDUAL:
        if name in out:
            gone = out[name].join(old.select(F.col("id").alias("person_id")), "person_id", "left_semi")
            done.append(_actions(gone.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "INACTIVE_WITH_CONTENT", "DELETE_RECORDS", F.concat(F.lit(f"{name}: "), F.col("n").cast("string"))))
            out[name] = without(out[name], old)
    return (frames if dry_run else out), reduce(DataFrame.unionByName, done)


def seed_rows(persons: DataFrame) -> DataFrame:
    """Persons that came with the seed, however it was noted."""
    return persons.where(F.coalesce(F.get_json_object("metadata", "$.source") == "seed", F.lit(False)) | F.coalesce(F.get_json_object("metadata", "$.seeded") == "true", F.lit(False)) | F.col("id").cast("string").startswith("seed-"))
