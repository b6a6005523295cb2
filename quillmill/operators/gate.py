"""The gate for new persons: a batch is held against all stored persons by an index that is kept and added to.

A new person is a duplicate if a stored active one reaches HIGH in matching.record_similarity. That takes either a common
external id or, where the new one has none, the same institution and a name similarity of LEAST_NAME. So the index has keys
(64-bit hashes) for external ids and, within an institution, for all pieces of a name: equal names, names within one
another, swapped parts and names that share most trigrams all meet under some key. Hashes that collide only add candidates,
for every pair is scored in full. A name looks its rarest keys up, by the index's own counts, so a piece that very many
persons of an institution have is no bucket that is opened.

What a name and an institution are worth to a new person is the same for all who share both, so of these only the smallest
id is in a segment's index by name, and new persons without an external id who share both look it up once, by the smallest
of them. So namesakes make no pairs among one another.

Index and persons lie in a store as segments, one of each per batch. A batch reads the segments and writes new ones by one
commit; nothing stored is written again until `compact`. Persons: id, name_zh, name_en, institution, orcid_id, scholar_id,
is_active, and more; ids are unique and not null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .matching import record_similarity
from .snapshot import Store
from .stored import Steps

HIGH, LEAST_NAME = 0.85, 0.81  # (0.4 * 0.8125 + 0.1) / 0.5 = 0.85; a little less, for rounding
IDS = ("orcid_id", "scholar_id")
#: Keys of a batch (a long each) that are broadcast at most: 64 MB.
MAX_BROADCAST = 8_000_000


def _name() -> Column:
    return F.lower(F.coalesce(F.nullif(F.col("name_en"), F.lit("")), F.nullif(F.col("name_zh"), F.lit(""))))


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _grams(name: Column, n: int) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n)))
    return F.when(F.length(name) >= n, each).otherwise(F.array().cast("array<string>"))


def _told(persons: DataFrame) -> DataFrame:
    """id, the external ids, place, name and active of persons; empty texts count as null."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return persons.select("id", *[empty(c).alias(c) for c in IDS], F.lower(empty("institution")).alias("place"), _name().alias("name"), F.coalesce("is_active", F.lit(True)).alias("active"))


def _shaped(named: DataFrame) -> DataFrame:
    """The rows of _told with the parts that keys are made of."""
    split = F.split("name", r"\s+")
    own = F.when(F.length("name") >= 3, F.array_min(F.transform(_grams(F.col("name"), 3), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]).otherwise(F.col("name"))
    pieces = F.array_distinct(F.concat(*[_grams(F.col("name"), n) for n in (1, 2, 3)]))
    return named.select("*", own.alias("own"), pieces.alias("pieces"), F.array_distinct(text.trigrams(F.col("name"))).alias("trigrams"), F.when(F.size(split) == 2, F.array_join(F.array_sort(split), " ")).alias("swapped"))


def _id_keys() -> list[Column]:
    return [F.when(F.col(c).isNotNull(), _key(c, F.col(c))) for c in IDS]


def _bare() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in IDS])


def _placed() -> Column:
    return F.col("place").isNotNull() & F.col("name").isNotNull()


def index_rows(persons: DataFrame) -> DataFrame:
    """key, id: what the index holds of persons. External ids of all; names of active ones, of those with one name and institution the smallest id's."""
    told = _told(persons)
    firsts = told.where(F.col("active") & _placed()).groupBy("place", "name").agg(F.min("id").alias("id"))
    return told.select(F.explode(F.array_compact(F.array(*_id_keys()))).alias("key"), "id").unionByName(_name_rows(firsts))


def _name_rows(firsts: DataFrame) -> DataFrame:
    """key, id: what the index holds of names (id, place, name)."""
    inside = lambda kind, items: F.transform(items, lambda p: _key(kind, F.col("place"), p))
    one = lambda kind, c: F.array(F.when(F.col(c).isNotNull(), _key(kind, F.col("place"), F.col(c))))
    named = F.concat(inside("holds", F.col("pieces")), inside("trigram", F.col("trigrams")), one("own", "own"), one("swapped", "swapped"))
    return _shaped(firsts).select(F.explode(F.array_distinct(F.array_compact(named))).alias("key"), "id")


def _probes(incoming: DataFrame) -> DataFrame:
    """in_id, kind, most, key: the keys a new person may look up, and how many of a kind (the rarest) are enough; null: all."""
    shaped = _shaped(_told(incoming))
    n, repeats = F.size("trigrams"), F.length("name") + 1 > F.size("trigrams")
    # Of n different trigrams at least LEAST_NAME * n are the other's; repeated ones count more often, so then all are tried.
    enough = F.when(~repeats, n - F.ceil(F.lit(LEAST_NAME) * n) + 1).cast("int")
    all_of = F.lit(None).cast("int")

    def probe(kind: str, most: Column, items: Column) -> Column:
        return F.transform(items, lambda p: F.struct(F.lit(kind).alias("kind"), most.alias("most"), _key(kind, F.col("place"), p).alias("key")))

    inner = F.when(F.length("name") >= 3, _grams(F.col("name"), 3)).otherwise(F.array("name"))
    named = F.concat(probe("holds", F.lit(1), F.array_distinct(inner)), probe("trigram", enough, F.col("trigrams")), probe("own", all_of, F.col("pieces")), probe("swapped", all_of, F.array_compact(F.array("swapped"))))
    ids = F.filter(F.array(*[F.struct(F.lit("id").alias("kind"), all_of.alias("most"), k.alias("key")) for k in _id_keys()]), lambda s: s["key"].isNotNull())
    return shaped.select(F.col("id").alias("in_id"), F.inline(F.when(_bare() & _placed(), named).otherwise(ids)))


def candidates(incoming: DataFrame, index: DataFrame, steps: Steps, name: str) -> DataFrame:
    """in_id, id: the stored persons that share a looked-up key with a new one. The index is read, never shuffled, for a batch of checked size."""
    probes = steps.write(_probes(incoming), f"{name}-probes")
    keys = probes.select("key").distinct()
    small = keys.count() <= MAX_BROADCAST
    hint = F.broadcast if small else lambda df: df
    counts = index.join(hint(keys), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A key that no stored person has is the rarest: looking it up finds nothing, and that is an answer.
    placed = probes.join(counts, "key", "left").withColumn("place", F.row_number().over(Window.partitionBy("in_id", "kind").orderBy(F.coalesce("n", F.lit(0)), "key")))
    chosen = steps.write(placed.where("(most is null or place <= most) and n is not null").select("in_id", "key"), f"{name}-chosen")
    return index.join(hint(chosen) if small else chosen, "key").select("in_id", "id").distinct()


def scored(pairs: DataFrame, incoming: DataFrame, persons: DataFrame) -> DataFrame:
    """in_id, id, similarity, active, same_orcid, same_scholar of pairs (in_id, id)."""
    columns = ("institution", *IDS)
    tell = lambda df, p, key, *more: df.select(F.col("id").alias(key), _name().alias(f"{p}_name"), *[F.nullif(F.col(c), F.lit("")).alias(f"{p}_{c}") for c in columns], *more)
    both = pairs.join(tell(incoming, "a", "in_id"), "in_id").join(tell(persons, "b", "id", F.coalesce("is_active", F.lit(True)).alias("active")), "id")
    record = lambda p: {"name": F.col(f"{p}_name"), **{c: F.col(f"{p}_{c}") for c in columns}}
    same = [F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)).alias(n) for c, n in zip(IDS, ("same_orcid", "same_scholar"))]
    return both.select("in_id", "id", record_similarity(record("a"), record("b")).alias("similarity"), "active", *same)


def _blocks(pairs: DataFrame) -> DataFrame:
    """in_id, id, similarity, decision of the pairs that keep a new person out."""
    decision = F.when(F.col("active") & (F.col("similarity") >= HIGH), "duplicate").when(F.col("same_orcid"), "orcid_taken").when(F.col("same_scholar"), "scholar_taken")
    return pairs.withColumn("decision", decision).where("decision is not null").select("in_id", "id", "similarity", "decision")


def _worst(blocks: DataFrame) -> DataFrame:
    """The decision of each in_id: a duplicate (the most similar, then smallest id) before a taken ORCID before a taken scholar id."""
    rank = F.array_position(F.array(F.lit("duplicate"), F.lit("orcid_taken"), F.lit("scholar_taken")), F.col("decision"))
    similar = F.when(F.col("decision") == "duplicate", -F.col("similarity")).otherwise(F.lit(0.0))
    best = blocks.groupBy("in_id").agg(F.min(F.struct(rank.alias("rank"), similar.alias("less"), "id", "decision", "similarity")).alias("b"))
    return best.select("in_id", "b.decision", "b.id", "b.similarity")


def _speakers(incoming: DataFrame) -> DataFrame:
    """in_id, speaker: the row that is looked up for a new one; itself, or the smallest id of those without external ids that share name and institution."""
    told = _told(incoming)
    equals = told.where(_bare() & _placed())
    firsts = equals.groupBy("place", "name").agg(F.min("id").alias("speaker"))
    return equals.join(firsts, ["place", "name"]).select(F.col("id").alias("in_id"), "speaker").unionByName(told.where(~_bare()).select(F.col("id").alias("in_id"), F.col("id").alias("speaker")))


def _heads(incoming: DataFrame, speakers: DataFrame) -> DataFrame:
    return incoming.join(speakers.select(F.col("speaker").alias("id")).distinct(), "id", "left_semi")


def kept_out(incoming: DataFrame, persons: DataFrame, index: DataFrame, steps: Steps) -> DataFrame:
    """in_id, decision, id, similarity of the rows of a batch that stored persons keep out."""
    speakers = steps.write(_speakers(incoming), "speakers")
    heads = _heads(incoming, speakers)
    said = _worst(_blocks(scored(candidates(heads, index, steps, "stored"), heads, persons)))
    return speakers.join(said.withColumnRenamed("in_id", "speaker"), "speaker").select("in_id", "decision", "id", "similarity")


def decided(incoming: DataFrame, persons: DataFrame, index: DataFrame, steps: Steps) -> DataFrame:
    """in_id, decision (created, duplicate, orcid_taken, scholar_taken), id, similarity of every row of a batch.

    The rows count as given one after another, by id: one that is created keeps later ones out, one that is kept out doesn't.
    Rows with external ids are kept out by one another only, so they are settled first. Of those that are created, and of
    the active ones without, the smallest id of a name and institution is enough to keep others out: another one without
    external ids is never created, as the smallest, or who keeps that out, keeps it out as well.
    """
    refused = steps.write(kept_out(incoming, persons, index, steps), "refused")
    rest = incoming.join(refused.select(F.col("in_id").alias("id")), "id", "left_anti")
    told = _told(rest)
    by_id = rest.join(told.where(~_bare()).select("id"), "id", "left_semi")
    id_keys = steps.write(told.select(F.explode(F.array_compact(F.array(*_id_keys()))).alias("key"), "id"), "own-ids")
    links = steps.write(_blocks(scored(candidates(by_id, id_keys, steps, "own-id").where("id < in_id"), by_id, by_id)), "id-links")
    held = steps.write(_held(links, steps, "id"), "id-held")

    free = told.where(F.col("active") & _placed()).join(held.select(F.col("in_id").alias("id")), "id", "left_anti").withColumn("bare", _bare())
    firsts = free.groupBy("place", "name", "bare").agg(F.min("id").alias("id")).select("id", "place", "name")
    speakers = steps.write(_speakers(rest.join(by_id.select("id"), "id", "left_anti")), "own-speakers")
    heads = _heads(rest, speakers)
    pairs = steps.write(scored(candidates(heads, steps.write(_name_rows(firsts), "own-names"), steps, "own"), heads, rest), "own-pairs")
    links = steps.write(_blocks(speakers.join(pairs.withColumnRenamed("in_id", "speaker"), "speaker").drop("speaker").where("id < in_id")), "name-links")
    out = refused.unionByName(held).unionByName(_held(links, steps, "name"))
    every = incoming.select(F.col("id").alias("in_id")).join(out, "in_id", "left")
    return every.select("in_id", F.coalesce("decision", F.lit("created")).alias("decision"), "id", "similarity")


def _held(links: DataFrame, steps: Steps, name: str) -> DataFrame:
    """in_id, decision, id, similarity of the rows that are kept out, of links of a batch's rows (in_id) to earlier ones (id) that keep them out if created."""
    # A row whose earlier partners are all kept out is created; one with a created partner is kept out. Only rows with partners take part.
    known, turn = links.select(F.col("id").alias("row"), F.lit(True).alias("created")).distinct().join(links.select(F.col("in_id").alias("row")), "row", "left_anti"), 0
    known = steps.write(known, f"{name}-known-{turn}")
    while True:
        states = links.join(known.withColumnRenamed("row", "id"), "id", "left").join(known.select(F.col("row").alias("in_id"), F.lit(True).alias("done")), "in_id", "left").where("done is null")
        told = states.groupBy("in_id").agg(F.max(F.coalesce("created", F.lit(False))).alias("blocked"), F.count_if(F.col("created").isNull()).alias("open"))
        fresh = steps.write(told.where("blocked or open = 0").select(F.col("in_id").alias("row"), (~F.col("blocked")).alias("created")), f"{name}-fresh")
        if fresh.isEmpty():
            break
        # The table before is still read, so two names take turns.
        turn = 1 - turn
        known = steps.write(known.unionByName(fresh), f"{name}-known-{turn}")
    return _worst(links.join(known.where("created").select(F.col("row").alias("id")), "id", "left_semi"))


def _segments(store: Store, table: str, version: int) -> DataFrame:
    names = sorted(n for n in store.manifest(version) if n.startswith(f"{table}."))
    return reduce(lambda a, b: a.unionByName(b), [store.read(n, version) for n in names])


def _sorted(keys: DataFrame) -> DataFrame:
    return keys.repartitionByRange("key").sortWithinPartitions("key")


def persons(store: Store, version: int | None = None) -> DataFrame:
    return _segments(store, "persons", store.versions()[-1] if version is None else version)


def begin(store: Store, first: DataFrame) -> int:
    """Stores the first persons and their index."""
    return store.commit({"persons.000000": first, "keys.000000": _sorted(index_rows(first))})


def admit(store: Store, incoming: DataFrame) -> DataFrame:
    """The decisions on a batch (the persons' columns), which is committed: the created persons and their keys as new segments.

    Raises snapshot.Conflict, and changes nothing, where another batch was committed meanwhile.
    """
    base, steps = store.versions()[-1], Steps(store.spark)
    result = steps.write(decided(incoming, persons(store, base), _segments(store, "keys", base), steps), "decisions")
    new = incoming.join(result.where("decision = 'created'").select(F.col("in_id").alias("id")), "id", "left_semi").select(persons(store, base).columns)
    store.commit({f"persons.{base:06d}": new, f"keys.{base:06d}": _sorted(index_rows(new)), f"decisions.{base:06d}": result}, base)
    steps.keep_only()
    return store.read(f"decisions.{base:06d}")


def compact(store: Store) -> int:
    """Makes one segment of persons and one of keys out of all, and lets the decisions go; `vacuum` then deletes the old files."""
    base = store.versions()[-1]
    old = [n for n in store.manifest(base) if n.split(".")[0] in ("persons", "keys", "decisions")]
    return store.commit({f"persons.{base:06d}": _segments(store, "persons", base), f"keys.{base:06d}": _sorted(_segments(store, "keys", base))}, base, drop=old)
