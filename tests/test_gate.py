import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import gate
from quillmill.operators.matching import record_similarity
from quillmill.operators.snapshot import Conflict, Store

SCHEMA = "id long, name_zh string, name_en string, institution string, orcid_id string, scholar_id string, is_active boolean"


def people(rng, ids):
    first, last = ("anna", "li", "Wei", "jo", "aaaa"), ("chen", "Chang", "wu", "li", "aaaaa", "chengdu")
    rows = []
    for i in ids:
        kind = rng.randrange(6)
        name = f"{rng.choice(first)} {rng.choice(last)}" if kind < 4 else rng.choice(first + last)
        zh = rng.choice([None, "", "王小明", "王明", "明"]) if kind == 5 else "某"
        has = lambda p, rng=rng: rng.random() < p
        rows.append((i, zh, None if kind == 5 else name, rng.choice([None, "", "A Univ", "a univ", "B"]), f"o{rng.randrange(6)}" if has(0.2) else None, f"s{rng.randrange(6)}" if has(0.15) else "" if has(0.1) else None, has(0.85)))
    return rows


def by_hand(spark, incoming, stored):
    """Row after row against all that is there, pairs scored by the full similarity."""
    both = spark.createDataFrame(stored + incoming, SCHEMA)
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    told = both.select("id", "is_active", F.coalesce(empty("name_en"), empty("name_zh")).alias("name"), *[empty(c).alias(c) for c in ("institution", "orcid_id", "scholar_id")])
    rec = lambda p: {c: F.col(f"{p}.{c}") for c in ("name", "institution", "orcid_id", "scholar_id")}
    same = lambda c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
    pairs = told.alias("a").join(told.alias("b"), F.col("a.id") > F.col("b.id")).select(F.col("a.id"), F.col("b.id"), record_similarity(rec("a"), rec("b")), F.col("b.is_active"), same("orcid_id"), same("scholar_id")).collect()
    there, out = {r[0] for r in stored}, {}
    for row in incoming:
        mine = [p for p in pairs if p[0] == row[0] and p[1] in there]
        near = sorted((-p[2], p[1]) for p in mine if p[3] and p[2] >= gate.HIGH)
        taken = sorted(p[1] for p in mine if p[4]) or sorted(p[1] for p in mine if p[5])
        out[row[0]] = ("duplicate", near[0][1]) if near else (("orcid_taken" if any(p[4] for p in mine) else "scholar_taken"), taken[0]) if taken else ("created", None)
        if out[row[0]][0] == "created":
            there.add(row[0])
    return out


def test_batches_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    stored, one, two = people(rng, range(40)), people(rng, range(40, 90)), people(rng, range(90, 130))
    store = Store(spark, str(tmp_path))
    gate.begin(store, spark.createDataFrame(stored, SCHEMA))
    seen = set()
    for batch in (one, two):
        want = by_hand(spark, batch, stored)
        got = {r["in_id"]: (r["decision"], r["id"]) for r in gate.admit(store, spark.createDataFrame(batch, SCHEMA)).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        # Who keeps a row out is fixed among the stored; of its own batch any created partner may be named first.
        assert all(got[k][1] == v[1] for k, v in want.items() if v[1] is not None and v[1] < batch[0][0])
        seen |= {v[0] for v in want.values()}
        stored = stored + [r for r in batch if want[r[0]][0] == "created"]
        assert {r["id"] for r in gate.persons(store).collect()} == {r[0] for r in stored}
    assert seen == {"created", "duplicate", "orcid_taken", "scholar_taken"}
    # Nothing is written again: a segment stays in the folder it was put in.
    assert store.manifest(1)["keys.000000"] == store.manifest(3)["keys.000000"] and len(store.manifest(3)) == 8
    before = {tuple(r) for r in gate.persons(store).collect()}
    gate.compact(store)
    assert store.vacuum() == 8 and sorted(store.manifest()) == ["keys.000003", "persons.000003"] and {tuple(r) for r in gate.persons(store).collect()} == before
    again = gate.admit(store, spark.createDataFrame([(900, *stored[0][1:])], SCHEMA)).first()
    assert again["in_id"] == 900 and store.versions()[-1] == 5


def test_empty_batches_and_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    empty = spark.createDataFrame([], SCHEMA)
    gate.begin(store, empty)
    assert gate.admit(store, empty).count() == 0
    assert [r["decision"] for r in gate.admit(store, spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)).collect()] == ["created"]
    with pytest.raises(Conflict):
        store.commit({"persons.000000": empty}, 1)


def test_namesakes_make_no_pairs(spark, tmp_path):
    stored = [(i, "某", "Wei Chen", "A Univ", f"o{i}" if i % 3 == 0 else None, None, i > 2) for i in range(30)]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    one = gate.index_rows(make(stored[4:5])).count()
    assert gate.index_rows(make(stored)).count() == one + 10
    steps = gate.Steps(spark)
    batch = make([(100 + i, "某", "chen WEI", "a univ", None, None, True) for i in range(20)])
    got = gate.kept_out(batch, make(stored), gate.index_rows(make(stored)), steps)
    assert {tuple(r)[:3] for r in got.collect()} == {(100 + i, "duplicate", 3) for i in range(20)}
    assert spark.read.parquet(steps.paths["stored-probes"]).select("in_id").distinct().count() == 1


def test_namesakes_of_a_batch(spark, tmp_path):
    # The smallest is inactive, the next has an id and is kept out by it, later ones meet the first active one without.
    batch = [(1, "某", "Wei Chen", "A", None, None, False), (2, "某", "Wei Chen", "A", "o1", None, True), (3, "某", "Wei Chen", "A", None, None, True), (4, "某", "Wei Chen", "A", None, None, True), (5, "某", "Wei Chen", "A", "o2", None, True), (6, "某", "Chen Wei", "A", None, None, True)]
    stored = [(0, "某", "Other", "B", "o1", None, True)]
    store = Store(spark, str(tmp_path))
    gate.begin(store, spark.createDataFrame(stored, SCHEMA))
    got = {r["in_id"]: (r["decision"], r["id"]) for r in gate.admit(store, spark.createDataFrame(batch, SCHEMA)).collect()}
    assert got == by_hand(spark, batch, stored)
