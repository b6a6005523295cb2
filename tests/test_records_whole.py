"""Queries over whole tables: nothing is left out by date or id."""

import datetime

from quillmill.operators import matching
from quillmill.plans.registry import QUERIES

LINES = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate date"


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_graphs_of_all_papers(spark, tmp_path):
    when = datetime.date(1995, 1, 1)
    table(spark, tmp_path, "supplier", [(i, 100.0) for i in (1, 2, 3, 4)], "s_suppkey long, s_acctbal double")
    table(spark, tmp_path, "orders", [(10, when), (11, when)], "o_orderkey long, o_orderdate date")
    table(spark, tmp_path, "lineitem", [(o, s, s, 1.0, when) for o in (10, 11) for s in (1, 2, 3)], LINES)
    edges = {(r.from_id, r.to_id): r.papers for r in QUERIES["coauthor_edges"](spark, str(tmp_path)).collect()}
    assert edges == {(a, b): 2 for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    ranks = {r.id: r.coauthors for r in QUERIES["pagerank_converged"](spark, str(tmp_path)).collect()}
    assert ranks == {1: 2, 2: 2, 3: 2, 4: 0}
    one = {r.id: r.rank for r in QUERIES["pagerank_one_iteration"](spark, str(tmp_path)).collect()}
    assert one[1] == one[2] == one[3] > one[4]
    assert {r.id: r.community for r in QUERIES["label_propagation"](spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_feed_links_every_person(spark, tmp_path):
    rows = [(i, text, "en", "s", len(text)) for i, text in ((13, "Quill mills"), (24, "quill again"), (25, "other words"))]
    table(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.id: r.person_id for r in QUERIES["personal_feed"](spark, str(tmp_path)).collect()}
    assert got == {13: 13, 24: 13, 25: 25}


def test_partial_matches_of_every_part(spark, tmp_path):
    table(spark, tmp_path, "part", [(1, "a b c"), (2, "x y"), (299, "a b d"), (300, "y x"), (4000, "c a q b"), (4001, "a q r")], "p_partkey long, p_name string")
    table(spark, tmp_path, "supplier", [(1,), (2,)], "s_suppkey long")
    got = {r.left_id: (r.right_id, r.similarity) for r in QUERIES["token_best_match"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0), 299: (1, 0.5), 300: (2, 1.0), 4000: (1, 0.75)}


def test_names_held_or_swapped_meet(spark):
    names = ["li wei", "li weiming zhang", "smith", "john smithson-hathaway", "wei", "zhang weiguo", "aa bbbbbbbbbb", "bbbbbbbbbb aa", "w", "li", "", "other name"]
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(names)], "id int, institution string, name string")
    got = {(r.a_id, r.b_id) for r in matching.similar_names(df, 0.7).collect()}
    held = {(i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if a in b or b in a}
    assert got == held | {(6, 7)}


def test_candidates_by_held_name_and_institution(spark):
    columns = "id long, name_zh string, name_en string, institution string, is_active boolean"
    stored = spark.createDataFrame([(1, None, "Prof. Wei Zhang (Physics Group)", "MIT", True), (2, None, "Ann Lee", "Mit, Cambridge", True), (3, None, "Bo Li", "ETH", True), (4, None, "Wei Zhang Jr", "MIT", False)], columns)
    new = spark.createDataFrame([(10, None, "wei zhang", "mit", True), (11, None, "Nobody Known", "MIT", True)], columns)
    assert {(r.in_id, r.id) for r in matching.candidates(new, stored, ()).collect()} == {(10, 1), (10, 2)}


def test_copies_of_a_name_make_no_pairs(spark):
    make = lambda names, first: spark.createDataFrame([(first + i, n) for i, n in enumerate(names)], "id long, name string")
    left, right = make(["a b", "B  a", "a c", "x", "", None] * 40, 0), make(["b a", "a", "c d", " "] * 30, 1000)
    best = matching.best_token_matches(left, right)
    plain = matching.best_matches(matching.token_matches(left, right))
    assert {tuple(r) for r in best.collect()} == {tuple(r) for r in plain.collect()} and best.count() == 120
    # Two ways to write one right name, so two names on either side meet, not 120 and 90 rows.
    joins = [line for line in best._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any("left_id" in line and "right_id" in line for line in joins)


def test_names_are_made_ready_once_a_person(spark, sf_dir):
    lines = QUERIES["duplicate_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("regexp_replace" in line for line in lines[:join]) and any("regexp_replace" in line for line in lines[join:])
