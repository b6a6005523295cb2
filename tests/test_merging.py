import json
import os

from pyspark.sql import functions as F

from quillmill.operators import graph, merging, metrics, stored


def test_chains_circles_and_forks_end_in_one_person(spark):
    pairs = [(1, 2), (2, 3), (4, 3), (10, 11), (11, 10), (20, 22), (20, 21), (30, 30), (None, 5), (6, None), (1, 2)]
    got = {r.source_id: r.target_id for r in merging.final_targets(spark.createDataFrame(pairs, "source_id int, target_id int")).collect()}
    assert got == {1: 3, 2: 3, 4: 3, 11: 10, 20: 21, 22: 21}
    assert merging.final_targets(spark.createDataFrame([], "source_id int, target_id int")).count() == 0


def test_gaps_names_and_metadata_are_filled_in_order(spark):
    rows = [
        (3, True, None, "", None, ["C", "X"], '{"k": {"deep": [1, 2]}, "t": null}'), (1, True, "a@x", "bio a", "0-1", ["A", "C"], '{"k": 1, "s": "one", "merged": false}'), (2, True, "b@x", "bio b", "0-2", None, '{"s": 2, "u": "quo\\"te"}'),
        (4, False, None, None, None, [], "no json"), (5, True, None, None, "0-5", ["E"], None),
    ]
    persons = spark.createDataFrame(rows, "id int, is_active boolean, email string, bio string, orcid string, names array<string>, metadata string")
    ends = spark.createDataFrame([(1, 3), (2, 3), (4, 3)], "source_id int, target_id int")
    got = {r.id: r for r in merging.merged(persons, ends, ["email", "bio"], ["orcid"], "names", "metadata", "2024-01-01").collect()}
    assert (got[3].email, got[3].bio, got[3].orcid, got[3].names, got[3].is_active) == ("a@x", "bio a", "0-1", ["C", "X", "A"], True)
    meta = json.loads(got[3].metadata)
    assert meta == {"k": {"deep": [1, 2]}, "t": None, "s": "one", "u": 'quo"te', "merged": True, "mergedFrom": 4, "mergedAt": "2024-01-01"}
    assert [(got[i].is_active, got[i].orcid) for i in (1, 2, 4, 5)] == [(False, None), (False, "0-2"), (False, None), (True, "0-5")]  # only the id that moved is cleared
    assert got[5].metadata is None and got[5].names == ["E"]


def test_children_move_once_to_the_end(spark):
    rows = [(1, 3, "d1"), (2, 1, "d1"), (3, 1, "d2"), (4, 2, "d2"), (5, 2, None), (6, 1, None), (7, 9, "d2"), (8, 3, "d1")]
    children = spark.createDataFrame(rows, "id int, person_id int, doi string")
    ends = spark.createDataFrame([(1, 3), (2, 3)], "source_id int, target_id int")
    assert {r.id: r.person_id for r in merging.moved_children(children, ends, "doi").collect()} == {1: 3, 2: 1, 3: 3, 4: 2, 5: 3, 6: 3, 7: 9, 8: 3}
    assert {r.person_id for r in merging.moved_children(children, ends).collect()} == {3, 9}


def test_components_and_ranks_leave_one_table_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "scratch", lambda spark: str(tmp_path))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    assert {(r.id, r.component) for r in graph.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id int")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(4) if i != j], "from_id int, to_id int, weight double")
    ranks = {r.id: r.rank for r in graph.pagerank(nodes, edges).collect()}
    assert ranks[4] < ranks[0] and abs(ranks[0] - ranks[3]) < 1e-9
    assert {r.community for r in graph.communities(nodes, edges).collect()} <= {0, 1, 4}
    tables = [t for d in os.listdir(tmp_path) for t in os.listdir(tmp_path / d)]
    assert sorted(t.split("-")[0].rstrip("01") for t in tables) == ["labels", "labels", "ranks"]


def test_label_propagation_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = {(min(a, b), max(a, b)): rng.choice([0.5, 1.0]) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(50)) if a != b}
    both = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    labels = {i: i for i in range(25)}
    for _ in range(20):
        new = {}
        for i in labels:
            heard = {}
            for a, b, w in both:
                if a == i:
                    heard[labels[b]] = heard.get(labels[b], 0) + w
            new[i] = min(heard, key=lambda c: (-heard[c], c)) if heard else labels[i]
        if new == labels:
            break
        labels = new
    got = graph.communities(spark.range(25).select(F.col("id").cast("int").alias("id")), spark.createDataFrame(both, "from_id int, to_id int, weight double"))
    assert {r.id: r.community for r in got.collect()} == labels


def test_errors_by_type(spark):
    rows = [("a", None), ("a", "timeout"), ("a", "timeout"), ("a", "dns"), ("b", None), (None, "dns")]
    got = {r.key: (r.requests, r.succeeded, r.failed, r.errors) for r in metrics.errors_by_type(spark.createDataFrame(rows, "key string, kind string"), "key", "kind").collect()}
    assert got == {"a": (4, 1, 3, {"dns": 1, "timeout": 2}), "b": (1, 1, 0, {}), None: (1, 0, 1, {"dns": 1})}


def test_a_look_up_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200_000).select((F.col("id") * 2).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    stored.write_for_lookup(rows, path, "id", 5_000)

    def read(value):
        found = stored.looked_up(spark, path, "id", value)
        return found.count(), found._jdf.queryExecution().executedPlan().toString()

    count, plan = read(12_346)
    assert count == 1 and "EqualTo(id,12346)" in plan
    assert read(12_347)[0] == 0
    import pyarrow.parquet as pq

    groups = [g for f in sorted((tmp_path / "t").glob("*.parquet")) for g in (lambda m: [m.row_group(i) for i in range(m.num_row_groups)])(pq.ParquetFile(f).metadata)]
    holding = [g for g in groups if g.column(0).statistics.min <= 12_346 <= g.column(0).statistics.max]
    assert len(groups) >= 40 and len(holding) == 1 and max(g.num_rows for g in groups) <= 5_000


def test_edges_are_counted_in_as_many_parts_as_pairs_ask_for(spark, monkeypatch):
    rows = [(p, a) for p in range(6) for a in range(p + 1)] + [(1, 0), (None, 1), (None, 2), (3, None)]
    papers = spark.createDataFrame(rows, "paper_id int, person_id int")
    monkeypatch.setattr(graph, "PAIRS", 5)
    edges = graph.coauthor_edges(papers)
    want = {(a, b): 6 - max(a, b) for a in range(6) for b in range(6) if a != b}
    assert {(r.from_id, r.to_id): r.papers for r in edges.collect()} == want
    assert edges.rdd.getNumPartitions() >= 35 // 5  # pairs of 0 to 5 others a paper
    assert {(r.from_id, r.to_id) for r in graph.coauthor_edges(papers, 3).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_many_nodes_are_joined_without_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1), (3, 4), (4, 3))], "from_id int, to_id int, weight double")
    nodes = spark.range(5).select(F.col("id").cast("int").alias("id"))
    tell = lambda: (sorted(map(tuple, graph.communities(nodes, edges, most=2).collect())), sorted((r.id, round(r.rank, 9)) for r in graph.pagerank(nodes, edges, most=2).collect()))
    small = tell()
    monkeypatch.setattr(graph, "MAX_BROADCAST", 0)
    assert tell() == small
