import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.llm import exact_dedup, near_dedup

EDGES = [None, "", " \n", "a", "A b", "a b", "ab", "a  b\t", " a", "x " * 30_000]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_equals_brute_force(make):
    texts = EDGES + ["same text here"] * 5 + ["same  text here"]
    got = rows(exact_dedup.exact_duplicates(make(texts), digest_all=True))
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for i, b in enumerate(bare):
        group = [j for j, x in enumerate(bare) if x == b]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].full_hash) == (keep, len(group), keep == i, hashlib.sha256(b.encode()).hexdigest())


def test_full_hash_only_where_length_and_prefix_repeat(make):
    got = rows(exact_dedup.exact_duplicates(make(["abc", "abd", "xyz", "xyz"])))
    assert [got[i].full_hash is None for i in range(4)] == [True, True, False, False]


def test_repeated_rows_and_null_ids(make):
    docs = make([(1, "t"), (1, "t"), (None, "t"), (2, "u"), (None, "v")])
    kept = exact_dedup.without_copies(docs)
    assert sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "t"), (False, "u"), (True, "v")]
    assert kept.columns == docs.columns
    assert sum(r.kept for r in exact_dedup.exact_duplicates(docs).collect()) == 3


def test_clashing_columns_survive(make):
    docs = make(["a", "a", "b"]).withColumn("kept", F.lit(1)).withColumn("norm", F.lit("n")).withColumn("node", F.lit(2)).withColumn("copy", F.lit(3))
    assert exact_dedup.without_copies(docs).count() == 2
    assert near_dedup.without_near_copies(docs).columns == docs.columns


def test_empty(make):
    docs = make(["a"]).where("false")
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0


def near_truth(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, line = [word() for _ in range(80)], [word() for _ in range(12)]
    out = list(EDGES) + ["one two", "One TWO", "a b c d e", "A b c d e"]
    for _ in range(60):  # near copies of one text, many of them too far from one another
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(80)] = word()
        out.append(" ".join(copy))
    out += [" ".join(line + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(40)]  # a common line
    return out + out[20:30]


@pytest.mark.parametrize("block, large, centres", [(256, 4096, 2), (4, 8, 0)])
def test_near_equals_brute_force(make, monkeypatch, block, large, centres):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "CENTRES", centres)
    texts = near_texts()
    got = rows(near_dedup.near_duplicates(make(texts)))
    want = near_truth(texts)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(texts)))


def test_pairs_of_large_buckets_need_one_band_only(make, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 1)
    monkeypatch.setattr(near_dedup, "CENTRES", 0)
    hashes, rng, texts = near_dedup.WordHashes(), random.Random(5), []
    while len(texts) < 4:
        n = rng.randrange(10**9)
        words = [f"w{n}x{i}" for i in range(700)]
        pair = [" ".join(words[:600]), " ".join(words[85:685])]  # 511 of 681 shingles, Jaccard just over 0.75
        a, b = (near_dedup.registers(near_dedup.shingle_set(t, hashes))[: near_dedup.ROWS * near_dedup.BANDS].reshape(-1, near_dedup.ROWS) for t in pair)
        if 1 <= (a == b).all(1).sum() < 4:
            texts += pair
    got = rows(near_dedup.near_duplicates(make(texts)))
    assert [got[i].component_id for i in range(4)] == [c for _, c in near_truth(texts)] == [0, 0, 2, 2]


def test_null_ids_are_not_linked(make):
    got = near_dedup.near_duplicates(make([(None, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (4, 3, False)]


def near_copies(n, words=60):
    base = [f"a{i}" for i in range(words)]
    return [" ".join(base[:-1] + [f"z{k}"]) for k in range(n)]


@pytest.mark.parametrize("n", [2, 3, 600])
def test_a_centre_may_close_every_bucket(make, n):
    docs = make(near_copies(n))
    assert {(r.component_id, r.kept == (r.doc_id == 0)) for r in near_dedup.near_duplicates(docs).collect()} == {(0, True)}
    assert [r.doc_id for r in near_dedup.without_near_copies(docs).collect()] == [0]


@pytest.mark.parametrize("large, centres", [(1, 0), (1, 1), (2, 2), (4, 1)])
def test_every_level_may_close_early(make, monkeypatch, large, centres):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "CENTRES", centres)
    texts = near_copies(5) + [t.replace("a", "b") for t in near_copies(3)] + ["alone " * 7, "x y z"]
    got = rows(near_dedup.near_duplicates(make(texts)))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == near_truth(texts)


def test_sets_that_share_an_id_are_all_compared(make):
    one, two = near_copies(3), [t.replace("a", "b") for t in near_copies(2)]
    docs = make([(1, one[0]), (1, two[0]), (5, one[1]), (6, two[1]), (7, one[2]), (1, one[0])])
    found = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert found == [(1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (7, 1)]
    assert near_dedup.without_near_copies(docs).count() == 1


def test_a_bucket_lets_out_a_spanning_forest(spark, make):
    """400 mutually similar sets of one bucket: 79,800 links, 399 pairs."""
    docs, hashes = near_copies(400), near_dedup.WordHashes()
    sets = [near_dedup.shingle_set(t, hashes) for t in docs]
    registers = [bytes(near_dedup.registers(s).astype(">u2").tobytes()) for s in sets]
    nodes = spark.createDataFrame([(i, len(s), r) for i, (s, r) in enumerate(zip(sets, registers))], "node long, n long, registers binary")
    held = spark.createDataFrame([(i, s.view("int64").tolist()) for i, s in enumerate(sets)], "node long, hashes array<bigint>")
    bucket = nodes.select(F.lit(7).cast("long").alias("key"), F.array(F.lit(0)).alias("bands"), "node", "n", F.col("node").alias("comp"), F.lit(400).cast("long").alias("members"))
    first = [r[: 2 * near_dedup.ROWS] for r in registers]
    alike = [i for i, f in enumerate(first) if f == first[0]]
    pairs = near_dedup._likely_in_blocks(bucket.where(F.col("node").isin(alike)), nodes, held).count()
    assert len(alike) > 100 and pairs == len(alike) - 1


def test_clashing_names_survive_near_copies(make):
    docs = make(near_copies(2)).withColumn("place", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("_copy", F.lit(3)).withColumn("row", F.lit(4))
    kept = near_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
