import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillmill.llm import decontamination, sharding, substring_dedup
from quillmill.llm.common import gram_hashes


def rng_words(rng, n, letters="abcdefgh", length=4):
    return ["".join(rng.choice(letters) for _ in range(length)) for _ in range(n)]


def repeats_truth(texts):
    words = [(t or "").encode().split() for t in texts]
    n = substring_dedup.WINDOW
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [500, 1])
def test_repeats_equal_brute_force(make, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST", most)
    rng = random.Random(5)
    passage, long = rng_words(rng, 60), rng_words(rng, 400)
    texts = [None, "", "short text", "And " * 100, "tick tock " * 90, " ".join(passage[:35]), " ".join(passage[:34])]
    texts += [" ".join(rng_words(rng, 20) + passage + rng_words(rng, 20)) for _ in range(12)]
    texts += [" ".join(long), " ".join(long[:200] + ["x"] + long[201:]), " ".join(long + long[100:180])]
    texts += [" ".join(rng.choice(["a", "b"]) for _ in range(120)) for _ in range(4)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.without_repeats(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_truth(texts)


def test_rows_given_twice_repeat_themselves(make):
    text = " ".join(rng_words(random.Random(1), 50))
    got = substring_dedup.without_repeats(make([(1, text), (1, text), (None, "a b")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 50, 50]
    assert substring_dedup.without_repeats(make(["a"]).where("false")).count() == 0


def test_index_counts_runs():
    rng = random.Random(2)
    segments = list({tuple(rng.randrange(4) for _ in range(rng.randrange(35, 50))) for _ in range(6)})
    segments += [segments[0][:40] + (9,) * 5]
    times = np.array([1] * len(segments))
    index = substring_dedup.FmIndex(np.array([w for s in segments for w in s]), np.array([len(s) for s in segments]), times)
    text = index.text
    for s, start in enumerate(index.starts):
        for n in (1, 3, 10):
            low, high = np.array([0]), np.array([index.n])
            for at in range(start + n - 1, start - 1, -1):
                low, high = index.extend(text[[at]], low, high)
            run = segments[s][:n]
            assert high[0] - low[0] == sum(t[i : i + n] == run for t in segments for i in range(len(t) - n + 1))


def test_grams_do_not_hang_on_their_place():
    a = np.arange(50, dtype=np.uint64)
    assert (gram_hashes(np.concatenate([a + 1000, a]), 12)[50:] == gram_hashes(a, 12)).all()


def decontamination_truth(docs, items):
    import regex

    split = regex.compile(r"[\p{L}\p{N}]+")
    shingled = {}
    for i, t in items.items():
        w = split.findall((t or "").lower())
        if len(w) >= 5:
            shingled[i] = (len(w), [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    having = Counter(x for _, s in shingled.values() for x in set(s))
    weigh = lambda xs: sum(1 / having.get(x, 1) for x in xs)
    out = {}
    for d, t in docs.items():
        w = split.findall((t or "").lower())
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, (n, own) in shingled.items():
            item, best = set(own), 0
            for a in range(-n + 5, len(s)):
                window = set(s[max(0, a) : max(0, a + n - 4)])
                if window & item:
                    best = max(best, weigh(window & item) / weigh(window | item))
            if best >= 0.75:
                out[d, i] = round(best, 4)
    return out


@pytest.mark.parametrize("inline, broadcast", [(20_000, 0), (0, 2_000_000), (0, 0)])
def test_leaks_equal_brute_force(spark, make, monkeypatch, inline, broadcast):
    monkeypatch.setattr(decontamination, "MAX_INLINE", inline)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", broadcast)
    rng = random.Random(7)
    items = {i: " ".join(rng_words(rng, rng.randrange(14, 50))) for i in range(6)} | {6: "too short", 7: None, 8: ""}
    items[9] = items[0]
    shared = items[1].split()[:10]
    items[10] = " ".join(shared + rng_words(rng, 20))
    docs = {0: None, 1: "", 2: "a b c", 3: " ".join(rng_words(rng, 300))}
    for k, i in enumerate((0, 1, 2, 3, 4, 10)):
        w = items[i].split()
        docs[10 + k] = " ".join(rng_words(rng, 30) + w + rng_words(rng, 30))
        docs[20 + k] = " ".join(x.upper() + "!!" for x in w)
        docs[30 + k] = " ".join(rng_words(rng, 9) + w[1:-1] + rng_words(rng, 9))
        docs[40 + k] = " ".join(rng_words(rng, 9) + w[: len(w) // 2] + rng_words(rng, 9))
    frame = make(list(docs.items()))
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 4) for r in decontamination.contaminated(frame, benchmark).collect()}
    want = decontamination_truth(docs, items)
    assert got == want and len(want) > 15
    left = {r.doc_id for r in decontamination.decontaminated(frame, benchmark).collect()}
    assert left == set(docs) - {d for d, _ in want}


def test_repeated_items_are_found_by_their_near_copies(spark, make):
    rng = random.Random(11)
    item = rng_words(rng, 50)
    near = item[:25] + ["changed"] + item[26:]
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i in range(10)], "item_id long, text string")
    got = {r.item_id: round(r.similarity, 4) for r in decontamination.contaminated(make([" ".join(near)]), benchmark).collect()}
    assert got == {i: round(41 / 51, 4) for i in range(10)}


def test_leaks_of_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(make(["a b c d e f"]), none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminated(make(["a"]).where("false"), some).count() == 0
    assert [r.doc_id for r in decontamination.decontaminated(make([(None, "x a b c d e f"), (None, "y")]), some).collect()] == [None]


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        fp, other = rng.getrandbits(64), 0
        flips = rng.sample(range(64), decontamination.RADIUS)
        other = fp
        for b in flips:
            other ^= 1 << b
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (fp, other))))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    from pyspark.sql import functions as F

    met = df.select("i", F.explode(F.arrays_zip(decontamination.blocks(F.col("a")).alias("x"), decontamination.blocks(F.col("b")).alias("y"))).alias("z")).where("z.x = z.y").select("i").distinct()
    assert met.count() == 200


def test_sharding_law_bytes(spark, make):
    rng = random.Random(6)
    docs = make([(i, "x" * int(rng.paretovariate(1.2) * 20)) for i in range(3000)] + [(None, None), (5, "again")])
    from pyspark.sql import functions as F

    records = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), sharding.virtual_slot().alias("virtual_slot"))
    slots = sharding.slot_bytes(records)
    first = sharding.plan(slots)
    placed = sharding.placed(records, first).collect()
    assert len(placed) == 3002
    loads, places = Counter(), {}
    for r in placed:
        loads[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r["bytes"] for r in slots.collect())
    assert max(loads.values()) - min(loads.values()) <= largest
    second = sharding.rebalanced(first, slots, 25)
    was, now = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, second))
    assert set(was) == set(now) and set(now.values()) == set(range(25)) and {r.version for r in second.collect()} == {2}
    assert sum(was[s] != now[s] for s in was) < 0.3 * len(was)
    assert sharding.plan(slots.where("false")).count() == 0


def test_short_items_are_found_as_whole_texts(spark, make):
    items = spark.createDataFrame([(1, "Two words"), (2, "..."), (3, None)], "item_id long, text string")
    docs = make([(1, "two  WORDS!"), (2, "two words more"), (3, ""), (4, None), (5, "two words two words two words")])
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontamination.contaminated(docs, items).collect()] == [(1, 1, 1.0)]


def test_map_is_stored_read_and_edited(spark, sf_dir, make):
    from pyspark.sql import functions as F

    rows = sharding.slot_map_edit(spark, sf_dir).collect()
    assert {r.map_version for r in rows} == {2} and max(r.shard for r in rows) < 24 and max(r.next_shard for r in rows) == 24
    loads = Counter()
    for r in rows:
        loads[r.next_shard] += r.bytes
        assert r.moved == (r.shard != r.next_shard)
    placed = sharding.op10_sharding(spark, sf_dir)
    was = {r.virtual_slot: r.shard for r in rows}
    assert all(was[r.virtual_slot] == r.shard for r in placed.collect())
    none = sharding.sized(make(["a"]).where("false"))
    folder = sharding._folder(spark)
    sharding.stored(sharding.plan(sharding.slot_bytes(none)), folder)
    assert sharding.placed(none, sharding.loaded(spark, folder)).count() == 0
    clash = make(["a", "b"]).withColumn("size", F.lit("x")).withColumn("virtual_slot", F.lit(-1)).withColumn("records", F.lit(0))
    assert sorted(r.size for r in sharding.sized(clash).collect()) == [9, 9]
