import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import centroids, html_text, spelling

# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_truth(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w, c in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * c else None
        out[w] = [c, len(around), form[w], words.get(form[w])]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def spelled(docs):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect()}


def word_rows(seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(base[: rng.randrange(1, 61)]) for _ in range(40)) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "Abcde ABCDE abcde"), (7, None), (8, ""), (9, "12 ., ×÷×÷× " * 3), (10, ("x" * 50_000 + " ") * 4), (11, ("x" * 49_999 + "-") * 3)] + [(3, texts[3])] * 2


@pytest.mark.parametrize("shard, group, block", [(1 << 17, 32 << 20, 1024), (10, 1, 7), (3, 4000, 2)])
def test_variants_equal_brute_force(make, monkeypatch, shard, group, block):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "GROUP_BYTES", group)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rows = word_rows() if shard > 3 else word_rows()[:12]
    assert spelled(make(rows).withColumn("word", F.lit(1)).withColumn("n", F.lit(2))) == variants_truth(rows)


def test_roots_follow_chains_and_ties_take_the_least(make):
    rows = [(1, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["zzzzz"] * 3 + ["zzzzy"] * 6 + ["yzzzz"] * 6))]
    got = spelled(make(rows))
    assert got == variants_truth(rows) and got["aaaaa"][4] == "aabbb" and got["zzzzz"][2] == "yzzzz"


def test_no_words(make):
    assert spelling.variants(make(["a b"])).count() == 0
    assert spelling.variants(make(["abcdef"] * 3).where("false")).count() == 0


@pytest.mark.parametrize("cut", [1000, 50, 3])
def test_automata_meet_each_near_word_once(cut):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))).encode("latin-1") for _ in range(400)})
    forest = spelling.Trie.forest([spelling.Trie.packed(words[i : i + cut], [1] * len(words[i : i + cut])) for i in range(0, len(words), cut)])
    a, b = forest.near(words)
    got = list(zip(a.tolist(), b.tolist()))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if i != j and near(x, y)}


# Main text


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randrange(1, 9)
        terminals = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        edges = [(a, b, rng.randrange(6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(t if x else s for x, (s, t) in zip(side, terminals)) + sum(c for a, b, c in edges if side[a] != side[b])

        every = list(itertools.product((False, True), repeat=n))
        least = min(map(cost, every))
        assert html_text.minimum_cut(terminals, edges) == list(max((x for x in every if cost(x) == least), key=sum))


S = "This is a proper sentence of the story, with enough words to look like one."
PAGE = f"""<!doctype html><html><head><title>T</title><script>var a="<p>x</p></head><body>";</script><style>p{{}}</style></head><body class="has-sidebar">
<header><a href=/>Home</a> <span>My Site</span></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your experience. {S}</p><button>OK</button></div>
<div id="content"><div class="post"><h1>Title of it</h1><p>{S}<p>Short.<p>{S} <a href=x>link</a>  more</p>
<div class="ad">{S} Buy now.</div><p>Tail &amp;amp; &lt;b&gt; end&nbsp;here.</p><ul><li>First item of list<li>Second item</ul></div>
<div id="comments"><h3>Comments</h3><article class="comment"><p>{S} I agree.</p></article><form><label>Name</label><textarea>{S}</textarea></form></div></div>
<aside><h3>Related</h3><p>{S}</p></aside><footer><p>&copy; 2020 All rights reserved. {S}</p></footer></body></html>"""
MAIN = "\n".join(["Title of it", S, "Short.", f"{S} link more", "Tail &amp; <b> end here.", "First item of list", "Second item"])


@pytest.mark.parametrize(
    "page, want",
    [
        (PAGE, MAIN),
        (f"<table><tr><td><a>Home</a> | <a>News</a></td></tr><tr><td>{S} {S}<br>{S}<p>Ok.<p>{S}</td></tr><tr><td>Copyright 2001</td></tr></table>", f"{S} {S} {S}\nOk.\n{S}"),
        (None, ""), ("", ""), ("<", ""), ("<!-- open", ""), ("<script>x", ""), ("<div hidden>secret text here.</div>", ""), (S, S), (f"<p>{S}</b></i></div>", S),
        (f"<form id=aspnet><main><p>{S}</p></main></form>", S),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<li><a>x</a>" * 30_000, '<a "' * 100_000, "<head>" * 30_000, "<select>" * 30_000, f"<p>{S}</p><div class=ad>b c d.</div>" * 10_000])
def test_long_pages_take_linear_time(page):
    import time

    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 20


def test_pages_of_the_table(spark, sf_dir):
    """Of the given pages the article is what stands between its tags."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op12_main_text(spark, sf_dir).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")].replace("<b>", "")
        parts = [" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split("</?(?:h1|p)>", article)]
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id] == (want, len(want))


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extracted(pages).collect()) == [(0, "", 0), (1, MAIN, len(MAIN)), (1, MAIN, len(MAIN))]
    assert html_text.extracted(pages.where("false")).count() == 0


# Centroids


def lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    means = [v for _, v in sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))][:k]
    for at in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in means] for _, v in kept]
        own = [min(range(len(means)), key=lambda c: (x[c], c)) for x in d]
        if at < rounds:
            for c in set(own):
                mine = [v for (_, v), o in zip(kept, own) if o == c]
                means[c] = [sum(x) // len(mine) for x in zip(*mine)]
    sums = Counter()
    for x, o in zip(d, own):
        sums[o] += x[o]
    return sorted((i or -1, o, x[o], sums[o], sum(sums.values()), hashlib.sha256(",".join(map(str, means[o])).encode()).hexdigest()) for (i, _), x, o in zip(kept, d, own))


def clustered(spark, rows):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    found = centroids.clustered(table).collect()
    return sorted((r.vec_id or -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found)


def vector_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, 64)) / 8 + rng.integers(0, 6, (n, 1))
    v[:: max(3, n // 100)] = v[0]
    return [(i, x.tolist()) for i, x in enumerate(v)]


def test_clusters_equal_full_scans(spark):
    rows = vector_rows(300)
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [None] + [1.0] * 63), (1003, [float("nan")] + [1.0] * 63), (1004, [float("inf")] + [1.0] * 63), (None, [0.5] * 64), (5, rows[5][1]), (1005, [])]
    assert clustered(spark, rows + odd) == lloyd(rows + odd)


@pytest.mark.parametrize("n", [1, 5, 16, 40])
def test_few_vectors(spark, n):
    rows = vector_rows(n, n)
    assert clustered(spark, rows) == lloyd(rows)


def test_no_vectors(spark):
    assert clustered(spark, [(1, None)]) == []


def test_filters_skip_distances_and_drop_no_winner():
    rng = np.random.default_rng(3)
    middle = rng.integers(-400, 400, (16, 64))
    v = middle[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 64))
    v[::3] = v[0]
    c, before = v[[int(np.flatnonzero((v != v[0]).any(1))[i * 7]) for i in range(16)]].copy(), None
    group, taken = centroids.grouped(c, 4), []
    for at in range(6):
        yinyang = centroids.Yinyang(c, group, before)
        if at:
            cluster, _, upper, lower, n = yinyang.next(v, cluster, upper, lower)
            taken.append(n)
        else:
            cluster, _, upper, lower = yinyang.first(v)
        assert (centroids.squared(v, c).argmin(1) == cluster).all()
        before, c = c, c.copy()
        for k in set(cluster.tolist()):
            c[k] = v[cluster == k].sum(0) // int((cluster == k).sum())
    assert min(taken) < 4000 * 16 / 4
