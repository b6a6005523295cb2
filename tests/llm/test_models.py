import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from quillmill.llm import bpe, language_id, token_counts, toxicity
from quillmill.llm.common import documents

ODD = [None, "", "<|endoftext|> a  <|endoftext|>\n\n x", "a" * 3000, " " * 50 + "x", "\x1c\x1d a\x85b  　 é漢字😀 1234½ it's we'll'D", "\r\n\t x\x0b\x0c y\xa0z", "the quick brown fox " * 2000]


def test_bpe_equals_the_library(make):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cé\n\t'sdl1²½漢😀‍\x1f́") for _ in range(200)) for _ in range(60)]
    tok = Tokenizer.from_file(bpe.default_path())
    rows = bpe.encoded(make(texts), ids=True)
    got = {r.doc_id: r for r in rows.collect()}
    back = {r.doc_id: r.text for r in bpe.decoded(rows).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and back[i] == text
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_merges_only_build_on_earlier_ones():
    b = bpe.Bpe(bpe.default_path())
    made = {i: -1 for i in b.first}
    for rank, (left, right, whole) in enumerate(b.merges):
        assert made[left] < rank and made[right] < rank and whole not in made
        made[whole] = rank


def test_token_counts_equal_brute_force(make):
    texts = ODD[:1] + ["", "the cat sat on the mat", "zzqxv", "naïve 漢字 😀", "a" * 300]
    costs = token_counts.piece_costs(token_counts.default_path())
    trie = token_counts.TrieCounts(token_counts.default_path())

    def count(word):
        best = [(0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = min((best[s][0] + costs[word[s:end]] // token_counts._TOKEN, best[s][1] + 1) for s in range(end) if word[s:end] in costs)
        return best[-1][1]

    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [sum(count(p.encode()) for p in trie.pattern.findall(t or "")) for t in texts]


def test_shared_prefixes_are_worked_out_once():
    trie = token_counts.TrieCounts(token_counts.default_path())
    trie.learn({"abcd", "abce", "abcf", "ab"})
    assert trie.nodes == 6


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, trans, start = rng.random((6, 3)), rng.random((3, 3)), rng.random(3)
    start /= start.sum()
    first = np.array([1, 0, 0, 0, 0, 0, 1, 0], bool)
    got = language_id.posteriors(np.concatenate([e, e[:2]]), first, trans, start)
    for sequence, at in ((e, 0), (e[:2], 6)):
        want = np.zeros(sequence.shape)
        for y in itertools.product(range(3), repeat=len(sequence)):
            p = start[y[0]] * sequence[0, y[0]]
            for t in range(1, len(sequence)):
                p *= trans[y[t - 1], y[t]] * sequence[t, y[t]]
            for t, k in enumerate(y):
                want[t, k] += p
        assert np.allclose(got[at : at + len(sequence)], want / want.sum(1, keepdims=True))


def test_blocks_of_long_texts_agree_with_plain_recursion():
    rng = np.random.default_rng(1)
    e, trans, start = rng.random((700, 4)) + 1e-3, rng.random((4, 4)) + 0.01, np.full(4, 0.25)
    alpha, a = [], None
    for t in range(700):
        a = (start if a is None else a @ trans) * e[t]
        a /= a.sum()
        alpha.append(a)
    z, want = np.ones(4), []
    for t in range(699, -1, -1):
        g = alpha[t] * z
        want.append(g / g.sum())
        z = trans @ (e[t] * z)
        z /= z.sum()
    assert np.allclose(language_id.posteriors(e, np.arange(700) == 0, trans, start), np.array(want)[::-1])


def test_language_held_out(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.op1_language_id(spark, sf_dir).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words_are_labelled():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    texts = [("x", " ".join(word("abc") for _ in range(60))) for _ in range(10)] + [("y", " ".join(word("mno") for _ in range(60))) for _ in range(10)]
    crf = language_id.fit(texts, words=3000)
    words = [word("abc") for _ in range(10)] + [word("mno") for _ in range(10)]
    gamma = language_id.posteriors(crf.emissions(words), np.arange(20) == 0, crf.transitions, crf.start)
    assert [crf.langs[k] for k in gamma.argmax(1)] == ["x"] * 10 + ["y"] * 10


def test_language_edges(make):
    crf = language_id.fit([("en", "the of and this with " * 20), ("de", "der die und nicht mit " * 20)], words=1000)
    got = {r.doc_id: r for r in language_id.predictions(make([None, "", "123 !!", "the and of", "und nicht die"]), crf).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert {r.lang_pred for r in language_id.predictions(make(["a"]), None).collect()} == {"und"}
    assert language_id.train(make(["a"], lang=None)) is None
    assert [r.text for r in language_id.identified(make([None, "12", "the and of"]), crf).collect()] == ["the and of"]


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        words, toxic = [word() for _ in range(30)], i % 4 == 1
        if toxic:
            words.insert(rng.randrange(30), rng.choice(["zorkish", "vilezork"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    got = {r.doc_id: r.score for r in toxicity.scores(frame, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == (i % 4 == 1) for i in held]) > 0.97


def test_toxicity_edges(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scores(make([None, "", "words"]), toxicity.train(make(["a"]), none)).collect()
    assert len(got) == 3 and all(0 <= r.score < toxicity.THRESHOLD for r in got)
    twice = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(make(["bad", "good"]), twice).bias > 0


def test_long_texts_go_in_pieces_without_loss(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["w%d" % i for i in rng.integers(0, 60, 900)]
    trans = rng.random((3, 3)) + 0.01
    crf = language_id.Crf(["a", "b", "c"], rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32), {}, np.zeros((0, 3)), trans, np.array([0.2, 0.3, 0.5]))
    whole = language_id.Predictor(crf)([words])
    for piece in (899, 300, 128, 101):
        monkeypatch.setattr(language_id, "_FLUSH_WORDS", piece)
        got = language_id.Predictor(crf)([words])
        assert got[0] == whole[0] and np.allclose(got[1], whole[1])


def test_language_query_on_odd_tables(spark, make):
    from pyspark.sql import functions as F

    rows = [(i, "the cat and the dog of this house") for i in range(6)] + [(i, "el gato y la casa de los dos") for i in range(6, 12)]
    docs = make(rows + [(3, rows[3][1]), (None, None), (20, ""), (21, "12 34")]).withColumn("lang", F.when(F.col("doc_id") < 6, "en").otherwise("es"))
    docs = docs.withColumn("score", F.lit(7)).withColumn("lang_pred", F.lit("x"))
    crf = language_id.train(docs)
    got = language_id.predictions(docs, crf)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 16
    told = {}
    for r in got.collect():
        assert told.setdefault(r.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score)  # repeated rows alike
    assert told[20] == told[21] == told[None] == ("und", 0.0) and {told[i][0] for i in range(6)} == {"en"} and {told[i][0] for i in range(6, 12)} == {"es"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.train(none) is None
    assert language_id.identified(none, None).count() == docs.count()
    assert language_id.predictions(docs.where("false"), crf).count() == 0


def test_counts_and_scores_on_odd_tables(spark, make):
    from pyspark.sql import functions as F

    docs = make([(1, "same words"), (1, "same words"), (None, None), (2, ""), (3, "bad bad bad")]).withColumn("n_tokens", F.lit(1)).withColumn("score", F.lit(1))
    counts = sorted(((r.doc_id or 0), r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert counts[0] == (0, 0) and counts[1] == counts[2] and counts[3] == (2, 0)
    assert token_counts.token_counts(docs.where("false")).count() == bpe.encoded(docs.where("false")).count() == 0
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.scores(docs, model).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id == 1}) == 1
    assert toxicity.scores(docs.where("false"), model).count() == 0
    nothing = toxicity.train(docs, labels.where("false"))
    assert max(r.score for r in toxicity.scores(docs, nothing).collect()) < 0.01


def test_toxicity_ratios_equal_plain_counts():
    texts = ["aa bb", "aa cc", "bb cc dd", "aa"] * 3
    toxic = np.array([1, 0, 0, 1] * 3)
    model = toxicity.fit(texts, toxic, np.ones(12), least_ratio=0.0, least_support=1, rounds=1)
    words = ["aa", "bb", "cc", "dd"]
    at, features = toxicity.char_grams(words, toxicity.SIZES, toxicity.BITS)
    counts = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, toxic):
        for w in set(text.split()):
            counts[label].update(features[at == words.index(w)].tolist())
    size = 1 << toxicity.BITS
    plain = {f: np.log((counts[1][f] + 1) / (sum(counts[1].values()) + size)) - np.log((counts[0][f] + 1) / (sum(counts[0].values()) + size)) for f in set(features.tolist())}
    # After one step of the fit every coefficient has moved by the same amount; n-grams that both classes have alike stay.
    for f, ratio in plain.items():
        assert counts[0][f] == counts[1][f] or np.isclose(abs(model.weights[f]), 0.05 * abs(ratio), rtol=1e-3)
