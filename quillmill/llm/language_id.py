"""Language of texts by a linear-chain conditional random field over words.

Each word's label is a language. Features of a word: hashed character n-grams with the word's ends (affixes and inner
n-grams) and its entry in a lexicon of the training words. Transitions between languages are learned from sequences in
which runs of different documents, often of different languages, follow one another, as in code-switched text.
Inference is exact forward-backward over the whole text; a document's language has the largest mean posterior.

The model is fitted on the driver on a bounded sample: at most about `docs_per_lang` labelled documents of each of the
`most_langs` most frequent languages (drawn by a hash of doc_id; texts of over `most_chars` characters are not learned
from) and `words` words. Everything else runs over whole texts, a bounded number of words at a time; a longer text goes
through forward-backward in pieces that hand their messages on, which is exact.

Null text, and text without a letter, is `und` with score 0. Without any labelled row every text is `und`, and
`identified` rejects nothing. A language unseen in training is never predicted. Repeated rows are predicted alike; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .ngrams import WordRows, char_grams

UNKNOWN = "und"
#: Bounds of the training sample.
DOCS_PER_LANG, TRAIN_WORDS, MOST_LANGS, MOST_CHARS = 250, 120_000, 200, 200_000
SIZES, BITS = (2, 3, 4, 5), 17
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_STEPS, _FLUSH_WORDS = 128, 100_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def held_out(column: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


@dataclass
class Crf:
    langs: list[str]
    grams: np.ndarray  # feature, language
    lexicon: dict[str, int]
    lexical: np.ndarray  # lexicon entry, language
    transitions: np.ndarray  # from, to
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores: word, language."""
        at, features = char_grams(words, SIZES, BITS)
        out = np.column_stack([np.bincount(at, self.grams[features, k], len(words)) for k in range(len(self.langs))])
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            i, j = np.array(known).T
            out[i] += self.lexical[j]
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        scores = self.scores(words)
        return np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0))


def _products(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each block of words (block, step, label): what it makes of the message that comes in, as a matrix up to a factor."""
    product = np.broadcast_to(np.eye(e.shape[2]), (len(e), e.shape[2], e.shape[2])).copy()
    for t in range(e.shape[1]):
        step = product @ transitions
        if first[:, t].any():
            step[first[:, t]] = product[first[:, t]].sum(2, keepdims=True) * start
        product = step * e[:, t, None, :]
        if t % 8 == 7:
            product /= product.max((1, 2), keepdims=True)
    return product


def posteriors(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each label at each word. e: emissions of the words of many texts in a row; first: words that begin a text.

    Exact: blocks of _STEPS words are multiplied up side by side, then the messages between blocks, then those inside.
    before, behind: the messages that come in from what stands before and behind, where e is a piece of a text.
    """
    n, k = e.shape
    blocks = -(-n // _STEPS)
    pad = blocks * _STEPS - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, _STEPS, k)
    first = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, _STEPS)
    product = _products(e, first, transitions, start)
    forward, backward = np.empty((blocks, k)), np.empty((blocks, k))
    message = np.full(k, 1 / k) if before is None else before
    for b in range(blocks):
        forward[b] = message
        message = message @ product[b]
        message /= message.sum()
    message = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        backward[b] = message
        if behind is not None and b == blocks - 1:
            rest = n - b * _STEPS
            message = _products(e[b : b + 1, :rest], first[b : b + 1, :rest], transitions, start)[0] @ behind
        else:
            message = product[b] @ message
        message /= message.sum()
    alpha, a = np.empty_like(e), forward
    for t in range(_STEPS):
        a = np.where(first[:, t, None], start, a @ transitions) * e[:, t]
        a = a / a.sum(1, keepdims=True)
        alpha[:, t] = a
    z = backward
    if behind is not None:  # it comes in at the last word, not behind the padding
        last = n - 1 - (blocks - 1) * _STEPS
    for t in range(_STEPS - 1, -1, -1):
        if behind is not None and t == last:
            z[-1] = behind
        gamma = alpha[:, t] * z
        alpha[:, t] = gamma / gamma.sum(1, keepdims=True)
        z = np.where(first[:, t, None], 1.0, (e[:, t] * z) @ transitions.T)
        z = z / z.sum(1, keepdims=True)
    return alpha.reshape(-1, k)[:n]


def _sequences(texts: list[tuple[str, list[str]]], langs: list[str], words: int, length: int, rng) -> tuple[list[list[str]], np.ndarray]:
    """Word sequences with labels: runs of 4 to 2 * length words drawn from texts of random languages, cut to one length."""
    by = {k: [w for lang, w in texts if lang == k] for k in langs}
    stream, labels = [], []
    while len(stream) < words:
        k = int(rng.integers(len(langs)))
        text = by[langs[k]][int(rng.integers(len(by[langs[k]])))]
        at = int(rng.integers(len(text)))
        run = text[at : at + int(rng.integers(4, 2 * length))]
        stream += run
        labels += [k] * len(run)
    n = len(stream) // length
    return [stream[i * length : (i + 1) * length] for i in range(n)], np.array(labels[: n * length]).reshape(n, length)


def fit(texts: list[tuple[str, str]], words: int = TRAIN_WORDS, length: int = 24, epochs: int = 3, batch: int = 128, rate: float = 0.3, seed: int = 7) -> Crf | None:
    """Maximum likelihood by AdaGrad; texts: (lang, text), in any order. None without a usable text."""
    split = sorted((lang, found) for lang, text in texts if lang and (found := words_of(text)))
    langs = sorted({lang for lang, _ in split})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    sequences, labels = _sequences(split, langs, words, length, rng)
    counts = Counter(w for s in sequences for w in s)
    vocabulary = sorted(counts)
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([[place[w] for w in s] for s in sequences])
    lexicon = {w: i for i, w in enumerate(w for w in vocabulary if counts[w] >= 3)}
    lexical_of = np.array([lexicon.get(w, len(lexicon)) for w in vocabulary])
    at, features = char_grams(vocabulary, SIZES, BITS)
    order = np.argsort(at, kind="stable")
    features, ends = features[order], np.cumsum(np.bincount(at, minlength=len(vocabulary)))
    k = len(langs)
    weights = {"grams": np.zeros((1 << BITS, k)), "lexical": np.zeros((len(lexicon) + 1, k)), "trans": np.zeros((k, k)), "start": np.zeros((1, k))}
    squares = {name: np.full_like(w, 1e-6) for name, w in weights.items()}

    def step(name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        rows, inverse = np.unique(rows, return_inverse=True)
        g = np.column_stack([np.bincount(inverse, gradient[:, j], len(rows)) for j in range(k)])
        squares[name][rows] += g * g
        weights[name][rows] -= rate * g / np.sqrt(squares[name][rows])

    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
            here, inverse = np.unique(ids[chosen], return_inverse=True)
            sizes = ends[here] - np.where(here > 0, ends[here - 1], 0)
            owner = np.repeat(np.arange(len(here)), sizes)
            grams = features[np.arange(sizes.sum()) + np.repeat(ends[here] - np.cumsum(sizes), sizes)]
            scores = np.column_stack([np.bincount(owner, weights["grams"][grams, j], len(here)) for j in range(k)]) + weights["lexical"][lexical_of[here]]
            e = np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0))[inverse.reshape(len(chosen), length)]
            true, trans, start = labels[chosen], np.exp(weights["trans"]), np.exp(weights["start"][0])
            alpha, scale, a = np.empty_like(e), np.empty(e.shape[:2]), None
            for t in range(length):
                a = (start if a is None else a @ trans) * e[:, t]
                scale[:, t] = a.sum(1)
                a = a / scale[:, t, None]
                alpha[:, t] = a
            z, gamma, pairs = np.ones((len(chosen), k)), np.empty_like(e), np.zeros((k, k))
            for t in range(length - 1, -1, -1):
                gamma[:, t] = alpha[:, t] * z
                if t:
                    ahead = e[:, t] * z / scale[:, t, None]
                    pairs += (alpha[:, t - 1].T @ ahead) * trans
                    z = ahead @ trans.T
            gamma -= np.eye(k)[true]
            np.subtract.at(pairs, (true[:, :-1].ravel(), true[:, 1:].ravel()), 1)
            by_word = np.column_stack([np.bincount(inverse.ravel(), gamma[..., j].ravel(), len(here)) for j in range(k)])
            step("grams", grams, by_word[owner])
            step("lexical", lexical_of[here], by_word)
            step("trans", np.arange(k), pairs)
            step("start", np.zeros(len(chosen), int), gamma[:, 0])
    weights["lexical"][-1] = 0
    trans, start = np.exp(weights["trans"] - weights["trans"].max()), np.exp(weights["start"][0] - weights["start"].max())
    return Crf(langs, weights["grams"].astype(np.float32), lexicon, weights["lexical"], trans, start / start.sum())


def training_rows(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, most_langs: int = MOST_LANGS, most_chars: int = MOST_CHARS) -> list[tuple[str, str]]:
    """The bounded sample: labelled rows that aren't held out, thinned by a hash to about docs_per_lang of each language."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") <= most_chars) & ~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return []
    part = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_lang / n))]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    drawn = rows.where(place < F.coalesce(part, F.lit(0.0)) * (1 << 30))
    found = drawn.orderBy(place, "doc_id", "lang", "text").select("lang", "text").limit(2 * docs_per_lang * len(counts)).collect()
    return [(r["lang"], r["text"]) for r in found]


def train(docs: DataFrame, **bounds: int) -> Crf | None:
    return fit(training_rows(docs, **bounds))


class Predictor:
    def __init__(self, crf: Crf):
        self.crf, self.cache = crf, WordRows(crf.emissions, len(crf.langs))

    def of_long(self, words: list[str]) -> np.ndarray:
        """Mean posterior of one text, piece by piece."""
        crf, k = self.crf, len(self.crf.langs)
        pieces = [(at, min(at + _FLUSH_WORDS, len(words))) for at in range(0, len(words), _FLUSH_WORDS)]
        emitted = lambda a, b: self.cache.rows[self.cache.places(words[a:b])]
        opens = lambda a, b: np.arange(a, b) == 0
        matrices = []
        for a, b in pieces:
            e, total = emitted(a, b), np.eye(k)
            for s in range(0, b - a, _STEPS):
                total = total @ _products(e[None, s : s + _STEPS], opens(a + s, min(a + s + _STEPS, b))[None], crf.transitions, crf.start)[0]
                total /= total.max()
            matrices.append(total)
        behind = [np.ones(k)]
        for m in matrices[:0:-1]:
            behind.append(m @ behind[-1])
            behind[-1] /= behind[-1].sum()
        message, summed = np.full(k, 1 / k), np.zeros(k)
        for (a, b), matrix, after in zip(pieces, matrices, behind[::-1]):
            summed += posteriors(emitted(a, b), opens(a, b), crf.transitions, crf.start, message, after).sum(0)
            message = message @ matrix
            message /= message.sum()
        return summed / len(words)

    def of_texts(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of whole texts, about _FLUSH_WORDS words at a time."""
        langs, scores, held, n = [], [np.empty(0)], [], 0

        def flush() -> None:
            found = self(held)
            langs.extend(found[0])
            scores.append(found[1])

        for text in column:
            words = words_of(text.as_py())
            if n and n + len(words) > _FLUSH_WORDS:
                flush()
                held, n = [], 0
            held.append(words)
            n += len(words)
        flush()
        return langs, np.concatenate(scores)

    def __call__(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """Language and score of texts given as words."""
        if len(texts) == 1 and len(texts[0]) > _FLUSH_WORDS:
            mean = self.of_long(texts[0])
            return [self.crf.langs[int(mean.argmax())]], np.array([min(1.0, mean.max())])
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        sizes = np.array([len(t) for t in texts])
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            first = np.zeros(sizes.sum(), bool)
            first[starts] = True
            places = self.cache.places([w for t in texts for w in t])
            marginal = posteriors(self.cache.rows[places], first, self.crf.transitions, self.crf.start)
            mean = np.add.reduceat(marginal, starts) / sizes[full, None]
            for i, row in zip(full, mean):
                langs[i], scores[i] = self.crf.langs[int(row.argmax())], min(1.0, row.max())
        return langs, scores


def predictions(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model.value) if model.value else None
        for batch in batches:
            langs, scores = predictor.of_texts(batch.column(1)) if predictor else ([UNKNOWN] * len(batch), np.zeros(len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, crf: Crf | None, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose language the model tells with a score of least_score or more; without a model all rows."""
    if crf is None:
        return docs
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(crf)
    text_at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model.value)
        for batch in batches:
            langs, scores = predictor.of_texts(batch.column(text_at))
            yield batch.filter(pa.array([k != UNKNOWN and s >= least_score for k, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predictions(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
