"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with its two ends marked); each n-gram has a hashed
embedding, so a misspelt word shares most of its vectors with the right one.  A span of a few words
is the average of its words' bags; a linear softmax over it tells the two classes apart.  Embeddings
and softmax are trained together by stochastic gradient descent.

A document of any length is read as overlapping spans and has the score of its worst one, since an
insult does not get weaker by what surrounds it.  In training, a toxic document's label holds for
its worst spans only: training starts from all spans of the toxic documents and then goes on, in
rounds, with those that the model so far finds worst, against spans of clean documents: all of them
at first, then the worst ones and some at random.  At last the scores of documents kept aside are
mapped to probabilities, together with their numbers of spans, since the worst of many is worse.

The softmax of an average is linear in the n-grams up to its last step, so scoring adds one number
a word, which is kept in a bounded cache.

The model is fitted on at most ``max_toxic`` and ``max_clean`` labelled documents of any
length, chosen by a hash of their ids; every document is scored, over its whole text.  The driver
holds the chosen documents' texts.

Defined cases: null and empty texts have the score of no toxic evidence at all; a null doc_id
counts as an empty id for the choice of held-out rows and never has a label; if a document has
several labels the highest counts; of rows that repeat a labelled doc_id one is learnt from, and all
are scored; equal texts have equal scores; an empty table gives an empty result; a very long text is
scored whole, by one task; further columns are kept by :func:`drop_toxic` and ignored otherwise,
whatever their names; without toxic or without clean labelled documents every score is
the share of toxic labels.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

DIM = 8
BUCKETS = 1 << 16
SPAN = 4
NGRAMS = (3, 4, 5)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Rows kept out of training, by the CRC-32 of the id's text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def word_ngrams(word: bytes) -> list[int]:
    """The buckets of a lower-case word's n-grams."""
    w = b"<" + word + b">"
    crc = zlib.crc32
    return [crc(w[i : i + n]) & (BUCKETS - 1) for n in NGRAMS for i in range(len(w) - n + 1)] or [crc(w) & (BUCKETS - 1)]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


class _WordScores(dict):
    """The sum a word adds to the logit, times 1/n-grams."""

    def __init__(self, scores: np.ndarray):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: bytes) -> float:
        value = float(self.scores[word_ngrams(word)].mean())
        if len(self) >= 500_000:
            self.clear()
        self[word] = value
        return value


@dataclass
class ToxicityModel:
    """ngram: what each bucket adds to the logit; bias; the map from the worst span's logit and the logarithm of the number of spans to a probability."""

    ngram: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None
    by_length: float = 0.0
    _cache: dict | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": None}

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The logit of the worst span, and the logarithm of the number of spans."""
        if self._cache is None:
            self._cache = _WordScores(self.ngram)
        words = words_of(text or "")
        if not words:
            return self.bias, 0.0
        values = np.fromiter(map(self._cache.__getitem__, words), np.float64, len(words))
        means = span_means(values)
        return self.bias + float(means.max()), float(np.log(len(means)))

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        logit, length = self.evidence(text)
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.by_length * length + self.shift, -30, 30))))


def span_means(values: np.ndarray) -> np.ndarray:
    """The mean of each run of SPAN words; of all words, if there are fewer."""
    if len(values) <= SPAN:
        return values.mean(keepdims=True)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[SPAN:] - total[:-SPAN]) / SPAN


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by their index."""
    return np.stack([np.bincount(index, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


class _Trainer:
    """Embeddings and softmax over the words of the training documents."""

    def __init__(self, docs: list[list[bytes]], seed: int):
        self.rng = np.random.default_rng(seed)
        index: dict[bytes, int] = {}
        self.docs = [np.array([index.setdefault(w, len(index)) for w in d], np.int64) for d in docs]
        grams = [np.array(word_ngrams(w), np.int32) for w in index]
        self.size = np.array([len(g) for g in grams], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.grams = np.concatenate(grams)
        self.E = self.rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.W = np.zeros((DIM, 2), np.float32)
        self.W[0] = (-0.5, 0.5)
        self.b = np.zeros(2, np.float32)
        self.gE = np.full((BUCKETS, 1), 1e-3, np.float32)

    def spans(self, d: int) -> np.ndarray:
        """The word numbers of each span of a document; shorter ones repeat their words."""
        w = self.docs[d]
        if len(w) < SPAN:
            return np.resize(w, (1, SPAN))
        return np.lib.stride_tricks.sliding_window_view(w, SPAN)

    def step(self, spans: np.ndarray, y: np.ndarray, rate: float) -> None:
        words, inverse = np.unique(spans, return_inverse=True)
        sizes = self.size[words]
        at = np.repeat(self.start[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        grams = self.grams[at]
        cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        vectors = np.add.reduceat(self.E[grams], cuts, axis=0) / sizes[:, None]
        h = vectors[inverse.reshape(spans.shape)].mean(axis=1)
        z = h @ self.W + self.b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = p @ self.W.T
        self.W -= rate * (h.T @ p)
        self.b -= rate * p.sum(axis=0)
        dv = _sums(inverse.reshape(-1), np.repeat(dh / SPAN, SPAN, axis=0), len(words))
        g = _sums(grams, np.repeat(dv / sizes[:, None], sizes, axis=0), BUCKETS)
        # The rate of a bucket falls with the gradients it has had.
        self.gE += (g * g).mean(axis=1, keepdims=True) * 1e4
        self.E -= rate * g * 20 / np.sqrt(self.gE)

    def ngram_logits(self) -> tuple[np.ndarray, float]:
        w = self.W[:, 1] - self.W[:, 0]
        return self.E @ w, float(self.b[1] - self.b[0])

    def word_logits(self) -> np.ndarray:
        return np.add.reduceat(self.ngram_logits()[0][self.grams], self.start[:-1]) / self.size


def train(texts: list[str], labels: list[int], seed: int = 7, rounds: int = 4, batch: int = 512, min_steps: int = 150) -> ToxicityModel:
    """Fit a model on whole texts; see the module's text."""
    both = [(words_of(t or ""), int(y)) for t, y in zip(texts, labels)]
    both = [(w, y) for w, y in both if w]
    y = np.array([v for _, v in both], np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0, constant=float(np.mean(labels)) if len(labels) else 0.0)
    t = _Trainer([w for w, _ in both], seed)
    # A fifth of the documents is kept for the map to probabilities, if it has enough of both classes.
    aside = t.rng.random(len(y)) < 0.2
    if min((y[aside] == 1).sum(), (y[aside] == 0).sum()) < 25:
        aside[:] = False
    toxic, clean = np.flatnonzero((y == 1) & ~aside), np.flatnonzero((y == 0) & ~aside)

    def pick(docs, each, worst):
        """``each`` spans of each document: at random, or the worst; all without ``each``."""
        found, word = [], t.word_logits() if worst else None
        for d in docs:
            s = t.spans(d)
            if each is None:
                k = slice(None)
            elif worst:
                m = word[s].mean(axis=1)
                k = np.argpartition(-m, min(each, len(m)) - 1)[:each]
            else:
                k = t.rng.integers(0, len(s), min(each, len(s)))
            found.append(s[k])
        return np.concatenate(found)

    for r in range(rounds):
        if r == 0:
            positive, negative = pick(toxic, None, False), pick(clean, None, False)
        else:
            positive = pick(toxic, 3, True)
            negative = np.concatenate([pick(clean, 3, True), pick(clean, 12, False)])
        x = np.concatenate([positive, negative])
        z = np.concatenate([np.ones(len(positive), np.int64), np.zeros(len(negative), np.int64)])
        for _ in range(max(2, -(-min_steps * batch // len(x)))):
            order = t.rng.permutation(len(x))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                t.step(x[part], z[part], 0.5 / (1 + r))
    grams, bias = t.ngram_logits()
    model = ToxicityModel(grams.astype(np.float32), bias, 1.0, 0.0)
    word = t.word_logits()
    means = [span_means(word[d]) for d in t.docs]
    x = np.array([(bias + m.max(), np.log(len(m))) for m in means])
    (model.slope, model.by_length), model.shift = _calibrate(x[aside], y[aside]) if aside.any() else _calibrate(x, y)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of the label on the columns of x, lightly held back, by Newton steps."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    u = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    held = np.append(np.full(x.shape[1], 0.1), 0.0)
    a = np.zeros(u.shape[1])
    a[0] = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ a, -30, 30)))
        w = p * (1 - p) + 1e-6
        d = np.linalg.solve((u * w[:, None]).T @ u + np.diag(held), u.T @ (p - y) + held * a)
        a -= np.clip(d, -2, 2)
        if abs(d).max() < 1e-8:
            break
    slopes = a[:-1] / sd
    return slopes, float(a[-1] - slopes @ mean)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_toxic: int, max_clean: int) -> list:
    """(id, text, toxic) of the chosen labelled documents outside the held-out part, in a fixed order.

    A row for each chosen id: of rows that repeat it the one whose text has the least digest.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 4, 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # The chosen ids are at most max_toxic + max_clean.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
    rows = found.agg(F.min_by("text", F.struct(F.sha2("text", 256))).alias("text")).select("doc_id", "text", "toxic").collect()
    return sorted((r.doc_id, r.text, r.toxic) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 1200, max_clean: int = 2400) -> ToxicityModel:
    rows = training_rows(docs, labels, id_col, text_col, max_toxic, max_clean)
    return train([r[1] for r in rows], [r[2] for r in rows])


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted: a row for each row."""
    schema = "doc_id long, held_out boolean, score double, predicted int"
    to = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = share.value
        for b in batches:
            scores = np.array([m.score(t.as_py()) for t in b.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], schema=to)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = share.value
        for b in batches:
            keep = pa.array([m.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
