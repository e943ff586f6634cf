"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Texts are lower-cased words and one end.  Each word is a run of subword ids of a public tokenizer,
the end is that tokenizer's end id.  The model reads windows of ids: embeddings with places, one
head of masked attention over the last ``PAST`` ids and the present ones, and a softmax over classes
of ids; an id's probability is its class's times its share of the class in the training corpus.  The
windows overlap, so every id is scored once and has ``PAST`` ids of context.

What is learnt from the corpus, always from every training document:
* counts of all words and all subword ids;
* the classes: the most frequent ids have one each, the others share one with ids that follow the
  same ids (counts of the ids before, by ``CONTEXTS`` hashed kinds, clustered);
* embeddings, attention and softmax, by gradient descent on every window of every training document.
  The windows are dealt to ``ROUNDS``, so that each is trained on once.  In a round every task trains
  on its share of the stored ids; the tasks' models are averaged, each embedding by how often its id
  was met, and the next round goes on from the average.

Texts are read and encoded once, in the partitions they come in, in runs of about ``chunk_chars``
characters.  A chunk is up to ``RUNS`` runs, whose distinct words are encoded once; it is stored as numbers: its distinct words with their training counts, and,
for each document, its ids (two bytes each) and the numbers of its words.  Training and scoring read
the ids from there without a shuffle.  Only the distinct words of the chunks are shuffled by word, once,
to be counted over the corpus; a word has a row for each chunk at most, however frequent it is.

Defined cases: null counts as empty; the empty text is scored as one end; a null doc_id is hashed as
an empty id; rows that repeat a doc_id are scored each, as often as they are there; words never met
in training have a count of 0; without training documents all counts are 0 and the ids are equally
likely; an empty table gives an empty result; a very long text is one document of a chunk, whose
memory follows the longest text; of ids with equal counts the lesser is taken as more frequent;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, release, text_or_empty

DIM = 16
CLASSES = 128
#: Ids with a class of their own, and hashed kinds of ids before, by which the others are clustered.
OWN_CLASS = 48
CONTEXTS = 32
PAST = 8
NOW = 16
SPAN = PAST + NOW
#: Windows scored or trained on at once, so that they stay in the processor's cache.
BATCH = 128
#: Rows of logits at once: a product of so many is small enough for the library's direct kernels, which copy nothing.
ROWS = 448
#: Words of a stored row of ids, of one document at least; words encoded at once.
SLICE = 20_000
#: Rows of words that a bucket has, about.
BUCKET = 500_000
#: Runs of texts that are a chunk at most, and words of a chunk after which the next one begins.
RUNS, WORDS = 4, 400_000
#: The rounds of training: the eighths of the windows dealt to each, and the rate.
ROUNDS = (((0,), 0.15), ((1, 2), 0.1), ((3, 4, 5, 6, 7), 0.07))
END = b" "
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


# -- the model ------------------------------------------------------------------------------------


def frequent_first(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.float64), kind="stable")


def context_classes(counts: np.ndarray, contexts: np.ndarray, steps: int = 12) -> np.ndarray:
    """Each id's class: its own, or that of the ids which follow the same kinds of ids (spherical k-means by counts)."""
    order = frequent_first(counts)
    of_class = np.empty(len(counts), np.int64)
    of_class[order[:OWN_CLASS]] = np.arange(min(OWN_CLASS, len(order)))
    rest, k = order[OWN_CLASS:], CLASSES - OWN_CLASS
    if len(rest):
        usual = contexts.sum(axis=0) / max(1, contexts.sum())
        near = np.sqrt((contexts[rest] + 4 * usual) / (contexts[rest].sum(axis=1, keepdims=True) + 4)).astype(np.float32)
        weight = counts[rest] + 0.1
        centre = near[np.arange(k) % len(near)].copy()
        for _ in range(steps):
            of = (near @ centre.T).argmax(axis=1)
            for j in range(near.shape[1]):
                centre[:, j] = np.bincount(of, weights=weight * near[:, j], minlength=k)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        of_class[rest] = OWN_CLASS + (near @ centre.T).argmax(axis=1)
    return of_class


@dataclass
class AttentionLm:
    """Parameters; of_class: each id's class; log_share: log10 of its share of the class.

    E has one row more than there are ids, which stands for no id.  KV makes keys and values; the
    last row of U is added to each class's logit.
    """

    E: np.ndarray
    P: np.ndarray
    Q: np.ndarray
    KV: np.ndarray
    O: np.ndarray  # noqa: E741
    U: np.ndarray
    of_class: np.ndarray
    log_share: np.ndarray

    NAMES = ("E", "P", "Q", "KV", "O", "U")

    @classmethod
    def new(cls, counts: np.ndarray, contexts: np.ndarray | None = None, seed: int = 3) -> AttentionLm:
        """An untrained model that knows the ids' classes and the classes' shares."""
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.25, s).astype(np.float32)
        of_class = context_classes(counts, np.zeros((len(counts), 1)) if contexts is None else contexts)
        c = counts.astype(np.float64) + 0.1
        total = np.bincount(of_class, weights=c, minlength=CLASSES)
        U = np.zeros((DIM + 1, CLASSES), np.float32)
        U[DIM] = np.log(np.maximum(total, 1e-9) / total.sum())
        E = np.concatenate([f(len(c), DIM), np.zeros((1, DIM), np.float32)])
        return cls(E, f(SPAN, DIM), f(DIM, DIM), f(DIM, 2 * DIM), f(DIM, DIM), U, of_class, np.log10(c / total[of_class]))

    def copy(self) -> AttentionLm:
        return AttentionLm(*(np.array(getattr(self, n)) for n in self.NAMES), self.of_class, self.log_share)

    @property
    def no_id(self) -> int:
        return len(self.E) - 1

    def _products(self) -> tuple[np.ndarray, np.ndarray]:
        """The queries' matrix times the keys', scaled, and the values' times that of the output: keys and values need not be made."""
        return self.Q @ self.KV[:, :DIM].T * _SCALE, self.KV[:, DIM:] @ self.O

    def forward(self, x: np.ndarray) -> tuple:
        """What the classes of the ids after each of the last NOW of SPAN ids are told from, with a last column of ones, and what led to it."""
        n = len(x)
        qk, vo = self._products()
        e = self.E.take(x, axis=0)
        e += self.P
        turned = np.empty((n, DIM + 1, SPAN), e.dtype)
        turned[:, :DIM] = e.transpose(0, 2, 1)
        turned[:, DIM] = 1
        now = np.ascontiguousarray(e[:, PAST:]).reshape(-1, DIM)
        q = (now @ qk).reshape(n, NOW, DIM)
        q2 = q * _LOG2_E
        w, total = self._weights(x, q2 @ turned[:, :DIM])
        if not _usable(total):
            w = q2 @ turned[:, :DIM]
            w -= np.where((_SEEN > 0) & (x != self.no_id)[:, None, :], w, -np.inf).max(axis=2, keepdims=True, initial=-1e30)
            w, total = self._weights(x, np.minimum(w, 0, out=w))
        w *= (1 / np.maximum(total, np.float32(1e-30))).reshape(n, NOW, 1)
        a = (w @ e).reshape(-1, DIM)
        h = np.ones((n * NOW, DIM + 1), e.dtype)
        np.add(a @ vo, now, out=h[:, :DIM])
        return h, (e, turned, now, q, w, a)

    def _weights(self, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two to the power of w where an id is seen, and the sums."""
        np.exp2(w, out=w)
        w *= _SEEN
        first = np.flatnonzero(x[:, 0] == self.no_id)  # windows that begin before their text
        if len(first):
            w[first] *= (x[first] != self.no_id)[:, None, :]
        return w, w.reshape(-1, SPAN) @ np.ones(SPAN, np.float32)

    def _softmax(self, h: np.ndarray, t: np.ndarray, safe: bool, owns: np.ndarray | None = None):
        """By runs of ROWS rows of h: the rows, the classes' exponentials, their sums, and where the target's class stands, of whose exponential
        ``owns`` takes the logarithm (base 2).  The logits of a run stay in a near cache; the next run overwrites them."""
        u = self.U * _LOG2_E
        z = np.empty((min(ROWS, len(h)), CLASSES), u.dtype)
        at = self.of_class.take(t)
        for lo in range(0, len(h), ROWS):
            part = slice(lo, min(lo + ROWS, len(h)))
            p = z[: part.stop - lo]
            own_at = at[part]
            own_at += _EACH_ROW[: len(p)]
            np.matmul(h[part], u, out=p)
            if safe:
                p -= p.max(axis=1)[:, None]
            if owns is not None:
                owns[part] = p.reshape(-1).take(own_at)
            np.exp2(p, out=p)
            yield part, p, p @ _EACH_CLASS, own_at

    def log10(self, x: np.ndarray, y: np.ndarray, safe: bool = False) -> np.ndarray:
        """log10 of the probabilities of y (windows, NOW) after the windows x (windows, SPAN); 0 where y is -1.  safe: logits may be too large for their exponentials."""
        t = y.reshape(-1)
        h = self.forward(x)[0]
        totals, owns = np.empty(len(h), h.dtype), np.empty(len(h), h.dtype)
        for part, _, total, _ in self._softmax(h, t, safe, owns):
            totals[part] = total
        if not safe and not _usable(totals):
            return self.log10(x, y, safe=True)
        owns -= np.log2(totals)
        found = self.log_share.take(t)
        found += owns * _LOG10_2
        found[t < 0] = 0.0
        return found.reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray, safe: bool = False) -> dict[str, np.ndarray]:
        """Of the mean loss; the embeddings' are by place in x."""
        n = len(x)
        h, (e, turned, now, q, w, a) = self.forward(x)
        t = y.reshape(-1)
        live = (t >= 0).astype(np.float32)
        live /= max(1, np.count_nonzero(live))
        back = np.ascontiguousarray(self.U[:DIM].T)
        dh, totals = np.empty((len(h), DIM), h.dtype), np.empty(len(h), h.dtype)
        g = {"U": np.zeros_like(self.U)}
        for part, p, total, own_at in self._softmax(h, t, safe):
            totals[part] = total
            p.reshape(-1)[own_at] -= total
            p *= (live[part] / total)[:, None]
            np.matmul(p, back, out=dh[part])
            g["U"] += h[part].T @ p
        if not safe and not _usable(totals):
            return self.gradients(x, y, safe=True)
        qk, vo = self._products()
        dvo = a.T @ dh
        g["O"] = self.KV[:, DIM:].T @ dvo
        # The last column takes off each query's mean, by the row of ones.
        da = np.empty((n, NOW, DIM + 1), h.dtype)
        flat = da.reshape(-1, DIM + 1)
        np.matmul(dh, vo.T, out=flat[:, :DIM])
        np.matmul(flat[:, :DIM] * a, _LESS, out=flat[:, DIM])
        ds = da @ turned
        ds *= w
        de = w.transpose(0, 2, 1) @ da[..., :DIM]
        de += ds.transpose(0, 2, 1) @ q
        dq = (ds @ e).reshape(-1, DIM)
        dqk = now.T @ dq
        dqk *= _SCALE
        g["Q"] = dqk @ self.KV[:, :DIM]
        g["KV"] = np.concatenate([dqk.T @ self.Q, dvo @ self.O.T], axis=1)
        dh += dq @ qk.T
        de[:, PAST:] += dh.reshape(n, NOW, DIM)
        g["P"] = (np.ones(n, np.float32) @ de.reshape(n, -1)).reshape(SPAN, DIM)
        g["E"] = de
        return g

    def no_gradients(self) -> dict[str, np.ndarray]:
        return {"E": np.full(self.E.shape, 1e-6, np.float32), "rest": np.full(sum(getattr(self, n).size for n in self.NAMES[1:]), 1e-6, np.float32)}

    def joined(self) -> np.ndarray:
        """All parameters but the embeddings in one array, parts of which they are from now on."""
        rest, at = np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES[1:]]), 0
        for n in self.NAMES[1:]:
            old = getattr(self, n)
            setattr(self, n, rest[at : at + old.size].reshape(old.shape))
            at += old.size
        return rest

    def train(self, x: np.ndarray, y: np.ndarray, rate: float, batch: int = BATCH, seed: int = 5, grown: dict[str, np.ndarray] | None = None) -> None:
        """One run over the windows, each parameter's rate falling with its gradients (Adagrad), of which ``grown`` keeps the sums."""
        grown, rest = self.no_gradients() if grown is None else grown, self.joined()
        order = np.random.default_rng(seed).permutation(len(x))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            windows_x = x.take(part, axis=0)
            g = self.gradients(windows_x, y.take(part, axis=0))
            ids = windows_x.reshape(-1).astype(np.uint16)
            by_id = np.argsort(ids, kind="stable")
            ids = ids.take(by_id)
            new = np.ones(len(ids), bool)
            np.not_equal(ids[1:], ids[:-1], out=new[1:])
            start = np.flatnonzero(new)
            # Sums of complex numbers are those of two columns each, in half the steps.
            ge = np.add.reduceat(g.pop("E").reshape(-1, DIM).take(by_id, axis=0).view(np.complex64), start, axis=0).view(np.float32)
            used = ids.take(start).astype(np.int64)
            if used[-1] == self.no_id:
                ge[-1] = 0
            self.E[used] -= _step(ge, grown["E"], rate, used)
            rest -= _step(np.concatenate([g[n].reshape(-1) for n in self.NAMES[1:]]), grown["rest"], rate)


def _step(g: np.ndarray, grown: np.ndarray, rate: float, rows: np.ndarray | None = None) -> np.ndarray:
    """Adagrad's step by the gradients g, of some rows or all, whose squares are added to ``grown``."""
    sums = g * g
    sums += grown if rows is None else grown.take(rows, axis=0)
    grown[... if rows is None else rows] = sums
    g *= np.float32(rate)
    g /= np.sqrt(sums, out=sums)
    return g


def _usable(totals: np.ndarray) -> bool:
    """Whether sums of exponentials have neither overflown nor vanished."""
    return bool(1e-30 < np.minimum.reduce(totals) and np.maximum.reduce(totals) < 1e30) if len(totals) else True


_SCALE = np.float32(DIM**-0.5)
_LOG2_E = np.float32(np.log2(np.e))
_LOG10_2 = float(np.log10(2))
#: A present id sees the past and what is not after it.
_SEEN = (np.arange(SPAN)[None, :] <= np.arange(NOW)[:, None] + PAST).astype(np.float32)
_LESS = np.full(DIM, -1, np.float32)
_EACH_CLASS = np.ones(CLASSES, np.float32)
_EACH_ROW = np.arange(0, ROWS * CLASSES, CLASSES)


def windows(ids: np.ndarray, sizes: np.ndarray, bos: int, no_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts given as joined ids: inputs, targets (-1: none) and the text of each window."""
    counts = -(-sizes // NOW)
    width = counts * NOW + PAST
    start = np.concatenate([[0], np.cumsum(width)])
    x, y = np.full(start[-1], no_id, np.int32), np.full(start[-1], -1, np.int32)
    start = start[:-1]
    place = np.repeat(start + PAST - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(len(ids))
    y[place] = ids
    # The input of a place is the id before it; a text starts after the begin id.
    x[place[:-1] + 1] = ids[:-1]
    x[start] = no_id
    x[start + PAST] = bos
    first = np.repeat(start - NOW * np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + NOW * np.arange(counts.sum())
    if not len(first):
        return x.reshape(0, SPAN), y.reshape(0, NOW), first
    runs = np.lib.stride_tricks.sliding_window_view
    return runs(x, SPAN)[first], runs(y, NOW)[first + PAST], np.repeat(np.arange(len(sizes)), counts)


# -- words and ids --------------------------------------------------------------------------------


@functools.cache
def tokenizer(model_file: str):
    from sentencepiece import SentencePieceProcessor

    t = SentencePieceProcessor(model_file=model_file)
    if t.get_piece_size() >= 1 << 16:
        raise ValueError("ids are stored in two bytes")
    return t


class Chunk:
    """Texts as numbers of their distinct words; the end, number 0, is the last word of each text."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        # Where a word begins or ends the bytes change between white space and others; the first text is thought after a space.
        in_word = ~_IS_SPACE.take(data)
        change = np.flatnonzero(np.diff(in_word, prepend=False))
        start, stop = change[::2], change[1::2]
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[in_word])]).dictionary_encode()
        self.words = pa.concat_arrays([pa.array([END]), words.dictionary])
        before = np.searchsorted(start, ends)
        self.sizes = np.diff(before, prepend=0) + 1
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        self.words_at = np.zeros(len(self.text), np.int32)
        is_word = np.ones(len(self.text), bool)
        is_word[np.cumsum(self.sizes) - 1] = False
        self.words_at[is_word] = words.indices.to_numpy() + 1

    def slices(self, words: int):
        """Runs (lo, hi) of texts of about so many words, of one text at least."""
        edge = np.concatenate([[0], np.cumsum(self.sizes)])
        lo = 0
        while lo < len(self.sizes):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + words, "right")) - 1)
            yield lo, hi, slice(int(edge[lo]), int(edge[hi]))
            lo = hi


class Words:
    """The distinct words of some chunks, their training counts, and their ids, each word encoded as after a space."""

    def __init__(self, model):
        self.model, self.words, self.n = model, pa.array([], pa.binary()), np.zeros(0, np.int64)
        self.flat, self.start = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def add(self, c: Chunk, learn: np.ndarray) -> np.ndarray:
        """The numbers here of a chunk's words; those met anew are encoded, and the words of the texts to learn from counted."""
        number = pc.index_in(c.words, value_set=self.words)
        new = c.words.filter(number.is_null())
        number = number.fill_null(-1).to_numpy().copy()
        number[number < 0] = np.arange(len(self.words), len(self.words) + len(new))
        flat, sizes = [self.flat], []
        for at in range(0, len(new), SLICE):
            found = self.model.encode([w.decode("utf-8", "replace") for w in new[at : at + SLICE].to_pylist()], num_threads=1)
            if at == 0 and not len(self.words):
                found[0] = [self.model.eos_id()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat.append(np.fromiter(itertools.chain.from_iterable(found), np.uint16, int(n.sum())))
            sizes.append(n)
        self.flat = np.concatenate(flat)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        self.words = pa.concat_arrays([self.words, new])
        self.n = np.concatenate([self.n, np.zeros(len(new), np.int64)])
        self.n[number] += np.bincount(c.words_at[learn[c.text]], minlength=len(c.words))
        return number

    def rows(self, chunk: int) -> pa.RecordBatch:
        cuts = range(0, len(self.words), SLICE)
        lists = pa.ListArray.from_arrays(pa.array([*cuts, len(self.words)], pa.int32()), self.words)
        return _rows(len(cuts), kind=["w"] * len(cuts), chunk=[chunk] * len(cuts), lo=list(cuts), word=lists, n=[self.n[k : k + SLICE] for k in cuts])


def spread(words: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of words, and how many each word has."""
    n = (start[1:] - start[:-1])[words]
    at = np.repeat(start[words] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
    return ids[at], n


def kinds(vocabulary: int) -> np.ndarray:
    """The hashed kind of each id as a context."""
    return ((np.arange(vocabulary, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(CONTEXTS)).astype(np.int32)


# -- Spark ----------------------------------------------------------------------------------------

_SUMS = [f"v{k}" for k in range(DIM)]
#: A row of kind w has distinct words of a chunk from number ``lo`` on, one of kind d and one of kind i documents from
#: number ``lo`` on (their words as numbers, and their ids), and one of kind s counts of ids.
_GATHERED = pa.schema(
    [("kind", pa.string()), ("chunk", pa.int64()), ("lo", pa.int64()), ("part", pa.int32()), ("word", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))]
    + [("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("low", pa.binary()), ("high", pa.binary()), ("id", pa.int32()), ("contexts", pa.list_(pa.int64()))]
)
_GATHERED_DDL = "kind string, chunk long, lo long, part int, word array<binary>, n array<long>, doc_id array<long>, held_out array<boolean>, sizes array<long>, low binary, high binary, id int, contexts array<long>"


def _rows(height: int, **columns) -> pa.RecordBatch:
    """Rows of the gathered table with the given columns, null in the others."""
    made = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([made(columns[f.name], f.type) if f.name in columns else pa.nulls(height, f.type) for f in _GATHERED], schema=_GATHERED)


def _halves(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """The low and the high two bytes of numbers, apart: the high ones are mostly zeros."""
    return numbers.astype(np.uint16).tobytes(), (numbers >> 16).astype(np.uint16).tobytes()


def _whole(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint16).astype(np.int32) | np.frombuffer(high, np.uint16).astype(np.int32) << 16


def _gather(model_file: str, chunk_chars: int):
    """Documents (doc_id, held_out, text) -> the distinct words of each chunk, its documents as numbers, and the partition's counts of ids."""

    def run(batches):
        model = tokenizer(model_file)
        kind = kinds(model.get_piece_size())
        contexts = np.zeros(len(kind) * CONTEXTS, np.int64)
        # Chunks are numbered within their partition, which a task that is run again writes anew.
        chunk, known, texts, runs = TaskContext.get().partitionId() << 32, Words(model), 0, 0
        for docs in _runs(batches, chunk_chars):
            given = docs.column(2).to_pylist()
            c = Chunk(given)
            learn = ~np.array(docs.column(1).to_pylist(), bool)
            c.words_at = known.add(c, learn)[c.words_at]
            ids, start = known.flat, known.start
            keys = []
            for number, (lo, hi, part) in enumerate(c.slices(SLICE)):
                ids_at, per_word = spread(c.words_at[part], ids, start)
                sizes = np.bincount(c.text[part] - lo, weights=per_word, minlength=hi - lo).astype(np.int64)
                mine = np.repeat(learn[lo:hi], sizes)
                before = np.concatenate([[model.bos_id()], ids_at[:-1]])
                before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = model.bos_id()
                keys.append(ids_at[mine] * np.int32(CONTEXTS) + kind[before[mine]])
                low, high = _halves(c.words_at[part])
                both, held = {"chunk": [chunk], "lo": [texts + lo], "part": [number % 8]}, [~learn[lo:hi]]
                yield _rows(1, kind=["d"], doc_id=[docs.column(0)[lo:hi].to_pylist()], held_out=held, sizes=[c.sizes[lo:hi]], low=[low], high=[high], **both)
                yield _rows(1, kind=["i"], held_out=held, sizes=[sizes], low=[ids_at.tobytes()], **both)
            contexts += np.bincount(np.concatenate(keys), minlength=len(contexts))
            texts += docs.num_rows
            runs += max(1, sum(map(len, given)) // chunk_chars)
            if len(known.words) > WORDS or runs >= RUNS:
                yield known.rows(chunk)
                chunk, known, texts, runs = chunk + 1, Words(model), 0, 0
        if texts:
            yield known.rows(chunk)
        contexts = contexts.reshape(-1, CONTEXTS)
        met = np.flatnonzero(contexts.sum(axis=1))
        yield _rows(len(met), kind=["s"] * len(met), id=met, contexts=list(contexts[met]))

    return run


def _runs(batches, most: int):
    """The rows of all batches again, in tables of about ``most`` bytes of text (column 2), of one row at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - done
            at = to
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _train_task(share, rate: float, bos: int):
    """Stored ids of a partition -> the parameters trained on all their training windows, times what they count for, in rows of DIM."""

    def run(batches):
        lm = share.value.copy()
        met, n, grown = np.zeros(len(lm.E)), 0, lm.no_gradients()
        for batch in batches:
            for sizes, held, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
                sizes, learn = sizes.values.to_numpy(), ~np.array(held.as_py(), bool)
                ids = np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int32)[np.repeat(learn, sizes)]
                x, y, _ = windows(ids, sizes[learn], bos, lm.no_id)
                lm.train(x, y, rate, grown=grown)
                met += np.bincount(x.reshape(-1), minlength=len(met))
                n += len(x)
        met[lm.no_id] = 0
        ids = np.flatnonzero(met)
        rest = _rest(lm)
        rows = np.concatenate([lm.E[ids] * met[ids, None], rest * n]).astype(np.float64)
        names = np.concatenate([ids, -1 - np.arange(len(rest))]).astype(np.int32)
        weight = np.concatenate([met[ids], np.full(len(rest), float(n))])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(weight), *(pa.array(rows[:, k]) for k in range(DIM))], names=["id", "n", *_SUMS])

    return run


def _rest(lm: AttentionLm) -> np.ndarray:
    """All parameters but the embeddings, in rows of DIM."""
    return np.concatenate([getattr(lm, n).reshape(-1) for n in AttentionLm.NAMES[1:]]).reshape(-1, DIM)


def fit(gathered: DataFrame, vocabulary: int, bos: int) -> AttentionLm:
    """Train on the gathered ids.  What comes to the driver has the size of the model."""
    spark = gathered.sparkSession
    contexts = np.zeros((vocabulary, CONTEXTS), np.int64)
    found = gathered.where("kind = 's'").groupBy("id").agg(*(F.sum(F.col("contexts")[k]).alias(f"c{k}") for k in range(CONTEXTS))).toPandas()
    contexts[found["id"]] = found.drop(columns="id")
    lm = AttentionLm.new(contexts.sum(axis=1), contexts)
    schema = "id int, n double, " + ", ".join(f"{v} double" for v in _SUMS)
    for parts, rate in ROUNDS:
        share = spark.sparkContext.broadcast(lm)
        dealt = gathered.where((F.col("kind") == "i") & F.col("part").isin(*parts)).select("sizes", "held_out", "low")
        mean = [(F.sum(v) / F.sum("n")).alias(v) for v in _SUMS]
        rows = dealt.mapInArrow(_train_task(share, rate, bos), schema).groupBy("id").agg(*mean).toPandas()
        share.unpersist()
        if not len(rows):
            continue
        ids, values = rows["id"].to_numpy(), rows[_SUMS].to_numpy(np.float32)
        lm = lm.copy()
        lm.E[ids[ids >= 0]] = values[ids >= 0]
        rest = values[np.argsort(-ids)][(ids >= 0).sum() :].reshape(-1)
        at = 0
        for n in AttentionLm.NAMES[1:]:
            p = getattr(lm, n)
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
    return lm


def _score(share, bos: int):
    """Stored ids -> chunk, k (the document's number in the chunk) and score."""

    def run(batches):
        lm = share.value
        for batch in batches:
            chunk, k, score = [], [], []
            for of, lo, sizes, ids in zip(*(batch.column(c) for c in range(4))):
                sizes = sizes.values.to_numpy()
                x, y, text = windows(np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int32), sizes, bos, lm.no_id)
                by_window = np.concatenate([lm.log10(x[at : at + BATCH], y[at : at + BATCH]).sum(axis=1) for at in range(0, len(x), BATCH)])
                chunk.append(np.full(len(sizes), of.as_py()))
                k.append(lo.as_py() + np.arange(len(sizes)))
                score.append(np.bincount(text, weights=by_window, minlength=len(sizes)))
            if chunk:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (chunk, k, score)], names=["chunk", "k", "score"])

    return run


def _deal(buckets: int):
    """Rows of words (chunk, lo, word, n) -> for each bucket the chunk's words that fall into it, with their numbers and counts."""

    def one(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
        word, n = pa.concat_arrays([w for _, w, _ in rows]), np.concatenate([k for _, _, k in rows])
        no = np.concatenate([lo + np.arange(len(w), dtype=np.int32) for lo, w, _ in rows])
        bucket = np.fromiter(map(zlib.crc32, word.to_pylist()), np.uint32, len(word)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        met, start = np.unique(bucket[order], return_index=True)
        cuts = pa.array([*start, len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(no[order], pa.int32()), word.take(pa.array(order)), pa.array(n[order], pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(np.full(len(met), chunk, np.int64)), *lists], names=["bucket", "chunk", "no", "word", "n"])

    def run(batches):
        rows = ((k.as_py(), lo.as_py(), w.values, n.values.to_numpy()) for b in batches for k, lo, w, n in zip(*(b.column(c) for c in range(4))))
        for chunk, of_chunk in itertools.groupby(rows, lambda r: r[0]):
            yield one(chunk, [r[1:] for r in of_chunk])

    return run


def _count(dealt: pa.Table) -> pa.Table:
    """All words of a bucket -> for each chunk its words' numbers and their counts over the corpus; one row has the bucket's totals."""
    word, n = (dealt.column(x).combine_chunks().flatten() for x in ("word", "n"))
    of = word.dictionary_encode().indices.to_numpy()
    c = np.bincount(of, weights=n.to_numpy()).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(dealt.column("no")).to_numpy())]).astype(np.int32)
    once = lambda x: pa.array(np.where(np.arange(dealt.num_rows) == 0, x, 0), pa.int64())
    return pa.table(
        [dealt.column("chunk"), dealt.column("no"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(c[of])), once(c.sum()), once(np.count_nonzero(c))],
        names=["chunk", "no", "c", "train_tokens", "distinct"],
    )


def _base(docs: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk's documents as word numbers, and its words' counts -> the documents' sums of log10(c + 1)."""
    no, count = (words.column(x).combine_chunks().flatten().to_numpy() for x in ("no", "c"))
    c = np.zeros(len(no), np.int64)
    c[no] = count
    log = np.log10(c + 1.0)
    out = defaultdict(list)
    for row in docs.to_pylist():
        at, n = _whole(row["low"], row["high"]), np.array(row["sizes"], np.int64)
        text = np.repeat(np.arange(len(n)), n)
        out["k"].append(row["lo"] + np.arange(len(n)))
        out["doc_id"] += row["doc_id"]
        out["held_out"] += row["held_out"]
        out["n_tokens"].append(n)
        out["n_known"].append(np.bincount(text, weights=c[at] > 0, minlength=len(n)).astype(np.int64))
        out["logs"].append(np.bincount(text, weights=log[at], minlength=len(n)))
    chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    join = lambda name, empty: np.concatenate([np.empty(0, empty), *out[name]])
    return pa.table(
        [pa.array(np.full(len(out["doc_id"]), chunk, np.int64)), pa.array(join("k", np.int64)), pa.array(out["doc_id"], pa.int64()), pa.array(out["held_out"], pa.bool_()), pa.array(join("n_tokens", np.int64)), pa.array(join("n_known", np.int64)), pa.array(join("logs", np.float64))],
        names=["chunk", "k", "doc_id", "held_out", "n_tokens", "n_known", "logs"],
    )


def score_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 8_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row."""
    model = tokenizer(model_file)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))
    gathered = Stored(texts.mapInArrow(_gather(model_file, chunk_chars), _GATHERED_DDL), "gathered", "zstd", by="kind")
    lm = fit(gathered.df, model.get_piece_size(), model.bos_id())
    share = docs.sparkSession.sparkContext.broadcast(lm)
    scores = Stored(gathered.df.where("kind = 'i'").select("chunk", "lo", "sizes", "low").mapInArrow(_score(share, model.bos_id()), "chunk long, k long, score double"), "scores").df
    gathered.drop("i")
    release(docs.sparkSession)
    documents, words = (gathered.reread().where(F.col("kind") == k) for k in "dw")
    # Words are shuffled in lists, by buckets of a bounded number of rows: a word has one row for each chunk at most.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() * SLICE // BUCKET)
    dealt = words.select("chunk", "lo", "word", "n").mapInArrow(_deal(buckets), "bucket int, chunk long, no array<int>, word array<binary>, n array<long>")
    schema = "chunk long, no array<int>, c array<long>, train_tokens long, distinct long"
    counted = Stored(dealt.groupBy("bucket").applyInArrow(_count, schema), "counted", "zstd").df
    release(docs.sparkSession)
    schema = "chunk long, k long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double"
    known = Stored(documents.select("chunk", "lo", "doc_id", "held_out", "sizes", "low", "high").groupBy("chunk").cogroup(counted.select("chunk", "no", "c").groupBy("chunk")).applyInArrow(_base, schema), "bases").df
    total = counted.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("train_tokens", "distinct")))
    gathered.drop()
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("distinct") + 1.0)
    # One row of totals.
    return known.join(scores.hint("merge"), ["chunk", "k"]).crossJoin(F.broadcast(total)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
