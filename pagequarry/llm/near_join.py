"""Similarity join on word n-grams: MinHash banding, then verification on full n-gram sets.

Documents with the same n-gram set form one class, so exact copies are one row from then on.  Each
class has a MinHash signature cut into bands; the number of bands and of rows in a band follow from
the similarity and the wanted recall.  Bands are shuffled by their hashes; classes that share one
are candidates.  Candidates are not written out as pairs: each bucket links its classes to its
least one, and the connected components of these links bring together all classes that could be
pairs.  Within a component every pair is verified on the full sets of n-grams of the texts, as
products of 0/1 matrices; n-grams are numbered exactly there, not hashed.  A component of more than
``block`` classes is cut into blocks, and every pair of blocks is a task of its own, so no task
holds more than two blocks.

The result has the number of linked documents of each document and the class it belongs to, the
connected component of verified links.

Defined cases: null counts as empty; a text without a word has no n-grams, no links and is a class
of its own; a text of fewer words than ``ngram`` has one n-gram, all its words; a null doc_id comes
after all others; repeated rows are copies of each other; an empty table gives an empty result;
further columns are ignored by :func:`near_join` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty, unused
from .components import connected_components
from .repetition import groups

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows for which, at the threshold, some band agrees with the wanted probability."""
    best = None
    for rows in range(1, max_hashes + 1):
        p, bands = threshold**rows, 1
        while bands * rows <= max_hashes and 1 - (1 - p) ** bands < recall:
            bands += 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_hashes(words: list[bytes], hashes: WordHashes, ngram: int) -> np.ndarray:
    """The distinct hashes of a document's n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < ngram:
        h = np.full(1, len(w), np.uint64)
        for x in w:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
        return h
    n = len(w) - ngram + 1
    h = np.zeros(n, np.uint64)
    for k in range(ngram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique(mix(h))


def sketch(docs: DataFrame, bands: int, rows: int, ngram: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2 (the row's key), n, h1, h2 (the set's number of n-grams and hash), bands."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    schema = "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, bands array<long>"
    names = ["doc_id", "k1", "k2", "n", "h1", "h2", "bands"]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in groups(batch, 3):
                sets = [ngram_hashes(t.split(), hashes, ngram) for t in part.column(3).to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                out = np.zeros((len(sets), bands), np.uint64)
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    h1[full] = np.add.reduceat(mix(every ^ np.uint64(0x51ED270B3A1C99D7)), starts)
                    h2[full] = np.add.reduceat(mix(every ^ np.uint64(0xA24BAED4963EE407)), starts)
                    for band in range(bands):
                        code = np.full(len(full), band + 1, np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            code = mix(code ^ np.minimum.reduceat(every * a[k] + b[k], starts))
                        out[full, band] = code
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(out.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=names)

    return keyed(docs, id_col, text_col).select("doc_id", "k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and two hashes of both, which name the row."""
    text, doc_id = text_or_empty(text_col), F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2"))


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def exact_sets(texts: list[bytes], ngram: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, n-gram) numbers of all distinct pairs, and the number of n-grams; equal numbers are equal n-grams."""
    number: dict[bytes, int] = {}
    docs, grams, short = [], [], {}
    split = [t.split() for t in texts]
    w = np.fromiter((number.setdefault(x, len(number)) for s in split for x in s), np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = len(w) - ngram + 1
    count = 0
    if n > 0:
        # Named word by word; windows that cross documents are dropped afterwards.
        name = w[:n]
        for k in range(1, ngram):
            name = _pair_names(name, w[k : k + n])
        inside = doc[:n] == doc[ngram - 1 :]
        docs.append(doc[:n][inside])
        grams.append(name[inside])
        count = int(name.max()) + 1
    for d, s in enumerate(split):
        if 0 < len(s) < ngram:
            docs.append(np.array([d]))
            grams.append(np.array([count + short.setdefault(tuple(s), len(short))]))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    count += len(short)
    pairs = np.unique(np.concatenate(docs) * count + np.concatenate(grams))
    return pairs // count, pairs % count, count


def verified(texts: list[bytes], ngram: int, threshold: Fraction, cut: int, columns: int = 4096) -> np.ndarray:
    """Which of the texts link: a square 0/1 matrix, or, with cut > 0, those before ``cut`` against those from it on."""
    doc, gram, count = exact_sets(texts, ngram)
    n = np.bincount(doc, minlength=len(texts))
    left = slice(0, cut or len(texts))
    right = slice(cut, len(texts))
    common = np.zeros((left.stop, len(texts) - cut), np.float32)
    if count:
        uses = np.bincount(gram, minlength=count)
        shared = uses[gram] > 1
        column = np.cumsum(uses > 1) - 1
        doc, gram = doc[shared], column[gram[shared]]
        order = np.argsort(gram, kind="stable")
        doc, gram = doc[order], gram[order]
        width = int((uses > 1).sum())
        for at in range(0, width, columns):
            lo, hi = np.searchsorted(gram, [at, at + columns])
            m = np.zeros((len(texts), min(columns, width - at)), np.float32)
            m[doc[lo:hi], gram[lo:hi] - at] = 1
            common += m[left] @ m[right].T
    total = n[left][:, None] + n[right][None, :]
    t = threshold
    linked = (common > 0) & (common.astype(np.int64) * (t.denominator + t.numerator) >= t.numerator * total)
    if not cut:
        np.fill_diagonal(linked, False)
    return linked


def local_roots(linked: np.ndarray, cut: int) -> np.ndarray:
    """The least index linked to each one, directly or not."""
    n = linked.shape[0] + (linked.shape[1] if cut else 0)
    root = np.arange(n)
    while True:
        if cut:
            a = np.where(linked, root[None, cut:], n).min(axis=1, initial=n)
            b = np.where(linked, root[:cut, None], n).min(axis=0, initial=n)
            new = np.minimum(root, np.concatenate([a, b]))
        else:
            new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify_groups(ngram: int, threshold: Fraction):
    """Rows sorted by (component, i, j) -> (cid, links, root) of each group of them."""

    def group(rows):
        _, i, j = rows[0][:3]
        rows = sorted(rows, key=lambda r: (r[4], r[3]))
        cut = sum(r[4] == i for r in rows) if i != j else 0
        if i != j and cut in (0, len(rows)):
            return []
        linked = verified([r[6] for r in rows], ngram, threshold, cut)
        size = np.array([r[5] for r in rows], np.int64)
        if cut:
            links = np.concatenate([linked @ size[cut:], linked.T @ size[:cut]])
        else:
            links = linked @ size
        root = local_roots(linked, cut)
        least = np.full(len(rows), np.iinfo(np.int64).max)
        cid = np.array([r[3] for r in rows], np.int64)
        np.minimum.at(least, root, cid)
        return [(int(c), int(k), int(m)) for c, k, m in zip(cid, links, least[root]) if k]

    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += group(held)
                    held = []
                # The rows of one class are sorted together, and have one text: one is held.
                if not held or held[-1][3] != row[3]:
                    held.append(row)
            if len(out) > 10_000:
                yield _triples(out)
                out = []
        if held:
            out += group(held)
        yield _triples(out)

    return run


def _triples(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cid", "links", "root"])


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 2000) -> DataFrame:
    """One row per input row: doc_id, class_id (the least doc_id of its class), n_links, kept, and the row's key k1, k2."""
    bands, rows = choose_bands(threshold, recall)
    sketches = store(sketch(docs, bands, rows, ngram, id_col, text_col), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2"))
    classes = store(
        sketches.where("n > 0").groupBy("n", "h1", "h2").agg(least.alias("least"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")).withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    banded = classes.select("cid", F.posexplode("bands").alias("band", "code"))
    buckets = store(banded.groupBy("band", "code").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    candidates = store(connected_components(banded.join(buckets, ["band", "code"]).select(F.col("cid").alias("src"), F.col("first").alias("dst"))), "candidates")
    members = candidates.join(classes.select("cid", "size", "least.k1", "least.k2"), F.col("node") == F.col("cid"))
    parts = store(candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "parts")
    placed = members.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # A class meets every block of its component: pairs (i, j) of blocks with i <= j.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    routed = store(placed.select("cid", "size", "k1", "k2", "root", "own", other).select("cid", "size", "k1", "k2", F.col("root").alias("component"), "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "routed")
    texts = keyed(docs, id_col, text_col).select("k1", "k2", F.col("text").cast("binary").alias("text"))
    # The same plan at every size: no broadcast while there are few candidates.
    needed = texts.join(routed.hint("merge"), ["k1", "k2"]).select("component", "i", "j", "cid", "own", "size", "text")
    dealt = needed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "cid")
    found = store(dealt.mapInArrow(_verify_groups(ngram, Fraction(threshold).limit_denominator(1000)), "cid long, links long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = store(connected_components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst"))), "roots")
    by_class = store(
        classes.select("cid", "n", "h1", "h2", "size", "least").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").select("n", "h1", "h2", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "by-class"
    )
    first = by_class.groupBy("root").agg(F.min("least").alias("first"))
    named = store(by_class.join(first, "root").select("n", "h1", "h2", "size", "links", "first"), "named")
    full = sketches.where("n > 0").join(named, ["n", "h1", "h2"]).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), (F.col("size") - 1 + F.col("links")).alias("n_links"), ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("kept"), "k1", "k2"
    )
    empty = sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "k1", "k2")
    return full.unionByName(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which one of each class stays, with all their columns."""
    k1, k2 = unused(docs, "k1", "k2")
    kept = near_join(docs, id_col, text_col, **options).where("kept").select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    text, doc_id = text_or_empty(text_col), F.col(id_col).cast("long")
    rows = docs.withColumns({k1: F.xxhash64(doc_id, text), k2: F.xxhash64(F.lit(1), text, doc_id)})
    # Repeated rows have one key; one of them stays.
    return rows.join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)
