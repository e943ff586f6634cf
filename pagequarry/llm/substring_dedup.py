"""Substring deduplication with an FM-index per shard.

A window is ``window`` consecutive words.  Words are removed that a window covers which also starts
in a document with a smaller id.

Copies of a whole text are told by its hash; all windows of one start in the document with the least
id among them.  For the rest, every window has an anchor, the one of its short word runs with the
least hash, so equal windows have equal anchors.  Neighbouring windows mostly share theirs, and only
anchors are shuffled, two numbers each.  Anchors met in one text only cannot belong to a window that
another text has.
The stretches of text around the other anchors are sharded by anchor, so that all occurrences of a
window meet in one shard.  A shard indexes its distinct stretches: backward search over the wavelet
tree of the index gives the interval of each window of the streamed stretches, and the least
document id of the interval decides whether the window is a repetition.

A text that repeats its own windows loses nothing by that.  Within a batch of documents anchors are
combined before the shuffle, so a passage that very many documents share moves one row a batch.  Anchors with more than ``hot`` distinct stretches are sharded
by the windows themselves.  Exact copies of a stretch are indexed once.

Defined cases: null counts as empty; a text of fewer words than the window loses nothing; a null
doc_id counts as greater than all others; rows that share a doc_id do not remove each other's words;
rows that are repeated whole are copies with one id, which lose nothing to each other; of ties
between anchors the first is taken; a very long text is cut into stretches like any other, and held
whole by one task; an empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored, release, store, text_or_empty
from .fm_index import FmIndex
from .near_join import WordHashes, mix
from .repetition import groups

ANCHOR = 4
LAST_ID = (1 << 63) - 1
INDEX_WORDS = 120_000
#: Text whose anchors are combined before the shuffle.
BATCH_BYTES = 32 << 20


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1 and k2 (hashes of the text), text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias("text"))


def anchors(words: list[bytes], hashes: WordHashes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash of each window, and the position of its anchor: the run with the least hash."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    runs = len(words) - ANCHOR + 1
    h = np.zeros(runs, np.uint64)
    for k in range(ANCHOR):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + runs]
    h = mix(h)
    at = first_least(h, window - ANCHOR + 1)
    return h[at], at


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the first of its least ones, from runs of doubled widths."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        # Of equal values the one in the left run is at least as far left.
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


def _anchor_rows(window: int):
    """Texts -> h, k1, known (met in two texts of the batch), witness (the batch's one row of h)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in groups(batch, 1, BATCH_BYTES):
                h, k, seen = [], [], set()
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if key not in seen:
                        seen.add(key)
                        h.append(np.unique(anchors(text.split(), hashes, window)[0]))
                        k.append(np.full(len(h[-1]), key, np.int64))
                if not h:
                    continue
                h, k = np.concatenate(h), np.concatenate(k)
                order = np.argsort(h, kind="stable")
                h, k = h[order], k[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                known = ~new
                known[:-1] |= ~new[1:]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(known), pa.array(new)], names=["h", "k1", "known", "witness"])

    return run


def _spans(gone: np.ndarray) -> list[dict[str, int]]:
    """The runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]


_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut(window: int, keep_text: bool):
    """Documents with their text's least id and repeated anchors -> a row for each document, and one for each stretch around such an anchor."""
    to = pa.schema({"k1": pa.int64(), "k2": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "removed": _REMOVED, "kept": pa.string(), "text": pa.binary(), "h": pa.int64(), "start": pa.int32(), "stretch": pa.binary()})

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in groups(batch, 3):
                out = []
                for doc_id, k1, k2, text, owner, repeated in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.split()
                    stretches = []
                    # All windows of a copy start in the document with the text's least id.
                    copy = (LAST_ID if doc_id is None else doc_id) > owner and len(words) >= window
                    if repeated and not copy:
                        h, at = anchors(words, hashes, window)
                        if len(at):
                            wanted = np.isin(h.view(np.int64), np.array(repeated, np.int64))
                            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                            ends = np.append(edge[1:], len(at))
                            for a, b, c in zip(edge.tolist(), ends.tolist(), h[edge].view(np.int64).tolist()):
                                if wanted[a]:
                                    stretches.append((k1, k2, doc_id, None, None, None, None, c, a, b" ".join(words[a : b + window - 1])))
                    whole = b"" if copy else b" ".join(words)
                    removed = [{"start": 0, "end": len(words)}] if copy else []
                    out.append((k1, k2, doc_id, len(words), None if stretches else removed, None if stretches else _kept(whole, keep_text), whole if stretches else None, None, None, None))
                    out += stretches
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)

    return run


_CUT = "k1 long, k2 long, doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string, text binary, h long, start int, stretch binary"


def _kept(text: bytes, keep_text: bool) -> str:
    return text.decode("utf-8", "replace") if keep_text else hashlib.sha256(text).hexdigest()


def least_ids(stretches: list[bytes], owners: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each stretch, in order, the least owner, looked up in an FM-index of all of them; and the windows a stretch has."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = lambda: len(number) + 1
    sizes = np.fromiter((s.count(b" ") + 1 for s in stretches), np.int64, len(stretches))
    words = np.fromiter(map(number.__getitem__, b" ".join(stretches).split(b" ")), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    text = np.insert(words, ends, 0)
    owner = np.repeat(np.array(owners, np.int64), sizes + 1)
    left = np.repeat(ends + np.arange(len(sizes)), sizes + 1) - np.arange(len(text))
    starts = np.flatnonzero(left >= window)
    index = FmIndex(text, window)
    by_order = owner[index.order]
    lo, hi = index.intervals(text[starts[:, None] + np.arange(window)], until_alone=True)
    least = owner[starts]  # of windows that only their own stretch has
    many = np.flatnonzero(hi - lo > 1)
    if len(many):
        # Windows of one length have the same interval or none in common.
        first, at, where = np.unique(lo[many], return_index=True, return_inverse=True)
        cuts = np.stack([first, hi[many][at]], axis=1).reshape(-1)
        least[many] = np.minimum.reduceat(np.append(by_order, LAST_ID), cuts)[::2][where]
    return least, sizes - window + 1


def _search(window: int):
    """Distinct stretches in the order of their shard keys -> the least ids of their windows."""

    def emit(held):
        least, n = least_ids([r[3] for r in held], [r[4] for r in held], window)
        columns = list(zip(*((r[0], r[1], r[2]) for r in held)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(least))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), lists], names=["h", "t1", "t2", "least"])

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # Equal windows have equal shard keys, so an index ends only between keys.
                if size >= INDEX_WORDS and row[5] != key:
                    yield emit(held)
                    held, size = [], 0
                key = row[5]
                held.append(row)
                size += row[3].count(b" ") + 2
        if held:
            yield emit(held)

    return run


def repeated_windows(stretches: DataFrame, window: int, hot: int) -> DataFrame:
    """(h, t1, t2, least), stored: the least document id of every window of every distinct stretch."""
    owner = F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("owner")
    table = Stored(stretches.groupBy("h", "t1", "t2").agg(F.first("stretch").alias("stretch"), owner), "stretches", "zstd")
    distinct = table.df
    release(distinct.sparkSession)
    crowded = store(distinct.groupBy("h").count().where(F.col("count") > hot).select("h"), "hot")
    columns = ["h", "t1", "t2", "stretch", "owner"]

    def looked_up(rows: DataFrame) -> DataFrame:
        dealt = rows.select(*columns, F.col("h").alias("key")).repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(_search(window), "h long, t1 long, t2 long, least array<long>")

    if crowded.isEmpty():
        found = store(looked_up(distinct), "least")
        table.drop()
        return found
    usual = looked_up(distinct.join(crowded, "h", "left_anti"))
    words = F.split(F.col("stretch").cast("string"), " ")
    each = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.array_join(F.slice(words, i + 1, window), " "))
    windows = store(distinct.join(crowded, "h", "left_semi").select("h", "t1", "t2", "owner", F.posexplode(each).alias("place", "w")).withColumns({"a": F.xxhash64("w"), "b": F.xxhash64(F.lit(1), "w")}), "windows")
    single = windows.groupBy("a", "b").agg(F.first("w").cast("binary").alias("stretch"), F.min("owner").alias("owner"))
    found = looked_up(single.select(F.col("a").alias("h"), F.col("a").alias("t1"), F.col("b").alias("t2"), "stretch", "owner"))
    found = store(found.select(F.col("t1").alias("a"), F.col("t2").alias("b"), F.col("least")[0].alias("least")), "hot-windows")
    gathered = windows.join(found, ["a", "b"]).groupBy("h", "t1", "t2").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda x: x["least"]).alias("least"))
    found = store(usual.unionByName(gathered), "least")
    table.drop()
    return found


def _remove(window: int, keep_text: bool):
    """Documents with the starts of repeated windows -> doc_id, n_words, removed, kept."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, n, text, starts in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split(b" ")
                change = np.zeros(n + 1, np.int64)
                for s in starts or ():
                    s = np.array(s, np.int64)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((doc_id, n, _spans(gone), _kept(left, keep_text)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), _REMOVED, pa.string()))], names=["doc_id", "n_words", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, hot: int = 20_000, keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, removed, kept.

    removed: the disjoint intervals (start, end, in words, end exclusive) that repeated windows cover.
    kept: what is left, words joined by one space; without ``keep_text`` its SHA-256 digest in
    lower-case hex, and texts that lose nothing are not stored on the way.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    found = Stored(rows.select("k1", "text").mapInArrow(_anchor_rows(window), "h long, k1 long, known boolean, witness boolean"), "anchors")
    # A window by anchor has one row for each batch that has it, however many texts do.
    of_h = W.partitionBy("h")
    told = F.max("known").over(of_h) | (F.min("k1").over(of_h) != F.max("k1").over(of_h))
    asked = found.df.where("witness").select("h", "k1", "known", told.alias("repeated")).where("repeated and not known").select("h", "k1")
    # Within its batch an anchor that two texts have is known to be repeated.
    by_text = asked.unionByName(found.df.where("known").select("h", "k1")).groupBy("k1").agg(F.collect_set("h").alias("repeated"))
    own = F.coalesce("doc_id", F.lit(LAST_ID))
    owners = rows.groupBy("k1", "k2").agg(F.min(own).alias("owner"))
    known = store(owners.join(by_text, "k1", "left"), "texts")
    del asked, by_text
    found.drop()
    release(spark)
    cut = Stored(rows.join(known, ["k1", "k2"]).select("doc_id", "k1", "k2", "text", "owner", "repeated").mapInArrow(_cut(window, keep_text), _CUT), "cut", "zstd").df
    release(spark)
    stretches = cut.where("h is not null").select("k1", "k2", "doc_id", "h", "start", "stretch", F.xxhash64("stretch").alias("t1"), F.xxhash64(F.lit(1), "stretch").alias("t2"))
    least = repeated_windows(stretches, window, hot)
    release(spark)
    places = F.filter(F.transform("least", lambda m, i: F.when(m < own, F.col("start") + i)), lambda x: x.isNotNull())
    starts = stretches.join(least, ["h", "t1", "t2"]).select("k1", "k2", places.alias("starts")).where("size(starts) > 0").distinct().groupBy("k1", "k2").agg(F.collect_list("starts").alias("starts"))
    touched = cut.where("text is not null").join(starts, ["k1", "k2"], "left").select("doc_id", "n_words", "text", "starts")
    whole = cut.where("kept is not null").select("doc_id", "n_words", "removed", "kept")
    return whole.unionByName(touched.mapInArrow(_remove(window, keep_text), "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string"))
