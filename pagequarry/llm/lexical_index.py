"""Ranked lexical search over a two-level quantised index.

The index has a row for each shard of documents.  Its first level are postings by term with each
impact (what a term adds to a document's score for every unit of the term's weight) rounded upwards
to a multiple of ``STEP`` and kept in one byte.  Its second level are the exact counts of the same
postings and the documents' lengths.  A search takes three passes over the shards, each for blocks of items:

1. the documents that hold a term are counted, which gives the terms' weights;
2. byte impacts bound every document's score from above and, since the rounding adds less than one
   step, from below; the k-th best lower bound of all shards is the item's threshold;
3. every document whose upper bound reaches the threshold is scored again with whole numbers from the
   second level, and the best k stay.

A document of the result has a score of at least the threshold, so it is among those scored again.
Tasks hand on at most k rows for each item, never a row for each document.

Terms are maximal runs of ASCII letters and digits and of all other characters from U+0080 on; only
A-Z are lower-cased.  Defined cases: null counts as empty; texts without terms are in no count and are
never found; a null doc_id is ranked after the others of its score; rows that repeat a doc_id are
documents of their own; equal scores are in the order of doc_id; rows that repeat an item_id are one item with the terms
of all; an item without a known term has no rows; an empty table gives an empty result; further
columns are ignored, whatever their names.  A very long text is held whole in its task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_or_empty
from .repetition import groups

_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_APART + _UPPER, b" " * len(_APART) + _UPPER.lower())
#: The same terms for Spark's functions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Impacts are below a million; a byte holds them in steps of this.
STEP = -(-1_000_000 // 255)
#: A shard ends with so many bytes of text, or documents (their places take two bytes).
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: (item, term) rows that are searched together.
BLOCK_TERMS = 20_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def impact(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that a document of ``size`` terms holds ``tf`` times adds for each unit of its weight."""
    m = 25 + (75 * size * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class LexicalIndex:
    """shards: a row for each shard, see ``SHARDS``; n: documents with a term; total: all their terms."""

    shards: DataFrame
    n: int
    total: int


#: terms: joined by spaces; starts: where each term's postings start (int32), and their end; places: documents within the
#: shard (uint16), impacts: in steps (uint8); counts: exact (uint32); sizes: the documents' terms (int64).
SHARDS = "terms binary, starts binary, places binary, impacts binary, counts binary, sizes binary, doc_ids array<long>"


def _totals(batches):
    """Documents with a term, and terms."""
    n = total = 0
    for batch in batches:
        for part in groups(batch, 0):
            texts = [t.translate(_FOLD) for t in part.column(0).to_pylist()]
            n += sum(1 for t in texts if t.strip(b" "))
            inside = np.frombuffer(b" ".join([b"", *texts]), np.uint8) != 0x20
            total += int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])


class _Shard:
    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.words: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.doc_ids: list[int | None] = []
        self.bytes = 0

    def add(self, doc_ids: list, texts: list[bytes]) -> None:
        split = [terms_of(t) for t in texts]
        sizes = [len(w) for w in split]
        self.words.append(np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes)))
        self.sizes += sizes
        self.doc_ids += doc_ids
        self.bytes += sum(map(len, texts))

    def row(self, n: int, total: int) -> pa.RecordBatch:
        sizes, many = np.array(self.sizes, np.int64), len(self.sizes)
        place = np.repeat(np.arange(many), sizes)
        keys, counts = np.unique(np.concatenate(self.words) * many + place, return_counts=True)
        places = keys % many
        starts = np.searchsorted(keys, np.arange(len(self.number) + 1) * many)
        impacts = -(-impact(counts.astype(np.int64), sizes[places], n, max(total, 1)) // STEP)
        packed = [b" ".join(self.number), starts.astype("<i4").tobytes(), places.astype("<u2").tobytes(), impacts.astype("u1").tobytes(), counts.astype("<u4").tobytes(), sizes.astype("<i8").tobytes()]
        ids = pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), pa.array(self.doc_ids, pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array([p], pa.binary()) for p in packed), ids], names=[c.split()[0] for c in SHARDS.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> LexicalIndex:
    """The index of all documents, stored in the shared folder, in shards of about ``shard_bytes`` of text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    sums = rows.select("text").mapInArrow(_totals, "n long, total long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total"))).first()
    n, total = sums.n, sums.total

    def run(batches):
        shard = _Shard()
        for batch in batches:
            for group in groups(batch, 1):
                for at in range(0, group.num_rows, SHARD_DOCS // 2):
                    part = group.slice(at, SHARD_DOCS // 2)
                    shard.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                    if shard.bytes >= shard_bytes or len(shard.sizes) >= SHARD_DOCS // 2:
                        yield shard.row(n, total)
                        shard = _Shard()
        if shard.sizes:
            yield shard.row(n, total)

    return LexicalIndex(store(rows.mapInArrow(run, SHARDS), "lexical-index"), n, total)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times)."""
    lower = F.translate(text_or_empty(text_col), _UPPER.decode(), _UPPER.lower().decode())
    each = items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _in_blocks(entries: DataFrame, n_blocks: int, by: str = "item_id") -> DataFrame:
    """(block, entries), stored: all entries of an item are in one block.  The blocks' size is known to the optimiser from their file."""
    block = F.pmod(F.xxhash64(by), F.lit(n_blocks)).alias("block")
    made = entries.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(*entries.columns))).alias("entries"))
    return store(made.hint("rebalance"), "items")


class _Block:
    """The entries of a block by item, and where their terms are in a shard."""

    def __init__(self, entries: list[dict]):
        self.by_item: dict[int | None, list[tuple[int, int]]] = {}
        self.least: dict[int | None, int] = {}
        number: dict[bytes, int] = {}
        for e in entries:
            k = number.setdefault(e["term"].encode(), len(number))
            if "item_id" in e:
                self.by_item.setdefault(e["item_id"], []).append((k, e["weight"]))
                self.least[e["item_id"]] = max(1, e.get("threshold") or 1)
        self.terms = pa.array(list(number), pa.binary())

    def found_in(self, terms: bytes) -> list[int]:
        """The place of each term among the shard's, or -1."""
        at = pc.index_in(self.terms, value_set=pa.array(terms.split(b" "), pa.binary()))
        return pc.fill_null(at, -1).to_pylist()


def _pairs(batches):
    """Each shard with each block: the batch's row with the block parsed once and the row's buffers."""
    blocks: dict[int, _Block] = {}
    for batch in batches:
        names = batch.schema.names
        for r in range(batch.num_rows):
            row = {c: batch.column(k)[r] for k, c in enumerate(names)}
            key = row["block"].as_py()
            if key not in blocks:
                blocks.clear()  # one at a time
                blocks[key] = _Block(row["entries"].as_py())
            yield row, blocks[key]


def _array(row: dict, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), kind)


def _bounds(row: dict, block: _Block, many: int):
    """For each item its postings (weight, first, end) in the shard, and all documents' sums of weighted steps and of weights."""
    at = block.found_in(row["terms"].as_buffer().to_pybytes())
    starts, places, steps = _array(row, "starts", "<i4"), _array(row, "places", "<u2").astype(np.int64), _array(row, "impacts", "u1").astype(np.int64)
    for item, entries in block.by_item.items():
        held = [(w, int(starts[at[k]]), int(starts[at[k] + 1])) for k, w in entries if at[k] >= 0 and w]
        if held:
            above, weight = np.zeros(many, np.int64), np.zeros(many, np.int64)
            for w, s, e in held:
                here = places[s:e]
                above[here] += w * steps[s:e]
                weight[here] += w
            yield item, held, above, weight, places


def _count_terms(batches):
    """(term, df) over the task's shards."""
    df: dict[bytes, int] = defaultdict(int)
    for row, block in _pairs(batches):
        starts = _array(row, "starts", "<i4")
        for term, k in zip(block.terms.to_pylist(), block.found_in(row["terms"].as_buffer().to_pybytes())):
            if k >= 0:
                df[term] += int(starts[k + 1] - starts[k])
    yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in df], pa.string()), pa.array(list(df.values()), pa.int64())], names=["term", "df"])


def _lower_bounds(k: int):
    """(item_id, lower): the k best lower bounds of the task's documents."""

    def run(batches):
        best: dict[int | None, np.ndarray] = {}
        for row, block in _pairs(batches):
            for item, _, above, weight, _ in _bounds(row, block, len(_array(row, "sizes", "<i8"))):
                lower = STEP * (above - weight) + weight
                lower = np.concatenate([best.get(item, lower[:0]), lower[weight > 0]])
                best[item] = np.partition(lower, -k)[-k:] if len(lower) > k else lower
        of = [i for i, x in best.items() for _ in x]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *best.values()]))], names=["item_id", "lower"])

    return run


def _order(scored: tuple) -> tuple:
    score, doc_id = scored
    return -score, doc_id is None, doc_id or 0


def _rescored(k: int, n: int, total: int):
    """(item_id, doc_id, score, rescored): the k best of the task's documents whose upper bound reaches the item's threshold."""

    def run(batches):
        best: dict[int | None, list[tuple]] = defaultdict(list)
        again: dict[int | None, int] = defaultdict(int)
        for row, block in _pairs(batches):
            sizes, counts, doc_ids = _array(row, "sizes", "<i8"), _array(row, "counts", "<u4"), row["doc_ids"].values
            for item, held, above, _, places in _bounds(row, block, len(sizes)):
                chosen = np.flatnonzero(STEP * above >= block.least[item])
                if not len(chosen):
                    continue
                again[item] += len(chosen)
                score = np.zeros(len(chosen), np.int64)
                for w, s, e in held:
                    at = s + np.searchsorted(places[s:e], chosen)
                    hit = np.flatnonzero(at < e)
                    hit = hit[places[at[hit]] == chosen[hit]]
                    score[hit] += w * impact(counts[at[hit]].astype(np.int64), sizes[chosen[hit]], n, total)
                if len(score) > k:  # all that reach the last place
                    near = score >= max(1, int(np.partition(score, -k)[-k]))
                else:
                    near = score > 0
                ids = doc_ids.take(pa.array(chosen[near])).to_pylist()
                best[item] = heapq.nsmallest(k, best[item] + list(zip(score[near].tolist(), ids)), key=_order)
        rows = [(item, doc_id, score, again[item]) for item, x in best.items() for score, doc_id in x]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=["item_id", "doc_id", "score", "rescored"])

    return run


def search(items: DataFrame, index: LexicalIndex, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item with a score above 0.

    Items come in blocks, so a task holds one shard and one block at a time.
    """
    asked = store(item_terms(items, id_col, text_col), "asked")
    n_blocks = -(-max(1, asked.count()) // block_terms)
    counted = index.shards.select("terms", "starts").crossJoin(_in_blocks(asked.select("term").distinct(), n_blocks, "term")).mapInArrow(_count_terms, "term string, df long")
    df = counted.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(df, "term").select("item_id", "term", (F.col("times") * weight).cast("long").alias("weight"))
    weighted = store(weighted.where("weight > 0"), "weights")
    blocks = _in_blocks(weighted, n_blocks)
    bounds = index.shards.select("terms", "starts", "places", "impacts", "sizes").crossJoin(blocks).mapInArrow(_lower_bounds(k), "item_id long, lower long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("lower")))
    threshold = bounds.withColumn("place", place).where(F.col("place") <= k).groupBy("item_id").agg(F.min(F.when(F.col("place") == k, F.col("lower"))).alias("threshold"))
    # An item has a threshold unless fewer than k documents hold its terms.
    known = weighted.join(threshold.withColumnRenamed("item_id", "of"), F.col("item_id").eqNullSafe(F.col("of")), "left").drop("of")
    found = index.shards.crossJoin(_in_blocks(known, n_blocks)).mapInArrow(_rescored(k, index.n, index.total), "item_id long, doc_id long, score long, rescored long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same by joins, for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
s AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM d),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * (SELECT N FROM s)) // (SELECT L FROM s)) AS m FROM d),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT N FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
