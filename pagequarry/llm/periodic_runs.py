"""Periodic runs by a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q that cannot be widened to either side
with this period.  Every run of period p and of two periods or more holds two neighbouring points jp
and (j + 1)p of the grid of p.  The common extension of the two points to the right is the minimum
of the longest common prefixes between their places in the suffix array; that to the left comes the
same way from the suffix array of the reversed words.  Both together give the whole run, so n words
take n / 1 + n / 2 + ... pairs of points.  Points at different words are on no run of this period
and are not asked for.  A run is met under its smallest period and under multiples of it, always
with the same ends, so the least period found for a stretch is its period.

The minima come from a sparse table of which one level is held at a time.  Many documents are sorted
together, each in its own range of ranks; only those in which a window of five words occurs twice are
sorted at all, since every run that is reported repeats such a window.

Defined cases: null counts as empty; documents without words or runs have no runs and keep all their
words; a null doc_id stays null; rows that repeat a doc_id are taken each; an empty table gives an
empty result; further columns are ignored, whatever their names.  A very long text is handled whole:
memory follows the longest document of a group, the pairs of points are taken block by block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .repetition import docs_with_repeats, groups, suffix_order

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Any run of that length has a window of so many words twice, one period apart.
WITNESS = 5
#: Pairs of points that are looked at together.
PAIRS = 1 << 20


def range_minima(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[first:end] of each range; no range is empty."""
    found = np.empty(len(first), values.dtype)
    level = np.frexp((end - first).astype(np.float64))[1] - 1
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(int(level.max(initial=0)) + 2))
    table = values
    for k in range(len(cuts) - 1):
        pick = by_level[cuts[k] : cuts[k + 1]]
        found[pick] = np.minimum(table[first[pick]], table[end[pick] - (1 << k)])
        if k + 2 < len(cuts):  # a level above the longest range may have no entry
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return found


class Extensions:
    """Longest common extensions to the right of two positions of a document."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        order, self.common = suffix_order(words, doc)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.place[a], self.place[b]
        return range_minima(self.common, np.minimum(x, y), np.maximum(x, y))


def _distinct(found: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) with the same ends the one of the least period, by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period; words are numbers, those of a document stand together."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    n = len(words)
    ahead, back = Extensions(words, doc), Extensions(words[::-1], doc[::-1])
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(starts, n))
    most = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    of = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[of] - 1) // period
    until = np.cumsum(points)
    found, at = [np.zeros((0, 3), np.int64)], 0
    while at < len(of):
        before = until[at] - points[at]
        end = max(at + 1, int(np.searchsorted(until, before + max(PAIRS, n), "right")))
        count = points[at:end]
        p = np.repeat(period[at:end], count)
        first = np.repeat(starts[of[at:end]], count)
        j = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        x = first + j * p
        at = end
        same = words[x] == words[x + p]
        x, p, first = x[same], p[same], first[same]
        if not len(x):
            continue
        right = ahead(x, x + p)
        left = np.zeros(len(x), np.int64)
        inner = x > first
        if inner.any():  # position i is n - 1 - i from the other side
            left[inner] = back(n - x[inner], n - x[inner] - p[inner])
        length = left + p + right
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        begin = x[long] - left[long]
        found.append(_distinct(np.stack([begin, begin + length[long], p[long]], axis=1)))
    return _distinct(np.concatenate(found))


def measure(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """For each text its runs (start, length, period), what is left of it, and its number of words."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [t.split() for t in texts]  # at the six white space characters, no others
    n_words = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((i for w in split for i in map(number.__getitem__, w)), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(texts)), n_words)
    pick = np.isin(doc, docs_with_repeats(words, doc, WITNESS))
    w, d = words[pick], doc[pick]
    found = runs_of(w, d)
    none = np.zeros((0, 3), np.int64)
    runs, left = [none] * len(texts), [b" ".join(x) for x in split]
    if len(found):
        of = d[found[:, 0]]
        for k in np.unique(of):
            begin = np.searchsorted(d, k)
            start, end, period = (found[of == k] - [begin, begin, 0]).T
            change = np.zeros(n_words[k] + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            stays = np.cumsum(change[:-1]) == 0
            runs[k] = np.stack([start, end - start, period], axis=1)
            left[k] = b" ".join([x for x, s in zip(split[k], stays) if s])
    return runs, left, n_words


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words, by start, then period) and collapsed: a row for each row.

    collapsed: the words joined by one space, without those that a run has after its first period.
    """

    def run(batches):
        for batch in batches:
            for part in groups(batch, 1):
                runs, left, n_words = measure(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                rows = np.concatenate(runs)
                of = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), lists, pa.array(left, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def highest_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; of equal ones the first."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    better = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.lit(None).cast(kind), lambda best, x: F.when(best.isNull() | better(x, best), x).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the highest run and digests, from the rows of :func:`find_runs`."""
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    best = found.withColumn("best", highest_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which documents chosen by a checksum of their id end in a run.

    With h the CRC-32 of the decimal id and g = h div 10, a document with h % 10 = 0 repeats its
    words from a = g % n on with period 1 + (n - a) div (3 + g % 8).  Null ids choose no document.
    """
    words = F.filter(F.split(text_or_empty("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_or_empty("text").alias("text"), h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # The head, then the first p words from a on as often as needed, cut to the length.
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int")), F.expr("int((n - a) div p + 1)")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n").cast("int")), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))
