"""Quality rules with repetition measured by a suffix array.

The words of a document are numbered and its suffixes sorted by prefix doubling; the ranks of every
doubling give the longest common prefix of neighbours in that order.  The intervals of suffixes that
share a prefix of ``min_repeat`` words or more are the repeated substrings; one before whose
occurrences no single word stands is maximal, and counted once.  The union of the spans of all
occurrences is the repeated part of the document.  Limited are its share of the characters, the share with repeats from ``short_repeat``
words on, and the longest repeat, whatever the document's length; each acts below the base rule.

Many documents are sorted together, each in its own range of ranks.  Only documents in which the
hash of a window of the least counted length occurs twice are sorted at all: without such a window there
is no repeat, and a false match of hashes only costs the sort.

Defined cases: null counts as empty; a document without words has zeros everywhere and fails for
having fewer than ``min_words`` words; lines without a word are not counted; a null doc_id stays null;
rows that repeat a doc_id are measured each; equal suffixes of a document are in the order of their
ends; an empty table gives an empty result; further columns are ignored, whatever their names.  A very
long text is measured whole: memory follows the longest document of a group.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
GROUP_BYTES = 4 << 20


@dataclass(frozen=True)
class Limits:
    """window: words of the base rule's repeats; max_share: of repeats from min_repeat words; short_share: from short_repeat words."""

    min_words: int = 20
    window: int = 8
    base_share: float = 0.30
    min_repeat: int = 8
    max_share: float = 0.15
    short_repeat: int = 5
    short_share: float = 0.25
    longest_words: int = 100


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def docs_with_repeats(words: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the documents in which the hash of a window occurs twice."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, doc.dtype)
    m = _mix(words.astype(np.uint64))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + m[k : k + n]
    inside = doc[:n] == doc[window - 1 :]
    d = doc[:n][inside]
    h = _mix(h[inside] ^ _mix(d.astype(np.uint64)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.unique(d[order[1:][same]])


def suffix_order(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of the documents in order, and the longest common prefix of each with the next one; 0 between documents."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = doc.astype(np.int64) * (int(words.max()) + 1) + words
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int32)
    ranks, width = [rank], 1
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), n - 1)
    end = np.repeat(last + 1, np.diff(np.concatenate([[-1], last])))
    position = np.arange(n)
    while True:
        ahead = position + width
        inside = ahead < end
        if not inside.any():
            break
        after = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = rank.astype(np.int64) * (n + 2) + after
        distinct, rank = np.unique(keys, return_inverse=True)
        rank = rank.astype(np.int32)
        ranks.append(rank)
        width *= 2
        if len(distinct) == n:
            break
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(doc[a] == doc[b])
    for level in range(len(ranks) - 1, -1, -1):
        step, r = 1 << level, ranks[level]
        x, y = a[live] + common[live], b[live] + common[live]
        fits = (x + step <= end[a[live]]) & (y + step <= end[b[live]])
        equal = np.zeros(len(live), bool)
        equal[fits] = r[x[fits]] == r[y[fits]]
        common[live[equal]] += step
    return order, common


def longest_repeats(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each position the length of the longest prefix of its suffix that starts elsewhere in the document too."""
    found = np.zeros(len(order), np.int64)
    found[order[1:]] = common
    found[order[:-1]] = np.maximum(found[order[:-1]], common)
    return found


def lcp_intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, length) of every longest common prefix interval of ``least`` and more.

    Such an interval is a run of suffixes first..last that share just ``length``: the occurrences
    of a repeated substring that no longer one on its right has all of.
    """
    live = np.flatnonzero(common >= least)
    found, stack, before = [], [], -2
    for k, value in zip(live.tolist(), common[live].tolist()):
        if k != before + 1:
            found += [(first, before + 1, length) for first, length in stack]
            stack = []
        first = k
        while stack and stack[-1][1] >= value:
            if stack[-1][1] == value:
                first = None
                break
            first, length = stack.pop()
            found.append((first, k, length))
        if first is not None:
            stack.append((first, value))
        before = k
    found += [(first, before + 1, length) for first, length in stack]
    columns = np.array(found, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def maximal_repeats(words: np.ndarray, doc: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of each distinct repeated substring of ``least`` words or more that no longer one has all occurrences of, on either side."""
    first, last, length = lcp_intervals(common, least)
    before = np.where((order > 0) & (doc[order] == doc[np.maximum(order - 1, 0)]), words[np.maximum(order - 1, 0)], -1)
    # An interval can be widened to the left if one word stands before all its occurrences.
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    maximal = changes[last] > changes[first]
    return doc[order[first[maximal]]], length[maximal]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list[bytes], limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """The measures of each text, given in UTF-8."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [t.split() for t in texts]  # at the six white space characters, no others
    n_words = np.array([len(w) for w in split], np.int64)
    total = int(n_words.sum())
    words = np.fromiter((i for w in split for i in map(number.__getitem__, w)), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), n_words)
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_repeat_words", "repeat_chars", "longest_repeat", "n_maximal_repeats", "short_repeat_chars")}
    least = min(limits.window, limits.min_repeat, limits.short_repeat)
    chosen = docs_with_repeats(words, doc, least)
    if len(chosen):
        pick = np.isin(doc, chosen)
        w, d = words[pick], doc[pick]
        order, common = suffix_order(w, d)
        longest = longest_repeats(order, common)
        n, chars = len(w), np.fromiter((len(x.decode("utf-8", "replace")) for k in chosen for x in split[k]), np.int64, len(w))

        def total_by_doc(values):
            return np.bincount(d, weights=values, minlength=len(texts)).astype(np.int64)

        at = np.flatnonzero(longest >= limits.window)
        out["n_repeat_words"] = total_by_doc(covered(at, longest[at], n))
        at = np.flatnonzero(longest >= limits.short_repeat)
        out["short_repeat_chars"] = total_by_doc(covered(at, longest[at], n) * chars)
        at = np.flatnonzero(longest >= limits.min_repeat)
        out["repeat_chars"] = total_by_doc(covered(at, longest[at], n) * chars)
        of, length = maximal_repeats(w, d, order, common, limits.min_repeat)
        np.maximum.at(out["longest_repeat"], of, length)
        out["n_maximal_repeats"] = np.bincount(of, minlength=len(texts)).astype(np.int64)
    return out | {
        "n_words": n_words,
        "word_chars": np.array([_code_points(t) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
    }


#: The bytes of UTF-8 that continue a character, and white space.
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + WHITE


def _code_points(text: bytes) -> int:
    return len(text.translate(None, _NOT_COUNTED))


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def judge(m: dict[str, np.ndarray], limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    n = m["n_words"]
    base = (n < limits.min_words) | (100 * m["n_repeat_words"] > round(100 * limits.base_share) * n)
    share = m["repeat_chars"] > limits.max_share * m["word_chars"]
    short = m["short_repeat_chars"] > limits.short_share * m["word_chars"]
    longest = m["longest_repeat"] > limits.longest_words
    return base, ~(base | share | short | longest)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "n_maximal_repeats")
OUTPUT = (*COLUMNS, "short_repeat_chars")


def groups(batch: pa.RecordBatch, column: int, most: int = GROUP_BYTES):
    """Slices of about ``most`` bytes of text, of one row at least."""
    at = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n or 0
    if batch.num_rows > at:
        yield batch.slice(at)


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed and kept: a row for each row."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in OUTPUT) + ", base_failed boolean, kept boolean"
    names = ["doc_id", *OUTPUT, "base_failed", "kept"]

    def run(batches):
        for batch in batches:
            for part in groups(batch, 1):
                m = measure(part.column(1).to_pylist(), limits)
                base, kept = judge(m, limits)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c]) for c in OUTPUT), pa.array(base), pa.array(kept)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
