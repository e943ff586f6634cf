import hashlib
import random
import re

import numpy as np
import pytest

from pagequarry.llm.fm_index import FmIndex
from pagequarry.llm.substring_dedup import first_least, remove_repeats


def test_backward_search_counts():
    r = np.random.default_rng(1)
    text = np.append(r.integers(1, 5, 300), 0)
    patterns = r.integers(1, 5, (200, 4))
    windows = np.lib.stride_tricks.sliding_window_view(text, 4)
    for depth in (None, 4, 5, 100):
        lo, hi = FmIndex(text, depth).intervals(patterns)
        assert ((hi - lo) == [(windows == p).all(axis=1).sum() for p in patterns]).all()
        order = FmIndex(text, depth).order
        there = windows[r.integers(0, len(windows), 100)]
        lo1, hi1 = FmIndex(text, depth).intervals(there, until_alone=True)
        lo2, hi2 = FmIndex(text, depth).intervals(there)
        more = hi2 - lo2 > 1
        assert (hi1 - lo1 == hi2 - lo2).all() and (lo1[more] == lo2[more]).all()
        for p, a, b in zip(patterns, lo, hi):
            assert {tuple(np.take(text, range(i, i + 4), mode="wrap")) for i in order[a:b].tolist()} <= {tuple(p)}
    with pytest.raises(ValueError):
        FmIndex(text, 3).intervals(patterns)


def brute(rows):
    last = (1 << 63) - 1
    key = lambda i: last if i is None else i
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, last), key(i))
    out = []
    for i, w in split:
        gone = [0] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [1] * 13
        left = " ".join(x for x, y in zip(w, gone) if not y)
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join(map(str, gone)))]
        out.append((key(i), len(w), spans, left))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(spark, hot):
    r = random.Random(2)
    passages = [" ".join(r.choice("abcdefghijk") * r.randint(1, 3) for _ in range(r.randint(13, 40))) for _ in range(4)]
    rows = [(0, ""), (1, None), (None, passages[0]), (None, passages[1] + " z"), (2, "short"), (3, "same " * 60)]
    for i in range(80):
        t = " ".join(r.choice(["a", "b", f"x{r.randint(0, 50)}"]) for _ in range(r.randint(0, 40)))
        for _ in range(r.randint(0, 3)):
            t += f" {r.choice(passages)}\n {r.choice('zy')}"
        rows.append((10 + i, t))
    rows += rows[8:12] + [(3, "same " * 30)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    for keep_text in (True, False):
        found = remove_repeats(df, hot=hot, keep_text=keep_text).collect()
        got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(x) for x in r.removed], r.kept) for r in found)
        assert got == [(i, n, spans, left if keep_text else hashlib.sha256(left.encode()).hexdigest()) for i, n, spans, left in brute(rows)]


def test_very_long_and_clashing(spark):
    """A text of 120,000 words that holds 40 of another one's; columns named like the operator's own."""
    r = random.Random(4)
    words = [f"w{r.randint(0, 10**7)}" for _ in range(120_000)]
    rows = [(1, " ".join(words), 1, "a", "b"), (2, "new " + " ".join(words[70_000:70_040]) + " end", 2, "a", "b")]
    found = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, k1 int, removed string, kept string")).collect()}
    assert found[1].removed == [] and found[1].kept == rows[0][1]
    assert [tuple(x) for x in found[2].removed] == [(1, 41)] and found[2].kept == "new end"


def test_first_least():
    r = np.random.default_rng(1)
    for n, w in ((1000, 10), (10, 10), (57, 3), (9, 1)):
        h = r.integers(0, 5, n).astype(np.uint64)
        assert (first_least(h, w) == np.arange(n - w + 1) + np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1)).all()


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
