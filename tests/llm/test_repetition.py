import numpy as np
import random
import re
from collections import Counter

from pagequarry.llm import repetition as R
from pagequarry.llm.repetition import COLUMNS, judge, measure, quality_rules


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    c = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    cover, longest = [0] * n, 0
    for i in range(n - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cover[i : i + 8] = [1] * 8
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cover), sum(len(x) for x, y in zip(w, cover) if y), longest if longest >= 8 else 0


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = ["", " \n", "a b\n\na b", "x " * 100, "é b # <", "\x1c\x85"] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(f"{r.choice('pq')}{r.randint(0, 3)}" for _ in range(80)) for _ in range(20)]
    m = measure([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(m[k][i]) for k in COLUMNS[:-1]) == brute(t), t
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[None].n_words == 0 and not got[None].kept
    for i, t in enumerate(texts):
        n, _, _, _, repeat, *_ = brute(t)
        assert got[i].base_failed == (n < 20 or 100 * repeat > 30 * n)


def test_verdict(spark):
    word = [f"w{i}" for i in range(3000)]
    clean, passage = " ".join(word[:400]), " ".join(word[:150])
    rows = [(0, clean), (1, f"{passage} {' '.join(word[1000:1600])} {passage}"), (2, f"{' '.join(word[:20])} {' '.join(word[1000:1600])} {' '.join(word[:20])}")]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept and got[2].kept and got[2].longest_repeat == 20 and got[2].n_maximal_repeats == 1
    assert got[1].longest_repeat == 150 and got[1].repeat_chars > 0 and not got[1].kept
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_limit_fails_a_text_that_passes_the_base_rule():
    word = [f"w{10_000 + i}" for i in range(40_000)]
    fresh = iter(word[1000:])
    new = lambda n: [next(fresh) for _ in range(n)]
    long_text = word[:500] + new(9500) + word[:500] + new(9500)
    share = [x for k in range(5) for x in word[10 * k : 10 * k + 10] + new(40) + word[10 * k : 10 * k + 10]] + new(200)
    short = [x for k in range(30) for x in word[6 * k : 6 * k + 6] + new(3) + word[6 * k : 6 * k + 6] + new(1)]
    few = word[:50] + new(900) + word[:50]
    m = measure([" ".join(t).encode() for t in (long_text, share, short, few)])
    base, kept = judge(m)
    assert base.tolist() == [False, False, False, False]
    assert kept.tolist() == [False, False, False, True]
    share_of = lambda k, i: m[k][i] / m["word_chars"][i]
    # Each of the three fails by one limit only.
    assert m["longest_repeat"].tolist()[:3] == [500, 10, 0]
    assert share_of("short_repeat_chars", 0) < 0.15 and 0.15 < share_of("repeat_chars", 1) and share_of("short_repeat_chars", 1) < 0.25
    assert m["repeat_chars"][2] == 0 and share_of("short_repeat_chars", 2) > 0.25


def test_maximal_repeats_against_brute_force():
    """Distinct substrings with two occurrences or more that cannot be widened to either side without losing one."""
    r = np.random.default_rng(9)
    for least in (1, 2, 4):
        docs = [r.integers(0, 3, n).tolist() for n in (0, 1, 40, 25, 60)] + [[1, 2, 3, 4] * 6, [7] * 9]
        words, doc = np.array([w for d in docs for w in d]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        of, length = R.maximal_repeats(words, doc, *R.suffix_order(words, doc), least)
        expected = []
        for k, d in enumerate(docs):
            at = {}
            for i in range(len(d)):
                for j in range(i + least, len(d) + 1):
                    at.setdefault(tuple(d[i:j]), []).append(i)
            for s, places in at.items():
                lefts, rights = {d[p - 1] if p else -1 - p for p in places}, {d[p + len(s)] if p + len(s) < len(d) else -1 - p for p in places}
                if len(places) > 1 and len(lefts) > 1 and len(rights) > 1:
                    expected.append((k, len(s)))
        assert sorted(zip(of.tolist(), length.tolist())) == sorted(expected)


def test_rows_of_every_kind(spark):
    """Repeated rows, a null id, a very long text, columns with clashing names, and no rows."""
    long = " ".join(f"w{i}" for i in range(150_000)) + " " + " ".join(f"r{i}" for i in range(300)) * 1 + " mid " + " ".join(f"r{i}" for i in range(300))
    rows = [(1, "a b " * 30, 1, "x"), (1, "a b " * 30, 1, "x"), (None, None, 2, "y"), (5, long, 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = R.quality_rules(df).collect()
    assert len(got) == 4 and len({tuple(x) for x in got if x.doc_id == 1}) == 1
    deep = next(x for x in got if x.doc_id == 5)
    assert (deep.n_words, deep.longest_repeat, deep.n_maximal_repeats, deep.base_failed, deep.kept) == (150_601, 300, 1, False, False)
    assert [x.kept for x in got if x.doc_id is None] == [False]
    assert R.quality_rules(df.where("false")).count() == 0
