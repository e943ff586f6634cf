import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import periodic_runs
from pagequarry.llm.periodic_runs import measure, range_minima


def brute(words):
    """(start, length, period) of all runs, by comparing words one by one for each period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_against_brute_force():
    r = random.Random(5)
    texts = []
    for _ in range(1500):
        n = r.randint(0, 60)
        w = [r.choice("abcde"[: r.choice([1, 2, 3, 5])]) for _ in range(n)]
        if n and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        texts.append(w)
    runs, left, n_words = measure([" ".join(w).encode() for w in texts])
    for w, found, kept, n in zip(texts, runs, left, n_words):
        want = brute(w)
        assert [tuple(x) for x in found.tolist()] == want
        assert kept.decode() == collapsed(w, want) and n == len(w)


def test_pairs_in_many_blocks(monkeypatch):
    texts = [b"a b c " * 200, b"x " * 900, b"u v " * 3 + b"w " + b"u v " * 40]
    whole = measure(texts)
    monkeypatch.setattr(periodic_runs, "PAIRS", 1)
    for a, b in zip(whole[0], measure(texts)[0]):
        assert a.tolist() == b.tolist()
    assert whole[0][0].tolist() == [[0, 600, 3]] and whole[0][1].tolist() == [[0, 900, 1]]


def test_range_minima():
    r = np.random.default_rng(2)
    values = r.integers(0, 50, 300)
    first = r.integers(0, 299, 500)
    end = np.array([r.integers(x + 1, 301) for x in first])
    assert range_minima(values, first, end).tolist() == [values[a:b].min() for a, b in zip(first, end)]


def test_text_alone_in_its_group():
    r = random.Random(7)
    for _ in range(400):
        w = [r.choice("aaab") for _ in range(r.randint(6, 40))]
        runs, left, _ = measure([" ".join(w).encode()])
        assert [tuple(x) for x in runs[0].tolist()] == brute(w) and left[0].decode() == collapsed(w, brute(w))


def test_range_longer_than_half_of_the_values():
    assert range_minima(np.arange(12), np.array([1, 0]), np.array([9, 12])).tolist() == [1, 0]


def test_very_long_text():
    words = [str(i) for i in range(30_000)] + ["p", "q", "r"] * 20_000 + ["z"]
    runs, left, _ = measure([" ".join(words).encode()])
    assert runs[0].tolist() == [[30_000, 60_000, 3]]
    assert left[0].decode() == " ".join(words[:30_003] + ["z"])


def test_query_against_brute_force(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    r = random.Random(3)
    rows = [(i, " \n".join(r.choice(["ab", "cd", "é", "x"]) for _ in range(r.randint(1, 120)))) for i in [*ids, *range(900, 930)]]
    rows += [(ids[0], rows[0][1]), (1000, None), (1001, ""), (1002, " \t\v "), (None, "a a a a a a a"), (ids[1], None), (1003, "a a a a a a b b b b b b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "runs": F.lit(1), "Words": F.lit(2), "p": F.lit(None).cast("int")})
    found = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs))).collect()
    assert len(found) == len(rows)
    got = sorted(tuple(x) for x in found if x.doc_id is not None)
    want = []
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        w = w if i is None else planted(i, w)
        runs = brute(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else None
        want.append((
            i, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest(),
        ))
    assert got == sorted(x for x in want if x[0] is not None)
    assert [tuple(x)[1:] for x in found if x.doc_id is None] == [x[1:] for x in want if x[0] is None]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_planted_runs(none)))
    assert found.collect() == [] and found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
