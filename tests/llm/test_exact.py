import hashlib
import re
from collections import Counter

import pytest

from pagequarry.llm.exact_dedup import exact_dedup, keep_first

TEXTS = [(1, "a  b"), (0, "a b"), (2, "a\n\tb"), (3, None), (4, ""), (5, " a b"), (None, "x" * 100), (6, "x" * 100), (7, "x" * 99), (7, "x" * 99), (8, "é🎉" * 40), (9, "é🎉" * 40 + "y"), (10, "ab" * 64), (11, "ab" * 64)]


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    out = Counter()
    for _, t in norm:
        pass
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    for t, ids in groups.items():
        keep = min(ids, key=order)
        first = True
        for i in sorted(ids, key=order):
            out[(i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest())] += 1
            first = False
    return out


@pytest.mark.parametrize("options", [{}, {"block_chars": 7}, {"block_chars": 1, "hash_bits": 2}, {"block_chars": 16, "hash_bits": 1}])
def test_against_brute_force(spark, options):
    """Also with hashes so short that most blocks collide."""
    df = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "doc_id long, text string, rid int")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, **options).collect())
    assert got == brute(TEXTS)


def test_keep_first_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in TEXTS], "doc_id long, text string, name string")
    got = keep_first(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([0, 3, 5, 6, 7, 8, 9, 10])
    assert keep_first(df.where("false")).count() == exact_dedup(df.where("false")).count() == 0
