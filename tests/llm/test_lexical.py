import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import lexical_index as li


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    """Every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    found = set()
    for item, ts in asked.items():
        scored = []
        for doc_id, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort()
        found |= {(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(scored[:k], 1)}
    return found


def example():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "x-y", "A_B", "été", "9", "a.b"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(words, weights, k=r.choice([0, 1, 5, 30, 300])))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "--- ..."), (None, "w3 w4 été"), (7, docs[7][1]), (503, docs[9][1]), (504, "w1 " * 40_000 + "rare"), (505, "RARE rare"), (506, "İ ﬁ \x85 \xa0w1")]
    items = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 4, 30])))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "unknown words only"), (43, "rare RARE w1"), (44, "w0 w0 w0"), (45, "İ"), (3, "twice w5"), (None, "w9 w2")]
    return docs, items


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("shard_bytes, block_terms, k", [(1 << 24, 20_000, 10), (2_000, 20, 10), (300, 7, 3)])
def test_search_against_brute_force(spark, shard_bytes, block_terms, k):
    docs, items = example()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("term", "score", "block")}).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "doc_id", "block")})
    index = li.build_index(d, shard_bytes=shard_bytes)
    assert rows(li.search(q, index, k, block_terms=block_terms)) == brute(docs, items, k)


def test_few_documents_are_scored_again(spark):
    r = random.Random(3)
    docs = [(i, " ".join(f"w{min(int(r.expovariate(0.05)), 200)}" for _ in range(r.randint(5, 200)))) for i in range(3000)]
    index = li.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    sums = spark.createDataFrame([(1, "w1 w60 w90"), (2, "w100")], "item_id long, text string")
    assert rows(li.search(sums, index)) == brute(docs, [(1, "w1 w60 w90"), (2, "w100")])
    entries = [{"item_id": 1, "term": t, "weight": w} for t, w in (("w60", 2000), ("w90", 3000))]
    row = index.shards.selectExpr("0L AS block", "*").toPandas().iloc[0]
    at = {c: memoryview(row[c]) for c in ("terms", "starts", "places", "impacts", "counts", "sizes")}

    class Buffer:
        def __init__(self, x):
            self.x = x

        def as_buffer(self):
            import pyarrow as pa

            return pa.py_buffer(self.x)

    held = {c: Buffer(bytes(x)) for c, x in at.items()}
    sizes = np.frombuffer(bytes(at["sizes"]), "<i8")
    ((_, postings, above, weight, places),) = li._bounds(held, li._Block(entries), len(sizes))
    exact, counts = np.zeros(len(sizes), np.int64), np.frombuffer(bytes(at["counts"]), "<u4").astype(np.int64)
    for w, s, e in postings:
        exact[places[s:e]] += w * li.impact(counts[s:e], sizes[places[s:e]], index.n, index.total)
    upper, lower = li.STEP * above, li.STEP * (above - weight) + weight
    assert (upper >= exact).all() and (lower <= exact)[weight > 0].all()
    assert (upper >= np.sort(lower)[-10]).sum() < 0.2 * (weight > 0).sum()


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item, no_item = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert li.search(item, li.build_index(none)).collect() == [] == li.search(no_item, li.build_index(one)).collect()
    assert li.search(item, li.build_index(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"))).collect() == []
    assert rows(li.search(item, li.build_index(one))) == brute([(1, "a b")], [(1, "a")])
