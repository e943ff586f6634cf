import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import keyword
from pagequarry.operators.index_store import KeywordStore, Segment
from pagequarry.operators.manifest import Conflict

WORDS = [f"w{i}" for i in range(40)] + ["été", "x_y"]


def chunk_rows(n, seed, first=0):
    r = random.Random(seed)
    weights = [1 / (1 + i) for i in range(len(WORDS))]
    return [(first + i, first + i, f"d{(first + i) % 4}" if i % 11 else None, r.choice(["y1", "y2", None]), " ".join(r.choices(WORDS, weights, k=r.choice([0, 1, 3, 20, 120])))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, seq long, doc_name string, fiscal_year string, indexed_text string")


def asked(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(WORDS, k=r.choice([1, 2, 8, 25]))), r.choice([None, "", "d1", "d2", "none"]), r.choice([None, None, "y1"])) for i in range(40)]
    rows += [(40, "unknown", None, None), (41, None, None, None), (42, "", "d1", None), (43, "w0 w0 W0", None, None)]
    return rows, spark.createDataFrame(rows, "query_id long, question string, doc_name string, fiscal_year string")


def brute(rows, questions, k=10, k1=1.5, b=0.75):
    split = {c: re.findall(r"\w+", (t or "").lower()) for c, _, _, _, t in rows}
    tfs = {c: Counter(t) for c, t in split.items()}
    n, df = len(rows), Counter(t for c in tfs.values() for t in c)
    avgdl = sum(map(len, split.values())) / max(n, 1)
    found = set()
    for q, text, doc, year in questions:
        terms = [t for t in re.findall(r"\w+", (text or "").lower()) if t in df]
        scored = []
        for c, seq, d, y, _ in rows:
            if terms and (not doc or d == doc) and (not year or y == year):
                norm = k1 * (1 - b + b * len(split[c]) / avgdl)
                score = sum(math.log((n + 1) / df[t]) * (1 + tfs[c][t] * (k1 + 1) / (norm + tfs[c][t])) for t in terms)
                scored.append((-round(score, 9), seq, c))
        found |= {(q, rank, c, round(-s, 4)) for rank, (s, _, c) in enumerate(sorted(scored)[:k], 1)}
    return found


def search(q, index):
    return {(r.query_id, r.bm25_rank, r.chunk_id, round(r.bm25_score, 4)) for r in keyword.keyword_search(q, index).collect()}


@pytest.mark.parametrize("shard, at_once, group", [(4096, 32, 256), (7, 0, 5), (64, 0, 256)])
def test_pruned_search_against_brute_force(spark, monkeypatch, shard, at_once, group):
    for name, value in (("SHARD", shard), ("AT_ONCE", at_once), ("QUESTIONS", group)):
        monkeypatch.setattr(keyword, name, value)
    rows = chunk_rows(300, 1) + [(900, 900, "d1", "y1", None), (901, 901, "d1", "y1", "w0 " * 5000)]
    questions, q = asked(spark)
    index = keyword.build_index(frame(spark, rows).repartition(3))
    assert index.shards.count() >= -(-len(rows) // shard) and index.chunks.groupBy("seg", "shard").count().where(f"count > {shard}").isEmpty()
    assert search(q, index) == brute(rows, questions)


def test_words_are_passed_over_without_loss():
    r = np.random.default_rng(6)
    for _ in range(300):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 6))
        norm, gain = r.uniform(0.5, 3, n), 2.5
        words, total = [], np.zeros(n)
        for _ in range(int(r.integers(1, 8))):
            places = np.flatnonzero(r.random(n) < r.uniform(0.05, 1))
            if len(places):
                tfs, w = r.integers(1, 9, len(places)), r.uniform(0.01, 5)
                part = w * (tfs * gain / (norm[places] + tfs))
                total[places] += part
                words.append((part.max() + r.uniform(0, 0.5), w, places, tfs))
        words.sort(key=lambda x: -x[0])
        open_to = np.flatnonzero(r.random(n) < 0.8)
        if not words:
            continue
        floor = float(r.choice([-np.inf, np.sort(total)[-k] - keyword.SLACK if n >= k else -np.inf]))
        at, parts = keyword.best_of_shard(words, norm, open_to, floor, k, gain)
        want = sorted((p for p in open_to if total[p] > 0 and total[p] >= floor), key=lambda p: (-total[p], p))[:k]
        assert set(want) <= set(at.tolist()) and np.allclose(parts, total[at])


def test_changes_against_a_rebuild(spark, tmp_path):
    store, folder = KeywordStore(spark, f"file://{tmp_path}/k"), f"file://{tmp_path}/k"
    questions, q = asked(spark)
    rows = chunk_rows(120, 2)
    assert store.version() == 0 and store.segments() == [] and store.delete(frame(spark, rows)) == 0 and store.merge() == 0
    with pytest.raises(ValueError):
        store.index()
    assert store.add(frame(spark, rows)) == 1
    more = chunk_rows(60, 3, first=500) + [(700, 700, "d9", None, "brandnew w1")]
    assert store.add(frame(spark, more)) == 2
    rows += more
    assert search(q, KeywordStore(spark, folder).index()) == brute(rows, questions)
    gone = spark.createDataFrame([(i,) for i in [*range(0, 200, 3), 505, 505, 700, 99_999, None]], "chunk_id long")
    assert store.delete(gone) == 3
    dead = {r.chunk_id for r in gone.collect()}
    rows = [r for r in rows if r[0] not in dead]
    assert search(q, store.index()) == brute(rows, questions)
    assert store.index().df.where("term = 'brandnew'").isEmpty()
    back = chunk_rows(20, 4)  # ids that were deleted, with other texts, and ids that are there
    back = [r for r in back if r[0] % 3 == 0]
    assert store.add(frame(spark, back)) == 4
    rows += back
    assert store.delete(spark.createDataFrame([(501,), (3,)], "chunk_id long")) == 5
    rows = [r for r in rows if r[0] not in (501, 3)]
    before = search(q, store.index())
    assert before == brute(rows, questions)
    stats = store.index().stats.first()
    assert store.merge() == 6 and len(store.segments()) == 1
    assert search(q, store.index()) == before and store.index().stats.first() == stats
    assert store.index().chunks.count() == len(rows)
    assert search(q, store.index(5)) == before  # an older version can be read until a vacuum
    assert store.vacuum() == 5 and store.vacuum() == 0 and search(q, KeywordStore(spark, folder).index()) == before
    assert store.add(frame(spark, chunk_rows(0, 1))) == 7 and search(q, store.index()) == before


def test_a_failed_change_loses_nothing(spark, tmp_path, monkeypatch):
    store = KeywordStore(spark, f"file://{tmp_path}/k")
    questions, q = asked(spark)
    rows = chunk_rows(50, 5)
    store.add(frame(spark, rows))
    want = brute(rows, questions)

    def broken(*_):
        raise RuntimeError("lost")

    add, delete = (lambda: store.add(frame(spark, chunk_rows(5, 6, first=100)))), (lambda: store.delete(frame(spark, rows)))
    for change, owner, name in ((add, keyword, "make_blocks"), (add, keyword, "frequencies"), (delete, keyword, "lengths"), (add, KeywordStore, "_commit"), (delete, KeywordStore, "_commit")):
        with monkeypatch.context() as m:
            m.setattr(owner, name, broken)
            with pytest.raises(RuntimeError, match="lost"):
                change()
        assert store.version() == 1
    assert search(q, store.index()) == want
    assert store.vacuum() > 0 and len(store.segments()) == 1 and search(q, store.index()) == want


def test_two_writers(spark, tmp_path):
    store = KeywordStore(spark, f"file://{tmp_path}/k")
    store.add(frame(spark, chunk_rows(5, 1)))
    base, segments = store.version(), store.segments()
    store.add(frame(spark, chunk_rows(5, 2, first=50)))
    with pytest.raises(Conflict):
        store._commit(base, [*segments, Segment(9, "other")])
    assert store.version() == 2 and {s.name for s in store.segments()} >= {s.name for s in segments}


def test_extra_columns_are_kept(spark, tmp_path):
    store = KeywordStore(spark, f"file://{tmp_path}/k")
    store.add(frame(spark, chunk_rows(5, 1)).withColumns({"page_number": F.lit(3), "text": F.lit("raw")}))
    assert {"page_number", "chunk_id", "dl", "tfs"} <= set(store.index().chunks.columns) and "text" not in store.index().chunks.columns


def test_small_parts_find_the_same(spark, monkeypatch):
    """Texts are counted and postings joined in parts of bounded size; a word may then have several blocks in a shard."""
    for name, value in (("TEXT", 300), ("POSTINGS", 50), ("AT_ONCE", 0), ("SHARD", 64)):
        monkeypatch.setattr(keyword, name, value)
    rows = chunk_rows(300, 1) + [(900, 900, "d1", "y1", None), (901, 901, "d1", "y1", "w0 " * 5000)]
    questions, q = asked(spark)
    index = keyword.build_index(frame(spark, rows).repartition(3))
    assert not index.blocks.groupBy("seg", "shard", "term").count().where("count > 1").isEmpty()
    assert search(q, index) == brute(rows, questions)


def test_parts_of_shards_are_bounded():
    tfs = pa.array([[(f"t{j}", 1) for j in range(n)] for n in [20, 20, 20, 90, 5, 5, 5, 0, 5]], pa.map_(pa.string(), pa.int32()))
    shard, place = [1, 1, 1, 1, 1, 2, 2, 3, 3], [0, 1, 2, 3, 4, 0, 1, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 9), pa.array(shard), pa.array(place, pa.int32()), pa.array([1] * 9, pa.int32()), tfs], names=["seg", "shard", "place", "dl", "tfs"])
    parts = list(keyword._shard_parts((batch.slice(at, 2) for at in range(0, 9, 2)), 50))
    assert [(p.column(1).to_pylist(), p.column(2).to_pylist()) for p in parts] == [([1, 1], [0, 1]), ([1], [2]), ([1], [3]), ([1], [4]), ([2, 2], [0, 1]), ([3, 3], [0, 1])]


def test_blocks_are_made_where_the_chunks_lie(spark):
    counted = keyword.in_shards(keyword.count_terms(frame(spark, chunk_rows(50, 3))))
    assert "Exchange" not in keyword.make_blocks(counted)._jdf.queryExecution().executedPlan().toString()
