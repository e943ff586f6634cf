"""Clashing column names, repeated rows, very long texts, null ids and entropies, for the operators that keep rows or columns."""

from collections import Counter

import numpy as np
import pytest

from pagequarry.llm import common, exact_dedup, mixing, near_join, toxicity

LONG = " ".join(f"w{i}" for i in range(60_000))
COLUMNS = "doc_id long, text string, source string, key string, k1 int, k2 int, block int, copies int, own int, turn int, _key int, `a``b.c` int"


def rows():
    fill = ("k", 1, 2, 3, 4, 5, 6, 7, 8)
    texts = [(1, "one two three four five six seven"), (2, "one two  three four five six seven"), (3, LONG), (3, LONG), (None, "z"), (None, None), (4, LONG + " end")]
    return [(i, t, "s", *fill) for i, t in texts]


@pytest.mark.parametrize("keep, left", [(exact_dedup.keep_first, {1: 1, 3: 1, 4: 1, None: 2}), (near_join.keep_one, {1: 1, 3: 1, None: 2}), (mixing.mixed, {1: 1, 2: 1, 3: 2, 4: 1, None: 2})])
def test_rows_are_kept_with_all_their_columns(spark, keep, left):
    df = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    got = keep(df)
    assert got.columns == df.columns
    found = got.collect()
    assert Counter(r.doc_id for r in found) == left and {tuple(r)[3:] for r in found} == {rows()[0][3:]}
    assert keep(df.where("false")).count() == 0


def test_block_names_do_not_depend_on_partitions(spark):
    texts = [(i, f"{'ab' * (i % 5)}{i % 7}" * 40) for i in range(60)]
    names = []
    for parts in (1, 5):
        found = exact_dedup.identities(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts), block_chars=8)
        names.append({r.doc_id: (r.n_blocks, r.name) for r in found.collect()})
    assert names[0] == names[1] and len(set(names[0].values())) == len({t for _, t in texts})


def test_entropies_on_both_sides_of_the_natural_one(spark):
    tokens = [("a", 600), ("b", 300), ("c", 100)]
    sources = spark.createDataFrame(tokens, "source string, tokens long")
    for target in (1.05, 0.9, 0.5, 0.1):
        w = np.array([r.weight for r in mixing.weights(sources, target, 2.0).collect()])
        assert abs(-(w * np.log(w)).sum() - target) < 1e-6 and abs(w.sum() - 1) < 1e-9


def test_repeated_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(40) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    found = toxicity.training_rows(docs, labels, "doc_id", "text", 5, 7)
    assert len(found) == len({i for i, *_ in found}) == 12 and found == toxicity.training_rows(docs.repartition(7), labels, "doc_id", "text", 5, 7)


def test_toxicity_score_against_plain_loops():
    r = np.random.default_rng(4)
    model = toxicity.ToxicityModel(r.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.3, 0.8, -0.2, by_length=0.05)
    for text in ("", None, "One", "a bb ccc dddd eeeee ffffff Gggggg", LONG[:5000], "x" * 3000):
        words = (text or "").lower().split()
        logits = [np.mean([model.ngram[b] for b in toxicity.word_ngrams(w.encode())], dtype=np.float64) for w in words]
        spans = [np.mean(logits[i : i + toxicity.SPAN]) for i in range(max(1, len(words) - toxicity.SPAN + 1))] if words else []
        worst = 0.3 + (max(spans) if spans else 0.0)
        expected = 1 / (1 + np.exp(-(0.8 * worst + 0.05 * np.log(max(1, len(spans))) - 0.2)))
        assert abs(model.score(text) - expected) < 1e-5


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
