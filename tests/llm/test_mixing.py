import math
from collections import Counter

from pyspark.sql import functions as F

from pagequarry.llm import mixing


def docs(spark, sizes):
    rows = [(1000 * k + i, "w " * n, s, "x") for k, (s, n, count) in enumerate(sizes) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")


def test_repetition_limit_and_whole_passes(spark):
    d = docs(spark, [("big", 5, 900), ("small", 5, 90), (None, 5, 9)])
    rows = mixing.mix_sources(d, blocks=64, max_repeats=2.0).collect()
    assert len(rows) == 999
    copies = {s: sorted({r.copies for r in rows if r.source == s}) for s in ("big", "small", None)}
    assert copies["big"] == [1] and copies[None] == [2] and copies["small"] == [1, 2]
    mixed = mixing.mixed(d, blocks=64, max_repeats=2.0)
    assert mixed.columns == d.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows})


def test_entropy_target_and_budget(spark):
    d = docs(spark, [("a", 10, 300), ("b", 10, 60), ("c", 10, 6)])
    rows = mixing.mix_sources(d, blocks=128, target_entropy=0.9, budget_tokens=1000).collect()
    w = {r.source: r.weight for r in rows}
    assert abs(sum(w.values()) - 1) < 1e-9
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.9) < 1e-6
    for s, x in w.items():
        taken = sum(r.copies * r.n_tokens for r in rows if r.source == s)
        # At most one block more than the source's budget.
        block = max(Counter(r.block for r in rows if r.source == s).values()) * 10
        assert x * 1000 - 1 <= taken <= x * 1000 + block + 1


def test_edges(spark):
    d = docs(spark, [("a", 0, 3), ("b", 2, 1)]).unionByName(spark.createDataFrame([(None, None, None, None)], "doc_id long, text string, source string, weight string"))
    rows = mixing.mix_sources(d).collect()
    assert len(rows) == 5 and all(r.copies >= 1 for r in rows)
    assert mixing.mix_sources(d.where("false")).count() == mixing.mixed(d.where("false")).count() == 0
    none = d.withColumn("text", F.lit(""))
    assert [r.copies for r in mixing.mix_sources(none).collect()] == [1] * 5
    twice = docs(spark, [("a", 2, 2)])
    assert mixing.mixed(twice.unionByName(twice)).count() == 4
