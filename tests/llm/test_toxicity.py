import random
import zlib

from pagequarry.llm import toxicity


def corpus(n):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "er", "ti", "on", "the", "sh", "ou"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(r.randint(5, 200))], i % 4 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["grumblefux", "snorkwit"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_rows_and_misspellings(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9001, "", "x"), (9002, "thean grumblefuxx ouonsh", "x"), (9002, "thean grumblefuxx ouonsh", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 804 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    by = {r.doc_id: r.predicted for r in got}
    assert by[9002] == 1 and by[9001] == by[None] == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()] == [0.0]
    assert toxicity.score_documents(docs.where("false"), toxicity.fit(docs, none)).count() == 0


def test_long_labelled_documents_are_trained_on(spark):
    rows = [(i, "ab cd " * n, y) for i, (n, y) in enumerate([(10, 1), (20_000, 1), (10, 0), (20_000, 0)] * 4)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, "doc_id", "text", 1200, 2400)
    assert got == [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]


def test_training_starts_from_all_spans_and_the_map_knows_the_length(monkeypatch):
    rows = corpus(300)
    seen, step = [], toxicity._Trainer.step
    monkeypatch.setattr(toxicity._Trainer, "step", lambda self, s, y, rate: (seen.append((len(s), rate)), step(self, s, y, rate))[1])
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], rounds=1, min_steps=1)
    spans = sum(max(1, len(t.split()) - toxicity.SPAN + 1) for _, t, _ in rows)
    # Two passes over the documents that are not kept aside.
    assert sum(n for n, _ in seen) > 2 * 0.6 * spans
    assert model.by_length != 0 and model.evidence("a b c d e")[1] > model.evidence("a b c d")[1] == 0
