import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import vector_store, vectors
from pagequarry.operators.vector_store import VectorStore

KIND = "chunk_id long, seq long, vec array<float>, doc_name string, fiscal_year string"


def crowds(n, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return np.round(centres[r.integers(0, 12, n)] + r.normal(scale=0.05, size=(n, dim)), 3).astype(np.float32)


def frame(spark, vecs, first=0):
    rows = [(first + i, first + i, [float(x) for x in v], f"d{i % 3}", None if i % 5 else "y") for i, v in enumerate(vecs)]
    return spark.createDataFrame([*rows, (first + 90_000, 90_000, None, "d0", "y"), (first + 90_001, 90_001, [0.0] * vecs.shape[1], "d0", "y")], KIND)


def asked(spark, vecs):
    wants = [(None, ""), ("d1", "y"), ("none", None), (None, "y"), ("d2", None)]
    rows = [(i, [float(x) for x in v], *wants[i % 5]) for i, v in enumerate(vecs)] + [(900, None, None, None), (901, [0.0] * vecs.shape[1], None, None)]
    return spark.createDataFrame(rows, "query_id long, vec array<float>, doc_name string, fiscal_year string")


def ranks(df):
    return {(r.query_id, r.vector_rank, r.chunk_id, round(r.vector_score, 7)) for r in df.collect()}


@pytest.mark.parametrize("cell, at_once", [(1024, 16), (40, 0)])
@pytest.mark.parametrize("overfetch", [None, 3])
def test_stored_search_is_that_of_all_rows(spark, tmp_path, monkeypatch, cell, at_once, overfetch):
    for name, value in (("CELL", cell), ("AT_ONCE", at_once)):
        monkeypatch.setattr(vector_store, name, value)
    vecs = crowds(900)
    rows, q = frame(spark, vecs).repartition(3), asked(spark, vecs[::60] + 0.01)
    store = VectorStore(spark, f"file://{tmp_path}/v")
    assert store.add(rows) == 901
    index = store.index()
    assert index.cells.agg(F.sum("n")).first()[0] == 901
    assert ranks(vector_store.search_index(q, index, top_k=7, overfetch=overfetch)) == ranks(vectors.vector_search(q, rows, top_k=7, overfetch=overfetch))


def test_most_cells_of_crowds_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_store, "CELL", 40)
    vecs = crowds(900)
    store = VectorStore(spark, f"file://{tmp_path}/v")
    store.add(frame(spark, vecs))
    index = store.index()
    q = asked(spark, vecs[::90]).where("query_id < 800").withColumns({"vec": vectors.normalised(F.col("vec")), "doc_name": F.lit(None).cast("string"), "fiscal_year": F.lit(None).cast("string")})
    pairs, floors = vector_store.cells_to_read(q, index, 10)
    share = pairs.count() / (index.cells.count() * q.count())
    assert share < 0.3 and floors.where("floor is null").isEmpty()


def test_bounds_hold_for_every_member(spark):
    cells = vector_store.make_cells(frame(spark, crowds(300))).collect()
    for c in cells:
        x = np.stack([np.frombuffer(m.vec) for m in c.members])
        assert len(x) == c.n and (np.linalg.norm(x - np.array(c.centre), axis=1) <= c.radius + 1e-12).all()
        assert set(c.docs) == {m.doc_name for m in c.members} and set(c.years) == {m.fiscal_year for m in c.members} - {None}


def test_changes_that_fail_leave_the_index_as_it_was(spark, tmp_path, monkeypatch):
    vecs = crowds(60)
    store, q = VectorStore(spark, f"file://{tmp_path}/v"), asked(spark, vecs[:3])
    with pytest.raises(ValueError):
        store.index()
    store.add(frame(spark, vecs))
    want = ranks(vector_store.search_index(q, store.index()))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the write, before it is named
        m.setattr(type(store.manifest), "commit", broken)
        for change in (store.add, store.replace):
            with pytest.raises(RuntimeError, match="lost"):
                change(frame(spark, vecs, first=500))
    assert store.count() == 61 and ranks(vector_store.search_index(q, store.index())) == want
    assert store.vacuum() == 2
    assert store.add(frame(spark, crowds(40, seed=2), first=500)) == 102 and store.index().cells.agg(F.sum("n")).first()[0] == 102
    assert store.replace(frame(spark, vecs)) == 61 and ranks(vector_store.search_index(q, store.index())) == want
    assert store.vacuum() == 2


def test_reindex(spark, tmp_path, monkeypatch):
    rows = [("c1", 0, "Alpha", "FY2024", "revenue rose"), ("c2", 1, "Beta", None, "offices"), ("c3", 2, "Alpha", None, "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, seq long, doc_name string, fiscal_year string, indexed_text string")
    target = f"file://{tmp_path}/v"
    monkeypatch.setattr(vector_store, "make_cells", lambda rows, made=vector_store.make_cells: made(rows).limit(1))
    monkeypatch.setattr(vector_store, "CELL", 1)
    with pytest.raises(RuntimeError, match="not 3"):  # a count that is not what was to be written
        vector_store.reindex(chunks, target)
    assert VectorStore(spark, target).count() == 0
    monkeypatch.undo()
    assert vector_store.reindex(chunks, target) == 3
    with pytest.raises(vector_store.NotEmpty):
        vector_store.reindex(chunks, target)
    assert vector_store.reindex(chunks, target, force=True) == 6


def test_empty_index(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/v")
    assert store.add(frame(spark, crowds(1)).where("false")) == 0
    assert vector_store.search_index(asked(spark, crowds(2)), store.index()).collect() == []
