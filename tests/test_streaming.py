import json
import time

from pyspark.sql import functions as F

from pagequarry.operators import ingest
from pagequarry.streaming.ingest import ingest_batch, stop_when_idle, stream_documents

TEXTS = ["story", "Standalone Financial Statements 2024-25\nfigures", "more figures. And a sentence.", "Consolidated Financial Statements 2024-25\nfigures", "figures", "Glossary", "words"]


def page(doc, n, text, of=len(TEXTS)):
    return json.dumps({"doc_name": doc, "entity": "Acme", "fiscal_year": "FY25", "n_pages": of, "page_number": n, "text": text})


def chunks(store):
    return sorted(tuple(r) for r in store.chunks().select("doc_name", "chunk_id", "chunk_index", "basis", "text").collect())


def test_documents_over_three_batches_and_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("A", i, t) for i, t in enumerate(TEXTS, 1)] + [("B", i, t) for i, t in enumerate(TEXTS, 1)]
    files = {
        1: [page(*rows[3]), page(*rows[0]), page(*rows[8])],
        2: [page(*rows[5]), page(*rows[1]), *(page(*r) for r in rows[9:])],
        3: [page(*rows[1]), page(*rows[2]), page(*rows[4]), page(*rows[6]), page(None, 1, "x"), page("C", 1, "never whole", 3)],
    }
    folder = f"file://{tmp_path}/s"

    def run():
        stop_when_idle(stream_documents(spark, f"file://{tmp_path}/in", folder, f"file://{tmp_path}/cp", files_per_batch=1))

    seen = []
    for k, lines in files.items():  # a new query each time, from the checkpoint
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        run()
        seen.append({r.doc_name for r in ingest.Store(spark, folder).registry().collect()})
    assert seen == [set(), set(), {"A"}]
    (tmp_path / "in" / "4.json").write_text(page(*rows[7]))
    run()
    batch = ingest.Store(spark, f"file://{tmp_path}/b")
    given = spark.createDataFrame([(d, "Acme", "FY25", n, t) for d, n, t in rows], "doc_name string, entity string, fiscal_year string, page_number int, text string")
    ingest_batch(batch, given)
    assert chunks(ingest.Store(spark, folder)) == chunks(batch) and len(chunks(batch)) == 14
    assert {r.basis for r in batch.chunks().where("page_number in (4, 5)").collect()} == {"consolidated"}
    numbers = lambda s: sorted((r.doc_name, r.pages, r.standalone_pages, r.consolidated_pages) for r in s.registry().collect())
    assert numbers(ingest.Store(spark, folder)) == numbers(batch)


def test_late_documents_are_let_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(page("L", 2, TEXTS[1], 9) + "\n" + page("L", 1, "story", None))
    folder = f"file://{tmp_path}/s"
    query = stream_documents(spark, f"file://{tmp_path}/in", folder, f"file://{tmp_path}/cp", late_ms=2000)
    try:
        for _ in range(90):
            if ingest.Store(spark, folder).registry().count():
                break
            time.sleep(1)
    finally:
        query.stop()
    store = ingest.Store(spark, folder)
    assert [(r.doc_name, r.pages) for r in store.registry().collect()] == [("L", 2)]
    assert [r.basis for r in store.chunks().orderBy(F.col("chunk_index")).collect()] == [None, "standalone"]
