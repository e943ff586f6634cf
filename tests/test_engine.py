import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import names
from pagequarry.config import Settings
from pagequarry.operators import basis, chunking, confidence, entities, ingest, keyword, responses, retrieval, vectors
from pagequarry.sources import readers


@pytest.mark.parametrize(
    "pages, expected",
    [
        (["story", "Standalone Financial Statements under Indian Accounting Standards (Ind AS) for", "figures", "Consolidated financial statements under Indian Accounting Standards", "figures", "Notice of the 44th Annual General Meeting"], [None, "standalone", "standalone", "consolidated", "consolidated", None]),
        (["", "   ", "\n\n"], [None] * 3),
        (["Consolidated Financial Statements"], [None]),
        (["See the Consolidated Financial Statements 2024-25 for details"], [None]),
        (["Standalone financial statements under Indian accounting standards" + "x" * 140], [None]),
        (["\n".join(["filler"] * 12 + ["Consolidated Financial Statements 2024-25"])], [None]),
        (["169 Consolidated Financial Statements 2024-25"], ["consolidated"]),
        (["Glossary\nStandalone Financial Statements 2024-25", "balance sheet"], ["standalone", "standalone"]),
        (["Consolidated Financial Statements 2024-25", "as told at the Annual General Meeting", "figures"], ["consolidated"] * 3),
    ],
)
def test_basis(spark, pages, expected):
    rows = spark.createDataFrame([("d", i, p) for i, p in enumerate(pages)], "doc_id string, page_number int, text string")
    assert [r.basis for r in basis.assign_basis(rows).orderBy("page_number").collect()] == expected


def test_chunker():
    assert chunking.chunk_text("One here. Two there.", 200) == ["One here. Two there."]
    many = chunking.chunk_text("\n\n".join(f"Sentence number {i} has some words in it." for i in range(30)), 100)
    assert len(many) > 1 and all(len(c.split()) <= 130 for c in many)
    assert many[1].startswith(many[0].split("\n\n")[-1])
    assert chunking.chunk_text("", 10) == chunking.chunk_text("  \n\n ", 10) == chunking.chunk_text(None) == []
    assert chunking.chunk_text(" ".join(["w"] * 50), 10) == [" ".join(["w"] * 50)]
    assert chunking.chunk_text("A b c. D e f. G h i.", 4) == ["A b c.", "D e f.", "G h i."]


def chunks(spark):
    rows = [("c1", 0, "Alpha Corp", "FY2024", "revenue for the fiscal year rose"), ("c2", 1, "Beta Corp", "FY2023", "headcount and offices"), ("c3", 2, "Alpha Corp", None, "cash flow")]
    return spark.createDataFrame(rows, "chunk_id string, seq long, doc_name string, fiscal_year string, indexed_text string")


def ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id long, question string, doc_name string, fiscal_year string, section_type string, top_n int")


def test_keyword_search(spark):
    q = ask(spark, ("revenue fiscal year", None, None, None, None), ("revenue fiscal year", "Alpha Corp", "", None, None), ("revenue", None, "FY2023", None, None), ("zzz", None, None, None, None))
    got = keyword.keyword_search(q, keyword.build_index(chunks(spark))).orderBy("query_id", "bm25_rank").collect()
    by = {i: [r.chunk_id for r in got if r.query_id == i] for i in range(4)}
    # Chunks without a word of the question still score, as every chunk does.
    assert by == {0: ["c1", "c2", "c3"], 1: ["c1", "c3"], 2: ["c2"], 3: []}
    assert all(r.bm25_score > 0 for r in got)
    empty = keyword.build_index(chunks(spark).where("false"))
    assert keyword.keyword_search(q, empty).count() == 0


def test_vector_search_and_merge(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0], "x", "y"), ("b", 1, [0.6, 0.8], "z", None), ("o", 2, [0.0, 0.0], "x", "y")], "chunk_id string, seq long, vec array<float>, doc_name string, fiscal_year string")
    q = spark.createDataFrame([(1, [2.0, 0.0], None, None), (2, [1.0, 0.0], "z", None)], "query_id long, vec array<float>, doc_name string, fiscal_year string")
    got = [(r.query_id, r.chunk_id, round(r.vector_score, 3)) for r in vectors.vector_search(q, rows).orderBy("query_id", "vector_rank").collect()]
    assert got == [(1, "a", 1.0), (1, "b", 0.6), (1, "o", 0.0), (2, "b", 0.6)]
    v = spark.createDataFrame([(1, "shared", 0.9, 1), (1, "v", 0.7, 2)], "query_id long, chunk_id string, vector_score double, vector_rank int")
    k = spark.createDataFrame([(1, "shared", 5.2, 1), (1, "k", 4.1, 2)], "query_id long, chunk_id string, bm25_score double, bm25_rank int")
    merged = retrieval.merge_lanes(v, k).orderBy("position").collect()
    assert [(r.chunk_id, r.retrieval_source, r.vector_score, r.bm25_score) for r in merged] == [("shared", "hybrid", 0.9, 5.2), ("v", "vector", 0.7, None), ("k", "bm25", None, 4.1)]


def test_rerank_order(spark):
    c = spark.createDataFrame([(0, "a", 1, "none"), (0, "b", 2, "revenue year"), (0, "c", 3, "revenue year")], "query_id long, chunk_id string, position int, indexed_text string")
    q = ask(spark, ("revenue year", None, None, None, 2))
    assert [r.chunk_id for r in retrieval.rerank(c, q).orderBy("rank").collect()] == ["b", "c"]
    nulls = retrieval.rerank(c, ask(spark, ("x", None, None, None, None)), lambda q, t: F.lit(None).cast("double"))
    assert [r.chunk_id for r in nulls.orderBy("rank").collect()] == ["a", "b", "c"]


CASES = [
    ([6.4, 3.1, 2.2], "high"), ([8.9, -5.0, -5.5], "moderate"), ([0.4, -3.0], "moderate"), ([-4.5, -7.0], "low"), ([-7.8, -8.2], "insufficient"), ([2, -2], "high"), ([2, -2.01], "moderate"),
    ([1.99, -2], "moderate"), ([-2, -2], "moderate"), ([-2.01], "low"), ([-6], "low"), ([-6.01], "insufficient"), ([], "insufficient"), ([None, None], "insufficient"), ([None, 6.4, None, 2.2], "high"),
]


def test_confidence(spark):
    q = spark.range(len(CASES) + 1).withColumnRenamed("id", "query_id")
    rows = [(i, None if s is None else float(s)) for i, (scores, _) in enumerate([*CASES, ([9.0, 8.5], "")]) for s in scores]
    foreign = spark.createDataFrame([(len(CASES), ["Wipro"])], "query_id long, names array<string>")
    got = {r.query_id: r for r in confidence.assess(q, spark.createDataFrame(rows, "query_id long, rerank_score double"), foreign, indexed="TCS").collect()}
    assert [got[i].level for i in range(len(CASES))] == [c[1] for c in CASES]
    assert got[len(CASES)].level == "insufficient" and "Wipro" in got[len(CASES)].abstention_reason
    assert all(r.abstained == (r.level == "insufficient") for r in got.values())
    with pytest.raises(ValueError):
        Settings(high=-3.0)


GATE = [
    ("What was Wipro's revenue in FY2025?", ["Wipro"]), ("What was HDFC Bank's net interest margin?", ["HDFC Bank"]), ("What is the capital adequacy ratio of State Bank of India?", ["State Bank of India"]),
    ("What was Zomato Limited's revenue?", ["Zomato Limited"]), ("What was Zomato revenue?", None), ("What was Tata Consultancy Services revenue?", None), ("Infosys Ltd revenue?", None),
    ("What does Ind AS 116 require?", None), ("Board of Directors", None), ("March 31, 2025", None), ("Compare Infosys and Wipro revenue for FY2025", ["Wipro"]), ("Compare Wipro and Accenture margins", ["Accenture", "Wipro"]),
    ("hpcl and sbin", None), (None, None),
]


def test_entity_gate(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GATE)], "query_id long, question string")
    have = spark.createDataFrame([("Infosys",), ("TCS",), ("",)], "entity string")
    got = {r.query_id: r.names for r in entities.foreign_entities(q, have).collect()}
    assert [got.get(i) for i in range(len(GATE))] == [n for _, n in GATE]


def test_store_guards_and_restart(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([("R1", "Acme", "FY25", None, "h1"), ("R2", "Bolt", "FY25", None, "h2"), ("Empty", "E", "FY25", None, "h3")], "doc_name string, entity string, fiscal_year string, file_path string, content_sha256 string")
    texts = ["intro text", "Standalone Financial Statements 2024-25\nfigures one", "Consolidated Financial Statements 2024-25\nfigures two", ""]
    from pagequarry.functions.text import doc_id

    ids = {r.doc_name: r.id for r in docs.select("doc_name", doc_id(F.col("doc_name")).alias("id")).collect()}
    pages = spark.createDataFrame([(ids[d], i, t, None) for d in ("R1", "R2") for i, t in enumerate(texts, 1)] + [(ids["Empty"], 1, " ", None)], "doc_id string, page_number int, text string, section_heading string")
    assert {r.doc_name: r.status for r in store.ingest(docs, pages).collect()} == {"R1": "new", "R2": "new", "Empty": "new"}
    again = docs.where("doc_name <> 'Empty'").withColumn("content_sha256", F.when(F.col("doc_name") == "R2", "other").otherwise(F.col("content_sha256")))
    assert {r.doc_name: r.status for r in store.ingest(again, pages).collect()} == {"R1": "already_indexed", "R2": "conflict"}
    reread = ingest.Store(spark, f"file://{tmp_path}/s")
    reg = {r.doc_name: r for r in reread.registry().collect()}
    assert set(reg) == {"R1", "R2"} and all((r.pages, r.chunks, r.standalone_pages, r.consolidated_pages) == (4, 3, 1, 2) for r in reg.values())
    c = reread.chunks().where("doc_name = 'R1'").orderBy("chunk_index").collect()
    assert [x.chunk_id for x in c] == [f"{ids['R1']}_p{i}_0" for i in (1, 2, 3)] and [x.basis for x in c] == [None, "standalone", "consolidated"]
    assert reread.chunk(c[0].chunk_id).count() == 1 and reread.document("no").isEmpty()
    listing = spark.createDataFrame([(f"/x/{ids['R1']}.pdf",)], "path string")
    assert [reread.served_file(x, listing) for x in ("../x", "0" * 16, ids["R2"], ids["R1"])] == ["invalid", "unknown", "missing", "found"]


def test_a_failed_ingest_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    from pagequarry.functions.text import doc_id
    from pagequarry.streaming.ingest import ingest_batch

    docs = spark.createDataFrame([("A", "Acme", "FY25", None, "h1"), ("B", "Bolt", "FY25", None, "h2")], "doc_name string, entity string, fiscal_year string, file_path string, content_sha256 string")
    pages = docs.select(doc_id(F.col("doc_name")).alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number"), F.lit("some text").alias("text"), F.lit(None).cast("string").alias("section_heading"))
    rows = pages.join(docs.withColumn("doc_id", doc_id(F.col("doc_name"))), "doc_id").select("doc_name", "entity", "fiscal_year", "page_number", "text")
    works = ingest.registry_rows

    def broken(*_):
        raise RuntimeError("lost")

    for k, run in enumerate((lambda s: s.ingest(docs, pages), lambda s: ingest_batch(s, rows))):
        store = ingest.Store(spark, f"file://{tmp_path}/s{k}")
        monkeypatch.setattr(ingest, "registry_rows", broken)
        for _ in range(2):
            with pytest.raises(RuntimeError, match="lost"):
                run(store)
        assert store.chunks().count() == 0 and store.registry().count() == 0
        assert store.vacuum() == 0 and store.vacuum(older_than_s=0) == 2 and store.vacuum(older_than_s=0) == 0
        monkeypatch.setattr(ingest, "registry_rows", works)
        assert {r.status for r in run(store).collect()} == {"new"} and {r.status for r in run(store).collect()} == {"already_indexed"}
        assert [(r.doc_name, r.chunks, r.pages) for r in store.registry().orderBy("doc_name").collect()] == [("A", 2, 2), ("B", 2, 2)]
        assert store.chunks().count() == store.chunks().select("chunk_id").distinct().count() == store.numbered_chunks().count() == 4
        assert store.vacuum(older_than_s=0) == 0 and store.chunks().count() == 4
        ident = store.registry().where("doc_name = 'B'").first().doc_id
        one = store.document_chunks(ident)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert one.count() == 2 and "PartitionFilters: [isnotnull(attempt" in plan.replace("\n", "") and f"(bucket#" in plan and ident[:2] in plan
        assert store.document_chunks("0" * 16).isEmpty() and store.chunk(f"{ident}_p2_0").count() == 1 and store.chunk("x").isEmpty()
    listing = pages.where("page_number = 1").orderBy("doc_id").limit(1).select(F.concat(F.lit("/x/"), "doc_id", F.lit(".pdf")).alias("path"))
    assert sorted(r.has_file for r in store.with_files(listing).collect()) == [False, True]
    ingest.stop_if_missing(spark.createDataFrame([], "file string"))
    with pytest.raises(ingest.MissingFiles, match="2 files are missing: a, b"):
        ingest.stop_if_missing(spark.createDataFrame([("b",), ("a",)], "file string"))


def test_manifest_and_pages(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"file": "a/x.pdf", "entity": "A", "fiscal_year": "F"}, {"file": "b/y.pdf", "doc_name": "Y", "entity": "B", "fiscal_year": "F"}]')
    m = readers.read_manifest(spark, f"file://{tmp_path}/m.json")
    assert [r.doc_name for r in m.orderBy("file").collect()] == ["x", "Y"]
    assert readers.read_manifest(spark, f"file://{tmp_path}/m.json", ("b/",)).count() == 1
    for text in ("{}", '[{"file": "a", "entity": ""}]', "[oops"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(readers.ManifestError):
            readers.read_manifest(spark, f"file://{tmp_path}/bad.json")
    with pytest.raises(readers.ManifestError):
        readers.read_manifest(spark, f"file://{tmp_path}/none.json")
    files = spark.createDataFrame([("d", bytearray(b"one\ftwo")), ("e", bytearray(b"\xff"))], "doc_id string, content binary")
    got = {(r.doc_id, r.page_number): (r.text, r.error) for r in readers.extract_pages(files, readers.plain_text).collect()}
    assert got[("d", 2)] == ("two", None) and got[("e", 0)][1].startswith("UnicodeDecodeError")
    assert readers.page_text("t", [[["a", None], [" b", "c"]]]) == "t\n\n[TABLE]\na | \nb | c\n[/TABLE]"


def test_events_and_answers(spark):
    ok = list(responses.events({"query_id": 1, "level": "high"}, responses.stream_answer("p", "f", lambda p: ["a", "", "b"])))
    assert [f.split("\n")[0] for f in ok] == ["event: meta", "event: delta", "event: delta", "event: done"] and '"generated"' in ok[-1]
    assert [f.split("\n")[0] for f in responses.events({"abstained": True})] == ["event: meta", "event: abstained"]

    def broken():
        yield "delta", "a"
        raise RuntimeError("x")

    assert list(responses.events({}, broken()))[-1].startswith("event: error")
    assert responses.answer("p", "f") == responses.answer("p", "f", lambda p: " ") == ("f", "extractive")
    assert responses.answer("p", "f", lambda p: "yes") == ("yes", "generated")


class Failing:
    """Fails with each of the errors in turn, then answers."""

    def __init__(self, *errors, before=()):
        self.errors, self.before, self.asked = list(errors), before, 0

    def stream(self, prompt):
        self.asked += 1
        yield from self.before
        if self.errors:
            raise self.errors.pop(0)
        yield from ("a", "b")

    def generate(self, prompt):
        return "".join(self.stream(prompt))


@pytest.mark.parametrize(
    "errors, asked, waits, good",
    [
        (["503 high demand"], 2, [1.0], True),
        (["429 slow down", "RESOURCE_EXHAUSTED"], 3, [1.0, 2.0], True),
        (["500", "502", "504", "x"], 3, [1.0, 2.0], False),
        (["401 bad key"], 1, [], False),
        (["429 GenerateRequestsPerDayPerProject"], 1, [], False),
        (["429: quota exceeded for metric x"], 1, [], False),
        ([responses.Unavailable("503 not installed")], 1, [], False),
    ],
)
def test_only_failures_that_may_pass_are_tried_again(errors, asked, waits, good):
    errors = [e if isinstance(e, Exception) else RuntimeError(e) for e in errors]
    for run in ("generate", "stream"):
        g, slept = Failing(*errors), []
        if run == "generate":
            assert responses.answer("p", "f", g.generate, sleep=slept.append) == (("ab", "generated") if good else ("f", "extractive"))
        else:
            got = list(responses.stream_answer("p", "f", g.stream, sleep=slept.append))
            assert got == ([("delta", "a"), ("delta", "b"), ("done", "ab", "generated")] if good else [("done", "f", "extractive")])
        assert (g.asked, slept) == (asked, waits)


def test_streams_keep_what_was_said():
    g = Failing(RuntimeError("503"), before=["x"])
    assert list(responses.stream_answer("p", "f", g.stream, sleep=print)) == [("delta", "x"), ("done", "x", "generated")] and g.asked == 1
    assert list(responses.stream_answer("p", "f", lambda p: iter(()))) == list(responses.stream_answer("p", "f")) == [("done", "f", "extractive")]


def test_providers():
    a, b = (responses.Provider(n, k, str, list) for n, k in (("one", None), ("two", "key")))
    assert responses.chosen_provider([a, b]) is b and responses.chosen_provider([b, a], " Two ") is b
    assert responses.chosen_provider([a, b], "none") is None and responses.chosen_provider([a]) is None
    for setting in ("one", "three"):
        with pytest.raises(ValueError):
            responses.chosen_provider([a, b], setting)


def test_settings_from_variables():
    got = Settings.from_variables({"BM25_TOP_K": "7", "RERANK_HIGH_THRESHOLD": "3.5", "GENERATION_PROVIDER": " None ", "FINAL_TOP_N": " ", "OTHER": "x"})
    assert got == Settings(keyword_top_k=7, high=3.5, provider="none") and Settings.from_variables({}) == Settings()
    for bad in ({"FINAL_TOP_N": "many"}, {"RERANK_ABSTAIN_THRESHOLD": "9"}, {"CONFIDENCE_MIN_SUPPORTING": "0"}, {"MAX_CHUNK_TOKENS": "-1"}, {"VECTOR_TOP_K": "1.5"}):
        with pytest.raises(ValueError):
            Settings.from_variables(bad)


def test_frames_as_rows(spark):
    import json

    results = spark.createDataFrame([(1, "high", "r", False, None), (2, "insufficient", "r", True, "why \"so\""), (3, "low", None, False, None), (4, "low", "r", False, None)], "query_id long, level string, reason string, abstained boolean, abstention_reason string")
    sources = spark.createDataFrame([(1, [(1, "c")])], "query_id long, sources array<struct<rank:int,chunk_id:string>>")
    answers = spark.createDataFrame([(1, "one\n\ntwo"), (2, "not said"), (4, "lost")], "query_id long, answer string")
    frames = responses.result_frames(results, sources, answers, spark.createDataFrame([(4, "gone")], "query_id long, message string"))
    got = {}
    for r in frames.orderBy("query_id", "seq").collect():
        got.setdefault(r.query_id, []).append((r.seq, r.event, json.loads(r.data)))
    assert got[1] == [(0, "meta", {"query_id": 1, "level": "high", "reason": "r", "sources": [{"rank": 1, "chunk_id": "c"}]}), (1, "delta", {"text": "one"}), (2, "delta", {"text": "two"}), (3, "done", {"answer_source": "extractive"})]
    assert got[2][1:] == [(1, "abstained", {"reason": 'why "so"'})] and got[4][1:] == [(1, "error", {"message": "gone"})]
    assert got[3] == [(0, "meta", {"query_id": 3, "level": "low", "reason": None, "sources": []}), (1, "done", {"answer_source": "extractive"})]
    assert responses.broken_frames(frames).isEmpty()
    bad = {"numbers": [(0, "meta"), (2, "done")], "meta": [(0, "done")], "end": [(0, "meta"), (1, "done"), (2, "abstained")], "delta": [(0, "meta"), (1, "delta"), (2, "error")], "event": [(0, "meta"), (1, "odd"), (2, "done")]}
    rows = spark.createDataFrame([(i, n, e) for i, f in enumerate(bad.values()) for n, e in f], "query_id long, seq int, event string")
    assert {r.query_id: r.fault for r in responses.broken_frames(rows).collect()} == dict(enumerate(bad))


def test_a_missing_file_stops_an_ingest(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("page one\fpage two")
    (tmp_path / "in" / "sub" / "b.txt").write_text("only page")
    rows = [("a.txt", "A", "E", "F"), ("c.txt", "C", "E", "F")]
    manifest = lambda rows: spark.createDataFrame(rows, "file string, doc_name string, entity string, fiscal_year string")
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ingest.MissingFiles, match="1 files are missing: c.txt"):
        store.ingest_manifest(manifest(rows), f"file://{tmp_path}/in", readers.plain_text)
    assert store.registry().isEmpty()
    assert [r.status for r in store.ingest_manifest(manifest(rows[:1]), f"file://{tmp_path}/in", readers.plain_text).collect()] == ["new"]
    assert [(r.doc_name, r.pages, r.chunks, r.file_path) for r in store.registry().collect()] == [("A", 2, 2, "a.txt")]


def test_uploads_and_hit_lists(spark, tmp_path):
    from pagequarry.functions.text import doc_id, format_count
    from pagequarry.operators import calibration

    registry = spark.createDataFrame([("A", "h"), ("B", "h")], "name string, content_sha256 string").select(doc_id(F.col("name")).alias("doc_id"), "content_sha256")
    rows = [("x/A.pdf", None, "E", "F", "h", 1), ("B.PDF", "B", "E", "F", "other", 1), ("c.txt", "C", "E", "F", "h", 1), ("d.pdf", "D", " ", "F", "h", 1), ("e.pdf", "E", "E", "F", "h", 0), ("f.pdf", None, "E", "F", "h", 3), (None, None, None, None, None, None)]
    up = spark.createDataFrame(rows, "file_name string, doc_name string, entity string, fiscal_year string, content_sha256 string, n_pages int")
    got = {r.file_name: (r.code, r.doc_name) for r in ingest.validate_uploads(up, registry).collect()}
    assert got == {"x/A.pdf": (409, "A"), "B.PDF": (409, "B"), "c.txt": (400, "C"), "d.pdf": (400, "D"), "e.pdf": (422, "E"), "f.pdf": (200, "f"), None: (400, None)}
    hits = spark.createDataFrame([(1, k, "d", k, None, 1.0 / k, "bm25") for k in range(1, 6)], "query_id long, rank int, doc_name string, page_number int, basis string, rerank_score double, retrieval_source string")
    found = calibration.top_hits(hits)
    assert [h.page for h in found.first().top_hits] == [1, 2, 3]
    calibration.write_measurements(found, f"file://{tmp_path}/m")
    assert spark.read.json(f"file://{tmp_path}/m").count() == 1
    assert spark.range(1).select(format_count(F.lit(1234567)).alias("x")).first().x == "12,34,567"


def test_streaming_ingest(spark, tmp_path):
    import json

    from pagequarry.streaming.ingest import stream_pages

    (tmp_path / "in").mkdir()
    page = lambda n, t: json.dumps({"doc_name": "S", "entity": "A", "fiscal_year": "F", "page_number": n, "text": t})
    (tmp_path / "in" / "1.json").write_text(page(1, "first page") + "\n" + page(2, "second page"))
    for k in range(2):
        stream_pages(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/s", f"file://{tmp_path}/cp").awaitTermination()
        (tmp_path / "in" / f"again{k}.json").write_text(page(1, "first page") + "\n" + page(2, "second page"))
    assert ingest.Store(spark, f"file://{tmp_path}/s").chunks().count() == 2


def test_mentions_against_brute_force(spark):
    r = random.Random(7)
    keys = {*names.ALIASES, *names.KNOWN}
    words = [*sorted(keys), "Acme Motors Limited", "Foo  Bar Ltd.", "bank of", "limited", "Wipro Limited", "x", "hdfc bank of baroda", "(TCS)", "tcs2", "l&t", "é", "Tata", "Steel Corp", "AG"]
    texts = [None, "", "HDFC  Bank of\nBaroda", "Tata Tata Steel, State Bank of India Limited\x01", "of Ernst & Young's"]
    texts += [r.choice([" ", "", ", ", "  "]).join(r.choice([str.upper, str.title, str])(r.choice(words)) for _ in range(r.randint(0, 7))) for _ in range(400)]

    def expected(q):
        text = " ".join((q or "").lower().replace("\x01", " ").split())
        spans = []
        for k in keys:
            spans += [(-len(k), k, i, i + len(k)) for i in range(len(text)) if text.startswith(k, i) and not re.search(r"\w$", text[:i]) and not re.match(r"\w", text[i + len(k) :])]
        spans = [(a, b, k) for _, k, a, b in sorted(spans)]
        for m in re.finditer(entities.SUFFIXED.removeprefix("(?U)"), q or ""):
            raw = " ".join(m[1].lower().split())
            if raw in text:
                spans.append((text.index(raw), text.index(raw) + len(raw), raw))
        used, found = set(), []
        for a, b, k in spans:
            if used.isdisjoint(range(a, b)):
                used |= set(range(a, b))
                found.append(k)
        return found

    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")
    got = {x.query_id: x.mentions for x in entities.mentions(df).collect()}
    assert [got.get(i, []) for i in range(len(texts))] == [expected(t) for t in texts]


def test_a_large_table_of_names(spark):
    keys = [f"maker{i % 1000} of {i}" for i in range(30_000)] + ["3m", "a.b. co", "aa aa", "été & fils", "&&"]
    known = entities.gazetteer(spark.createDataFrame([(k,) for k in [*keys, "AA  aa"]], "key string"))
    assert known.count() == len(keys) - 1
    rows = [(1, "Maker7  of 1007, maker7 of 10078x and maker7 of 7"), (2, "xaa aa aa; 3M-3m 13m"), (3, "A.B. Co. ÉTÉ & Fils"), (4, "nothing && here"), (5, None), (6, "aa aa aa aa " * 300)]
    got = {r.query_id: r.mentions for r in entities.mentions(spark.createDataFrame(rows, "query_id long, question string"), known).collect()}
    assert got == {1: ["maker7 of 1007", "maker7 of 7"], 2: ["aa aa", "3m", "3m"], 3: ["été & fils", "a.b. co"], 6: ["aa aa"] * 600}


def test_files_are_stored_by_document(spark, tmp_path):
    rows = [("Report A", b"one"), ("Report A", b"one"), ("B", b"\x00two"), ("C", None)]
    files = spark.createDataFrame(rows, "doc_name string, content binary")
    ident = lambda name: hashlib.sha256(name.encode()).hexdigest()[:16]
    for _ in range(2):  # again, as after a failure
        assert ingest.store_files(files, f"file://{tmp_path}/kept") == 2
        assert {p.name: p.read_bytes() for p in (tmp_path / "kept").iterdir()} == {f"{ident('Report A')}.pdf": b"one", f"{ident('B')}.pdf": b"\x00two"}
    assert ingest.store_files(files.where("false"), str(tmp_path / "none")) == 0


def test_generator_availability():
    assert responses.generator_available("json", "k") == (True, None)
    assert not responses.generator_available("json", " ")[0] and not responses.generator_available("json", None)[0]
    assert not responses.generator_available("no_such_module_here", "k")[0] and not responses.generator_available("no_such_parent.child", "k")[0]


def test_vector_search_beside_brute_force(spark):
    r = np.random.default_rng(4)
    vecs = np.round(r.normal(size=(300, 4)), 1).astype(np.float32)  # with ties
    rows = spark.createDataFrame([(i, i, [float(x) for x in v], f"d{i % 3}", None if i % 5 else "y") for i, v in enumerate(vecs)] + [(900, 900, None, "d0", "y")], "chunk_id long, seq long, vec array<float>, doc_name string, fiscal_year string").repartition(5)
    asked = [(0, [1.0, 0.0, 0.5, 0.0], None, ""), (1, [0.0, -1.0, 0.0, 0.0], "d1", "y"), (2, None, None, None), (3, [1.0, 1.0, 1.0, 1.0], "none", None)]
    q = spark.createDataFrame(asked, "query_id long, vec array<float>, doc_name string, fiscal_year string")
    got = {}
    for x in vectors.vector_search(q, rows, top_k=7).orderBy("query_id", "vector_rank").collect():
        got.setdefault(x.query_id, []).append((x.chunk_id, x.vector_rank))
    unit = vecs.astype(float) / np.maximum(np.linalg.norm(vecs.astype(float), axis=1, keepdims=True), 1e-300)
    for i, v, doc, year in asked[:2]:
        s = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 9)
        open_to = [j for j in range(300) if (not doc or doc == f"d{j % 3}") and (not year or j % 5 == 0)]
        assert got[i] == [(j, k + 1) for k, j in enumerate(sorted(open_to, key=lambda j: (-s[j], j))[:7])]
    assert set(got) == {0, 1}


def test_hashed_embedding_counts_each_token(spark):
    e = vectors.hashed_embedding(F.col("t"), 8)
    a, b, none, null = (x.v for x in spark.createDataFrame([("x y x",), ("x",), ("..",), (None,)], "t string").select(e.alias("v")).collect())
    y = spark.createDataFrame([("y",)], "t string").select(e.alias("v")).first().v
    assert null is None and none == [0.0] * 8 and sum(map(abs, b)) == 1 and a == [2 * p + q for p, q in zip(b, y)]
