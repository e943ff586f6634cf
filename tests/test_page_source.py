import pytest

from pagequarry.sources import page_source
from pagequarry.sources.page_source import PageRange, PageReader

PLAIN, SPARE = "pagequarry.sources.readers:plain_text", "page_extractors:latin"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Files, and an extractor that workers can import."""
    import os
    import zipfile

    tmp_path = tmp_path_factory.mktemp("pages")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"one\ftwo\f\ffour")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"caf\xe9\fsecond")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff broken")
    (tmp_path / "in" / "c.other").write_bytes(b"x")
    code = 'def latin(content):\n    if b"broken" in content:\n        raise ValueError("no pages")\n    return [(p or "spare", [[["a", None]]] if p == "two" else []) for p in content.decode("latin-1").split("\\f")]\n'
    with zipfile.ZipFile(tmp_path / "page_extractors.zip", "w") as z:
        z.writestr("page_extractors.py", code)
    spark.sparkContext.addPyFile(os.fspath(tmp_path / "page_extractors.zip"))
    page_source.register(spark)
    return f"file://{tmp_path}/in"


def pages(spark, folder, **options):
    df = spark.read.format("document_pages").options(path=folder, first=PLAIN, suffix=".txt", **options).load()
    return df


def test_two_extractors_and_a_failing_file(spark, folder):
    got = {(r.file, r.page_number): (r.text, r.error) for r in pages(spark, folder, second=SPARE).collect()}
    assert got == {
        ("a.txt", 1): ("one", None), ("a.txt", 2): ("two", None), ("a.txt", 3): ("spare", None), ("a.txt", 4): ("four", None),
        ("sub/b.txt", 1): ("café", None), ("sub/b.txt", 2): ("second", None), ("bad.txt", 0): (None, "ValueError: no pages"),
    }
    alone = {(r.file, r.page_number): r.error for r in pages(spark, folder).collect()}
    assert alone[("sub/b.txt", 0)].startswith("UnicodeDecodeError") and alone[("a.txt", 3)] is None


def test_ranges_of_pages(spark, folder):
    whole, split = pages(spark, folder, second=SPARE), pages(spark, folder, second=SPARE, splitBytes=4)
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_filters_reach_the_reader(spark, folder):
    from pyspark.sql.datasource import EqualTo

    reader = PageReader({"path": folder, "first": PLAIN, "second": None})
    asked = [EqualTo(("file",), "a.txt"), EqualTo(("page_number",), 2), EqualTo(("text",), "x")]
    assert list(reader.pushFilters(asked)) == asked
    assert reader.partitions() == [PageRange("a.txt", 0, 1)] and [r[:2] for r in reader.read(reader.partitions()[0])] == [("a.txt", 2)]
    found = pages(spark, folder).where("file = 'a.txt' and page_number = 4")
    assert [r.text for r in found.collect()] == ["four"]


def test_options(spark, folder):
    with pytest.raises(Exception, match="path and first"):
        spark.read.format("document_pages").option("path", folder).load().collect()
