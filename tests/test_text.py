import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as X


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_words_and_sentences_are_pythons(spark):
    texts = ["Énorme naïve_x 12.5%", "", "  a\tb \n c ", "One. Two!  Three? four", "É. è"]
    assert column(spark, texts, X.tokens) == [re.findall(r"\b\w+\b", t.lower()) for t in texts]
    assert column(spark, texts, X.word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, X.sentences) == [re.split(r"(?<=[.!?])\s+", t) for t in texts]
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]


def test_relevance(spark):
    scores = [0.0, 10.0, -10.0, 6.4, -7.8, 99.0, -99.0, None, 0.5, 0.1]
    expected = [50, 100, 0, 82, 11, 100, 0, 50] + [round((s + 10) / 20 * 100) for s in (0.5, 0.1)]
    assert column(spark, scores, X.relevance, "double") == expected


def test_grouping(spark):
    numbers = [0, 999, 1000, 100000, 225712, 10000000, -225712]
    assert column(spark, numbers, X.group_indian, "long") == ["0", "999", "1,000", "1,00,000", "2,25,712", "1,00,00,000", "-2,25,712"]
    prose = ["162,990", "1,234,567.89", "1,62,990", "16299000", "March 31, 2025", "FY2024-25", "[Page 276]", "Note 2.18", "a 1,000 b 2,345,678 c"]
    assert column(spark, prose, X.regroup_prose) == ["1,62,990", "12,34,567.89", "1,62,990", "16299000", "March 31, 2025", "FY2024-25", "[Page 276]", "Note 2.18", "a 1,000 b 23,45,678 c"]
    assert column(spark, [225712.0, None, float("nan")], X.format_inr, "double") == ["2,25,712", "—", "—"]
    assert column(spark, [2.5, -2.5, 0.4, float("inf")], X.format_inr, "double") == ["3", "-3", "0", "—"]
    assert column(spark, [7, 45, 1234, None], X.page_label, "int") == ["p.007", "p.045", "p.1234", "p.?"]


def test_headings_follow_the_patterns_order(spark):
    texts = ["MANAGEMENT DISCUSSION AND ANALYSIS\n\nx", "Item 1A. Risk Factors\n\nx", "1. Overview of it\nITEM 2. Later", "nothing here", "x" * 600 + "\nITEM 3. Far"]
    assert column(spark, texts, X.section_heading) == ["MANAGEMENT DISCUSSION AND ANALYSIS", "Item 1A. Risk Factors", "ITEM 2. Later", None, None]


def test_lists_and_names(spark):
    assert column(spark, [[], ["A"], ["A", "B"], ["A", "B", "C"]], X.listed, "array<string>") == ["", "A", "A and B", "A, B and C"]
    assert column(spark, ["Wipro  Limited", "HDFC Bank", "bank"], X.without_suffix) == ["wipro", "hdfc", "bank"]
    assert column(spark, ["a/b.c/report 1.pdf", ".hidden", "x"], X.file_stem) == ["report 1", ".hidden", "x"]


def test_markdown(spark):
    t = "text\n| a | n |\n|---|--:|\n| x | 1,000 |\n| y | ₹ 5 crore |\nmore"
    assert column(spark, [t], X.markdown_rows) == [[["a", "n"], ["x", "1,000"], ["y", "₹ 5 crore"]]]
    assert column(spark, [t], lambda c: X.numeric_columns(X.markdown_rows(c))) == [[False, True]]


def test_highlight_and_place(spark):
    long = "This is a sentence that is certainly longer than forty characters."
    text = f"Carried over. {long} Short one. [TABLE]\nx\n[/TABLE]"
    assert column(spark, [text], lambda c: X.highlight(c, F.lit(False))) == [long]
    assert column(spark, [text], lambda c: X.highlight(c, F.lit(True))) == [None]
    assert column(spark, [f"AA {long}", f"{long} {long}", "no"], lambda c: X.locate_once(c, F.lit(long))) == [4, None, None]


@pytest.mark.parametrize("seed", range(2))
def test_one_decimal_is_printf(spark, seed):
    r = random.Random(seed)
    values = [round(r.uniform(-12, 12), 2) for _ in range(300)] + [0.25, 0.35, -0.04]
    assert column(spark, values, X.one_decimal, "double") == [f"{v:.1f}" for v in values]


def test_html(spark):
    assert column(spark, ["<a & 'b'>\"", None], X.escape_html) == ["&lt;a &amp; &#39;b&#39;&gt;&quot;", ""]


def test_chip_of_a_source(spark):
    rows = [("d1", "Report", "Acme", "FY2024", "standalone", 7), (None, "Report", None, "", None, 7)]
    d = spark.createDataFrame(rows, "d string, n string, e string, y string, b string, p int")
    whole, inert = (tuple(r.chip) for r in d.select(X.provenance_chip(*map(F.col, "dneybp")).alias("chip")).collect())
    assert whole == (True, "Acme", "FY2024", "Standalone", "p.7", "Open Report at page 7", "Open source: Acme, FY2024, standalone, page 7")
    assert inert == (False, "Entity ?", "FY ?", "Basis unknown", "p.7", "No stored PDF for Report", "Source (no PDF available): Unknown entity, unknown fiscal year, basis unknown, page 7")


def test_places_on_the_page_as_it_is(spark):
    from pyspark.sql import functions as F

    from pagequarry.functions.text import raw_place

    said = "Revenue (net) rose by 5.2% to Rs 1,62,990 crore in the year"
    pages = ["Intro.\n\tREVENUE  (net)\nrose by 5.2%\tto Rs 1,62,990 crore in the year. End", said + " " + said, "nothing", None, said.replace("5.2", "5x2")]
    rows = spark.createDataFrame([(i, p, said) for i, p in enumerate(pages)] + [(9, "short text", "short text"), (10, said, None)], "i int, page string, said string")
    got = {r.i: r.at and tuple(r.at) for r in rows.select("i", raw_place(F.col("page"), F.col("said")).alias("at")).collect()}
    assert got == {0: (9, 60), 1: None, 2: None, 3: None, 4: None, 9: None, 10: None}
    assert pages[0][8 : 8 + 60].lower().split() == said.lower().split()


def test_places_of_very_long_sentences_and_letters_that_grow(spark):
    from pyspark.sql import functions as F

    from pagequarry.functions.text import raw_place

    many = " ".join(f"w{i}" for i in range(60_000))
    grown = "İzmir and İstanbul had a longer sentence than forty letters, 😀 too"
    raw = lambda t: t.replace(" ", "\n\t ")
    pages = [(1, " \nA b. " + raw(many) + "! End", many, 8), (2, "xİİ " + raw(grown) + " z", grown, 5), (3, "pre" + raw(many), many, 4), (4, raw(grown) + "q İ", grown, 1)]
    rows = spark.createDataFrame([(i, p, c) for i, p, c, _ in pages], "i int, page string, said string")
    got = {r.i: tuple(r.at) for r in rows.select("i", raw_place(F.col("page"), F.col("said")).alias("at")).collect()}
    assert got == {i: (start, len(raw(c))) for i, _, c, start in pages}
