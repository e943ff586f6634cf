"""Column functions on text.  Patterns spell their classes out, so Java, Python and RE2 agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space at both ends (trim() knows only the space)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def sentences(c: Column) -> Column:
    """Cut after . ! ? followed by white space."""
    return F.split(c, r"(?<=[.!?])\s+")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda p: p != "")


def doc_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 16)


def file_stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^/])\.[^.]+$", "")


#: Fixed values, tried in this order: an item number, a line in capitals, a numbered heading.
HEADINGS = (r"(?imd)^(ITEM\s+\d+[A-Z]?\.?\s+.+)$", r"(?md)^([A-Z][A-Z\s]{5,50})$", r"(?md)^(\d+\.\s+[A-Z][^.]{5,60})$")


def section_heading(text: Column) -> Column:
    """The first pattern that matches in the first 500 characters wins, whatever its place; at most 120 characters."""
    head = F.substring(text, 1, 500)
    found = [F.when(head.rlike(p), F.substring(strip(F.regexp_extract(head, p, 1)), 1, 120)) for p in HEADINGS]
    return F.coalesce(*found)


def table_text(rows: Column) -> Column:
    """Cells joined by bars, rows by line ends; null cells are empty."""
    cells = lambda r: F.array_join(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), " | ")
    return F.array_join(F.transform(rows, cells), "\n")


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def provenance(entity: Column, year: Column, basis: Column, page: Column) -> Column:
    """One line that says where a page is from; empty if neither entity nor year is known."""
    who = F.concat_ws(" ", _nonempty(entity), _nonempty(year))
    statements = F.when(basis.isNotNull() & (basis != ""), F.concat(F.lit(", "), basis, F.lit(" financial statements"))).otherwise("")
    return F.when(who == "", "").otherwise(F.concat(who, F.lit(" annual report"), statements, F.lit(", page "), page.cast("string"), F.lit(".")))


def indexed_text(line: Column, text: Column) -> Column:
    return F.when(line == "", text).otherwise(F.concat(line, F.lit("\n"), text))


def relevance(score: Column) -> Column:
    """0..100 from a logit in -10..10, rounded half to even; null counts as 0."""
    held = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.coalesce(score.cast("double"), F.lit(0.0))))
    return F.rint((held + 10.0) / 20.0 * 100.0).cast("int")


def one_decimal(c: Column) -> Column:
    """Half to even on the exact value, as C's printf does; format_string rounds half up."""
    return F.call_function("format_number", c, F.lit("0.0"))


def excerpt(text: Column, dots: bool = False) -> Column:
    cut = F.substring(text, 1, 600)
    return F.concat(cut, F.when(F.length(text) > 600, "...").otherwise("")) if dots else cut


def is_table(text: Column) -> Column:
    return F.contains(text, F.lit("[TABLE]"))


def normal_name(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"\s+", " ")


#: Suffixes of company names.
CORPORATE = r"limited|ltd\.?|inc\.?|corp\.?|corporation|plc|llp|gmbh|ag|nv|sa|bank"


def without_suffix(c: Column) -> Column:
    return strip(F.regexp_replace(normal_name(c), rf"\s+(?:{CORPORATE})$", ""))


def listed(names: Column) -> Column:
    """A / A and B / A, B and C."""
    n = F.size(names)
    return F.when(n <= 1, F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(names, -1)))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[,\s]", "")


def has_figure(text: Column, figure: Column) -> Column:
    return F.contains(digits_only(text), digits_only(figure))


def _grouped(digits: Column) -> Column:
    """A digit string, the last three together and pairs before."""
    return F.regexp_replace(digits, r"(\d)(?=(?:\d{2})*\d{3}$)", "$1,")


def group_indian(number: Column) -> Column:
    s = number.cast("string")
    return F.when(s.startswith("-"), F.concat(F.lit("-"), _grouped(F.substring(s, 2, 100)))).otherwise(_grouped(s))


def format_inr(value: Column, decimals: int = 0) -> Column:
    """Indian grouping with so many decimals, halves rounded away from 0; unknown and infinite values are a dash, never 0."""
    fixed = F.round(value.try_cast("decimal(38,10)"), decimals).cast(f"decimal(38,{decimals})").cast("string")
    whole = group_indian(F.split(fixed, r"\.")[0])
    text = F.concat(whole, F.lit("."), F.split(fixed, r"\.")[1]) if decimals else whole
    return F.coalesce(text, F.lit("—"))


def format_count(value: Column) -> Column:
    """A whole number in Indian grouping."""
    return format_inr(value, 0)


def format_ms(value: Column) -> Column:
    return format_inr(F.floor(value.cast("double") + 0.5))


#: Fixed value: a run of Western groups that is no part of a longer figure.
WESTERN = r"(?<![\d,.])(\d{1,3}(?:,\d{3})+)(\.\d+)?(?![\d,])"


def regroup_prose(c: Column) -> Column:
    """Western digit groups become Indian ones; anything else stays.

    The text is cut at marks around each run, and the marked pieces are regrouped.
    """
    marked = F.split(F.regexp_replace(c, WESTERN, "\x01\x02$1\x01$2"), "\x01")
    piece = lambda p: F.when(p.startswith("\x02"), _grouped(F.regexp_replace(p, "[\x02,]", ""))).otherwise(p)
    return F.array_join(F.transform(marked, piece), "")


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def basis_label(c: Column, short: bool = False) -> Column:
    known = F.initcap(c) if short else F.concat(F.initcap(c), F.lit(" financial statements"))
    return F.when(c.isin("standalone", "consolidated"), known).otherwise("Basis unknown" if short else "Basis not determined")


def page_label(c: Column) -> Column:
    return F.when(c.isNull(), "p.?").otherwise(F.format_string("p.%03d", c.cast("int")))


# The wording of a chip's title and label.
def provenance_chip(doc_id: Column, doc_name: Column, entity: Column, year: Column, basis: Column, page: Column) -> Column:
    """(can_open, entity, fiscal_year, basis, page, title, label) of a cited source; unknown parts have a placeholder.

    A source whose document has no stored file (a null or empty doc_id) cannot be opened.
    """
    short, number = basis_label(basis, short=True), F.coalesce(page.cast("string"), F.lit("?"))
    known = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", F.lit(other)).otherwise(c)
    can_open, name = F.coalesce(doc_id, F.lit("")) != "", F.coalesce(doc_name, F.lit("?"))
    title = F.when(can_open, F.concat(F.lit("Open "), name, F.lit(" at page "), number)).otherwise(F.concat(F.lit("No stored PDF for "), name))
    said = F.concat_ws(", ", known(entity, "Unknown entity"), known(year, "unknown fiscal year"), F.lower(short), F.concat(F.lit("page "), number))
    label = F.concat(F.when(can_open, "Open source: ").otherwise("Source (no PDF available): "), said)
    return F.struct(can_open.alias("can_open"), known(entity, "Entity ?").alias("entity"), known(year, "FY ?").alias("fiscal_year"), short.alias("basis"), F.concat(F.lit("p."), number).alias("page"), title.alias("title"), label.alias("label"))


def source_label(i: Column, entity: Column, year: Column, basis: Column, page: Column, section: Column) -> Column:
    parts = F.concat_ws(
        " | ", F.coalesce(_nonempty(entity), F.lit("Entity not recorded")), F.coalesce(_nonempty(year), F.lit("Fiscal year not recorded")), basis_label(basis), F.concat(F.lit("Page "), page.cast("string"))
    )
    line = F.coalesce(F.concat(F.lit("\n    Section: "), _nonempty(section)), F.lit(""))
    return F.concat(F.lit("[Source "), i.cast("string"), F.lit("] "), parts, line)


def confidence_state(level: Column) -> Column:
    """The four known levels; anything else is shown with caution."""
    return F.when(level.isin("high", "moderate", "low", "insufficient"), level).otherwise("unknown")


def weak_relevance(c: Column) -> Column:
    return c < 40


#: A cell that is a figure, and a line that divides a table's head from its body.
FIGURE_CELL = r"(?i)^[₹\s]*-?[\d,.]+\s*(crore|lakh|%)?$"
DIVIDER = r"^\|[\s:|-]+\|$"


def numeric_cell(c: Column) -> Column:
    return c.rlike(FIGURE_CELL) & c.rlike(r"\d")


def markdown_rows(c: Column) -> Column:
    """The rows of bar tables as arrays of cells, without dividing lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    rows = F.filter(lines, lambda x: (F.length(x) > 1) & x.startswith("|") & x.endswith("|") & ~x.rlike(DIVIDER))
    return F.transform(rows, lambda x: F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"\|"), strip))


def numeric_columns(rows: Column) -> Column:
    """For each column whether all its cells below the header are numbers or empty; false without such rows."""
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))
    column = lambda i: F.forall(body, lambda r: F.coalesce((F.get(r, i) == "") | numeric_cell(F.get(r, i)), F.lit(True)))
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: (F.size(rows) > 1) & column(i))


def highlight(text: Column, table: Column) -> Column:
    """The longest sentence of 40 characters or more, the first one on ties; the carried first sentence and tables are left out."""
    prose = F.regexp_replace(text, r"(?s)\[TABLE\].*?\[/TABLE\]", " ")
    found = F.filter(F.transform(sentences(prose), strip), lambda s: s != "")
    used = F.when(F.size(found) > 1, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(1)))).otherwise(found)
    runs = F.filter(F.transform(used, lambda s, i: F.struct((-F.length(F.regexp_replace(s, r"\s+", " "))).alias("n"), i.alias("i"), F.regexp_replace(s, r"\s+", " ").alias("s"))), lambda x: x["n"] <= -40)
    return F.when(~table & (F.length(normal_name(prose)) > 0), F.get(F.array_sort(runs), F.lit(0))["s"])


def _once(hay: Column, needle: Column) -> Column:
    first = F.position(needle, hay)
    again = F.position(needle, hay, first + 1)
    return F.when((F.length(needle) >= 40) & (first > 0) & (again == 0), first)


def locate_once(page: Column, candidate: Column) -> Column:
    """The place from 1 of the candidate on the page, both normalised, if it is there exactly once; else null."""
    return _once(normal_name(page), normal_name(candidate))


def _bound(value: Column, f) -> Column:
    """f(value), with the value made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _raw_length(words: Column, head: Column) -> Column:
    """Characters of a page, cut into its words with the white space after each, that a head of the normalised page stands for."""
    n = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
    word, inside = F.get(words, n), F.length(F.substring_index(head, " ", -1))
    # Few letters have more characters in lower case than in upper case.
    longer = F.size(F.filter(F.sequence(F.lit(1), F.length(word)), lambda k: F.length(F.lower(F.substring(word, F.lit(1), k))) <= inside))
    return F.length(F.array_join(F.slice(words, F.lit(1), n), "")) + F.when(F.length(F.lower(word)) == F.length(word), inside).otherwise(longer)


def raw_place(page: Column, candidate: Column) -> Column:
    """(start from 1, length) on the page as it is of a candidate that the normalised page has exactly once; else null.

    Between the candidate's words the page may have any white space, and either case of letters.  The place is carried over
    word by word: a pattern of all the candidate's words needs a stack that grows with their number.
    """

    def carried(v: Column) -> Column:
        words, first = v["words"], v["first"]
        start = _raw_length(words, F.substring(v["hay"], F.lit(1), first - 1))
        end = _raw_length(words, F.substring(v["hay"], F.lit(1), first - 1 + F.length(v["needle"])))
        lead = F.length(v["page"]) - F.length(F.array_join(words, ""))
        return F.when(first.isNotNull(), F.struct((lead + start + 1).alias("start"), (end - start).alias("length")))

    found = F.struct(page.alias("page"), normal_name(page).alias("hay"), normal_name(candidate).alias("needle"), F.regexp_extract_all(page, F.lit(r"\S+\s*"), F.lit(0)).alias("words"))
    return _bound(found, lambda v: _bound(F.struct(*(v[c].alias(c) for c in ("page", "hay", "needle", "words")), _once(v["hay"], v["needle"]).alias("first")), carried))
