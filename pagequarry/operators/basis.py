"""Which set of statements a page belongs to, carried from marked pages to those that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Patterns of lines that name the statements.
MARKERS = (
    r"(?i)^(standalone|consolidated)\s+financial\s+statements\s+under\s+indian\s+accounting\s+standards",
    r"(?i)^(?:\d{1,4}\s+)?(standalone|consolidated)\s+financial\s+statements\s+\d{4}-\d{2}\s*$",
    r"(?i)^notes?\s+forming\s+part\s+of\s+the\s+(standalone|consolidated)\s+financial\s+statements",
)
#: Patterns of lines that end the statements.
TERMINATORS = (r"(?i)^notice\s+of\s+the\s+\d+\s*(?:st|nd|rd|th)\s+annual\s+general\s+meeting", r"(?i)^dear\s+members?\b", r"(?i)^glossary\s*$", r"(?i)^abbreviations\s*$")
HEAD_LINES, LINE_CHARS = 8, 130


def head_lines(text: Column) -> Column:
    """The first lines with text; long ones keep their place but are not looked at."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.filter(F.slice(lines, 1, HEAD_LINES), lambda x: F.length(x) <= LINE_CHARS)


def page_event(text: Column) -> Column:
    """The basis that a page names, '' if it only ends the statements, null if neither."""
    lines = head_lines(text)
    name = lambda x: F.coalesce(*(F.when(x.rlike(p), F.lower(F.regexp_extract(x, p, 1))) for p in MARKERS))
    marked = F.get(F.filter(F.transform(lines, name), lambda x: x.isNotNull()), F.lit(0))
    ended = F.exists(lines, lambda x: F.coalesce(*(F.when(x.rlike(p), True) for p in TERMINATORS), F.lit(False)))
    return F.coalesce(marked, F.when(ended, F.lit("")))


def assign_basis(pages: DataFrame, by: str = "doc_id", order: str = "page_number", text: str = "text") -> DataFrame:
    """Adds basis: the last event of the document's pages so far."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("__event", ignorenulls=True).over(so_far)
    return pages.withColumn("__event", page_event(F.col(text))).withColumn("basis", F.nullif(carried, F.lit(""))).drop("__event")
