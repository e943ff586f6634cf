"""Documents whose pages come over many micro-batches, held in state until they are whole or late."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.basis import page_event

#: A page says how many its document has; ``n_pages`` may be null where that is not known.
INPUT = "doc_name string, entity string, fiscal_year string, n_pages int, page_number int, text string"
#: A page with the basis carried to it, and why its document was let go: complete or late.
RELEASED = "doc_name string, entity string, fiscal_year string, page_number int, text string, basis string, released string"
_PAGE = "entity string, fiscal_year string, text string, event string"
_EXPECTED = "n_pages int"
_COLUMNS = [c.split()[0] for c in RELEASED.split(", ")]


class HeldPages(StatefulProcessor):
    """Pages of one document by number; a page that comes again replaces the one before.

    A document goes as soon as it has all the pages that its pages speak of, or when none has come for
    ``late_ms``.  Its pages go in order, each with the basis of the last page before it that names one
    or ends one; a document that is let go late and goes on is one of its own.
    """

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_number int", _PAGE)
        self.expected = handle.getValueState("expected", _EXPECTED)

    def handleInputRows(self, key, rows, timerValues):
        expected = self.expected.get()
        expected = expected[0] if expected else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                if not pd.isna(r.n_pages):
                    expected = max(int(r.n_pages), expected or 0)
                self.pages.updateValue((int(r.page_number),), tuple(None if pd.isna(x) else x for x in (r.entity, r.fiscal_year, r.text, r.event)))
        if expected is not None:
            self.expected.update((expected,))
        whole = expected is not None and sum(1 for _ in self.pages.keys()) >= expected
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if whole:
            yield self._release(key, "complete")
            return
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.late_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # Spark deletes the timer itself
        if self.pages.exists():
            yield self._release(key, "late")

    def _release(self, key, why: str) -> pd.DataFrame:
        basis, found = None, []
        for (number,), (entity, year, text, event) in sorted(self.pages.iterator(), key=lambda x: x[0]):
            if event is not None:
                basis = event or None
            found.append((key[0], entity, year, number, text, basis, why))
        self.pages.clear()
        self.expected.clear()
        return pd.DataFrame(found, columns=_COLUMNS).astype({"page_number": "int32"})

    def close(self) -> None:
        pass


def whole_documents(pages: DataFrame, late_ms: int = 600_000, initial: DataFrame | None = None) -> DataFrame:
    """A stream of pages (``INPUT``) -> the pages of documents that are complete or late (``RELEASED``).

    Rows without a name or page number are left out.  State lies in RocksDB, by document; the stream
    needs ``spark.sql.streaming.stateStore.providerClass`` set to its provider.
    """
    rows = pages.where("doc_name is not null and page_number is not null").withColumn("event", page_event(F.coalesce("text", F.lit(""))))
    return rows.groupBy("doc_name").transformWithStateInPandas(HeldPages(late_ms), RELEASED, "update", "ProcessingTime", initialState=initial)
