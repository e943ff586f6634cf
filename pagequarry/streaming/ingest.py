"""Ingesting from a stream of page files; the guard makes a repeated batch harmless."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as X
from ..operators.ingest import Store
from ..operators.scratch import keep
from . import pages

INPUT = "doc_name string, entity string, fiscal_year string, page_number int, text string"


def ingest_batch(store: Store, rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Whole documents given as rows of pages (INPUT)."""
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")))), lambda x: x["h"]), ""), 256)
    docs = rows.groupBy("doc_name").agg(F.first("entity").alias("entity"), F.first("fiscal_year").alias("fiscal_year"), digest.alias("content_sha256")).withColumn("file_path", F.lit(None).cast("string"))
    known = ["basis"] if "basis" in rows.columns else []
    pages = rows.select(X.doc_id(F.col("doc_name")).alias("doc_id"), "page_number", "text", X.section_heading(F.col("text")).alias("section_heading"), *known)
    return store.ingest(docs, pages, settings)


def stream_pages(spark: SparkSession, source: str, folder: str, checkpoint: str, settings: Settings = DEFAULTS):
    """A streaming query that ingests JSON files of pages as they come; a document's pages come in one batch (see :func:`stream_documents`)."""
    store = Store(spark, folder)
    rows = spark.readStream.schema(INPUT).json(source)
    return rows.writeStream.foreachBatch(lambda df, _: ingest_batch(store, df, settings) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed value: the state store that keeps documents between batches.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_documents(spark: SparkSession, source: str, folder: str, checkpoint: str, settings: Settings = DEFAULTS, late_ms: int = 600_000, files_per_batch: int | None = None, every: str = "1 second"):
    """A streaming query that ingests JSON files of pages (``pages.INPUT``) whose documents come over many batches.

    A document is ingested when it is complete or late, with the basis carried through its pages in
    state.  A batch that is repeated after a failure finds its documents registered.  The query goes on until it is
    stopped, as documents may turn late without new pages; see :func:`stop_when_idle`.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    store = Store(spark, folder)
    reader = spark.readStream.schema(pages.INPUT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    released = pages.whole_documents(reader.json(source), late_ms)

    def ingest(batch: DataFrame, _: int) -> None:
        rows = keep(batch, "released")  # made once, as every reading of a batch would update the state anew
        if not rows.isEmpty():
            ingest_batch(store, rows, settings)

    return released.writeStream.outputMode("update").foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stop_when_idle(query, poll_s: float = 0.5) -> None:
    """Stop a query once two batches have found no new rows; one with timers never ends or waits by itself.

    The first batch after a start may be one that an earlier run had begun, so one alone says nothing.
    """
    try:
        while query.isActive:
            last = query.recentProgress[-2:]
            if len(last) == 2 and all(p["numInputRows"] == 0 for p in last):
                break
            time.sleep(poll_s)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events in windows, by type, with late rows until the watermark; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
