"""Cutting pages into chunks of limited length."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions import text as X

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n{2,}")


def pack(parts: list[str], limit: int, glue: str, overlap: int = 0) -> list[str]:
    """Parts joined in order into pieces of at most ``limit`` words, each started with the last sentences of the one before."""
    out, held, size = [], [], 0
    for part in parts:
        n = len(part.split())
        if held and size + n > limit:
            out.append(glue.join(held))
            tail = " ".join(_SENTENCE.split(held[-1])[-overlap:]) if overlap else ""
            held = [tail] if overlap else []
            size = len(tail.split())
        held.append(part)
        size += n
    return out + [glue.join(held)] if held else out


def chunk_text(text: str | None, max_words: int | None = None, overlap: int = 1) -> list[str]:
    """Paragraphs packed with an overlap; pieces still too long are packed anew by sentences, without one."""
    limit = max_words or DEFAULTS.max_words
    paragraphs = [p.strip() for p in _PARAGRAPH.split(text or "") if p.strip()]
    found = []
    for piece in pack(paragraphs, limit, "\n\n", overlap):
        found += [piece] if len(piece.split()) <= limit else pack(_SENTENCE.split(piece), limit, " ")
    return [x for x in found if x.strip()]


def chunk_pages(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages (doc_id, page_number, text, section_heading, and what else is to be kept) -> a row for each chunk.

    Adds chunk_id, chunk_index (through the document) and text; blank pages make no chunks.
    """
    limit, overlap = settings.max_words, settings.overlap_sentences
    names = [*pages.columns, "__i", "__chunk"]
    schema = T.StructType([*pages.schema.fields, T.StructField("__i", T.IntegerType()), T.StructField("__chunk", T.StringType())])
    text = pages.columns.index("text")

    def cut(batches):
        for batch in batches:
            found = [chunk_text(t, limit, overlap) for t in batch.column(text).to_pylist()]
            of = pa.array([k for k, c in enumerate(found) for _ in c], pa.int64())
            places, chunks = pa.array([i for c in found for i in range(len(c))], pa.int32()), pa.array([x for c in found for x in c], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.take(of).columns, places, chunks], names=names)

    each = pages.where(X.strip(F.coalesce("text", F.lit(""))) != "").mapInArrow(cut, schema)
    order = Window.partitionBy("doc_id").orderBy("page_number", "__i")
    return (
        each.withColumns({"chunk_id": F.concat_ws("_", "doc_id", F.concat(F.lit("p"), F.col("page_number").cast("string")), F.col("__i").cast("string")), "chunk_index": F.row_number().over(order) - 1, "text": F.col("__chunk")})
        .withColumnRenamed("section_heading", "section_title")
        .drop("__i", "__chunk")
    )
