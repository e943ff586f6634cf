"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i = T.StringType(), T.IntegerType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


MANIFEST = _struct(("file", _s, True), ("doc_name", _s, True), ("entity", _s, True), ("fiscal_year", _s, True))
PAGES = _struct(("doc_id", _s, False), ("page_number", _i, False), ("text", _s, True), ("section_heading", _s, True))
CHUNKS = _struct(
    ("chunk_id", _s, False), ("doc_id", _s, False), ("doc_name", _s, False), ("page_number", _i, False), ("section_title", _s, True), ("chunk_index", _i, False),
    ("entity", _s, True), ("fiscal_year", _s, True), ("basis", _s, True), ("text", _s, False),
)
REGISTRY = _struct(
    ("doc_id", _s, False), ("doc_name", _s, False), ("pages", _i, False), ("chunks", _i, False), ("entity", _s, True), ("fiscal_year", _s, True),
    ("standalone_pages", _i, False), ("consolidated_pages", _i, False), ("file_path", _s, True), ("content_sha256", _s, True), ("ingested_at", T.TimestampType(), False),
)
#: What is written: each chunk with the attempt that wrote it, each registered document with the attempt whose chunks count.
#: The last two are the folders that chunks lie in: the attempt, and the first characters of the document's id.
STORED_CHUNKS = T.StructType([*CHUNKS.fields, T.StructField("attempt", _s, False), T.StructField("bucket", _s, False)])
STORED_REGISTRY = T.StructType([*REGISTRY.fields, T.StructField("attempt", _s, False)])
VECTORS = _struct(("chunk_id", _s, False), ("vec", T.ArrayType(T.FloatType()), False))
QUERIES = _struct(("query_id", T.LongType(), False), ("question", _s, False), ("doc_name", _s, True), ("fiscal_year", _s, True), ("section_type", _s, True), ("top_n", _i, True))
