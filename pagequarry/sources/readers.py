"""Manifests, files and page extraction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X


class ManifestError(ValueError):
    """A manifest that cannot be used."""


def read_manifest(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> DataFrame:
    """file, doc_name (the file's stem if not given), entity, fiscal_year; ``only`` keeps files that hold any of the texts."""
    try:
        raw = spark.read.text(path, wholetext=True)
        first = raw.select(F.trim("value").alias("v")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ManifestError(f"manifest not found: {path}") from e
    if first is None or not first.v.startswith("["):
        raise ManifestError("the manifest must be a JSON list")
    rows = raw.select(F.explode_outer(F.from_json("value", "array<struct<file string, doc_name string, entity string, fiscal_year string>>")).alias("x")).select("x.*")
    bad = rows.agg(*(F.count(F.when(F.coalesce(X.strip(F.col(c)), F.lit("")) == "", 1)).alias(c) for c in ("file", "entity", "fiscal_year"))).first().asDict()
    if missing := [c for c, n in bad.items() if n]:
        raise ManifestError(f"entries without {', '.join(missing)}, or no valid JSON")
    rows = rows.withColumn("doc_name", F.coalesce("doc_name", X.file_stem(F.col("file"))))
    if only:
        hit = F.lit(False)
        for o in only:
            hit = hit | F.contains("file", F.lit(o))
        rows = rows.where(hit)
        if rows.isEmpty():
            raise ManifestError("no entry matches")
    return rows


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose file is not among the listed paths; if there are any, nothing is to be ingested."""
    return manifest.join(listing.select(F.col("path").alias("file")), "file", "left_anti")


def plan(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What an ingest would read: file, doc_name, doc_id, size, the start of the content's digest."""
    return manifest.join(files, manifest["file"] == files["path"]).select("file", "doc_name", X.doc_id(F.col("doc_name")).alias("doc_id"), F.length("content").alias("size"), F.substring(F.sha2("content", 256), 1, 12).alias("sha"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Takes a file's bytes, returns for each page its text and its tables (rows of cells).
Extractor = Callable[[bytes], list[tuple[str, list[list[list[str]]]]]]


def page_text(text: str | None, tables: list) -> str:
    """A page's text with its tables after it, in marked blocks."""
    rows = lambda t: "\n".join(" | ".join((c or "").strip() for c in r) for r in t)
    return "\n".join([text or "", *(f"\n[TABLE]\n{rows(t)}\n[/TABLE]\n" for t in tables)]).strip()


def extract_pages(files: DataFrame, first: Extractor, second: Extractor | None = None) -> DataFrame:
    """Files (doc_id, content) -> pages (doc_id, page_number, text, section_heading, error).

    A page without text takes the second extractor's; a file on which the first fails is read with
    the second; a file on which both fail has one row with the error.
    """

    def read(content: bytes) -> list[str]:
        try:
            pages = [page_text(*p) for p in first(content)]
        except Exception:
            if second is None:
                raise
            return [page_text(*p) for p in second(content)]
        if second is not None and not all(pages):
            try:
                other = [page_text(*p) for p in second(content)]
            except Exception:
                other = []
            pages = [p or (other[i] if i < len(other) else "") for i, p in enumerate(pages)]
        return pages

    def run(batches):
        for b in batches:
            out = []
            for d, c in zip(b["doc_id"], b["content"]):
                try:
                    out += [(d, i, t, None) for i, t in enumerate(read(bytes(c)), 1)]
                except Exception as e:
                    out.append((d, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "text", "error"])

    pages = files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_number int, text string, error string")
    return pages.withColumn("section_heading", X.section_heading(F.col("text")))


def plain_text(content: bytes) -> list[tuple[str, list]]:
    """An extractor for text files: pages end with a form feed."""
    return [(p, []) for p in content.decode("utf-8").split("\f")]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)
