"""Ingesting documents: guards, pages, chunks, registry."""

from __future__ import annotations

import re
import time
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULTS, Settings
from ..functions import text as X
from ..sources import readers
from .basis import assign_basis
from .chunking import chunk_pages
from .scratch import hadoop_path


def guard(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds status: new, already_indexed (same content) or conflict (same document, other content).

    incoming: doc_name, content_sha256, and what else is to be kept.
    """
    known = registry.select("doc_id", F.col("content_sha256").alias("__known"), F.lit(True).alias("__there"))
    rows = incoming.withColumn("doc_id", X.doc_id(F.col("doc_name"))).join(known, "doc_id", "left")
    status = F.when(F.col("__there").isNull(), "new").when(F.col("__known").eqNullSafe(F.col("content_sha256")), "already_indexed").otherwise("conflict")
    return rows.withColumn("status", status).drop("__known", "__there")


def prepare(pages: DataFrame, documents: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(pages with basis, chunks): pages (doc_id, page_number, text, section_heading, basis if it is known), documents (doc_id, doc_name, entity, fiscal_year)."""
    based = pages if "basis" in pages.columns else assign_basis(pages)
    chunks = chunk_pages(based, settings).join(documents.select("doc_id", "doc_name", "entity", "fiscal_year"), "doc_id")
    return based, chunks.select(*schemas.CHUNKS.names)


def registry_rows(based: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The registry's rows of documents that have chunks."""
    p = based.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("pages"), F.count_if(F.col("basis") == "standalone").cast("int").alias("standalone_pages"), F.count_if(F.col("basis") == "consolidated").cast("int").alias("consolidated_pages")
    )
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    return documents.join(p, "doc_id").join(c, "doc_id").withColumn("ingested_at", F.current_timestamp()).select(*schemas.REGISTRY.names)


def with_indexed_text(chunks: DataFrame) -> DataFrame:
    """Adds the text that is searched: a line of provenance and the chunk."""
    line = X.provenance(F.col("entity"), F.col("fiscal_year"), F.col("basis"), F.col("page_number"))
    return chunks.withColumn("indexed_text", X.indexed_text(line, F.col("text")))


#: Characters of a document's id that name its bucket: 256 buckets.
BUCKET_CHARS = 2


class Store:
    """Tables in a folder.

    Chunks lie in a folder for each attempt, and in it for each bucket of document ids.  The registry is
    written last and names the attempt of each document, and readers see only chunks of registered
    attempts: what a failed ingest has left behind is never seen, goes with :meth:`vacuum`, and a
    retry writes the documents anew under its own.  A lookup of one document reads one folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        path, fs = hadoop_path(self.spark, f"{self.folder}/{name}")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _registered(self) -> DataFrame:
        return self._read("registry", schemas.STORED_REGISTRY)

    def registry(self) -> DataFrame:
        return self._registered().drop("attempt")

    def chunks(self) -> DataFrame:
        return self._read("chunks", schemas.STORED_CHUNKS).join(self._registered().select("doc_id", "attempt"), ["doc_id", "attempt"], "left_semi").select(*schemas.CHUNKS.names)

    def numbered_chunks(self) -> DataFrame:
        """The chunks with seq, their order by document, page and place; readers that need an order sort by it."""
        return self.chunks().withColumn("seq", F.struct("doc_name", "doc_id", "chunk_index"))

    def document(self, doc_id: str) -> DataFrame:
        return self.registry().where(F.col("doc_id") == doc_id)

    def document_chunks(self, doc_id: str) -> DataFrame:
        """The chunks of one document: its registered attempt and its bucket are partition filters."""
        found = self._registered().where(F.col("doc_id") == doc_id).select("attempt").first()
        rows = self._read("chunks", schemas.STORED_CHUNKS).where((F.col("attempt") == (found.attempt if found else "")) & (F.col("bucket") == doc_id[:BUCKET_CHARS]))
        return rows.where(F.col("doc_id") == doc_id).select(*schemas.CHUNKS.names)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.document_chunks(chunk_id.partition("_")[0]).where(F.col("chunk_id") == chunk_id)

    def vacuum(self, older_than_s: float = 86_400) -> int:
        """Remove what attempts have left that the registry does not name; returns how many attempts went.

        Attempts that wrote anything in the last ``older_than_s`` seconds may still be at work and stay.
        Readers never see the files that go.
        """
        named = {r.attempt for r in self._registered().select("attempt").distinct().toLocalIterator()}
        gone = 0
        for table, prefix in (("chunks", "attempt="), ("status", "")):
            path, fs = hadoop_path(self.spark, f"{self.folder}/{table}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                name, age = s.getPath().getName(), time.time() - s.getModificationTime() / 1000
                if name.startswith(prefix) and name[0] not in "._" and name.removeprefix(prefix) not in named and age >= older_than_s:
                    fs.delete(s.getPath(), True)
                    gone += table == "chunks"
        return gone

    def ingest_manifest(self, manifest: DataFrame, folder: str, first, second=None, settings: Settings = DEFAULTS) -> DataFrame:
        """Ingest the files that a manifest (file, doc_name, entity, fiscal_year) names in a folder; returns each document's status.

        If any file is missing, nothing is read or written (:class:`MissingFiles`).  first, second: extractors.
        """
        listed = readers.read_files(self.spark, folder)
        root = F.lit(folder.rstrip("/") + "/")
        inside = listed.select(F.regexp_replace(F.element_at(F.split("path", F.regexp_replace(root, "^[a-z]+:/*", "/")), -1), "^/+", "").alias("path"), "content")
        stop_if_missing(readers.missing_files(manifest, inside))
        files = inside.join(manifest, inside["path"] == manifest["file"]).drop("path")
        documents = files.select("doc_name", "entity", "fiscal_year", F.col("file").alias("file_path"), F.sha2("content", 256).alias("content_sha256"))
        pages = readers.extract_pages(files.select(X.doc_id(F.col("doc_name")).alias("doc_id"), "content"), first, second)
        return self.ingest(documents, pages.where("error is null").drop("error"), settings)

    def ingest(self, documents: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
        """Write the new ones among documents (doc_name, entity, fiscal_year, file_path, content_sha256) and return each one's status.

        pages: doc_id, page_number, text, section_heading.  Documents without chunks are not registered.
        """
        attempt = uuid.uuid4().hex
        status = guard(documents, self.registry())
        new = status.where("status = 'new'").drop("status").dropDuplicates(["doc_id"])
        based, chunks = prepare(pages.join(new.select("doc_id"), "doc_id", "left_semi"), new, settings)
        # The statuses must be known before the registry changes; they are a row for each document given.
        result = f"{self.folder}/status/{attempt}"
        status.select("doc_id", "doc_name", "status").write.parquet(result)
        placed = chunks.withColumns({"attempt": F.lit(attempt), "bucket": F.substring("doc_id", 1, BUCKET_CHARS)})
        # Gathered by bucket, a large one over several tasks, so that there are few files.
        placed.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("attempt", "bucket").parquet(f"{self.folder}/chunks")
        stored = self._read("chunks", schemas.STORED_CHUNKS).where(F.col("attempt") == attempt)
        registry_rows(based, stored, new).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.folder}/registry")
        return self.spark.read.schema("doc_id string, doc_name string, status string").parquet(result)

    def with_files(self, listing: DataFrame) -> DataFrame:
        """The registry with has_file: whether the listing (path) holds the document's stored file, ``<doc_id>.pdf`` in any folder."""
        there = listing.select(F.regexp_extract("path", r"([0-9a-f]{16})\.pdf$", 1).alias("doc_id"), F.lit(True).alias("has_file")).where("doc_id <> ''").distinct()
        return self.registry().join(there, "doc_id", "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))

    def served_file(self, doc_id: str, listing: DataFrame) -> str:
        """invalid / unknown / missing / found: whether a document's stored file can be served."""
        if not re.fullmatch(r"[0-9a-f]{16}", doc_id):
            return "invalid"
        if self.document(doc_id).isEmpty():
            return "unknown"
        return "missing" if listing.where(F.col("path").endswith(f"{doc_id}.pdf")).isEmpty() else "found"


#: The codes of an upload that is malformed, conflicts with what is stored, or holds no text.
BAD_REQUEST, CONFLICT, NO_TEXT, GOOD = 400, 409, 422, 200


def validate_uploads(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds doc_id, status, code and error to uploads (file_name, doc_name, entity, fiscal_year, content_sha256, n_pages with text).

    A null or blank doc_name becomes the file's stem, null entities and years count as blank; the
    first fault found is the one reported.
    """
    blank = lambda c: X.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    named = uploads.withColumn("doc_name", F.when(blank("doc_name"), X.file_stem(F.col("file_name"))).otherwise(F.col("doc_name")))
    rows = guard(named, registry)
    fault = lambda code, text: F.struct(F.lit(code).alias("code"), F.lit(text).alias("error"))
    found = (
        F.when(~F.lower(F.coalesce("file_name", F.lit(""))).endswith(".pdf"), fault(BAD_REQUEST, "not a PDF file"))
        .when(blank("entity") | blank("fiscal_year"), fault(BAD_REQUEST, "entity and fiscal year must not be blank"))
        .when(F.col("status") == "already_indexed", fault(CONFLICT, "indexed already"))
        .when(F.col("status") == "conflict", fault(CONFLICT, "another content is indexed under this name"))
        .when(F.coalesce("n_pages", F.lit(0)) == 0, fault(NO_TEXT, "no text found"))
        .otherwise(F.struct(F.lit(GOOD).alias("code"), F.lit(None).cast("string").alias("error")))
    )
    return rows.withColumn("found", found).select(*rows.columns, "found.code", "found.error")


def tally(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def store_files(files: DataFrame, folder: str) -> int:
    """Write each document's file (doc_name, content) to ``<folder>/<doc_id>.pdf`` and return how many were written.

    The executors write, each file under a name of its own that is then changed, so no reader sees a
    part of one and a task that is run again writes the same.  The folder is a URI or a path that all
    executors share.  Null contents are left out; of rows with one name one is written.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(held) as out:
                    out.write(content.as_buffer())
                fs.move(held, f"{root}/{name}.pdf")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.where("content is not null").select(X.doc_id(F.col("doc_name")).alias("doc_id"), "content").dropDuplicates(["doc_id"])
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


class MissingFiles(RuntimeError):
    """Files that a manifest names are not there."""


def stop_if_missing(missing: DataFrame, most_named: int = 20) -> None:
    """Refuse to go on if there are missing files (file); the message names the first of them and says how many there are."""
    n = missing.count()
    if n:
        named = [r.file for r in missing.orderBy("file").limit(most_named).collect()]
        raise MissingFiles(f"{n} files are missing: " + ", ".join(named) + (", ..." if n > len(named) else ""))


def document_counts(chunks: DataFrame) -> DataFrame:
    """doc_name, chunks, pages with chunks, chunks by basis; a row for each document, by name."""
    counts = chunks.groupBy("doc_name").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("page_number").alias("pages_with_chunks"), F.count_if(F.col("basis") == "standalone").alias("standalone"), F.count_if(F.col("basis") == "consolidated").alias("consolidated"), F.count_if(F.col("basis").isNull()).alias("undetermined")
    )
    return counts.orderBy("doc_name")


def indexed_entities(chunks: DataFrame) -> DataFrame:
    """The distinct names, in order."""
    return chunks.where("entity <> ''").select("entity").distinct().orderBy("entity")
