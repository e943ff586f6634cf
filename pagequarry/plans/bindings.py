"""How the engine's inputs are made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index_store import file_state, resident_keyword_index
from ..operators.ingest import with_indexed_text
from ..operators.vector_store import resident_vector_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a page of its source, and a chunk; its language stands for the year."""
    d = table(spark, sf_dir, "documents")
    rows = d.join(page_numbers(d), "doc_id").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"), F.col("source").alias("doc_name"), F.col("source").alias("entity"), F.col("lang").alias("fiscal_year"), "page_number", F.lit(None).cast("string").alias("basis"), "text"
    )
    return with_indexed_text(rows)


def page_numbers(documents: DataFrame, span: int = 8192) -> DataFrame:
    """(doc_id, page_number): the place of a document among its source's, by id.

    Places are counted within spans of ids and added up over the spans, so that a large source is
    spread over tasks.  A null source is a source of its own.
    """
    ids = documents.select("doc_id", "source", F.floor(F.col("doc_id") / span).alias("span"))
    over = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("source", "span").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("source").alias("__source"), F.col("span").alias("__span"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    placed = ids.withColumn("place", F.row_number().over(Window.partitionBy("source", "span").orderBy("doc_id")))
    joined = placed.join(before, placed["source"].eqNullSafe(before["__source"]) & (placed["span"] == before["__span"]))
    return joined.select("doc_id", (F.col("before") + F.col("place")).cast("int").alias("page_number"))


def keyword_index(spark: SparkSession, sf_dir: str):
    """The resident keyword index of the documents."""
    return resident_keyword_index(spark, table(spark, sf_dir, "documents").inputFiles(), lambda: chunks(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str, filtered: bool = False) -> DataFrame:
    """The benchmark's items as one batch of questions."""
    none = F.lit(None).cast("string")
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), (F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")) if filtered else none).alias("doc_name"), (F.when(F.col("item_id") % 2 == 0, "en") if filtered else none).alias("fiscal_year"), none.alias("section_type"), F.lit(None).cast("int").alias("top_n")
    )


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("doc_name"), F.col("lang").alias("fiscal_year"))
    return table(spark, sf_dir, "embeddings").join(d, "vec_id", "left").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"), "doc_name", "fiscal_year")


def vector_index(spark: SparkSession, sf_dir: str):
    """The resident index of the embeddings."""
    files = [*table(spark, sf_dir, "embeddings").inputFiles(), *table(spark, sf_dir, "documents").inputFiles()]
    return resident_vector_index(spark, file_state(spark, files), lambda: vector_rows(spark, sf_dir))


def vector_questions(spark: SparkSession, sf_dir: str, filtered: bool = False) -> DataFrame:
    """The questions with the vector of the same number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return questions(spark, sf_dir, filtered).join(v, "query_id")


def turns_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose pages name statements now and then."""
    c = table(spark, sf_dir, "conversations")
    head = (
        F.when(F.col("turn") % 5 == 1, "Standalone Financial Statements 2024-25\n")
        .when(F.col("turn") % 5 == 3, F.concat(F.lit("12 Consolidated Financial Statements 20"), F.lpad(((F.col("conv_id") % 9) + 20).cast("string"), 2, "0"), F.lit("-25\n")))
        .when(F.col("turn") % 5 == 4, "Glossary\n")
        .otherwise("")
    )
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.concat(head, "text").alias("text"))
