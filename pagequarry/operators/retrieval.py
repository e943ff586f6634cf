"""Merging both lanes, filtering by section, and reranking with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import tokens


def merge_lanes(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """query_id, chunk_id, vector_score, bm25_score, retrieval_source, position: the vector lane first, then what only the keyword lane has."""
    v = vector.select("query_id", "chunk_id", "vector_score", "vector_rank")
    k = keyword.select("query_id", "chunk_id", "bm25_score", "bm25_rank")
    both = v.join(k, ["query_id", "chunk_id"], "full_outer")
    source = F.when(F.col("vector_score").isNotNull() & F.col("bm25_score").isNotNull(), "hybrid").when(F.col("vector_score").isNotNull(), "vector").otherwise("bm25")
    order = Window.partitionBy("query_id").orderBy(F.col("vector_rank").asc_nulls_last(), "bm25_rank")
    return both.select("query_id", "chunk_id", "vector_score", "bm25_score", source.alias("retrieval_source"), F.row_number().over(order).alias("position"))


def section_filter(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates whose section title holds the question's section, ignoring case; without one all stay."""
    wants = queries.select("query_id", F.col("section_type").alias("__want"))
    hit = F.contains(F.lower("section_title"), F.lower("__want"))
    return candidates.join(wants, "query_id").where((F.coalesce("__want", F.lit("")) == "") | F.coalesce(hit, F.lit(False))).drop("__want")


def shared_words_logit(question: Column, words: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that are among the words, from -11 to 11."""
    asked = F.array_distinct(tokens(question))
    hit = F.size(F.array_intersect(asked, words))
    return F.when(F.size(asked) > 0, hit / F.size(asked) * 22.0 - 11.0).otherwise(F.lit(-11.0))


def lexical_logit(question: Column, text: Column) -> Column:
    """The same of a text's words."""
    return shared_words_logit(question, tokens(text))


def counted_logit(question: Column, tfs: Column) -> Column:
    """The same of the words that a keyword index has counted, so no text is read."""
    return shared_words_logit(question, F.map_keys(tfs))


def rerank(candidates: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_logit, settings: Settings = DEFAULTS, on: str = "indexed_text") -> DataFrame:
    """Adds rerank_score and rank, and keeps the best top_n of each question; null scores count as 0, ties stay in candidate order.

    candidates: query_id, chunk_id, position, the column that is scored with the question, and what else is to be kept.
    """
    asked = queries.select("query_id", "question", "top_n")
    scored = candidates.join(asked, "query_id").withColumn("rerank_score", scorer(F.col("question"), F.col(on)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "position")
    most = F.coalesce(F.when(F.col("top_n") > 0, F.col("top_n")), F.lit(settings.top_n))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("question", "top_n", on)
