"""Measuring retrieval on probes and recommending thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_figure


def first_hits(hits: DataFrame, probes: DataFrame) -> DataFrame:
    """query_id, expected_rank (right figure and basis), rank_any_basis.

    hits: query_id, rank, text, basis; probes: query_id, expect_figure, expect_basis.
    """
    r = hits.join(probes, "query_id")
    figure = has_figure(F.col("text"), F.col("expect_figure"))
    return r.groupBy("query_id").agg(F.min(F.when(figure & ((F.col("basis") == F.col("expect_basis")) | F.col("expect_basis").isNull()), F.col("rank"))).alias("expected_rank"), F.min(F.when(figure, F.col("rank"))).alias("rank_any_basis"))


def top_hits(hits: DataFrame, most: int = 3) -> DataFrame:
    """query_id, top_hits: the best ranked hits as an ordered list of structs.

    hits: query_id, rank, doc_name, page_number, basis, rerank_score, retrieval_source.
    """
    item = F.struct("rank", F.col("doc_name").alias("doc"), F.col("page_number").alias("page"), "basis", F.col("rerank_score").alias("score"), F.col("retrieval_source").alias("source"))
    return hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("top_hits"))


def write_measurements(measured: DataFrame, path: str) -> None:
    """Raw measurements as JSON, a row a line."""
    measured.write.mode("overwrite").json(path)


def score_summary(measured: DataFrame) -> DataFrame:
    """kind, n, lowest, middle, highest of the top scores."""
    return measured.where("top is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("lowest"), F.median("top").alias("middle"), F.max("top").alias("highest"))


def recommend(measured: DataFrame) -> DataFrame:
    """separated, floor, high, moderate from the top scores of answerable and absent probes."""
    absent = F.col("kind") == "absent"
    one = measured.where("top is not null").agg(F.min(F.when(~absent, F.col("top"))).alias("worst"), F.max(F.when(absent, F.col("top"))).alias("best"), F.median(F.when(~absent, F.col("top"))).alias("middle"))
    clear = F.col("worst") > F.col("best")
    floor = F.when(clear, F.bround((F.col("worst") + F.col("best")) / 2, 1)).otherwise(F.bround(F.col("best") + 0.1, 1))
    high = F.bround("middle", 1)
    return one.select(clear.alias("separated"), floor.alias("floor"), high.alias("high"), F.bround((high + floor) / 2, 1).alias("moderate"))
