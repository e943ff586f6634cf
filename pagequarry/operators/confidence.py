"""How far a question's evidence carries: explicit thresholds, applied in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import listed, one_decimal


def assess(queries: DataFrame, scores: DataFrame, foreign: DataFrame | None = None, settings: Settings = DEFAULTS, indexed: str = "") -> DataFrame:
    """query_id, level, reason, abstention_reason, abstained, top, supporting, n_scores.

    queries: query_id; scores: query_id, rerank_score (may be null); foreign: query_id, names (array),
    the companies that are not indexed.  indexed: the names that are, as one text.
    """
    s = settings
    of = scores.groupBy("query_id").agg(F.max("rerank_score").alias("top"), F.count(F.when(F.col("rerank_score") >= s.moderate, 1)).alias("supporting"), F.count(F.lit(1)).alias("n_scores"))
    rows = queries.select("query_id").join(of, "query_id", "left").fillna(0, ["supporting", "n_scores"])
    if foreign is not None:
        rows = rows.join(foreign.select("query_id", "names"), "query_id", "left")
    else:
        rows = rows.withColumn("names", F.lit(None).cast("array<string>"))
    gated = F.coalesce(F.size("names"), F.lit(0)) > 0
    top, text = F.col("top"), one_decimal(F.col("top"))
    level = (
        F.when(gated | top.isNull() | (top < s.abstain), "insufficient")
        .when((top >= s.high) & (F.col("supporting") >= s.min_supporting), "high")
        .when(top >= s.moderate, "moderate")
        .otherwise("low")
    )
    none = F.when(F.col("n_scores") == 0, "retrieval came back empty").otherwise(F.concat(F.lit("not one score on "), F.col("n_scores").cast("string"), F.lit(" hits")))
    reason = (
        F.when(gated, F.concat(F.lit("asks about "), listed(F.col("names")), F.lit(", of which nothing is held")))
        .when(top.isNull(), none)
        .when(top < s.abstain, F.concat(F.lit("best score "), text, F.lit(" is under the floor")))
        .when(level == "high", F.concat(F.lit("best score "), text, F.lit(", "), F.col("supporting").cast("string"), F.lit(" chunks in support")))
        .when(top >= s.high, F.concat(F.lit("best score "), text, F.lit(", one chunk alone")))
        .when(level == "moderate", F.concat(F.lit("best score "), text, F.lit(" is under the high threshold")))
        .otherwise(F.concat(F.lit("best score "), text, F.lit(" is weak")))
    )
    scope = F.lit(f" Companies at hand: {indexed}." if indexed else "")
    stop = F.when(gated, F.concat(F.lit("Nothing is held on "), listed(F.col("names")), F.lit("."), scope)).when(top.isNull(), F.concat(F.lit("Evidence is missing, as "), none, F.lit("."))).when(top < s.abstain, F.lit("What was found is too weak to answer from."))
    return rows.select("query_id", level.alias("level"), reason.alias("reason"), stop.alias("abstention_reason"), (level == "insufficient").alias("abstained"), "top", "supporting", "n_scores")
