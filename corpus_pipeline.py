"""The corpus pipeline: documents to token ids in five stages.

Each stage takes what the one before has kept and returns the columns of ``documents``; the last
returns the token ids.  Between stages the rows are written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import exact_dedup, mixing, near_join, piece_bpe, toxicity
from pagequarry.llm.common import read_table, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model marks are left out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return near_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice; every document is there once at least."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and the digests of the ids and of what they decode to."""
    import public_tokenizers

    return piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("sentencepiece", encode),
]

#: SQL cannot express the trained model or the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage-{k}")
    return docs
