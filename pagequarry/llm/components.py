"""Connected components by alternating large-star and small-star steps, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (src, dst: long): root is the least node of the component.

    Every step takes the least neighbour of a node by a combined aggregate and joins it to the
    node's edges, so a node with very many neighbours can be split.  Stops when nothing changes.
    """
    now = Stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    state = _state(now.df)
    while state[0]:
        both = now.df.unionByName(now.df.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = Stored(both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m")), "least")
        large = Stored(both.join(least.df, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct(), "large")
        low = Stored(large.df.groupBy("src").agg(F.min("dst").alias("m")), "low")
        small = large.df.join(low.df, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*")
        after = Stored(small.where("src <> dst").distinct(), "edges")
        new = _state(after.df)
        for x in (now, least, large, low):
            x.drop()
        now = after
        if new == state:
            break
        state = new
    roots = now.df.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return now.df.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
