"""Shared pieces of the training-data operators: storage between steps and word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where all is one machine has it a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/pagequarry-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Stored:
    """A DataFrame written to the shared folder, reread, and removable when no longer needed."""

    def __init__(self, df: DataFrame, label: str, compression: str = "snappy", by: str | None = None):
        """``by``: a column of few values whose parts of the table can be dropped one by one."""
        self.spark, self.by = df.sparkSession, by
        self.path = f"{shared_dir(self.spark)}/pagequarry/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", compression).partitionBy(*([by] if by else [])).parquet(self.path)
        self.schema = df.schema
        self.df = self.reread()
        p, fs = _fs(self.spark, self.path)
        fs.deleteOnExit(p)

    def reread(self) -> DataFrame:
        """The table anew, whose columns are others than those of ``df`` in a join of both."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, part: str | None = None) -> None:
        """Delete the table, or one part of it; ``df`` is not to be used then, a new :meth:`reread` has the rest."""
        p, fs = _fs(self.spark, self.path if part is None else f"{self.path}/{self.by}={part}")
        fs.delete(p, True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder; it goes when the session ends."""
    return Stored(df, label).df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with: its cleaner follows the JVM's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of the columns', whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
