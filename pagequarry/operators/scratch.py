"""Tables between the steps of a search, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where all is one machine is there a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/pagequarry-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def goes_at_exit(spark: SparkSession, folder: str) -> str:
    p, fs = hadoop_path(spark, folder)
    fs.deleteOnExit(p)
    return folder


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and reread: it is made once, and the optimiser knows its size from the files."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/pagequarry-steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(goes_at_exit(spark, folder))
