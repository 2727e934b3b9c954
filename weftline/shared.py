"""Tables that a plan computes once and reads again, in a folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``; of this machine only where Spark is local and none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def local_folder(spark: SparkSession) -> str:
    """A new shared folder for files that no Hadoop file system opens, such as databases; it has to be mounted everywhere."""
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("spark.checkpoint.dir is no mounted folder")
    os.makedirs(folder)
    return folder


def written(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """The rows of ``df`` as Parquet files, read again; with ``by``, one folder for each of its values."""
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
