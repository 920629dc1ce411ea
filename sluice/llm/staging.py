"""Intermediate tables in the folder that all executors share.

`spark.checkpoint.dir` names it. A table written there cuts lineage: it is read
back as plain Parquet, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; in local tests, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own()
    return found.rstrip("/")


@cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sluice-")


def place(df: DataFrame, label: str) -> str:
    """Write `df` to the shared folder; returns its path there. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(place(df, label))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a placed table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
