"""Shared folder for written tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The cluster's folder; a folder of our own only in local mode without a setting."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="treecensus-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{base(spark)}/treecensus/{label}-{uuid.uuid4().hex}"


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write rows once and go on from the written table.

    For results that are costly to make, much smaller than their input, and read
    several times by what follows.
    """
    where = folder(rows.sparkSession, label)
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written folder wherever the session's file systems have it; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
