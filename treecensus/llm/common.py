"""What several operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from treecensus.operators.joins import fits_broadcast
from treecensus.workspace import folder, settle

__all__ = ["folder", "settle", "table", "importable", "pieces_of", "slim", "slices_for", "numbered", "matrix"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package reaches the executors as usual (``--py-files`` or an image).
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small (by rows, and by bytes where rows are long), so that a task holds little at once."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows, batch.num_rows - at)
            part = batch.slice(at, take)
            while take > 1 and part.nbytes > size:
                take = max(1, take // 2)
                part = batch.slice(at, take)
            yield part
            at += take


def slim(task: Callable) -> Callable:
    """A function for mapInArrow that gives its freed memory back to the system once its batches are done.

    Spark keeps Python workers between tasks and for a minute after the last one. Without this each keeps the
    room of its largest task, beside the memory of the stage that runs by then.
    """
    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()
    return run


def give_back() -> None:
    """Return freed memory of Arrow and of the C library (where it can) to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices_for(rows: int, each: int, least: int = 64) -> int:
    """How many salts split ``rows`` so that a slice has about ``each`` rows, even if one key has them all."""
    return max(least, -(-rows // each))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with their place (``idx``, from 0) in their group and the group's ``size``.

    Only counts per partition and group are brought together, so a group may hold any share of the rows.
    """
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())  # equal rows need not stay together
    keys = [group, *order, "_spread"]
    placed = settle(spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_at", F.monotonically_increasing_id()).drop("_spread"), "numbered")
    part = F.shiftright("_at", 33)  # the partition
    counts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("_group")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                    .withColumn("size", F.sum("_n").over(own)).drop("_n"), "counts")
    if fits_broadcast(counts):
        counts = F.broadcast(counts)
    return (placed.join(counts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
            .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_group", "_part", "_first", "_before"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls as a matrix of doubles; short rows are followed by zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths := column.value_lengths().to_numpy())
    out = np.zeros((len(column), size))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out
