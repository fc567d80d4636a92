"""Likely copies: same size, then equal samples of the content.

A group of copies may hold a large share of all files, so groups are counted
with partial aggregation and only the counts are joined back to the members;
members are never collected or paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus import constants as C
from treecensus.operators.joins import fits_broadcast, lookup_join, spread_join
from treecensus.workspace import folder, settle


def candidates(files: DataFrame) -> DataFrame:
    """Non-empty files."""
    return files.where((F.col("type") == C.FILE) & (F.col("size") > 0))


def _key(*columns) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)


def members(rows: DataFrame) -> DataFrame:
    """Rows whose ``group_id`` occurs more than once, with the group's number of files."""
    counts = rows.groupBy("group_id").agg(F.count("*").alias("files"))
    return spread_join(rows, counts.where("files > 1"), F.col("group_id"), "group_id", "inner",
                       counts=counts.select("group_id", "files"))


def by_size(files: DataFrame, keys: tuple[str, ...] = ("size", "datablocks")) -> DataFrame:
    """Files that share their size and block count."""
    return members(candidates(files).withColumn("group_id", _key(*keys)))


def group_report(grouped: DataFrame) -> DataFrame:
    """One row per group, largest waste first."""
    return (grouped.groupBy("group_id").agg(
        F.first("size").alias("size"), F.count("*").alias("files"), F.min("path").alias("example"))
        .withColumn("extra_bytes", F.col("size") * (F.col("files") - 1))
        .orderBy(F.desc("extra_bytes"), "group_id"))


def sample_points(size: Column, points: int | None = None) -> Column:
    """How many samples a file of this size gets."""
    if points is not None:
        if not 3 <= points <= C.SAMPLE_MOST:
            raise ValueError("sample points must be between 3 and 11")
        return F.lit(points)
    (limit, chosen), *rest = C.SAMPLE_STEPS
    steps = F.when(size <= limit, F.lit(chosen))
    for limit, chosen in rest:
        steps = steps.when(size <= limit, F.lit(chosen))
    return steps.otherwise(F.lit(C.SAMPLE_MOST))


def fingerprint(content: Column, size: Column, sample: int = C.SAMPLE_BYTES,
                points: int | None = None) -> Column:
    """Hash of evenly spaced samples, first and last included; small files whole."""
    n = sample_points(size, points)
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.substring(content, (F.floor(i * (size - sample) / (n - 1)) + 1).cast("int"), F.lit(sample)))
    return F.when(size <= n * sample, F.sha2(content, 256)).otherwise(
        F.sha2(F.array_join(pieces, ""), 256))


def sampled(files: DataFrame, sample: int = C.SAMPLE_BYTES, points: int | None = None) -> DataFrame:
    """Files with equal size and equal samples. Advisory: samples are not whole contents.

    Only files that share their size are hashed, if the list of such sizes measures small; beyond that the sizes
    are left to the grouping, as contents are hashed where they are read and never shuffled.  The hashes are
    written once, so that counting and joining them does not read contents again.
    """
    files = candidates(files)
    shared = settle(files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"), "sizes")
    if fits_broadcast(shared):
        files = files.join(F.broadcast(shared), "size", "left_semi")
    printed = files.withColumn("fingerprint", fingerprint(F.col("content"), F.col("size"), sample, points))
    hashes = printed.drop("content").withColumn("group_id", _key("size", "fingerprint"))
    return members(settle(hashes, "fingerprints"))


def sample_ranges(files: DataFrame, sample: int = C.SAMPLE_BYTES, points: int | None = None) -> DataFrame:
    """(path, size, no, offset, bytes): what must be read of files that share their size, and nothing else.

    Small files have one range, the whole; others one for each sample.  Their bytes add up to ``estimate``.
    """
    files = candidates(files)
    shared = files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select(F.col("size").alias("_size"))
    listed = lookup_join(files.select("path", "size"), settle(shared, "sizes"), F.col("size"), "_size", "semi")
    n, size = sample_points(F.col("size"), points), F.col("size")
    several = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("no"), F.floor(i * (size - sample) / (n - 1)).cast("bigint").alias("offset"), F.lit(sample).cast("bigint").alias("bytes")))
    whole = F.array(F.struct(F.lit(0).alias("no"), F.lit(0).cast("bigint").alias("offset"), size.cast("bigint").alias("bytes")))
    ranges = F.when(size <= n * sample, whole).otherwise(several)
    return listed.select("path", "size", F.explode(ranges).alias("r")).select("path", "size", "r.*")


def sampled_ranges(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """``sampled`` from the data of the ranges: rows (path, size, no, part, data), the parts of a range in order.

    A file has a bounded number of samples, which meet in one row.
    """
    binary = pieces.schema["data"].dataType.typeName() == "binary"
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "part", "data"))), lambda p: F.hex(p["data"]) if binary else p["data"])
    joined = F.array_join(parts, "")
    printed = (pieces.groupBy("path", "size").agg(F.sha2(F.unhex(joined) if binary else joined, 256).alias("fingerprint"))
               .select("path", "fingerprint", _key("size", "fingerprint").alias("group_id")))
    # a file has one row on either side
    return members(settle(candidates(files).join(printed, "path"), "fingerprints"))


def estimate(files: DataFrame, sample: int = C.SAMPLE_BYTES, points: int | None = None) -> DataFrame:
    """Bytes that sampling would read; nothing is read."""
    per_size = (candidates(files).groupBy("size").agg(F.count("*").alias("files")).where("files > 1"))
    read = F.least(F.col("size"), sample_points(F.col("size"), points) * F.lit(sample).cast("bigint"))
    return per_size.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
                        F.coalesce(F.sum(F.col("files") * read), F.lit(0)).alias("bytes_to_read"))


def ranked_groups(spark, grouped: DataFrame) -> DataFrame:
    """Dense 1-based group numbers by size (largest first), then id, without one big sort task.

    Groups are range-partitioned and written; a group's number is the number of
    groups in earlier partitions plus its place in its own.  Only one count per
    partition meets in a single task.
    """
    groups = grouped.groupBy("group_id").agg(F.first("size").alias("size"), F.count("*").alias("files"))
    where = folder(spark, "groups")
    mask = (1 << 33) - 1
    (groups.repartitionByRange(F.desc("size"), F.col("group_id"))
     .sortWithinPartitions(F.desc("size"), "group_id")
     .select("*", F.spark_partition_id().alias("part"),
             F.monotonically_increasing_id().bitwiseAND(F.lit(mask)).alias("place"))
     .write.parquet(where))
    stored = spark.read.parquet(where)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (stored.groupBy("part").agg(F.count("*").alias("n"))
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return stored.join(F.broadcast(offsets), "part").select(
        (F.col("offset") + F.col("place") + 1).alias("group_no"), "group_id", "size", "files")
