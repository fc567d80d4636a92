"""Streaming forms of the incremental operators.

Stateless filters append; aggregates keep Spark's own aggregation state.  Runs
end when the available input is read, so a scheduled run picks up where the
last one stopped if it is given the same target and checkpoint.  Without them
both are new folders below the shared one.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from treecensus import constants as C
from treecensus.functions import paths
from treecensus.operators.hierarchy import capacity
from treecensus.operators.joins import above
from treecensus.operators.reports import owned_bytes
from treecensus.operators.search import Search, owner_column, predicate
from treecensus.workspace import folder, remove


#: Buckets of a stored state; more for states whose buckets would be large.
BUCKETS = 64
#: Which run holds each bucket.
NOTE = (T.StructType().add("bucket", T.ArrayType(T.IntegerType())).add("run", T.ArrayType(T.LongType()))
        .add("buckets", T.IntegerType()))


def run_append(stream: DataFrame, target: str, checkpoint: str, kind: str = "parquet") -> None:
    """Write rows as they arrive until the available input is used up."""
    query = (stream.writeStream.format(kind).outputMode("append")
             .option("path", target).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
                mode: str = "update") -> None:
    """Hand every batch of results to a function; the way to attach an own sink."""
    query = (stream.writeStream.foreachBatch(each).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _stored(spark: SparkSession, schema: T.StructType, where: str) -> DataFrame:
    """Rows written as ``batch=n`` folders, with their batch; an empty folder -1 keeps the table readable before the first."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{where}/batch=-1")
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(where)


def latest_state(spark: SparkSession, stream: DataFrame, keys: list[str], label: str,
                 target: str | None = None, checkpoint: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Run an update-mode aggregate until the available input is read, and return its rows.

    With the same ``target`` and ``checkpoint`` a later run goes on where this
    one ended; without them the run is on its own.  Each batch is written under
    its number, so a repeated batch replaces itself; the last batch that
    mentions a key holds its result.

    The state lies in buckets by a hash of the key.  A run ends by merging its
    batches into the buckets that they touch, and by a note that says for every
    bucket which run holds it; all other buckets stay as they are.  The note is
    written last, so a run that is lost before it changes nothing.  Batches and
    buckets that neither this note nor the one before refers to are removed
    then; a result that is read later than two runs on has to be kept by its
    reader.  The number of buckets is that of a target's first run.  Without
    any input the result is empty.
    """
    where = target or folder(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batches/batch={number}")

    run_batches(stream, checkpoint or folder(spark, label + "-state"), write)
    values = [c for c in stream.columns if c not in keys]
    newest = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
    return _merged(spark, stream.schema, keys, where, buckets, newest)


def folded_state(spark: SparkSession, stream: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], label: str,
                 merge: Callable[[DataFrame], DataFrame] | None = None, target: str | None = None,
                 checkpoint: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Run an aggregate that can be put together from parts until the available input is read, and return its rows.

    ``step`` aggregates the rows of one batch by ``keys``; ``merge`` puts such parts together, by adding up every
    other column if not given.  Batches are aggregated each on its own, and a run merges them into the stored
    buckets when it ends, as in ``latest_state``.  So there is no aggregation state in Spark, whose tasks all load
    and store it in every batch and report on each other's part of it.  A target of one form is no target of the other.
    """
    where, schema = target or folder(spark, label), step(stream).schema
    values = [c for c in schema.names if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{where}/batches/batch={number}")

    def parts(rows: DataFrame) -> DataFrame:
        found = merge(rows) if merge else rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values))
        return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))

    run_batches(stream, checkpoint or folder(spark, label + "-state"), write, mode="append")
    return _merged(spark, schema, keys, where, buckets, parts)


def _merged(spark: SparkSession, schema: T.StructType, keys: list[str], where: str, buckets: int,
            merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Merge the batches written since the last note into the buckets of their keys, note that, and return all rows."""
    notes = sorted(_stored(spark, NOTE, f"{where}/notes").collect(), key=lambda n: n.batch)  # the last one and the one before
    last = notes[-1] if notes else None
    held = {b: run for b, run in zip(last.bucket, last.run)} if last else {}
    buckets = last.buckets if last else buckets
    rows = _stored(spark, schema, f"{where}/batches").where(F.col("batch") > (last.batch if last else -1))
    newest = rows.agg(F.max("batch")).first()[0]
    if newest is None:
        return _state(spark, schema, where, held)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)
    rows = rows.withColumn("_bucket", bucket)
    touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
    old = _state(spark, schema, where, {b: run for b, run in held.items() if b in set(touched)})
    every = rows.drop("_bucket").unionByName(old.withColumn("batch", F.lit(-1).cast("bigint")))
    found = merge(every).withColumn("_bucket", bucket)
    found.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{where}/state/run={newest}")
    now = held | dict.fromkeys(touched, newest)
    note = [([*now], [*now.values()], buckets)]
    spark.createDataFrame(note, NOTE).write.mode("overwrite").parquet(f"{where}/notes/batch={newest}")
    merged = [r[0] for r in _stored(spark, schema, f"{where}/batches").where(
        F.col("batch").between(0, last.batch if last else -1)).select("batch").distinct().collect()]  # those of one run
    for number in merged:
        remove(spark, f"{where}/batches/batch={number}")
    for note in notes[:-1]:
        for b, run in {*zip(note.bucket, note.run)} - {*held.items(), *now.items()}:
            remove(spark, f"{where}/state/run={run}/_bucket={b}")
        remove(spark, f"{where}/notes/batch={note.batch}")
    return _state(spark, schema, where, now)


def _state(spark: SparkSession, schema: T.StructType, where: str, held: dict[int, int]) -> DataFrame:
    """The rows of buckets, each from the run that holds it."""
    if not held:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("basePath", f"{where}/state")
            .parquet(*(f"{where}/state/run={run}/_bucket={b}" for b, run in held.items())).select(*schema.names))


def filtered(stream: DataFrame, opts: Search) -> DataFrame:
    return stream.where(predicate(stream, opts))


def totals(stream: DataFrame) -> DataFrame:
    return stream.agg(F.count("*").alias("total_files"), F.sum(capacity()).alias("total_capacity"))


def owner_totals(stream: DataFrame) -> DataFrame:
    held = owned_bytes(stream)
    folder_row = F.col("type") == C.DIRECTORY
    return (stream.withColumn("_owner", owner_column(stream)).where("_owner IS NOT NULL")
            .groupBy(F.col("_owner").alias("owner"))
            .agg(F.sum(held).alias("bytes"), F.count_if(~folder_row).alias("files"),
                 F.count_if(folder_row).alias("dirs")))


def directory_totals(stream: DataFrame, root: str = "/") -> DataFrame:
    """Running totals of every directory that contains a match, as one stream; objects are repeated for their ancestors.

    ``home_totals`` and ``rolled_up`` give the same with less state and fewer rows.
    """
    root = paths.root_text(root)
    return (stream.where(paths.below(F.col("path"), root))
            .select(F.explode(paths.ancestors(F.col("path"), root)).alias("path"), capacity().alias("_cap"))
            .groupBy("path").agg(F.count("*").alias("files"), F.sum("_cap").alias("capacity")))


def home_totals(stream: DataFrame, root: str = "/") -> DataFrame:
    """Running totals of the directories that contain matches themselves: the state has a row for each, not for each ancestor."""
    root = paths.root_text(root)
    return (stream.where(paths.below(F.col("path"), root)).groupBy(paths.parent(F.col("path")).alias("home"))
            .agg(F.count("*").alias("files"), F.sum(capacity()).alias("capacity")))


def rolled_up(homes: DataFrame, root: str = "/") -> DataFrame:
    """Totals of every directory from those of ``home_totals``: their sums are repeated for the ancestors, objects are not."""
    chain = paths.ancestors_or_self(F.col("home"), paths.root_text(root))
    return (homes.select(F.explode(chain).alias("path"), "files", "capacity")
            .groupBy("path").agg(F.sum("files").alias("files"), F.sum("capacity").alias("capacity")))


def latest_change(changes: DataFrame) -> DataFrame:
    """The change in force per path: the highest sequence number wins, late ones are ignored."""
    return changes.groupBy("path").agg(
        F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("ts", "seq").alias("ts"))


def without_deleted(state: DataFrame) -> DataFrame:
    """Objects that exist, after directory deletions (paths ending in ``/``) took their descendants.

    A descendant survives a directory's deletion only if it changed later.  The
    newest deletion above a row decides, found through its ancestors.
    """
    gone = state.where("op = 'DELETE' AND path LIKE '%/'").select(
        paths.clean(F.col("path")).alias("_dir"), F.col("seq").alias("_gone"))
    alive = above(state.where("op <> 'DELETE'"), gone, "_dir", F.max("_gone"), "_last")
    return alive.where("_last IS NULL OR seq > _last").drop("_last")


def limited(spark: SparkSession, stream: DataFrame, n: int, order: str = "path",
            target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The first n rows over all batches; the stream is stopped once they are written.

    With the same ``target`` and ``checkpoint`` a later run goes on where this
    one ended, and reads nothing if the rows are all there.  Rows of earlier
    runs are counted once, then each batch is counted as it is written.
    """
    where = target or folder(spark, "limit")
    done: dict[int, int] = {}
    full = threading.Event()

    def write(batch: DataFrame, number: int) -> None:
        if full.is_set():
            return
        if not done:
            done[-1] = _stored(spark, stream.schema, where).where(F.col("batch") < number).count()
        here = f"{where}/batch={number}"
        left = n - sum(done[k] for k in done if k < number)
        batch.orderBy(order).limit(max(left, 0)).write.mode("overwrite").parquet(here)
        done[number] = spark.read.schema(stream.schema).parquet(here).count()
        if sum(done.values()) >= n:
            full.set()

    if _stored(spark, stream.schema, where).count() < n:
        query = (stream.writeStream.foreachBatch(write).outputMode("append")
                 .option("checkpointLocation", checkpoint or folder(spark, "limit-state"))
                 .trigger(availableNow=True).start())
        while not query.awaitTermination(1):
            if full.is_set():
                query.stop()
    return _stored(spark, stream.schema, where).drop("batch")


def growth(stream: DataFrame, days: int = 30, late: str = "30 days", time: str = "creation_time") -> DataFrame:
    """Objects and bytes created per window; rows later than the watermark are dropped by Spark."""
    return (stream.withWatermark(time, late).groupBy(F.window(time, f"{days} days").alias("_w"))
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
            .select(F.unix_seconds("_w.start").alias("window_start"), "files", "bytes"))


class Growth(NamedTuple):
    """Windows with their sums and whether they are closed; the rows that came after their window was closed, if they are kept."""
    windows: DataFrame
    late: DataFrame | None


#: Sums of one batch; ``seen`` is the latest moment among the rows, in microseconds.
SUMS = (T.StructType().add("window_start", T.LongType()).add("is_late", T.BooleanType()).add("files", T.LongType())
        .add("bytes", T.LongType()).add("seen", T.LongType()))


def growth_with_late(spark: SparkSession, stream: DataFrame, days: int = 30, late: float = 30, time: str = "creation_time",
                     target: str | None = None, checkpoint: str | None = None, keep: bool = True) -> Growth:
    """Objects and bytes per window as in ``growth``, with the rows that Spark would drop as a table of their own.

    Without ``keep`` there is no such table, and only the sums of late rows are written, beside those of the windows.

    The watermark of a batch is the latest moment of all batches before it,
    less ``late`` days.  A window is closed once its end is not after the
    watermark; its sums never change again, and a row that comes for it later
    goes to the side table.  So do rows without a time.  The watermark follows
    from the stored sums of earlier batches alone, so a batch that is repeated
    after a loss is split as it was.  With the same ``target`` and
    ``checkpoint`` a later run goes on where this one ended.
    """
    where, span = target or folder(spark, "growth"), days * 86400
    start = (F.floor(F.unix_seconds(time) / span) * span).cast("bigint")
    schema = stream.schema

    def closes_at(before: int | None) -> int | None:
        """Seconds up to which windows are closed by the batches before one, or by all."""
        sums = _stored(spark, SUMS, f"{where}/sums")
        seen = (sums if before is None else sums.where(F.col("batch") < before)).agg(F.max("seen")).first()[0]
        return None if seen is None else math.floor(seen / 1e6 - late * 86400)

    def write(batch: DataFrame, number: int) -> None:
        closed = F.coalesce(start + span <= F.lit(closes_at(number)).cast("bigint"), F.lit(False)) | F.col(time).isNull()
        if keep:
            batch.persist(StorageLevel.DISK_ONLY)  # its input is read once for both tables
        try:
            (batch.groupBy(start.alias("window_start"), closed.alias("is_late"))
             .agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"), F.max(F.unix_micros(time)).alias("seen"))
             .write.mode("overwrite").parquet(f"{where}/sums/batch={number}"))
            # written even if it has no rows, so that a repeated batch replaces what it left
            if keep:
                batch.where(closed).write.mode("overwrite").parquet(f"{where}/late/batch={number}")
        finally:
            if keep:
                batch.unpersist()

    run_batches(stream, checkpoint or folder(spark, "growth-state"), write, mode="append")
    end = F.lit(closes_at(None)).cast("bigint")
    windows = (_stored(spark, SUMS, f"{where}/sums").where("NOT is_late").groupBy("window_start")
               .agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
               .withColumn("closed", F.coalesce(F.col("window_start") + span <= end, F.lit(False))))
    return Growth(windows, _stored(spark, schema, f"{where}/late").drop("batch") if keep else None)
