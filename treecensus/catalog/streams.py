"""Queries that run as streams until their input is used up; results equal the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus import workspace
from treecensus.catalog.data import AS_OF, Data
from treecensus.catalog.exchange import raw_pages
from treecensus.catalog.registry import query
from treecensus.catalog.summaries import _HELD, _PER_TOP
from treecensus.operators.search import Search
from treecensus.sources import tables
from treecensus.streaming import jobs

PAGES = 48


def _pages(d: Data) -> DataFrame:
    return tables.stream_inventory(d.spark, raw_pages(d), PAGES)


def _appended(d: Data, stream: DataFrame) -> DataFrame:
    target = workspace.folder(d.spark, "stream")
    jobs.run_append(stream, target, workspace.folder(d.spark, "stream-state"))
    return d.spark.read.schema(stream.schema).parquet(target)


@query("stream_inventory", "SELECT path, type, size FROM fx_entries")
def stream_inventory(d: Data) -> DataFrame:
    return _appended(d, _pages(d).select("path", "type", "size"))


@query("sink_stream", "SELECT path, owner FROM fx_entries")
def sink_stream(d: Data) -> DataFrame:
    target = workspace.folder(d.spark, "stream")
    jobs.run_append(_pages(d).select("path", "owner"), target, workspace.folder(d.spark, "stream-state"), "json")
    return d.spark.read.schema("path string, owner string").json(target)


@query("stream_filter", r"""
SELECT path, size FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE' AND size > 10000000
  AND modification_time < TIMESTAMP '2002-01-01' - INTERVAL 700 DAY AND regexp_matches(name, '\.(pdf|py)$')""")
def stream_filter(d: Data) -> DataFrame:
    opts = Search(as_of=AS_OF, type="file", larger_than="10MB", older_than=700, names=("*.pdf", "*.py"))
    return _appended(d, jobs.filtered(_pages(d), opts).select("path", "size"))


@query("stream_totals", "SELECT count(*) AS total_files, CAST(sum(capacity) AS BIGINT) AS total_capacity FROM fx_entries")
def stream_totals(d: Data) -> DataFrame:
    return jobs.folded_state(d.spark, _pages(d), jobs.totals, [], "totals")


@query("stream_owner_report", f"""
SELECT owner, CAST(sum(held) AS BIGINT) AS bytes, count(*) FILTER (type <> 'FS_FILE_TYPE_DIRECTORY') AS files,
  count(*) FILTER (type = 'FS_FILE_TYPE_DIRECTORY') AS dirs FROM {_HELD} GROUP BY owner""")
def stream_owner_report(d: Data) -> DataFrame:
    return jobs.folded_state(d.spark, _pages(d), jobs.owner_totals, ["owner"], "owners")


@query("stream_dir_matches", """
SELECT path, count(*) AS files, CAST(sum(capacity) AS BIGINT) AS capacity FROM fx_up WHERE type = 'FS_FILE_TYPE_FILE' GROUP BY path""")
def stream_dir_matches(d: Data) -> DataFrame:
    found = jobs.filtered(_pages(d), Search(type="file"))
    return jobs.rolled_up(jobs.folded_state(d.spark, found, jobs.home_totals, ["home"], "directories"))


def _feed(d: Data) -> DataFrame:
    """The change feed as a stream: one file per day, in no particular order inside a day."""
    where = workspace.folder(d.spark, "feed")
    d.change_feed.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(where)
    return (d.spark.readStream.schema("seq bigint, ts timestamp, op string, path string, day date")
            .option("maxFilesPerTrigger", 12).parquet(where).drop("day"))


@query("stream_apply_changes", """
SELECT path, seq, op, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS place FROM fx_changes) WHERE place = 1 AND op <> 'DELETE'""")
def stream_apply_changes(d: Data) -> DataFrame:
    state = jobs.folded_state(d.spark, _feed(d), jobs.latest_change, ["path"], "changes", jobs.latest_change)
    return jobs.without_deleted(state).withColumn("ts", F.unix_seconds("ts"))


@query("stream_apply_directory_deletes", """
WITH c AS (SELECT seq, op, path FROM fx_changes WHERE op <> 'DELETE'
  UNION ALL SELECT seq, op, regexp_replace(path, '[^/]*$', '') FROM fx_changes WHERE op = 'DELETE'),
s AS (SELECT path, max(seq) AS seq, arg_max(op, seq) AS op FROM c GROUP BY path)
SELECT path, seq FROM s WHERE op <> 'DELETE' AND NOT EXISTS (
  SELECT 1 FROM s g WHERE g.op = 'DELETE' AND starts_with(s.path, g.path) AND g.seq >= s.seq)""")
def stream_apply_directory_deletes(d: Data) -> DataFrame:
    # an error deletes the whole directory of its user
    whole = F.when(F.col("op") == "DELETE", F.regexp_replace("path", "[^/]*$", "")).otherwise(F.col("path"))
    state = jobs.folded_state(d.spark, _feed(d).withColumn("path", whole), jobs.latest_change, ["path"], "changes", jobs.latest_change)
    return jobs.without_deleted(state).select("path", "seq")


@query("stream_limit", """
SELECT least(500, count(*)) AS written, least(500, count(*)) AS known FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE'""")
def stream_limit(d: Data) -> DataFrame:
    # which rows a limit keeps is arbitrary: their number is compared, and that they are rows of the inventory
    found = jobs.filtered(_pages(d), Search(type="file")).select("path", "size")
    kept = jobs.limited(d.spark, found, 500)
    same = kept.join(d.files.select("path", F.col("size").alias("_size")), "path", "left")
    return same.agg(F.count("*").alias("written"), F.count_if(F.col("size") == F.col("_size")).alias("known"))


@query("stream_growth", """
SELECT CAST(floor(epoch(creation_time) / 2592000) AS BIGINT) * 2592000 AS window_start, count(*) AS files,
  CAST(sum(size) AS BIGINT) AS bytes FROM fx_files GROUP BY 1""")
def stream_growth(d: Data) -> DataFrame:
    # pages are in path order, so the watermark must cover the whole span of creation times
    files = jobs.filtered(_pages(d), Search(file_only=True)).select("creation_time", "size")
    return jobs.growth_with_late(d.spark, files, late=4000, keep=False).windows.select("window_start", "files", "bytes")


@query("stream_growth_late", """
SELECT CAST(floor(epoch(creation_time) / 2592000) AS BIGINT) * 2592000 AS window_start, count(*) AS files,
  CAST(sum(size) AS BIGINT) AS bytes FROM fx_files GROUP BY 1""")
def stream_growth_late(d: Data) -> DataFrame:
    # what is late depends on the order of the pages; windows and late rows together are all rows
    files = jobs.filtered(_pages(d), Search(file_only=True)).select("path", "creation_time", "size")
    found = jobs.growth_with_late(d.spark, files, late=60)
    late = found.late.select((F.floor(F.unix_seconds("creation_time") / 2592000) * 2592000).cast("bigint").alias("window_start"),
                             F.lit(1).cast("bigint").alias("files"), "size")
    rows = found.windows.select("window_start", "files", "bytes").unionByName(late.withColumnRenamed("size", "bytes"))
    return rows.groupBy("window_start").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@query("custom_sink", _PER_TOP.format(rows="fx_files"))
def custom_sink(d: Data) -> DataFrame:
    # the caller's own sink: a function that gets every batch
    from treecensus.operators.hierarchy import per_directory

    where = workspace.folder(d.spark, "custom")

    def each(batch: DataFrame, number: int) -> None:
        per_directory(batch).write.mode("overwrite").parquet(f"{where}/batch={number}")

    found = jobs.filtered(_pages(d), Search(file_only=True))
    jobs.run_batches(found, workspace.folder(d.spark, "custom-state"), each, mode="append")
    return (d.spark.read.parquet(where).groupBy("path", "depth")
            .agg(F.sum("files").alias("files"), F.sum("capacity").alias("capacity")))
