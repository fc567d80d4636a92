"""Queries over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus import constants as C, workspace
from treecensus.catalog.data import AS_OF, DAILY, Data
from treecensus.catalog.registry import query
from treecensus.functions import patterns, paths
from treecensus.operators import changelog, snapshots as S
from treecensus.operators.search import Search
from treecensus.sources import tables
from treecensus.sources.tables import scan_snapshot


def _sized(d: Data, rows: DataFrame) -> DataFrame:
    """Snapshots with the number and bytes of the files they hold."""
    held = d.snap_files.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rows.join(held, rows.id == held.snapshot_id).select(
        "id", "name", "source", F.unix_seconds("ts").alias("ts"), "files", "bytes")


_SIZED = """
SELECT s.id, s.name, s.source, CAST(epoch(s.ts) AS BIGINT) AS ts, count(*) AS files, CAST(sum(f.size) AS BIGINT) AS bytes
FROM fx_snapshots s JOIN fx_snap f ON f.snapshot_id = s.id WHERE {test} GROUP BY ALL"""


@query("scan_snapshots", _SIZED.format(test="true"))
def scan_snapshots(d: Data) -> DataFrame:
    where = d.stored_at("snapshot-list", lambda where: d.snapshots.write.parquet(where))
    return _sized(d, tables.scan_snapshots(d.spark, where))


@query("list_snapshots", _SIZED.format(test="s.name NOT LIKE 'replication_%'"))
def list_snapshots(d: Data) -> DataFrame:
    return _sized(d, S.eligible(d.snapshots)).orderBy(F.desc("ts"))


@query("snapshot_age_window", _SIZED.format(test="s.ts > TIMESTAMP '2002-01-01' - INTERVAL 1500 DAY "
                                                 "AND s.ts < TIMESTAMP '2002-01-01' - INTERVAL 240 HOUR"))
def snapshot_age_window(d: Data) -> DataFrame:
    return _sized(d, S.eligible(d.snapshots, True, newer_than="1500", older_than="240h", as_of=AS_OF))


@query("recent_snapshots", """
SELECT id, CAST(rank AS INTEGER) AS rank, files FROM (SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS rank FROM fx_snapshots
  WHERE name NOT LIKE 'replication_%') JOIN (SELECT snapshot_id AS id, count(*) AS files FROM fx_snap GROUP BY 1) USING (id)
WHERE rank <= 3""")
def recent_snapshots(d: Data) -> DataFrame:
    held = d.snap_files.groupBy(F.col("snapshot_id").alias("id")).agg(F.count("*").alias("files"))
    return S.recent(S.eligible(d.snapshots), 3).join(held, "id").select("id", "rank", "files")


@query("snapshot_coverage", """
SELECT f.path, s.id AS snapshot_id FROM fx_files f JOIN fx_snapshots s
  ON s.source = '/' OR starts_with(f.path, s.source || '/')""")
def snapshot_coverage(d: Data) -> DataFrame:
    return S.coverage(d.files.select("path"), d.snapshots)


@query("scan_snapshot", """
SELECT path, type, size FROM fx_snap WHERE snapshot_id = 4
UNION ALL SELECT path, 'FS_FILE_TYPE_DIRECTORY', 0 FROM fx_snap_dirs WHERE snapshot_id = 4""")
def scan_snapshot_query(d: Data) -> DataFrame:
    return scan_snapshot(d.snap_entries, 4).select("path", "type", "size")


@query("search_all_snapshots", r"""
SELECT snapshot_id, path, size FROM fx_snap WHERE snapshot_id IN (1, 2, 4, 0)
  AND size > 20000000 AND regexp_matches(path, '\.pdf$')""")
def search_all_snapshots(d: Data) -> DataFrame:
    chosen = S.eligible(d.snapshots, path="/")
    test = (F.col("size") > 20_000_000) & patterns.match_name(paths.basename(F.col("path")), "*.pdf")
    return S.search_all(d.snap_entries, chosen, test).select("snapshot_id", "path", "size")


@query("latest_per_path", """
SELECT path, snapshot_id, size FROM (SELECT path, snapshot_id, size,
  row_number() OVER (PARTITION BY path ORDER BY ts DESC, snapshot_id DESC) AS place
  FROM fx_snap WHERE snapshot_id IN (1, 2, 3, 4) AND size > 10000000) WHERE place = 1""")
def latest_per_path(d: Data) -> DataFrame:
    chosen = S.recent(S.eligible(d.snapshots.where("id > 0"), include_replication=True, path="/"), 4)
    found = S.search_all(d.snap_entries, chosen, F.col("size") > 10_000_000)
    return S.latest_per_path(found).select("path", "snapshot_id", "size")


@query("tree_diff", "SELECT op, path FROM fx_diff_collapsed")
def tree_diff(d: Data) -> DataFrame:
    return S.tree_diff(d.snapshot(2), d.snapshot(4))


@query("expand_diff", "SELECT op, path || CASE WHEN dir THEN '/' ELSE '' END AS path FROM fx_diff")
def expand_diff(d: Data) -> DataFrame:
    older, newer = d.snapshot(2), d.snapshot(4)
    changes = workspace.settle(S.tree_diff(older, newer), "diff")
    return S.expand_diff(changes, older, newer)


@query("changed_only", """
SELECT op, path || CASE WHEN dir THEN '/' ELSE '' END AS path FROM fx_diff WHERE op <> 'MODIFY'""")
def changed_only(d: Data) -> DataFrame:
    return S.tree_diff(d.snapshot(2), d.snapshot(4), collapse=False).where("op <> 'MODIFY'")


@query("incremental_search", r"""
SELECT snapshot_id AS seq, path, size FROM fx_snap WHERE snapshot_id IN (1, 2, 4) AND size > 15000000
  AND regexp_matches(path, '\.(docx|log)$')""")
def incremental_search(d: Data) -> DataFrame:
    base, log = d.daily
    found = changelog.search(base, log, DAILY[0], DAILY, Search(
        file_only=True, names=["*.docx", "*.log"], larger_than=15_000_000, case_sensitive=True))
    return found.select("seq", "path", "size")


@query("asof_version", """
SELECT path, snapshot_id AS seq, size FROM fx_snap WHERE snapshot_id IN (2, 4)""")
def asof_version(d: Data) -> DataFrame:
    base, log = d.daily
    return changelog.find(base, log, DAILY[0], (2, 4), F.col("type") != C.DIRECTORY).select("path", "seq", "size")
