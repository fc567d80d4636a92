"""Snapshots are written without a sort, whose memory would grow with a task's rows."""

from conftest import pairs

from treecensus.catalog.data import SNAPSHOTS, Data
from treecensus.workspace import folder


def test_files_of_snapshots_are_neither_repeated_nor_sorted(spark, monkeypatch):
    d = Data(spark, "/root/testdata/sf0.001")
    where = folder(spark, "snapshots")
    plans = []
    kept = d.files_k.__class__.sortWithinPartitions
    monkeypatch.setattr(d.files_k.__class__, "sortWithinPartitions", lambda self, *a: plans.append(self) or kept(self, *a))
    d._write_snapshots(where)
    assert all(p.where("type <> 'FS_FILE_TYPE_DIRECTORY'").count() == 0 for p in plans)  # only directories are sorted
    rows = spark.read.parquet(where)
    assert {r.snapshot_id for r in rows.select("snapshot_id").distinct().collect()} == {s[0] for s in SNAPSHOTS}
    ts = "timestamp'1998-07-01'"
    want = d.files_k.where(f"creation_time <= {ts} AND (k % 6 <> 0 OR {ts} < date_add(cast(modification_time AS date), 200))")
    found = rows.where("snapshot_id = 2 AND type <> 'FS_FILE_TYPE_DIRECTORY'")
    assert pairs(found, "path") == pairs(want, "path") and found.count() == want.count()
    size = f"size + IF(modification_time <= {ts}, 4096, 0)"
    assert pairs(found, "path", "size") == pairs(want.selectExpr("path", f"{size} AS size"), "path", "size")
