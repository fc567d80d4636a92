"""Snapshots: differences, their expansion, and rebuilding."""

import random

import pytest
from conftest import column, pairs
from pyspark.sql import functions as F

from treecensus.operators import joins, snapshots as S

ROWS = "path string, type string, size bigint"
DIMENSION = "id int, ts timestamp, name string, source string, in_deletion boolean"


def tree(spark, files):
    """Files (path -> size) and their directories."""
    dirs = {"/".join(p.split("/")[:i]) for p in files for i in range(2, p.count("/") + 1)}
    rows = [(p, "FS_FILE_TYPE_FILE", s) for p, s in files.items() if not p.endswith("/")]
    rows += [(d.rstrip("/"), "FS_FILE_TYPE_DIRECTORY", 0) for d in dirs | {p for p in files if p.endswith("/")}]
    return spark.createDataFrame(sorted(set(rows)), ROWS)


def test_diff_collapses_directories(spark):
    old = tree(spark, {"/a/x": 1, "/a/gone/y": 1, "/a/gone/deep/z": 1, "/same/s": 1, "/t/was": 1})
    new = tree(spark, {"/a/x": 2, "/a/new/n": 1, "/a/new/in/m": 1, "/same/s": 1, "/t/was/dir": 1, "/a/empty/": 0})
    diff = S.tree_diff(old, new)
    assert pairs(diff, "op", "path") == {
        ("MODIFY", "/a/x"), ("DELETE", "/a/gone/"), ("CREATE", "/a/new/"), ("CREATE", "/a/empty/"),
        ("DELETE", "/t/was"), ("CREATE", "/t/was/")}
    whole = S.tree_diff(old, new, collapse=False)
    assert pairs(S.expand_diff(diff, old, new), "op", "path") == pairs(whole, "op", "path")
    assert S.tree_diff(old, old).count() == 0


def test_incremental_equals_searching_every_snapshot(spark):
    rng = random.Random(7)
    state, snaps = {}, []
    for number in range(1, 6):
        for _ in range(40):
            path = f"/r/d{rng.randrange(4)}/f{rng.randrange(12)}"
            if rng.random() < 0.3:
                state.pop(path, None)
            else:
                state[path] = rng.randrange(100)
        snaps.append((number, dict(state)))
    frames = {n: spark.createDataFrame([(p, "FS_FILE_TYPE_FILE", s) for p, s in f.items()], ROWS) for n, f in snaps}
    changes, fresh = None, None
    for older, newer in zip(range(1, 5), range(2, 6)):
        diff = S.tree_diff(frames[older], frames[newer]).withColumn("seq", F.lit(newer))
        rows = frames[newer].join(diff.where("op <> 'DELETE'").select("path", "seq"), "path")
        changes = diff if changes is None else changes.unionByName(diff)
        fresh = rows if fresh is None else fresh.unionByName(rows)
    moments = spark.createDataFrame([(n,) for n in range(1, 6)], "seq int")
    got = S.incremental_search(frames[1].withColumn("seq", F.lit(1)), changes, fresh, moments, F.col("size") > 30)
    assert pairs(got, "seq", "path", "size") == {(n, p, s) for n, f in snaps for p, s in f.items() if s > 30}


def test_eligible_snapshots(spark):
    from datetime import datetime

    rows = [(1, datetime(2001, 12, 1), "a", "/", False), (2, datetime(2001, 12, 31), "b", "/home", False),
            (3, datetime(2001, 12, 31, 18), "replication_to_x", "/", False), (4, datetime(2001, 12, 31), "d", "/", True),
            (5, datetime(2001, 12, 31, 23), "e", "/home/joe/", False)]
    table = spark.createDataFrame(rows, DIMENSION)

    def ids(**options):
        return column(S.eligible(table, **options), "id")

    assert ids() == [1, 2, 5]
    assert ids(include_replication=True) == [1, 2, 3, 5]
    assert ids(path="/home/joe") == [1, 2, 5] and ids(path="/home/joel") == [1, 2] and ids(path="/") == [1]
    now = "2002-01-01T00:00:00"
    assert ids(newer_than="2h", as_of=now) == [5] and ids(older_than="7", as_of=now) == [1]
    assert ids(older_than="7d", newer_than="2d", as_of=now) == []
    assert [r.id for r in S.recent(S.eligible(table), 2).orderBy("rank").collect()] == [5, 2]


def test_latest_per_path_falls_back_to_older_snapshots(spark):
    from datetime import datetime

    rows = [("/a", 1, datetime(2001, 1, 1), 10), ("/a", 2, datetime(2001, 2, 1), 20), ("/b", 1, datetime(2001, 1, 1), 30)]
    found = spark.createDataFrame(rows, "path string, snapshot_id int, snapshot_time timestamp, size bigint")
    assert pairs(S.latest_per_path(found), "path", "size") == {("/a", 20), ("/b", 30)}


@pytest.mark.parametrize("most", [500_000, 1])
def test_coverage_in_place_and_per_directory(spark, monkeypatch, most):
    for module in (joins, S):
        monkeypatch.setattr(module, "fits_broadcast", lambda table: most > 1)
    objects = ["/a", "/a/b", "/a/b/f", "/a/bc", "/a/bc/g", "/x/y/z", "/top", None]
    rows = spark.createDataFrame([(p,) for p in objects], "path string")
    taken = [("/", 1), ("/a", 2), ("/a/", 3), ("/a/b", 4), ("/a/b/f", 5), ("/x/y/z/deeper", 6), ("/a/b", 4), (None, 7), ("/to", 8)]
    found = S.coverage(rows, spark.createDataFrame(taken, "source string, id long"))
    want = sorted((p, i) for p in objects if p for s, i in taken if s and (
        s == "/" or p == s.rstrip("/") or p.startswith(s.rstrip("/") + "/")))
    assert sorted(map(tuple, found.collect())) == want
    assert S.coverage(rows, spark.createDataFrame([], "source string, id long")).count() == 0
    assert S.coverage(rows.limit(0), spark.createDataFrame(taken, "source string, id long")).count() == 0
