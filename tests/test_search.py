"""Filters: null rules, thresholds, scope and pruning."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from conftest import DIR, LINK, column, pairs
from pyspark.sql import functions as F

from treecensus.functions import patterns
from treecensus.operators import presets, reports, search as S
from treecensus.operators.hierarchy import directory_aggregates, per_directory
from treecensus.operators.search import Search
from treecensus.options import OptionError

NOW = datetime(2002, 1, 1, 12, 0, 0, 500_000)


def found(frame, **options):
    return column(S.search(frame, Search(**options)))


def test_size_thresholds_and_nulls(make):
    rows = make(("/none", {"size": None}), ("/at", {"size": 1000}), ("/over", {"size": 1001}),
                ("/meta", {"size": 1000, "metablocks": 1}))
    assert found(rows, larger_than="1KB") == ["/over"]
    assert found(rows, larger_than="1KB", include_metadata=True) == ["/meta", "/over"]
    assert found(rows, smaller_than="1001") == ["/at", "/meta"]


def test_age_thresholds_are_strict_on_whole_seconds(make):
    limit = NOW - timedelta(days=10)
    rows = make(("/none", {"modification_time": None}), ("/same", {"modification_time": limit.replace(microsecond=0)}),
                ("/fraction", {"modification_time": limit + timedelta(microseconds=400_000)}),
                ("/later", {"modification_time": limit + timedelta(seconds=1)}),
                ("/earlier", {"modification_time": limit - timedelta(seconds=1)}))
    # the threshold itself has a fraction, the compared times have not
    assert found(rows, as_of=NOW, older_than=10) == ["/earlier", "/fraction", "/same"]
    assert found(rows, as_of=NOW, newer_than=10) == ["/later"]
    whole = NOW.replace(microsecond=0)
    assert found(rows, as_of=whole, older_than=10) == ["/earlier"]
    assert found(rows, as_of=whole, newer_than=10) == ["/later"]
    assert len(found(rows, as_of=NOW, older_than=0)) == 5


def test_inverted_window_is_an_error(make):
    with pytest.raises(OptionError):
        found(make("/a"), as_of=NOW, older_than=10, newer_than=10)


def test_attributes_need_exact_values(make):
    rows = make(("/t", {"extended_attributes": (True, False)}), ("/f", {"extended_attributes": (False, False)}),
                ("/n", {"extended_attributes": (None, None)}), ("/x", {"extended_attributes": None}))
    assert found(rows, attributes_true=["hidden"]) == ["/t"]
    assert found(rows, attributes_false=["hidden"]) == ["/f"]


def test_types_and_names(make):
    rows = make("/d.log/", "/d.log/a.log", ("/d.log/l", {"type": LINK}), "/d.log/b.txt")
    assert found(rows, type="link") == ["/d.log/l"]
    assert found(rows, file_only=True) == ["/d.log/a.log", "/d.log/b.txt", "/d.log/l"]
    # excluding a directory by name does not hide what it holds
    assert found(rows, names_not=["*.log"]) == ["/d.log/b.txt", "/d.log/l"]
    assert found(rows, names=["*.log", "b*"], names_all=["*.*"]) == ["/d.log", "/d.log/a.log", "/d.log/b.txt"]


def test_scope_depth_and_single_object(make):
    rows = make("/a/", "/a/b/", "/a/b/c", "/ab", "/a/x")
    assert found(rows, root="/a/") == ["/a/b", "/a/b/c", "/a/x"]
    assert found(rows, root="/a", max_depth=1) == ["/a/b", "/a/x"]
    assert found(rows, root="/a", max_depth=0) == []
    assert len(found(rows, max_depth=-1)) == 5
    assert found(rows, root="/a/x") == ["/a/x"]


def test_omitting_directories(make):
    rows = make("/r/", "/r/tmp/", "/r/tmp/f", "/r/tmp.txt", "/r/s/", "/r/s/tmp/", "/r/s/tmp/g", "/r/s/h", "/r/TMP/")
    assert found(rows, root="/r", omit_subdirs=["tmp"]) == ["/r/TMP", "/r/s", "/r/s/h", "/r/tmp.txt"]
    assert found(rows, root="/r", omit_subdirs=["/r/*/tmp/"]) == [
        "/r/TMP", "/r/s", "/r/s/h", "/r/tmp", "/r/tmp.txt", "/r/tmp/f"]
    assert found(rows, root="/r", omit_subdirs=["^/r/s$"], omit_mode="regex") == ["/r/TMP", "/r/tmp", "/r/tmp.txt", "/r/tmp/f"]
    # the root itself is exempt, a file is never omitted by path
    assert len(found(rows, root="/r", omit_subdirs=["r"], omit_paths=["/r", "/r/tmp.txt"])) == 8
    assert found(rows, root="/r", omit_paths=["/r/s/"]) == ["/r/TMP", "/r/tmp", "/r/tmp.txt", "/r/tmp/f"]
    gone = make("/r/s/", "/r/tmp/").select("path")
    assert column(S.omit_anti_join(rows, gone)) == ["/r", "/r/TMP", "/r/tmp.txt"]


def test_big_directories(make):
    rows = make("/r/", "/r/a/", "/r/a/1", "/r/a/2", "/r/a/b/", "/r/a/b/3", "/r/c/", "/r/c/4")
    assert column(S.skip_big_directories(rows, 3, "/r", root_exempt=True)) == ["/r/a", "/r/c", "/r/c/4"]
    assert column(S.skip_big_directories(rows, 3, "/r")) == []
    assert len(column(S.skip_big_directories(rows, 100, "/r"))) == 7
    summary = S.skip_summary(S.big_directories(rows, 3, "/r", root_exempt=True)).first()
    assert tuple(summary) == (1, 3, 1)


def test_filter_order_does_not_matter(make):
    rows = make("/a/x.log", ("/a/y.log", {"size": 5000}), ("/b/z.log", {"size": 5000}))
    one = S.search(S.search(rows, Search(larger_than="1KB")), Search(root="/a", names=["*.log"]))
    two = S.search(S.search(rows, Search(root="/a", names=["*.log"])), Search(larger_than="1KB"))
    assert column(one) == column(two) == found(rows, larger_than="1KB", root="/a", names=["*.log"])


def test_totals_agree(make):
    rows = make("/r/", "/r/a/", ("/r/a/1", {"datablocks": 2}), ("/r/a/b/2", {"size": 7}), ("/r/x", {"size": 3}),
                ("/out/y", {"size": 5}), ("/r/a/b", {"type": DIR, "size": 0, "metablocks": 1}))
    total = tuple(reports.match_totals(rows).first())
    for every in (False, True):
        report = {r.path: (r.files, r.capacity, r.depth) for r in per_directory(rows, "/r/", every).collect()}
        assert report["/r"] == (*total, 0)
        assert report["/r/a"] == (3, 8192 + 7 + 4096, 1)
        assert ("/r/a/b" in report) == every
    assert tuple(per_directory(rows.where("false"), "/r").first()) == ("/r", 0, 0, 0)
    assert tuple(reports.match_totals(rows.where("false")).first()) == (0, 0)


def test_empty_directories_have_aggregates(make):
    rows = make("/a/", "/a/e/", "/a/f")
    got = {r.path: (r.total_files, r.total_directories) for r in directory_aggregates(rows).collect()}
    assert got == {"/": (1, 2), "/a": (1, 1), "/a/e": (0, 0)}


def test_unreadable_blocks_count_zero_for_the_owner(make):
    rows = make(("/a", {"datablocks": 1}), ("/b", {"datablocks": 3}), ("/c", {"owner": None, "datablocks": 9}))
    rows = rows.withColumn("bad_blocks", F.col("path") == "/b")
    assert {(r.owner, r.bytes, r.files) for r in reports.owner_report(rows).collect()} == {("o", 4096, 2), (None, 4096, 2)}


def test_filters_reach_the_scan(spark, make, tmp_path):
    where = str(tmp_path / "t")
    make("/a/x", "/b/y").write.parquet(where)
    stored = spark.read.parquet(where)
    opts = Search(as_of=NOW, root="/a", type="file", larger_than="5", older_than=10, owners=["o"])
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = S.search(stored, opts).select("path")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PushedFilters"):]
    for test in ("StringStartsWith(path,/a)", "EqualTo(type,FS_FILE_TYPE_FILE)", "GreaterThan(size,5)",
                 "LessThan(modification_time", "owner"):
        assert test in scan, test
    assert "symlink" not in scan and "ReadSchema: struct<path:string,type:string,size:bigint,owner:string,modification_time:timestamp>" in scan


def test_named_searches_equal_one_search_each(spark, make):
    recent, old = datetime(2025, 12, 30), datetime(2015, 1, 1)
    names = ["core.1", "x.core", "a.LOG", "b.log", "a.log.1", "README", "~x", "v.mov", "cache.tmp", "proxy_small", "q.exe", "d/", "plain"]
    rows = make(*((f"/{when.year}{size}/{n}", {"size": size, "access_time": when, "modification_time": when, "creation_time": when})
                  for n in names for when in (recent, old) for size in (10, 2_000_000_000)))
    own = {"but": Search(names=("*.log", "^core"), names_not=("*README*", "x*"), names_all=("*o*", "*.*")),
           "exact": Search(names=("*.log",), case_sensitive=True), "regex": Search(names=(r"\.(log|tmp)$",)),
           "no_names": Search(type="directory"), "not_only": Search(names_not=("*.*",), type="file")}
    chosen = presets.PRESETS | own
    as_of = "2026-01-01T00:00:00Z"
    found = presets.named_searches(rows, as_of, chosen)
    want = {(r.path, name) for name, opts in chosen.items() for r in S.search(rows, replace(opts, as_of=as_of)).collect()}
    assert pairs(found, "path", "category") == want and {c for _, c in want} >= {"core_dumps", "old_logs", *own}
    plan = presets.named_searches(rows, as_of)._jdf.queryExecution().executedPlan().toString()
    globs = [p for o in presets.PRESETS.values() for p in o.names if not patterns.reads_as_regex(p, o.pattern_mode)]
    assert len(globs) > 30 and plan.count("regexp_replace(") <= 1
