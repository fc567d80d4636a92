"""Streams end with the result of the batch form."""

import json
from datetime import datetime, timedelta

from conftest import ENTRY, column, pairs
from pyspark.sql import functions as F

from treecensus import workspace
from treecensus.operators.hierarchy import per_directory
from treecensus.operators.search import Search
from treecensus.streaming import jobs

FEED = "seq bigint, op string, path string, ts timestamp"


def feed(spark, tmp_path, batches):
    import os
    import time

    for i, rows in enumerate(batches):
        where = tmp_path / f"{i}.json"
        where.write_text("\n".join(json.dumps({"seq": s, "op": o, "path": p, "ts": "2001-01-01T00:00:00Z"}) for s, o, p in rows))
        os.utime(where, (time.time() - 100 + i,) * 2)
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(str(tmp_path))


def test_changes_fold_in_any_order(spark, tmp_path):
    stream = feed(spark, tmp_path, [
        [(1, "CREATE", "/d/a"), (2, "CREATE", "/d/b"), (3, "CREATE", "/e"), (9, "MODIFY", "/late")],
        [(5, "DELETE", "/d/"), (4, "MODIFY", "/d/a"), (7, "MODIFY", "/late")],
        [(6, "CREATE", "/d/c"), (8, "DELETE", "/e")]])
    state = jobs.latest_state(spark, jobs.latest_change(stream), ["path"], "t")
    assert ("/late", 9) in pairs(state, "path", "seq")
    # /d/c came after its directory was deleted
    assert column(jobs.without_deleted(state)) == ["/d/c", "/late"]


def test_totals_filter_and_limit(spark, make, tmp_path):
    rows = make(*[f"/r/d{i % 3}/f{i}" for i in range(20)], "/r/x/")
    where = str(tmp_path / "in")
    rows.repartition(5).write.parquet(where)

    def stream():
        return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(where)

    totals = jobs.latest_state(spark, jobs.totals(stream()), [], "t").first()
    assert (totals.total_files, totals.total_capacity) == (21, 210)
    owners = jobs.latest_state(spark, jobs.owner_totals(stream()), ["owner"], "t").first()
    assert (owners.owner, owners.files, owners.dirs) == ("o", 20, 1)
    found = jobs.filtered(stream(), Search(type="file"))
    per = jobs.latest_state(spark, jobs.directory_totals(found, "/r"), ["path"], "t")
    batch = per_directory(rows.where("type = 'FS_FILE_TYPE_FILE'"), "/r", every_level=True).where("depth > 0")
    assert pairs(per, "path", "files", "capacity") == pairs(batch, "path", "files", "capacity")
    homes = jobs.latest_state(spark, jobs.home_totals(found, "/r"), ["home"], "t")
    assert homes.count() == 3  # a row for each directory with matches of its own
    assert pairs(jobs.rolled_up(homes, "/r"), "path", "files", "capacity") == pairs(batch, "path", "files", "capacity")
    some = jobs.limited(spark, found.select("path"), 7)
    assert some.count() == 7 and set(column(some)) <= set(column(rows))
    assert jobs.limited(spark, found.select("path"), 100).count() == 20
    growth = jobs.latest_state(spark, jobs.growth(found), ["window_start"], "t").first()
    assert growth.files == 20


def test_a_stopped_run_goes_on_where_it_ended(spark, make, tmp_path):
    where, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    make("/a").write.parquet(where)
    for extra in ("/b", None):
        stream = spark.readStream.schema(ENTRY).parquet(where).select("path")
        jobs.run_append(stream, out, mark)
        if extra:
            make(extra).write.mode("append").parquet(where)
    assert column(spark.read.parquet(out)) == ["/a", "/b"]


def test_aggregates_and_limits_go_on_where_they_ended(spark, make, tmp_path):
    where, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    make().write.parquet(where)

    def totals():
        stream = spark.readStream.schema(ENTRY).parquet(where)
        return jobs.latest_state(spark, jobs.owner_totals(stream), ["owner"], "t", out, mark)

    def some():
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(where).select("path")
        return jobs.limited(spark, stream, 5, "path", out + "-limit", mark + "-limit")

    assert totals().count() == 0 and some().count() == 0
    for files, seen in (("abc", 3), ("", 3), ("defg", 7), ("h", 8)):
        if files:
            make(*[f"/{f}" for f in files]).write.mode("append").parquet(where)
        assert pairs(totals(), "owner", "files") == {("o", seen)}
        assert some().count() == min(seen, 5)
    assert set("/" + c for c in "abc") <= set(column(some()))


def test_a_run_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    where, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    want, seq = {}, 0

    def run(changes):
        nonlocal seq
        rows = []
        for path in changes:
            seq += 1
            want[path] = seq
            rows.append((seq, "MODIFY", path))
        (tmp_path / "in" / f"s{seq}.json").write_text("\n".join(
            json.dumps({"seq": s, "op": o, "path": p, "ts": "2001-01-01T00:00:00Z"}) for s, o, p in rows))
        stream = spark.readStream.schema(FEED).json(where)
        found = jobs.latest_state(spark, jobs.latest_change(stream), ["path"], "t", out, mark)
        assert pairs(found, "path", "seq") == set(want.items())
        return found

    def held():
        notes = spark.read.schema("bucket array<int>, run array<bigint>, batch int").parquet(out + "/notes").collect()
        last = max((n for n in notes if n.bucket), key=lambda n: n.batch)
        return dict(zip(last.bucket, last.run)), len(notes)

    run([f"/d/{i}" for i in range(600)])
    first, _ = held()
    assert len(first) == jobs.BUCKETS and len(set(first.values())) == 1
    second_result = run([f"/d/{i}" for i in range(595, 605)])  # half of them new
    second, _ = held()
    touched = {b for b in second if second[b] != first[b]}
    assert 0 < len(touched) <= 10
    assert second_result.count() == 605
    run(["/d/1"])
    third, notes = held()
    assert len({b for b in third if third[b] != second[b]}) == 1 and notes == 2
    # what only the first note referred to is gone, what is still held is not
    kept = {(int(p.parent.name[4:]), int(p.name[8:])) for p in (tmp_path / "out" / "state").glob("run=*/_bucket=*")}
    assert kept == {(r, b) for b, r in second.items()} | {(r, b) for b, r in third.items()}
    assert second_result.count() == 605  # the result of the run before can still be read
    assert run([]).count() == 605


def test_the_shared_folder_is_the_sessions(spark):
    base = workspace.base(spark)
    assert workspace.folder(spark, "x").startswith(base + "/treecensus/x-") and base == workspace.base(spark)


def test_rows_after_their_window_closed_are_kept_aside(spark, make, tmp_path):
    where, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    day = lambda n: datetime(1970, 1, 1) + timedelta(days=n)
    # windows of 10 days, and 5 days' grace; each list is one batch
    batches = [[("/a", 1), ("/b", 12)], [("/c", 9), ("/d", 26)], [("/e", 3), ("/f", 14), ("/g", 27)], [("/h", 19), ("/i", None), ("/j", 20)]]
    want, late, seen = {}, set(), None
    for n, batch in enumerate(batches):
        rows = make(*((p, {"creation_time": None if at is None else day(at), "size": n + 1}) for p, at in batch))
        rows.coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(ENTRY).parquet(where)
        found = jobs.growth_with_late(spark, stream, days=10, late=5, target=out, checkpoint=mark)
        for p, at in batch:
            begin = None if at is None else at // 10 * 10
            if at is None or (seen is not None and begin + 10 <= seen - 5):
                late.add(p)
            else:
                files, size = want.get(begin, (0, 0))
                want[begin] = (files + 1, size + n + 1)
        seen = max([seen or 0, *(at for _, at in batch if at is not None)])
        got = {r.window_start // 86400: (r.files, r.bytes) for r in found.windows.collect()}
        assert got == want and set(column(found.late)) == late
        closed = {r.window_start // 86400 for r in found.windows.where("closed").collect()}
        assert closed == {b for b in want if b + 10 <= seen - 5}
    assert late == {"/e", "/f", "/h", "/i"} and closed == {0, 10}
    again = jobs.growth_with_late(spark, spark.readStream.schema(ENTRY).parquet(where), days=10, late=5, target=out, checkpoint=mark)
    assert {r.window_start // 86400: (r.files, r.bytes) for r in again.windows.collect()} == want


def test_a_batch_is_read_once_for_windows_and_late_rows(spark, make, tmp_path):
    where = str(tmp_path / "in")
    for day in (40, 1):  # the second batch is late
        rows = make(*((f"/{day}/{i}", {"creation_time": datetime(1970, 1, 1) + timedelta(days=day)}) for i in range(5)))
        rows.coalesce(1).write.mode("append").parquet(where)
    read = spark.sparkContext.accumulator(0)

    def seen(size):
        read.add(1)
        return size

    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(where)
    stream = stream.withColumn("size", F.udf(seen, "bigint")("size"))
    found = jobs.growth_with_late(spark, stream, days=10, late=5)
    assert {r.window_start // 86400: r.files for r in found.windows.collect()} == {40: 5} and found.late.count() == 5
    assert read.value == 10


def test_growth_of_nothing(spark, tmp_path):
    where = str(tmp_path / "in")
    spark.createDataFrame([], ENTRY).write.parquet(where)
    found = jobs.growth_with_late(spark, spark.readStream.schema(ENTRY).parquet(where))
    assert found.windows.count() == 0 and found.late.count() == 0


def test_folded_states_equal_the_batch_form_and_go_on(spark, make, tmp_path):
    where, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    owned = lambda n: [(f"/r/d{i % 3}/f{i}", {"owner": f"o{i % 5}", "size": i}) for i in range(n)] + ["/r/x/"]
    wants = {"owners": (jobs.owner_totals, ["owner"]), "homes": (jobs.home_totals, ["home"]), "all": (jobs.totals, [])}
    for n in (20, 7):
        make(*owned(n)).repartition(2).write.mode("append").parquet(where)
        for name, (step, keys) in wants.items():
            stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(where)
            got = jobs.folded_state(spark, stream, step, keys, name, target=f"{out}-{name}", checkpoint=f"{mark}-{name}", buckets=4)
            batch = step(spark.read.schema(ENTRY).parquet(where))
            assert got.schema.simpleString() == batch.schema.simpleString()
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_folded_changes_equal_the_stateful_form(spark, tmp_path):
    stream = feed(spark, tmp_path, [
        [(1, "CREATE", "/d/a"), (2, "CREATE", "/d/b"), (9, "MODIFY", "/late")],
        [(5, "DELETE", "/d/"), (4, "MODIFY", "/d/a"), (7, "MODIFY", "/late")], [(6, "CREATE", "/d/c")]])
    folded = jobs.folded_state(spark, stream, jobs.latest_change, ["path"], "t", jobs.latest_change)
    stateful = jobs.latest_state(spark, jobs.latest_change(stream), ["path"], "t")
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, stateful.collect()))


def test_stream_queries_keep_no_aggregation_state(spark, monkeypatch):
    # every state task reports on every partition of the state, so what the driver gets grows with the square of the partitions
    from treecensus.catalog import registry
    from treecensus.catalog import all_queries  # noqa: F401

    plans, run = [], jobs.run_batches

    def noted(stream, *args, **named):
        plans.append(stream._jdf.queryExecution().logical().toString())
        run(stream, *args, **named)

    monkeypatch.setattr(jobs, "run_batches", noted)
    names = ["stream_totals", "stream_owner_report", "stream_dir_matches", "stream_growth", "stream_growth_late", "stream_apply_changes"]
    for name in names:
        registry.bound(registry.QUERIES[name])(spark, "/root/testdata/sf0.001")
    assert len(plans) == len(names) and not any("Aggregate" in p for p in plans)


def test_late_rows_need_not_be_kept(spark, make, tmp_path):
    where = str(tmp_path / "in")
    for day in (40, 1):  # the second batch is late
        make((f"/{day}", {"creation_time": datetime(1970, 1, 1) + timedelta(days=day)})).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(where)
    found = jobs.growth_with_late(spark, stream, days=10, late=5, keep=False)
    assert {r.window_start // 86400: r.files for r in found.windows.collect()} == {40: 1} and found.late is None
