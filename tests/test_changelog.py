"""Searching changes instead of trees."""

import random
import re

import pytest
from conftest import DIR, FILE, pairs
from pyspark.sql import functions as F

from treecensus.catalog.data import DAILY, Data
from treecensus.operators import changelog
from treecensus.operators.search import Search, predicate
from treecensus.options import OptionError

ROWS = "path string, type string, size bigint, owner string, modification_time timestamp, access_time timestamp"


def trees(spark, seed=7, numbers=(2, 3, 5, 8, 9)):
    """Files that come, go, return, change (also with the same size, or only by being read) and turn into directories."""
    from datetime import datetime

    draw, state, out = random.Random(seed), {}, {}
    for number in numbers:
        for _ in range(40):
            path, when = f"/r/d{draw.randrange(4)}/f{draw.randrange(14)}", datetime(2001, 1, 1 + draw.randrange(28))
            what = draw.random()
            if what < 0.25:
                state.pop(path, None)
            elif what < 0.35 and path in state:
                state[path] = (*state[path][:-1], when)
            elif what < 0.45:
                state[path] = (DIR, 0, None, when, when)
            else:
                state[path] = (FILE, draw.randrange(5), draw.choice("ab"), when, when)
        rows = [(p, *v) for p, v in state.items()]
        rows += [(f"/r/d{i}", DIR, 0, "root", datetime(2001, 1, number), datetime(2001, 1, 1)) for i in range(4)]
        out[number] = spark.createDataFrame(rows, ROWS)
    return out


def found(frame):
    return pairs(frame, "seq", "path", "type", "size", "owner", "modification_time")


SEARCHES = [Search(), Search(type="file", larger_than=2), Search(owners=["a"], names=["f1*"]), Search(type="directory"),
            Search(root="/r/d2", smaller_than=4), Search(as_of="2001-02-01T00:00:00", older_than=10)]


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    own, where = trees(spark), str(tmp_path_factory.mktemp("log"))
    changelog.write(own, where)
    return own, where


@pytest.mark.parametrize("opts", SEARCHES)
@pytest.mark.parametrize("moments", [(2, 3, 5, 8, 9), (3, 8), (9,), (2,)])
def test_equals_a_search_of_every_tree(spark, logged, opts, moments):
    own, where = logged
    base = own[2]
    got = changelog.search(base, changelog.read(spark, where, base), 2, moments, opts)
    want = None
    for m in moments:
        hits = own[m].where(predicate(own[m], opts)).withColumn("seq", F.lit(m))
        want = hits if want is None else want.unionByName(hits)
    assert found(got) == found(want)
    assert got.count() == want.count()


def test_being_read_is_no_change(spark):
    from datetime import datetime

    rows = [("/a", FILE, 1, "a", datetime(2001, 1, 1), datetime(2001, 1, d)) for d in (1, 2)]
    older, newer = (spark.createDataFrame([r], ROWS) for r in rows)
    assert changelog.step(older, newer, 2, 1).count() == 0


def test_a_step_is_added_and_repeated(spark, tmp_path):
    own, where = trees(spark, 3), str(tmp_path / "log")
    changelog.write({n: own[n] for n in (2, 3)}, where)
    for _ in range(2):  # the second time as after a failed run
        changelog.append(own[3], own[5], 5, 3, where)
    log = changelog.read(spark, where, own[2])
    assert log.groupBy("seq", "path").count().where("count > 1").count() == 0
    assert {r.before for r in log.where("seq = 5").select("before").collect()} == {3}
    got = changelog.find(own[2], log, 2, (5,), F.lit(True))
    assert found(got) == found(own[5].withColumn("seq", F.lit(5)))


def test_one_tree_and_an_empty_log(spark, tmp_path):
    own, where = trees(spark, 5, (4,)), str(tmp_path / "log")
    changelog.write(own, where)
    got = changelog.find(own[4], changelog.read(spark, where, own[4]), 4, (4,), F.lit(True))
    assert found(got) == found(own[4].withColumn("seq", F.lit(4)))


@pytest.mark.parametrize("opts", [
    Search(max_depth=2), Search(time_field="access_time", older_than=3), Search(ages={"access_time": (None, 4)}),
    Search(between=("access_time", "2001-01-01", "2001-01-02")), Search(where="access_time IS NULL")])
def test_what_a_log_cannot_answer_is_refused(spark, logged, opts):
    own, where = logged
    with pytest.raises(OptionError):
        changelog.search(own[2], changelog.read(spark, where, own[2]), 2, (2, 3), opts)


def test_other_times_are_not_refused():
    changelog.checked(Search(time_field="access_time"))
    changelog.checked(Search(older_than=3, max_depth=-1))


def test_snapshots_before_the_oldest_are_refused(spark, logged):
    own, where = logged
    with pytest.raises(OptionError):
        changelog.find(own[3], changelog.read(spark, where, own[3]), 3, (2, 3), F.lit(True))


def test_one_tree_and_the_log_are_read(spark):
    data = Data(spark, "/root/testdata/sf0.001")
    base, log = data.daily
    frame = changelog.search(base, log, DAILY[0], DAILY, Search(file_only=True, larger_than=15_000_000))
    plan = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = re.findall(r"\n\(\d+\) Scan parquet.*?(?=\n\n\n|\n\(\d+\))", plan, re.S)
    assert len(scans) == 2
    trees_read, log_read = sorted(scans, key=lambda s: "before" in s or "seq" in s)
    assert "snapshot_id" in trees_read and re.search(r"PartitionFilters: .*snapshot_id.* = 1", trees_read)
    assert "GreaterThan(size,15000000)" in trees_read  # the search reaches the scan
    assert "seq" in log_read and "PartitionFilters" in log_read
    assert plan.count("Exchange hashpartitioning(path") <= 2 and "Join" not in plan
