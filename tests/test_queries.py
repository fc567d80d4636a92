"""Every registered query against its SQL twin on the smallest tables, and its plan."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from treecensus.catalog import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# a cross product, a nested loop, or Python in the plan
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow",
            "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "FlatMapCoGroupsIn")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


def test_every_query_has_a_twin():
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows[0].path == "/" and [r.capacity for r in rows] == sorted((r.capacity for r in rows), reverse=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, database, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = check.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]
    cursor = database.execute(entry.oracle_sql()[name])
    assert got == check.rows_of([d[0] for d in cursor.description], cursor.fetchall())
