"""Joins under skew."""

import pytest
from conftest import column, pairs
from pyspark.sql import functions as F

from treecensus.operators import joins, similarity
from treecensus.plans import transfer


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, a tenth has none."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (n % 500).cast("string")))
    return spark.range(0, 30000, numPartitions=4).select(F.concat(F.lit("/p/"), n.cast("string")).alias("path"), key.alias("key"))


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 500, 2)] + [("unused", 9), (None, 5)]
    return spark.createDataFrame(rows, "name string, value int")


@pytest.mark.parametrize("how", ["left", "inner", "semi", "anti"])
def test_spread_join_equals_a_plain_join(spark, skewed, lookup, how):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = joins.spread_join(skewed, lookup, F.col("key"), "name", how)
        plain = skewed.join(lookup, F.col("key") == F.col("name"), joins.KINDS[how]).drop("name")
        assert got.columns == plain.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
        counts = skewed.groupBy("key").count()
        again = joins.spread_join(skewed, lookup, F.col("key"), "name", how, counts=counts)
        assert sorted(map(repr, again.collect())) == sorted(map(repr, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_is_spread_over_tasks(spark, skewed, lookup):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
                "spark.sql.shuffle.partitions": "32"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = joins.spread_join(skewed, lookup, F.col("key"), "name")
        for rows in (joined.where("key = 'hot'"), joined.where("key IS NULL")):
            sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) > 8 and max(sizes) < sum(sizes) / 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lookup_join_falls_back_when_the_dimension_is_large(skewed, lookup, monkeypatch):
    small = joins.lookup_join(skewed, lookup, F.col("key"), "name").collect()
    monkeypatch.setattr(joins, "MOST_ROWS", 10)
    assert not joins.fits_broadcast(lookup)
    large = joins.lookup_join(skewed, lookup, F.col("key"), "name").collect()
    assert sorted(map(repr, small)) == sorted(map(repr, large))


def test_prefix_joins(make):
    rows = make("/a/", "/a/b/", "/a/b/c", "/ab/", "/ab/x", "/top")
    dirs = make("/a/", "/a/b/").select("path")
    assert column(joins.beneath(rows, dirs)) == ["/a/b", "/a/b/c"]
    assert column(joins.beneath(rows, dirs, how="anti")) == ["/a", "/ab", "/ab/x", "/top"]
    assert pairs(joins.nearest_above(rows, dirs), "path", "top") == {("/a", "/a"), ("/a/b", "/a"), ("/a/b/c", "/a")}
    assert len(column(joins.beneath(rows, make("/").select(F.lit("/").alias("path"))))) == 6


def test_a_third_of_all_files_are_copies(spark):
    n = F.col("id")
    files = spark.range(6000).select(
        F.concat(F.lit("/f/"), n.cast("string")).alias("path"), F.lit("FS_FILE_TYPE_FILE").alias("type"),
        F.lit(8).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("datablocks"),
        F.when(n % 3 == 0, "samesame").otherwise(F.lpad((n - n % 2).cast("string"), 8, "0")).alias("content"))
    found = similarity.sampled(files)
    brute = {}
    for r in files.collect():
        brute.setdefault(r.content, []).append(r.path)
    want = sorted(p for v in brute.values() if len(v) > 1 for p in v)
    assert column(found) == want
    report = similarity.group_report(found).first()
    assert (report.files, report.extra_bytes) == (2000, 8 * 1999)
    assert similarity.by_size(files).count() == 6000
    numbers = [r.group_no for r in similarity.ranked_groups(spark, found).collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_shared_targets_with_a_hot_target(spark):
    n = F.col("id")
    rows = spark.range(9000).select(F.concat(F.lit("/s/"), n.cast("string")).alias("path"), F.when(
        n % 3 == 0, "/d/same").otherwise(F.concat(F.lit("/d/"), n.cast("string"))).alias("target"))
    got = transfer.duplicate_targets(rows).groupBy("shared").count().collect()
    assert {(r.shared, r["count"]) for r in got} == {(True, 3000), (False, 6000)}
