"""The stored inventory: ranges of paths of bounded size, without what follows from its other columns."""

from conftest import DIR, pairs
from pyspark.sql import functions as F

from treecensus.catalog import data
from treecensus.catalog.data import Data
from treecensus.workspace import folder


def test_larger_tables_have_more_ranges_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(data, "RANGE_ROWS", 100, raising=False)
    d = Data(spark, "/root/testdata/sf0.001")
    where = folder(spark, "inventory")
    d._write_inventory(where)
    rows = spark.read.parquet(where)
    files = rows.where(F.col("type") != DIR).groupBy(F.input_file_name().alias("file")).agg(
        F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high")).orderBy("low").collect()
    assert sum(f.n for f in files) == d.table("orders").count() > 1000
    assert max(f.n for f in files) <= 200
    assert all(a.high < b.low for a, b in zip(files, files[1:]))
    assert "acl" not in rows.columns and "tags" not in rows.columns


def test_lists_and_tags_follow_from_the_stored_columns(spark):
    d = Data(spark, "/root/testdata/sf0.001")
    base = d._base().withColumns({"owner": F.col("c_custkey").cast("string"),
                                  "group": F.concat(F.lit("g"), F.col("c_nationkey").cast("string"))})
    shown = F.to_json("acl").alias("acl")
    assert pairs(d.objects.select("path", shown), "path", "acl") == pairs(
        base.select("path", d._acl().alias("acl")).select("path", shown), "path", "acl")
    project = d.tagged.select("path", F.col("tags")["project"].alias("p"))
    assert pairs(project, "path", "p") == pairs(base.select(
        "path", F.when(F.col("k") % 3 == 0, F.col("c_mktsegment")).alias("p")), "path", "p")


def test_directories_are_derived_from_one_reading_of_the_files(spark):
    files = Data(spark, "/root/testdata/sf0.001").files
    read = spark.sparkContext.accumulator(0)

    def seen(path):
        read.add(1)
        return path

    path = F.udf(seen)("path").alias("path")
    dirs = Data._dirs(files.select(path, "creation_time", "modification_time"))
    assert pairs(dirs, "path", "child_count") == pairs(Data(spark, "/root/testdata/sf0.001").dirs, "path", "child_count")
    assert read.value == files.count() > 1000
