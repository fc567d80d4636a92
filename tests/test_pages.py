"""Raw pages: larger tables have larger pages, so a stream over them has a bounded number of batches."""

from conftest import column

from treecensus.catalog import exchange
from treecensus.catalog.data import Data


def test_the_number_of_pages_does_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(exchange, "MOST_PAGES", 4, raising=False)
    d = Data(spark, "/root/testdata/sf0.001")
    where = exchange.raw_pages(d)
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).drop("content")
    assert d.entries.count() > 1000  # more than a page of the least size
    assert all(r.path.endswith(".json.lz4") for r in pages.select("path").collect())  # a page costs little more than its text
    tasks = d.entries.rdd.getNumPartitions()
    assert pages.count() <= 4 + tasks
    # compressed: a row has about 900 characters as text
    assert sum(r.length for r in pages.select("length").collect()) < 300 * d.entries.count()
    assert column(exchange.tables.scan_inventory(spark, where)) == column(d.entries)
    assert exchange.raw_pages(d) == where


def test_rows_of_a_page(spark):
    assert exchange.page_rows(spark.range(100)) == exchange.PAGE_ROWS
    assert exchange.page_rows(spark.range(59_000_000)) * exchange.MOST_PAGES >= 59_000_000
