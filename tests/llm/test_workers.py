"""What Python workers keep between tasks."""

import ctypes
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treecensus.llm import near_duplicates, packing


class Caught:
    """Stands for a table, and keeps the function that Spark would run in its workers."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        self.task = task
        return self


def give_back():
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def anonymous():
    return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024


@pytest.mark.parametrize("make", [lambda d: near_duplicates.fingerprints(d, full=True),
                                  lambda d: packing.cut(d, public_tokenizers.path("byte_bpe_50k.json"))])
def test_a_worker_gives_its_memory_back_after_a_task(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(6000).withColumn("row", F.col("doc_id"))
    batches = docs.select("doc_id", "text", "row").toArrow().to_batches(max_chunksize=10_000)
    task = make(Caught(docs.schema)).task
    give_back()
    for _ in task(iter(batches)):
        pass
    held = anonymous()
    give_back()
    assert held - anonymous() < 8
