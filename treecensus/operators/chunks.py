"""File contents as a table of chunks, so that one large file is spread over tasks.

A row is (path, chunk, size, data): ``data`` holds the chunk's bytes (or characters), ``size`` is that of
the whole file, repeated.  An empty file has one row with empty data.  Nothing here brings the chunks of
a file together; a version of a file is compared with another one chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.operators.regions import merge_regions, pieces
from treecensus.workspace import settle

KEY = ["path", "chunk"]


def cut(files: DataFrame, content: str = "content", chunk: int = C.CHUNK) -> DataFrame:
    """The chunks of a content column; for files that fit in one value. Files without content have no rows."""
    binary = files.schema[content].dataType.typeName() == "binary"
    size = F.length(content).cast("bigint")
    whole = F.when(size == 0, F.array(content)).otherwise(pieces(F.col(content), chunk, binary))
    return (files.where(F.col(content).isNotNull())
            .select("path", size.alias("size"), F.posexplode(whole).alias("chunk", "data"))
            .select("path", F.col("chunk").cast("bigint").alias("chunk"), "size", "data"))


def write(chunks: DataFrame, where: str) -> None:
    """Stores chunks by path and place: the rows of a file lie together, and a large one is in several files."""
    chunks.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(where)


def read_range(chunks: DataFrame, offset: int, length: int, chunk: int = C.CHUNK) -> DataFrame:
    """(path, size, data): a zero-based range of every file; only the chunks that it touches are read.

    A file that ends before the range has empty data.  The pieces of one range meet in one row.
    """
    first, last = offset // chunk, max(offset, offset + length - 1) // chunk
    empty = F.substring("data", 1, 0)
    part = F.struct("chunk", F.substring("data", F.greatest(F.lit(1), F.lit(offset + 1) - F.col("chunk") * chunk).cast("int"),
                                         (F.least(F.lit(offset + length), (F.col("chunk") + 1) * chunk)
                                          - F.greatest(F.lit(offset), F.col("chunk") * chunk)).cast("int")).alias("data"))
    # the first chunk stands for files that end before the range
    touched = chunks.where((F.col("chunk") == 0) | F.col("chunk").between(first, last))
    kept = F.struct("chunk", F.when(F.col("chunk").between(first, last), part["data"]).otherwise(empty).alias("data"))
    binary = chunks.schema["data"].dataType.typeName() == "binary"
    ordered = F.transform(F.array_sort(F.collect_list(kept)), lambda p: F.hex(p["data"]) if binary else p["data"])
    joined = F.array_join(ordered, "")
    return touched.groupBy("path", "size").agg((F.unhex(joined) if binary else joined).alias("data"))


def pick(chunks: DataFrame, ranges: DataFrame, chunk: int = C.CHUNK) -> DataFrame:
    """The data of listed ranges (path, size, no, offset, bytes): rows (path, size, no, part, data).

    A range has a part for each chunk that it touches; the list is joined by (path, chunk).
    """
    first, last = F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.greatest("bytes", F.lit(1)) - 1) / chunk)
    wanted = (ranges.where("bytes > 0").select("*", F.explode(F.sequence(first, last)).alias("chunk")))
    start = F.greatest(F.lit(0), F.col("offset") - F.col("chunk") * chunk)
    end = F.least(F.lit(chunk), F.col("offset") + F.col("bytes") - F.col("chunk") * chunk)
    return wanted.join(chunks.select(*KEY, "data"), KEY).select(
        "path", "size", "no", F.col("chunk").alias("part"), F.substring("data", (start + 1).cast("int"), (end - start).cast("int")).alias("data"))


def _facts(chunks: DataFrame, name: str) -> DataFrame:
    """What is compared: lengths and hashes instead of the data itself."""
    return chunks.select(*KEY, F.length("data").alias(f"{name}_n"), F.sha2("data", 256).alias(f"{name}_hash"))


def byte_diff(good: DataFrame, live: DataFrame, chunk: int = C.CHUNK, threshold: int = C.WHOLE_FILE_BELOW) -> DataFrame:
    """(path, kind, offset, bytes): what must be written to turn the live version of files back into the good one.

    ``data`` rows are changed ranges of the part both versions have, ``tail`` copies the end the live file
    lacks, ``truncate`` cuts what it has too much.  Files below the threshold (0 for none) and files without
    a live version are copied ``whole``.  Only hashes are shuffled, by (path, chunk), so a huge file is
    compared by many tasks; contents meet for the chunk in which the shorter version ends, one a file.
    Files that only the live side has are left alone.
    """
    sizes = lambda t, n: t.where("chunk = 0").select("path", F.col("size").alias(n))
    files = settle(sizes(good, "g").join(sizes(live, "l"), "path", "left"), "sizes")
    both = _facts(good, "good").join(_facts(live, "live"), KEY)  # (path, chunk) is unique on either side
    unlike = settle(both.where((F.col("good_n") != F.col("live_n")) | (F.col("good_hash") != F.col("live_hash")))
                    .select(*KEY, "good_n", "live_n"), "unlike")
    ends = unlike.where("good_n <> live_n").select(*KEY, F.least("good_n", "live_n").alias("n"))
    shared = [F.substring(F.col(f"{side}.data"), F.lit(1), F.col("e.n")) for side in ("a", "b")]
    differ = (ends.alias("e").join(good.select(*KEY, "data").alias("a"), KEY).join(live.select(*KEY, "data").alias("b"), KEY)
              .where(shared[0] != shared[1]).select(*KEY, "n"))
    changed = unlike.where("good_n = live_n").select(*KEY, F.col("good_n").alias("n")).unionByName(differ)

    kept = files.where(F.col("l").isNotNull() & (F.col("g") >= threshold))
    runs = merge_regions(changed.join(kept.select("path"), "path", "left_semi")
                         .select(*KEY, F.col("n").cast("bigint").alias("bytes")))
    data = runs.select("path", F.lit("data").alias("kind"), (F.col("first") * chunk).alias("offset"), "bytes")
    # a file below the threshold has few chunks
    small = files.where(F.col("l").isNotNull() & (F.col("g") < threshold))
    touched = small.join(unlike.select("path").distinct(), "path", "left_semi").unionByName(small.where("g <> l")).distinct()
    whole = files.where("l IS NULL").unionByName(touched)

    def row(rows: DataFrame, kind: str, offset: Column, size: Column) -> DataFrame:
        return rows.select("path", F.lit(kind).alias("kind"), offset.cast("bigint").alias("offset"), size.cast("bigint").alias("bytes"))

    g, end = F.col("g"), F.col("l")
    return (data.unionByName(row(whole, "whole", F.lit(0), g))
            .unionByName(row(kept.where("g > l"), "tail", end, g - end))
            .unionByName(row(kept.where("g < l"), "truncate", g, end - g)))
