"""Changed regions of files, from fixed-size chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus import constants as C

SPAN = 1 << 16


def _is_binary(files: DataFrame, column: str) -> bool:
    return files.schema[column].dataType.typeName() == "binary"


def pieces(content: Column, chunk: int = C.CHUNK, binary: bool = False) -> Column:
    """Fixed-size pieces of the whole content.

    Text is cut in characters by one pass of a regular expression, bytes by
    offset; both cost linear time per file.
    """
    if not binary:
        return F.regexp_extract_all(content, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    last = F.ceil(F.length(content) / chunk).cast("int") - 1
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(content, i * chunk + 1, F.lit(chunk)))
    ).otherwise(F.array().cast("array<binary>"))


def chunk_hashes(files: DataFrame, content: str = "content", chunk: int = C.CHUNK) -> DataFrame:
    """(path, chunk, bytes, hash) of every piece, the form in which versions of large files are kept."""
    cut = F.transform(pieces(F.col(content), chunk, _is_binary(files, content)), lambda p: F.struct(
        F.length(p).cast("bigint").alias("bytes"), F.sha2(p, 256).alias("hash")))
    return files.select("path", F.posexplode(cut).alias("chunk", "p")).select(
        "path", F.col("chunk").cast("bigint").alias("chunk"), "p.bytes", "p.hash")


def changed_chunks(good: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks of the good version that the live one lacks or holds differently.

    The key is (path, chunk), so even a single huge file is spread evenly.
    """
    other = live.select("path", "chunk", F.col("hash").alias("_other"))
    return (good.join(other, ["path", "chunk"], "left")
            .where(~F.col("hash").eqNullSafe(F.col("_other"))).select("path", "chunk", "bytes"))


def merge_regions(changed: DataFrame, keys: Sequence[str] = ("path",), span: int = SPAN) -> DataFrame:
    """Adjacent changed chunks (keys, chunk, bytes) as runs (keys, first, last, bytes).

    One huge file may hold most changed chunks, so runs are built per file and
    block of ``span`` chunks first.  Only runs that touch a block's edge can
    continue in the next one; these few are merged per file afterwards.
    """
    order = Window.partitionBy(*keys, "_block").orderBy("chunk")
    merged = (F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bytes").alias("bytes"))
    chunk = F.col("chunk").cast("bigint")
    runs = (changed.select(*keys, chunk.alias("first"), chunk.alias("last"), "chunk", "bytes",
                           F.floor(F.col("chunk") / span).alias("_block"))
            .withColumn("_run", F.col("chunk") - F.row_number().over(order))
            .groupBy(*keys, "_block", "_run").agg(*merged))
    edge = (F.col("first") % span == 0) | ((F.col("last") + 1) % span == 0)
    by_file = Window.partitionBy(*keys).orderBy("first")
    starts = F.coalesce(F.lag("last").over(by_file) + 1 != F.col("first"), F.lit(True)).cast("int")
    joined = (runs.where(edge).withColumn("_start", starts)
              .withColumn("_no", F.sum("_start").over(by_file))
              .groupBy(*keys, "_no").agg(*merged))
    columns = [*keys, "first", "last", "bytes"]
    return runs.where(~edge).select(*columns).unionByName(joined.select(*columns))


def byte_diff(files: DataFrame, good: str, live: str, chunk: int = C.CHUNK,
              threshold: int = C.WHOLE_FILE_BELOW) -> DataFrame:
    """What must be written to turn the live content back into the good one.

    ``data`` rows are changed ranges of the part both versions have, ``tail``
    copies the end the live file lacks, ``truncate`` cuts what it has too much.
    Files below the threshold (0 for none) and files without a live version are
    copied ``whole``.  Contents are compared where they are read; only the
    changes are shuffled.
    """
    same = F.coalesce(F.col(good) == F.col(live), F.lit(False))
    work = (files.where(F.col(good).isNotNull() & ~same)
            .withColumns({"_g": F.length(good).cast("bigint"), "_l": F.length(live).cast("bigint")})
            .withColumn("_o", F.least("_g", "_l")))
    whole = F.col(live).isNull() | (F.col("_g") < threshold)

    def step(kind: str, number: Column, offset: Column, size: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), number.cast("bigint").alias("chunk"),
                        offset.cast("bigint").alias("offset"), size.cast("bigint").alias("bytes"))

    zero = F.lit(0)
    # both versions cut to the part they share, so that the last chunk compares like with like
    parts = [pieces(F.substr(F.col(c), F.lit(1), F.col("_o").cast("int")), chunk, _is_binary(files, c))
             for c in (good, live)]
    differs = F.zip_with(*parts, lambda a, b: a != b)
    data = F.filter(F.transform(differs, lambda d, i: F.when(d, step(
        "data", i, i * chunk, F.least(F.lit(chunk).cast("bigint"), F.col("_o") - i * chunk)))),
        lambda s: s.isNotNull())
    ends = F.filter(F.array(
        F.when(F.col("_g") > F.col("_l"), step("tail", zero, F.col("_l"), F.col("_g") - F.col("_l"))),
        F.when(F.col("_g") < F.col("_l"), step("truncate", zero, F.col("_g"), F.col("_l") - F.col("_g")))),
        lambda s: s.isNotNull())
    steps = F.when(whole, F.array(step("whole", zero, zero, F.col("_g")))).otherwise(F.concat(data, ends))
    rows = work.select("path", F.explode(steps).alias("s")).select("path", "s.*")
    # an end has one row per file and kind: its offset is the key that keeps it apart
    at = F.when(F.col("kind") == "data", F.lit(None)).otherwise(F.col("offset"))
    runs = merge_regions(rows.withColumn("_at", at), ("path", "kind", "_at"))
    return runs.select("path", "kind", F.coalesce("_at", F.col("first") * chunk).alias("offset"), "bytes")
