"""Queries over file contents: likely copies and changed regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus.catalog.data import Data
from treecensus.catalog.registry import query
from treecensus.operators import chunks, regions, similarity

SAMPLE = 256
CHUNK = 256


@query("scan_file_content", """
SELECT path, size, sha256(substring(content, 101, 50)) AS range_hash, sha256(content) AS content_hash FROM fx_content""")
def scan_file_content(d: Data) -> DataFrame:
    # the range from the chunks that it touches; the whole only where all of it is hashed
    ranges = chunks.read_range(d.chunks("content", CHUNK), 100, 50, CHUNK).select("path", F.sha2("data", 256).alias("range_hash"))
    whole = d.content.select("path", "size", F.sha2("content", 256).alias("content_hash"))
    return whole.join(ranges, "path").select("path", "size", "range_hash", "content_hash")


@query("similar_by_size", """
SELECT path, size, count(*) OVER (PARTITION BY size, datablocks) AS files FROM fx_content WHERE size > 0
QUALIFY count(*) OVER (PARTITION BY size, datablocks) > 1""")
def similar_by_size(d: Data) -> DataFrame:
    return similarity.by_size(d.content.drop("content", "content_old")).select("path", "size", "files")


# 3 samples up to 1 MiB, which covers every document
_PRINT = f"""CASE WHEN size <= {3 * SAMPLE} THEN sha256(content) ELSE sha256(substring(content, 1, {SAMPLE})
  || substring(content, CAST(floor((size - {SAMPLE}) / 2) AS BIGINT) + 1, {SAMPLE})
  || substring(content, CAST(size - {SAMPLE} + 1 AS BIGINT), {SAMPLE})) END"""
_GROUPS = f"""
SELECT path, size, fingerprint, sha256(size || '|' || fingerprint) AS group_id,
  count(*) OVER (PARTITION BY size, fingerprint) AS files
FROM (SELECT path, size, {_PRINT} AS fingerprint FROM fx_content WHERE size > 0)
QUALIFY count(*) OVER (PARTITION BY size, fingerprint) > 1"""


def _similar(d: Data) -> DataFrame:
    files = d.content.drop("content", "content_old")
    ranges = similarity.sample_ranges(files, SAMPLE)
    return similarity.sampled_ranges(files, chunks.pick(d.chunks("content", CHUNK), ranges, CHUNK))


@query("similar_sampled", f"SELECT path, size, group_id, files FROM ({_GROUPS})")
def similar_sampled(d: Data) -> DataFrame:
    return _similar(d).select("path", "size", "group_id", "files")


@query("similar_report", f"""
SELECT group_id, any_value(size) AS size, count(*) AS files, min(path) AS example,
  any_value(size) * (count(*) - 1) AS extra_bytes FROM ({_GROUPS}) GROUP BY group_id""")
def similar_report(d: Data) -> DataFrame:
    return similarity.group_report(_similar(d))


@query("similar_group_id", f"""
SELECT row_number() OVER (ORDER BY size DESC, group_id) AS group_no, group_id, size, files
FROM (SELECT DISTINCT group_id, size, files FROM ({_GROUPS}))""")
def similar_group_id(d: Data) -> DataFrame:
    return similarity.ranked_groups(d.spark, _similar(d))


@query("similar_estimate", f"""
SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(n * least(size, 3 * {SAMPLE})) AS BIGINT) AS bytes_to_read
FROM (SELECT size, count(*) AS n FROM fx_content WHERE size > 0 GROUP BY size HAVING count(*) > 1)""")
def similar_estimate(d: Data) -> DataFrame:
    return similarity.estimate(d.content.drop("content", "content_old"), sample=SAMPLE)


def _diff_sql(good: str, live: str) -> str:
    """Chunk by chunk comparison, adjacent changed chunks merged."""
    return f"""
WITH w AS (SELECT path, {good} AS good, {live} AS live, length({good}) AS g, length({live}) AS l,
    least(length({good}), length({live})) AS o FROM fx_content WHERE {good} <> {live}),
p AS (SELECT * FROM w WHERE g >= 1000),
c AS (SELECT path, o, u.i FROM p, LATERAL (SELECT unnest(range(0, CAST(ceil(o / {CHUNK}) AS BIGINT))) AS i) u
  WHERE substring(good, u.i * {CHUNK} + 1, least({CHUNK}, o - u.i * {CHUNK}))
     <> substring(live, u.i * {CHUNK} + 1, least({CHUNK}, o - u.i * {CHUNK}))),
r AS (SELECT path, o, i, i - row_number() OVER (PARTITION BY path ORDER BY i) AS run FROM c)
SELECT path, 'whole' AS kind, CAST(0 AS BIGINT) AS "offset", g AS bytes FROM w WHERE g < 1000
UNION ALL SELECT path, 'data', min(i) * {CHUNK}, least((max(i) + 1) * {CHUNK}, any_value(o)) - min(i) * {CHUNK}
  FROM r GROUP BY path, run
UNION ALL SELECT path, 'tail', l, g - l FROM p WHERE g > l
UNION ALL SELECT path, 'truncate', g, l - g FROM p WHERE g < l"""


@query("byte_diff", _diff_sql("content_old", "content"))
def byte_diff(d: Data) -> DataFrame:
    return chunks.byte_diff(d.chunks("content_old", CHUNK), d.chunks("content", CHUNK), CHUNK, 1000)


@query("byte_diff_forward", _diff_sql("content", "content_old"))
def byte_diff_forward(d: Data) -> DataFrame:
    return chunks.byte_diff(d.chunks("content", CHUNK), d.chunks("content_old", CHUNK), CHUNK, 1000)


@query("merge_regions", f"""
WITH c AS (SELECT path, u.i FROM fx_content, LATERAL (SELECT unnest(range(0, CAST(ceil(size / {CHUNK}.0) AS BIGINT))) AS i) u
  WHERE contains(substring(content, u.i * {CHUNK} + 1, {CHUNK}), '\n')),
r AS (SELECT path, i, i - row_number() OVER (PARTITION BY path ORDER BY i) AS run FROM c)
SELECT path, min(i) AS first, max(i) AS last, count(*) AS bytes FROM r GROUP BY path, run""".replace("'\n'", "chr(10)"))
def merge_regions(d: Data) -> DataFrame:
    # chunks that hold a line feed; a short span makes runs cross its borders
    pieces = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    chunks = d.content.select("path", F.posexplode(pieces).alias("chunk", "piece")).where(F.col("piece").contains("\n"))
    return regions.merge_regions(chunks.select("path", "chunk", F.lit(1).cast("bigint").alias("bytes")), span=4)


@query("changed_chunks", f"""
WITH c AS (SELECT path, u.i AS chunk, substring(content, u.i * {CHUNK} + 1, {CHUNK}) AS a,
    substring(content_old, u.i * {CHUNK} + 1, {CHUNK}) AS b
  FROM fx_content, LATERAL (SELECT unnest(range(0, CAST(ceil(size / {CHUNK}.0) AS BIGINT))) AS i) u)
SELECT path, chunk, length(a) AS bytes FROM c WHERE a <> b""")
def changed_chunks(d: Data) -> DataFrame:
    return regions.changed_chunks(regions.chunk_hashes(d.content, "content", CHUNK),
                                  regions.chunk_hashes(d.content, "content_old", CHUNK))
