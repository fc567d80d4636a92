"""Operator 6, token ids in files: frequency ranks in byte-aligned codes with separate control bytes.

Ids are ranked by how often they occur in all documents, so that the commonest take one byte.
A rank is stored in 1 to 4 bytes; two bits of a control byte tell how many, four ranks to a
control byte, and control bytes are kept apart from the data bytes.  Reading looks the four
lengths of a control byte up in a table and gathers the data bytes with numpy.

The file format is a folder of two Parquet tables, so that any store Spark reaches can hold it:
``ranks`` (rank, id), and ``blocks`` with rows of whole documents in ascending order: shard,
block, first (ids before it in its shard), doc_ids, counts, control, data.  A document's control
bytes start anew, so documents can be read on their own.  Shards follow each other in doc_id
order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from treecensus.llm.common import folder, pieces_of
from treecensus.llm.tokens import encoder

SHARD_IDS = 1 << 23
BLOCK_IDS = 1 << 16
#: Lengths in bytes of the four codes of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)
BLOCKS = ("shard int, block int, first bigint, doc_ids array<{kind}>, counts array<bigint>, "
          "control binary, data binary")


def padding(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many ids: the ends of their slots (four to a control byte), and which slots are used."""
    slots = -(-counts // 4) * 4
    ends, used = np.cumsum(slots), np.ones(int(slots.sum()), bool)
    for k in (1, 2, 3):
        used[ends[slots - counts >= k] - k] = False
    return ends, used


def compress_all(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents after each other, each with the places where documents end."""
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    ends, used = padding(counts)
    codes = np.zeros(len(used), np.uint8)
    codes[used] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    data = np.empty(at[-1], np.uint8)
    data[at[:-1]] = ranks.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        data[at[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control, ends // 4, data, at[np.cumsum(counts)]


def compress(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document."""
    control, _, data, _ = compress_all(ranks, np.array([len(ranks)]))
    return control.tobytes(), data.tobytes()


def expand(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of a block, all documents after each other."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[padding(counts)[1]]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that follow each other in ``data`` and end at ``ends``."""
    places = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(data)])


def token_ids(documents: DataFrame, tokenizer: str, end_id: int, wide: str) -> DataFrame:
    """(doc_id, ids) of whole texts with their end id, as bytes of numpy type ``wide``."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in pieces_of(batches):
            ids = [np.frombuffer(coder.encode(text.as_py()) + end, "<u4").astype(wide).tobytes()
                   for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tokenise, f"doc_id {kind}, ids binary")


def id_counts(coded: DataFrame, wide: str) -> DataFrame:
    """(id, n) over all documents; a task sends a row per id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in pieces_of(batches):
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), wide)
            new = np.bincount(ids, minlength=len(seen))
            new[:len(seen)] += seen
            seen = new
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())], ["id", "n"])

    return coded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents below ``path``, in ascending doc_id order.

    A null text is an empty one: only the end id is written.  Rows without a doc_id come first;
    rows with the same doc_id follow each other by their ids.  An empty table writes no blocks.
    """
    spark, kind = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    wide = "<u2" if max(end_id + 1, encoder(tokenizer).library.get_vocab_size()) <= 1 << 16 else "<u4"
    written = folder(spark, "token-ids")  # texts are tokenised once; counting and coding read these
    token_ids(documents, tokenizer, end_id, wide).write.option("compression", "zstd").parquet(written)
    ids = spark.read.schema(f"doc_id {kind}, ids binary").parquet(written)
    counted = id_counts(ids, wide).orderBy(F.desc("n"), "id").collect()  # the vocabulary at most
    (spark.createDataFrame([(r, c.id) for r, c in enumerate(counted)], "rank int, id bigint").coalesce(1)
     .write.parquet(f"{path}/ranks"))
    shards = max(1, -(-sum(c.n for c in counted) // shard_ids))
    edges = np.array(sorted(set(ids.approxQuantile(
        "doc_id", [k / shards for k in range(1, shards)], 0.1 / shards)))) if shards > 1 else np.zeros(0)
    rank_of = np.zeros(max([end_id, *(c.id for c in counted)]) + 1, np.uint32)
    rank_of[[c.id for c in counted]] = np.arange(len(counted))
    ranks = spark.sparkContext.broadcast(rank_of)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts = batch.column("ids").to_pylist()
            plain = np.frombuffer(b"".join(texts), wide).astype("<u4")
            counts = np.array([len(text) // np.dtype(wide).itemsize for text in texts], np.int64)
            ends = np.cumsum(counts)
            tie = [zlib.crc32(plain[e - n:e]) for e, n in zip(ends.tolist(), counts.tolist())]
            control, control_ends, data, data_ends = compress_all(ranks.value[plain], counts)
            own = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(float)
            shard = np.searchsorted(edges, np.nan_to_num(own, nan=-np.inf), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), batch.column("doc_id"), pa.array(tie, pa.int64()), pa.array(counts),
                 binaries(control, control_ends), binaries(data, data_ends)],
                ["shard", "doc_id", "tie", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, block = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def out():
            ids, counts, control, data = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([list(ids)], pa.list_(id_type)), pa.array([list(counts)], pa.list_(pa.int64())),
                 pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary())],
                ["shard", "block", "first", "doc_ids", "counts", "control", "data"])

        id_type = pa.int64()
        for batch in pieces_of(batches):
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "control", "data"))):
                held.append(row)
                size += row[1]
                if size >= BLOCK_IDS:
                    yield out()
                    first, block, held, size = first + size, block + 1, [], 0
        if held:
            yield out()

    coded = ids.mapInArrow(
        encode, f"shard int, doc_id {kind}, tie bigint, n bigint, control binary, data binary")
    (coded.repartitionById(shards, F.col("shard"))
     .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "n")
     .mapInArrow(blocks, BLOCKS.format(kind=kind))
     .write.option("compression", "zstd").parquet(f"{path}/blocks"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents back from the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()  # the vocabulary at most
    ids = spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))
    sizes = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    totals = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    based = (blocks.join(F.broadcast(before), "shard")  # a row for each file
             .select((F.col("before") + F.col("first")).alias("first"), "doc_ids", "counts", "control", "data"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, doc_ids, counts, control, data = (batch.column(k)[i] for k in range(5))
                counts = counts.values.to_numpy(zero_copy_only=False)
                whole = ids.value[expand(control.as_py(), data.as_py(), counts)].tobytes()
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(first.as_py() + ends - counts), pa.array(counts),
                     pa.array([whole[4 * (e - n):4 * e] for e, n in zip(ends, counts)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return based.mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
