"""Operator 5, best-fit packing by length patterns and non-negative least squares.

How well documents fit together depends on their lengths alone, and there are at most
``capacity`` lengths.  So the histogram of lengths is all that the plan needs:

1. enumerate the patterns of one to three lengths that fill a sequence exactly,
2. find non-negative repeat counts whose lengths come closest to the histogram (least squares,
   accelerated projected gradients over the sparse pattern table),
3. round them, never using more of a length than there is,
4. pack what is left from the longest length down, each sequence taking the longest that still fits.

The plan lists, for each length, which of its documents (by rank) go to which sequences.  Ranks
are given in salted slices of a length, so that a length shared by a third of all rows is spread
over the cluster.  Only the histogram (``capacity`` rows at most) reaches the driver, and only
the plan (bounded by the patterns, not by the documents) is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from treecensus.llm.common import pieces_of, settle, slices_for, slim
from treecensus.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
STEPS = 300


def cut(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents: row, doc_id, piece, start, length and ``ids`` (little-endian unsigned 32-bit).

    A document's ids end with ``end_id``.  Those longer than ``capacity`` are cut; all pieces
    but the first are full.  A null text is an empty one: its only id is the end.  ``row`` tells
    repeated documents apart; it is stable only once the pieces are written.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in pieces_of(batches):
            at, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                whole = coder.encode(text.as_py()) + end
                n = len(whole) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(whole[4 * a:4 * b])
            own = batch.select(["row", "doc_id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary())], ["row", "doc_id", "piece", "start", "length", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(
        slim(tokenise), f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths that sum to the capacity, as rows of three (0: none)."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    values = np.flatnonzero(there)
    there[0] = True  # the third place may stay empty
    for a in values[::-1]:
        b = values[(values <= a) & (values <= capacity - a)]
        c = capacity - a - b
        fits = (c <= b) & there[np.clip(c, 0, capacity)] & (c >= 0)
        if fits.any():
            found.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_squares(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared difference between what patterns use and ``counts``."""
    size = len(counts)
    there = (patterns > 0).astype(float)
    uses = lambda x: np.bincount(patterns.ravel(), (x[:, None] * there).ravel(), size)
    turns = lambda r: (r[patterns] * there).sum(axis=1)
    probe = np.ones(len(patterns))
    for _ in range(8):  # the largest eigenvalue bounds the step
        probe = turns(uses(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step, x, y, t = 1 / (1.05 * norm), np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * turns(uses(y) - counts))
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / grown * (new - x), new, grown
    return x


def fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences as (pattern, repeats); a pattern is a list of (length, how many), longest first."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    patterns, plan = full_patterns(np.flatnonzero(left), capacity), []
    sizes = np.arange(capacity + 1)
    if 2 * left[sizes > capacity / 2].sum() > (left @ sizes) / capacity:
        # long documents (one a sequence) take most sequences; patterns without one would use up what fits beside them
        patterns = patterns[patterns[:, 0] > capacity / 2]
    if len(patterns):
        wanted = least_squares(patterns, left.astype(float))
        for k in np.argsort(-wanted, kind="stable"):
            if wanted[k] < 0.5:
                break
            own, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = int(min(round(wanted[k]), *(left[own] // times)))
            if n > 0:
                left[own] -= n * times
                plan.append(([(int(a), int(m)) for a, m in zip(own[::-1], times[::-1])], n))
    while (own := np.flatnonzero(left)).size:
        pattern, room, top = [], capacity, len(own)
        while top:
            top = int(np.searchsorted(own[:top], room, side="right"))
            if not top:
                break
            a = int(own[top - 1])
            m = int(min(room // a, left[a]))
            pattern.append((a, m))
            room -= m * a
            top -= 1
        n = int(min(left[a] // m for a, m in pattern))
        for a, m in pattern:
            left[a] -= n * m
        plan.append((pattern, n))
    return plan


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of it, repeats, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, n in plan:
        offset = 0
        for length, m in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, n, offset))
            used[length] = rank + m * n
            offset += m * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``row``, ``piece`` and ``length`` (1 to ``capacity``).

    ``pieces`` is read more than once, so it must be a written table.  Sequences have no gaps
    and start at offset 0; equal lengths are interchangeable, and go by row.  No pieces give no rows.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    salts = slices_for(pieces.count(), 1 << 16)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    counts = settle(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(fit(histogram, capacity)))
    before = (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before")
    ranked = (salted.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_salt").orderBy("row", "piece")) - 1)
        .join(counts.select("length", "_salt", before), ["length", "_salt"])
        .select(*columns, (F.col("_rank") + F.col("_before")).alias("_rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, key = table.value, None
        for batch in batches:
            if key is None:
                key = plan[:, 0] * (1 << 50) + plan[:, 1]
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            own = plan[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1]
            nth, which = np.divmod(rank - own[:, 1], own[:, 3])
            yield pa.RecordBatch.from_arrays(
                [*batch.select(columns).columns, pa.array(own[:, 2] + which), pa.array(own[:, 4] + nth * length)],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ``ids``: sequence_id, n_ids, ids.

    A sequence has at most ``capacity`` pieces, so its list is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("_parts"), F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("_parts"))
            .select("sequence_id", "n_ids", joined.alias("ids")))
