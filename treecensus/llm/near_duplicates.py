"""Operator 7, MinHash near-duplicates: universal hash minima, banding, verification, connected components.

Documents are sets of ``size``-word shingles; two are linked if 100 * intersection is at least
``percent`` * union.  The steps:

1. Fingerprints: each document's ``bands * rows`` minima of universal hashes over its distinct
   shingles, and a digest of the whole set.  Equal sets are linked by their digest alone; the one
   with the smallest doc_id stands for all its copies from here on.
2. Banding: documents that agree in all minima of a band share a bucket.  At similarity 0.75 a
   pair shares none of 50 bands of 6 with a probability of 6 in 100,000 (at 0.8: 3 in a million).
3. Stars: each member of a bucket is compared with the bucket's smallest member: first by
   signature (a byte of each minimum), then exactly on the full sets.
4. Components of these links by alternating large-star and small-star.
5. The rest, exactly: buckets that still hold several components are compared across components,
   in blocks: every member outside a bucket's largest component meets blocks of all its members.
   Only confirmed links leave a task, one for each member and component, so large buckets of near
   copies neither emit their pairs nor meet in one task.  Then components once more.

A pair that shares a bucket is thus either in one component or has been compared.  Shingles are
64-bit hashes, computed from word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from treecensus.llm.common import give_back, pieces_of, settle, slim
from treecensus.operators.joins import fits_broadcast

BLOCK = 512
#: Bytes of a block from which its worker gives memory back after it.
LARGE = 16 << 20


@dataclass(frozen=True)
class Settings:
    size: int = 5
    percent: int = 75
    bands: int = 50
    rows: int = 6
    #: Pairs whose signatures agree in a smaller share are not compared exactly: five standard errors below.
    slack: float = 0.125

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers and summands of the universal hashes (multiply-shift; comparing whole products)."""
        draw, n = np.random.default_rng(20), self.bands * self.rows
        return draw.integers(0, 1 << 63, n, dtype=np.uint64) * 2 + 1, draw.integers(0, 1 << 63, n, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes of words that a task keeps (about 200 bytes each).
MOST_WORDS = 200_000


class Words(dict):
    """Hashes of words; emptied when it holds ``MOST_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer words than a shingle are one as a whole.

    Lower-casing and splitting work on bytes: only A-Z are lower-cased, only ASCII space divides.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    span = min(size, len(own))
    total = np.full(len(own) - span + 1, span, np.uint64)
    for k in range(span):
        total = mixed(total + own[k:len(own) - span + 1 + k])
    return np.unique(total)


def minima(own: np.ndarray, multipliers: np.ndarray, summands: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), BLOCK):
        np.minimum(least, (own[a:a + BLOCK, None] * multipliers + summands).min(axis=0), out=least)
    return least


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def fingerprints(documents: DataFrame, set_: Settings = Settings(), full: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest, bands (a key each) and marks (a byte of each minimum); ``full`` adds the set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (multipliers, summands) = Words(), set_.hashes()
        number = np.arange(set_.bands, dtype=np.uint64)
        for batch in pieces_of(batches):
            size, digest, bands, marks, sets = [], [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), set_.size, words)
                size.append(len(own))
                raw = own.tobytes()
                sets.append(raw)
                if not len(own):
                    digest.append(None), bands.append(None), marks.append(None)
                    continue
                digest.append(hashlib.blake2b(raw, digest_size=16).digest())
                least = minima(own, multipliers, summands)
                marks.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
                keys = number + 1
                for column in least.reshape(set_.bands, set_.rows).T:
                    keys = mixed(keys + column)
                bands.append(keys.view(np.int64))
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                       pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            names = ["doc_id", "n_shingles", "digest", "bands", "marks"]
            if full:
                columns.append(pa.array(sets, pa.binary()))
                names.append("shingles")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>, marks binary"
    return documents.select("doc_id", "text").mapInArrow(slim(scan), schema + ", shingles binary" * full)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of undirected edges (a, b); the component is its smallest node.

    Alternating large-star and small-star: every round is a few joins and groupings whose result
    is written, and rounds go on until the edges no longer change (then all are stars).
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        joined = small.select("a", F.col("m").alias("b")).unionByName(moved)
        now = settle(joined.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")


def compared(pairs: DataFrame, sets: DataFrame, set_: Settings) -> DataFrame:
    """The pairs (a, b) that are links: by signature first, then exactly."""
    sides = [sets.select(F.col("doc_id").alias(x), F.col("marks").alias(f"{x}_marks"), F.col("shingles").alias(f"{x}_set"))
             for x in "ab"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = set_.percent / 100 - set_.slack
        for batch in pieces_of(batches):
            keep = []
            marks, full = ([[np.frombuffer(x.as_py(), t) for x in batch.column(s + k)] for s in "ab"]
                           for k, t in (("_marks", np.uint8), ("_set", np.uint64)))
            for i in range(batch.num_rows):
                if (marks[0][i] == marks[1][i]).mean() >= least and linked(full[0][i], full[1][i], set_.percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(slim(confirm), f"a {kind}, b {kind}")


def across(members: DataFrame, classes: DataFrame, sets: DataFrame, set_: Settings) -> DataFrame:
    """Links (a, b) between different components inside the same bucket.

    ``members`` has (key, band, doc_id).  A bucket's members are dealt to blocks by hash; those
    outside its most frequent component are repeated for each block of members.
    """
    placed = (members.join(classes, members["doc_id"] == classes["node"], "left")
              .select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = (shares.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"),
                                         F.count("*").alias("kinds"))
               .where("kinds > 1")
               .select("key", F.col("top.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
                       F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("sides")))
    inside = settle(placed.join(buckets, "key"), "mixed-buckets")
    part = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "band", "doc_id", "component"]
    rows = (inside.select(*columns, part("block", "blocks").alias("block"), whole("sides").alias("side"), F.lit(False).alias("asks"))
            .unionByName(inside.where("component <> main").select(
                *columns, whole("blocks").alias("block"), part("side", "sides").alias("side"), F.lit(True).alias("asks"))))
    kind = members.schema["doc_id"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, kinds = group.column("doc_id").to_pylist(), group.column("component").to_pylist()
        band = group.column("band")[0].as_py()
        bands = np.array(group.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
        full = group.column("shingles")
        others = np.flatnonzero(~asks)
        found = []
        for i in np.flatnonzero(asks):
            first = (bands[others] == bands[i]).argmax(axis=1) == band  # else an earlier band compares them
            alike = (marks[others] == marks[i]).mean(axis=1) >= set_.percent / 100 - set_.slack
            own, joined = np.frombuffer(full[i].as_py(), np.uint64), {kinds[i]}
            for j in others[first & alike]:
                if kinds[j] not in joined and linked(own, np.frombuffer(full[int(j)].as_py(), np.uint64), set_.percent):
                    joined.add(kinds[j])
                    found.append((ids[i], ids[j]))
        if group.nbytes > LARGE:
            give_back()
        return pa.table({"a": pa.array([a for a, _ in found], group.schema.field("doc_id").type),
                         "b": pa.array([b for _, b in found], group.schema.field("doc_id").type)})

    return (rows.join(sets, "doc_id").groupBy("key", "block", "side")
            .applyInArrow(compare, f"a {kind}, b {kind}").distinct())


def near_duplicates(documents: DataFrame, set_: Settings = Settings()) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept.

    A text that is null or without words has no shingles and is linked with nothing.  Rows that
    share a doc_id count as one document with several texts.  A row without a doc_id is linked
    with nothing either: its component_id is null and it is kept.  An empty table gives no rows.
    """
    prints = settle(fingerprints(documents, set_), "fingerprints")
    named = prints.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    copies = settle(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "copies")
    banded = (named.join(copies, ["digest", "doc_id"], "left_semi")
              .select("doc_id", F.posexplode("bands").alias("band", "key")))
    pivots = (banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
              .where("pivot < last").select("key", "pivot"))
    members = settle(banded.join(pivots, "key"), "buckets")
    wanted = members.select("doc_id").distinct()
    wanted = settle(wanted, "candidates")
    texts = documents.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "doc_id", "left_semi")
    sets = settle(fingerprints(texts, set_, full=True).where("digest IS NOT NULL")
                  .select("doc_id", "bands", "marks", "shingles"), "shingles")
    stars = members.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = settle(compared(stars, sets, set_), "links")
    first = components(links)
    rest = settle(across(members.select("key", "band", "doc_id"), first, sets, set_), "links")
    # copies of one set that stand under several doc_ids with other texts are linked through their digest
    own = named.join(copies.withColumnRenamed("doc_id", "b"), "digest").select(F.col("doc_id").alias("a"), "b").where("a <> b")
    merged = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest).unionByName(own)
    last = components(merged)
    return (prints.select("doc_id", "n_shingles").join(last, prints["doc_id"] == last["node"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
