"""Operator 13, approximate nearest neighbours: vantage-point trees per shard, Euclidean distance.

A top tree of vantage points, fitted on a bounded sample, sends every vector to a leaf.  A leaf's
vectors are cut into shards of ``SHARD`` by their distance to the leaf's own vantage point, so a
shard is a ring around it; there are as many shards as the vectors need.  What is known of a leaf
or a ring (the least and greatest distance of its vectors to a vantage point) is measured over all
its vectors, not the sample's.  Each shard has a vantage-point tree of its own.

A query is searched in its own shard first.  Its k-th distance there is an upper limit; by the
triangle inequality a leaf, ring or tree node can hold nothing nearer than the gap between the
query's distance to the vantage point and the measured ones.  It is skipped if ``factor`` times
that gap exceeds the limit: with factor 1 the search is exact, with a larger one it skips more.

Vectors of equal value are searched once; each brings its k + 1 smallest ids, more can't be in any
result.  The shards that many queries come to are repeated for blocks of queries.

Rows without a vec_id, and vectors that are null, all zero or hold null or non-finite components,
take no part.  Repeated rows (same vec_id and vector) count once; a vec_id with several vectors has
a row, and where it is asked for a query, for each.  A shorter vector counts as followed by zeros.
Equal distances are ordered by vec_id.  Other columns are not read.  An empty table has no rows.
Squared distances must fit in a double.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus.llm.common import matrix, numbered, settle
from treecensus.llm.top_k import usable

SAMPLE = 16384
SHARD = 4096
#: Queries of a shard that are searched together.
BLOCK = 4096
LEAF = 32
#: Sample vectors in a leaf of the top tree, at least; limits its depth.
FEWEST = 8
FACTOR = 1.25


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows of x and y, from their differences."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 20) // max(1, y.size))
    for i in range(0, len(x), step):
        out[i:i + step] = np.sqrt(((x[i:i + step, None] - y[None]) ** 2).sum(axis=2))
    return out


def vantage(x: np.ndarray) -> int:
    """The row, of eight tried, whose distances to the others differ most."""
    tried = np.unique(np.linspace(0, len(x) - 1, 8).astype(int))
    seen = x[np.unique(np.linspace(0, len(x) - 1, 256).astype(int))]
    return int(tried[gaps(x[tried], seen).std(axis=1).argmax()])


class Top:
    """The top tree: ``points[i]`` and ``radius[i]`` of inner node i, whose children are 2i + 1 (inside) and 2i + 2.

    Leaves follow the inner nodes; they have a point as well, but no radius.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.inner = depth, (1 << depth) - 1
        self.points = np.zeros((2 * self.inner + 1, sample.shape[1]))
        self.radius = np.zeros(self.inner)
        own = {0: sample}
        for i in range(len(self.points)):
            x = own.pop(i)
            if len(x):
                self.points[i] = x[vantage(x)]
            if i < self.inner:
                gap = gaps(x, self.points[i:i + 1])[:, 0]
                self.radius[i] = np.median(gap) if len(x) else 0
                own[2 * i + 1], own[2 * i + 2] = x[gap <= self.radius[i]], x[gap > self.radius[i]]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the points on the way there, the leaf's own last."""
        node, ways = np.zeros(len(x), np.int64), np.empty((len(x), self.depth + 1))
        for level in range(self.depth + 1):
            ways[:, level] = np.sqrt(((x - self.points[node]) ** 2).sum(axis=1))
            if level < self.depth:
                node = 2 * node + 1 + (ways[:, level] > self.radius[node])
        return node - self.inner, ways

    def above(self, leaf: int) -> list[int]:
        """The nodes on the way to a leaf, the leaf itself last."""
        node, way = leaf + self.inner, []
        while True:
            way.append(node)
            if node == 0:
                return way[::-1]
            node = (node - 1) // 2


def apart(gap: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A lower limit of the distance to vectors that lie from ``least`` to ``most`` away from a point ``gap`` away."""
    return np.maximum(0, np.maximum(least - gap, gap - most)) * (1 - 1e-9)


class Tree:
    """The vantage-point tree of a shard."""

    def __init__(self, x: np.ndarray, own: np.ndarray):
        self.own, self.children = own, []
        if len(own) <= LEAF:
            return
        self.point = x[own[vantage(x[own])]]
        gap = gaps(x[own], self.point[None])[:, 0]
        inside = gap <= np.median(gap)
        for part in (inside, ~inside):
            if part.any() and not part.all():
                self.children.append((gap[part].min(), gap[part].max(), Tree(x, own[part])))


class Search:
    """Queries against one shard. ``limits`` are their k-th distances so far, ``found`` the rows within them."""

    def __init__(self, queries: np.ndarray, limits: np.ndarray, points: np.ndarray, keep: int, factor: float):
        self.queries, self.points, self.keep, self.factor = queries, points, keep, factor
        self.limits, self.best = limits.copy(), np.full((len(queries), keep), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.met = 0
        self.visit(Tree(points, np.arange(len(points))), np.arange(len(queries)))

    def visit(self, node: Tree, asking: np.ndarray) -> None:
        if not node.children:
            return self.compare(node.own, asking)
        gap = gaps(self.queries[asking], node.point[None])[:, 0]
        away = np.stack([apart(gap, least, most) for least, most, _ in node.children])
        first = away.argmin(axis=0)  # the nearer child first; it lowers the limit for the other
        for turn in range(len(node.children)):
            for c, (_, _, child) in enumerate(node.children):
                go = ((first == c) == (turn == 0)) & (self.factor * away[c] <= self.limits[asking])
                if go.any():
                    self.visit(child, asking[go])

    def compare(self, own: np.ndarray, asking: np.ndarray) -> None:
        self.met += len(own) * len(asking)
        gap = gaps(self.queries[asking], self.points[own])
        at, to = np.nonzero(gap <= self.limits[asking][:, None])
        self.found.append((asking[at], own[to], gap[at, to]))
        merged = np.concatenate([self.best[asking], gap], axis=1)
        self.best[asking] = np.partition(merged, self.keep - 1, axis=1)[:, :self.keep]
        self.limits[asking] = np.minimum(self.limits[asking], self.best[asking].max(axis=1))


def nonzero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


FOUND = "query_id bigint, query bigint, limit double, vec_id bigint, score double"


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = FACTOR) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of ``k`` near other rows."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & nonzero(F.col("embedding")))
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v")).distinct())
    order = Window.partitionBy("v").orderBy("vec_id")  # the first k + 1 are taken before the shuffle as well
    kept = settle(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
                  .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0).withColumn("query", F.xxhash64("v"))
    many, size = kept.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = matrix(kept.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(SAMPLE)
                    .select("v").toArrow()["v"].combine_chunks(), size)
    depth = max(0, min(ceil(log2(max(1, many / SHARD))), int(log2(max(1, len(sample) / FEWEST)))))
    top = spark.sparkContext.broadcast(Top(sample, depth))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, ways = top.value.place(matrix(batch.column("v"), size))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf, pa.int64()), pa.array(list(ways[:, :-1]), pa.list_(pa.float64())), pa.array(ways[:, -1])],
                [*batch.schema.names, "leaf", "ways", "gap"])

    placed = "leaf bigint, ways array<double>, gap double"
    shards = settle(numbered(kept.mapInArrow(place, f"v {kind}, ids array<bigint>, {placed}"), "leaf", ["gap"])
                    .withColumn("ring", F.floor(F.col("idx") / SHARD).cast("bigint")).drop("idx", "size"), "shards")
    rings = settle(shards.groupBy("leaf", "ring").agg(
        F.min("gap").alias("least"), F.max("gap").alias("most"),
        *(f(F.col("ways")[i]).alias(f"{n}{i}") for i in range(depth) for n, f in (("least", F.min), ("most", F.max)))), "rings")
    # at most SAMPLE / FEWEST rows
    known = rings.groupBy("leaf").agg(*(f(c).alias(c) for c in rings.columns[2:] for f in [F.min if c.startswith("least") else F.max])).collect()
    leaves = np.array([r.leaf for r in known], np.int64)
    limits = [(np.array([r[f"least{n}"] for r in known]), np.array([r[f"most{n}"] for r in known])) for n in [*range(depth), ""]]
    ways = np.array([top.value.above(int(i)) for i in leaves], np.int64).reshape(len(leaves), depth + 1)
    outline = spark.sparkContext.broadcast((leaves, limits, ways))

    homes = asking.mapInArrow(place, f"vec_id bigint, v {kind}, query bigint, {placed}")
    off = F.greatest(F.col("least") - F.col("gap"), F.col("gap") - F.col("most"), F.lit(0.0))
    homes = (homes.join(rings.select("leaf", "ring", "least", "most"), "leaf").groupBy("vec_id", "query")
             .agg(F.min_by(F.struct("leaf", "ring", "v"), F.struct(off, "ring")).alias("home"))
             .select("vec_id", "query", "home.*", F.lit(float("inf")).alias("limit")))
    near = settle(_searched(shards, homes, k, factor, size, kind), "near")
    reached = near.groupBy("query_id", "query").agg(F.min("limit").alias("limit"))
    told = homes.drop("limit").join(reached.withColumnRenamed("query_id", "vec_id"), ["vec_id", "query"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, limits, ways = outline.value
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                gap = gaps(matrix(batch.column("v"), size), top.value.points)
                away = np.max([apart(gap[:, ways[:, i]], *pair) for i, pair in enumerate(limits)], axis=0)
                at, to = np.nonzero(factor * away <= batch.column("limit").to_numpy()[:, None])
                part = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(leaves[to]), pa.array(gap[at, ways[to, -1]] if len(at) else np.zeros(0))],
                    [*batch.schema.names, "leaf", "gap"])

    sent = told.withColumnsRenamed({"leaf": "home", "ring": "home_ring"}).mapInArrow(
        route, f"vec_id bigint, query bigint, home bigint, home_ring bigint, v {kind}, limit double, leaf bigint, gap double")
    others = (sent.join(rings.select("leaf", "ring", "least", "most"), "leaf")
              .where((off * factor * (1 - 1e-9) <= F.col("limit")) & ~((F.col("leaf") == F.col("home")) & (F.col("ring") == F.col("home_ring"))))
              .select("vec_id", "query", "leaf", "ring", "v", "limit"))
    far = _searched(shards, settle(others, "asked"), k, factor, size, kind)
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return (near.unionByName(far).where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _searched(shards: DataFrame, asked: DataFrame, k: int, factor: float, size: int, kind: str) -> DataFrame:
    """Queries (vec_id, query, v, limit) against the shard (leaf, ring) they are sent to, ``k`` rows of each at most.

    A query that finds fewer has a further row without vec_id, so that its limit is told anyway.
    """
    loads = asked.groupBy("leaf", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = (shards.select("leaf", "ring", "v", "ids").join(loads, ["leaf", "ring"])
            .select("leaf", "ring", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("bigint").alias("vec_id"),
                    F.lit(None).cast("bigint").alias("query"), "v", "ids", F.lit(None).cast("double").alias("limit")))
    sent = (asked.join(loads, ["leaf", "ring"])
            .select("leaf", "ring", F.pmod(F.xxhash64("vec_id", "query"), F.col("blocks")).cast("int").alias("block"), "vec_id", "query", "v",
                    F.lit(None).cast("array<bigint>").alias("ids"), "limit"))

    def search(group: pa.Table) -> pa.Table:
        x = matrix(group.column("v").combine_chunks(), size)
        asks = group.column("vec_id").is_valid()
        told = group.filter(asks)
        is_query = asks.to_numpy()
        ids = group.column("ids").filter(pa.array(~is_query)).to_pylist()
        names, queries = told.column("vec_id").to_pylist(), x[is_query]
        run = Search(queries, told.column("limit").to_numpy(), x[~is_query], k + 1, factor)
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for at, to, gap in run.found:
            for q, p, g in zip(at.tolist(), to.tolist(), gap.tolist()):
                # the own row is the one with the own id and the same vector
                best[q].extend((g, i) for i in ids[p] if i != names[q] or g > 0)
        rows = [[(q, g, i) for g, i in sorted(pairs)[:k]] or [(q, None, None)] for q, pairs in enumerate(best)]
        flat = [r for own in rows for r in own]
        at = np.array([q for q, _, _ in flat], np.int64)
        return pa.table({"query_id": pa.array([names[q] for q in at], pa.int64()), "query": told.column("query").take(pa.array(at)),
                         "limit": pa.array(run.limits[at]), "vec_id": pa.array([i for _, _, i in flat], pa.int64()),
                         "score": pa.array([g for _, g, _ in flat], pa.float64())})

    return held.unionByName(sent).groupBy("leaf", "ring", "block").applyInArrow(search, FOUND)
