"""Operator 10, exact top-k search by inner product: a dual-tree search over cover trees.

Vectors are integer (each component x becomes floor(256 * x)).  The top level of the tree is a set
of pivots chosen farthest-first from a bounded sample; every vector belongs to its nearest pivot's
node, whose covering radius is measured over all members.  A query goes only to nodes whose bound
(pivot score plus norm times radius) reaches the query's k-th score among the sample, which is a
true lower limit.  Inside a block of a node, a cover tree over the vectors and one over the queries
are searched together: a pair of nodes is skipped if its bound is below the worst k-th score of
the query node.  Skipping is strict, so ties survive, and every score is exact.

Equal vectors are searched once; each brings its k + 1 smallest ids, more can't be in any result.
Nodes are split into blocks of bounded size, and so are the queries that come to a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus.llm.common import settle

PIVOTS = 64
SAMPLE = 4096
BLOCK = 4096
LEAF = 32


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: in floating point while every sum stays below 2 ** 53, else in integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0 ** 53:
        whole = np.frompyfunc(int, 1, 1)
        return whole(a).dot(whole(b).T)
    return a @ b.T


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` points, each the farthest from those before it."""
    chosen = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


class Node:
    """A cover tree node: its center, the radius that covers its points, and children of half the scale."""

    def __init__(self, x: np.ndarray, own: np.ndarray):
        gap = np.linalg.norm(x[own] - x[own[0]], axis=1)
        self.own, self.center, self.norm, self.radius = own, x[own[0]], float(np.linalg.norm(x[own[0]])), float(gap.max())
        self.children: list[Node] = []
        parts, rest = [], own
        while len(own) > LEAF and len(rest):
            near = np.linalg.norm(x[rest] - x[rest[0]], axis=1) <= self.radius / 2
            parts.append(rest[near])
            rest = rest[~near]
            if len(parts) > len(own) // 4:  # half the radius groups nothing here: stay a leaf
                return
        if len(parts) > 1:
            self.children = [Node(x, part) for part in parts]


class Search:
    """The dual-tree search of some queries in one block; keeps the best ``keep`` vectors of each query."""

    def __init__(self, queries: np.ndarray, floors: np.ndarray, points: np.ndarray, keep: int):
        self.queries, self.points, self.keep = queries, points, keep
        self.floors = floors.copy()
        self.best = np.full((len(queries), keep), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.visit(Node(queries, np.arange(len(queries))), [Node(points, np.arange(len(points)))])

    def visit(self, group: Node, nodes: list[Node]) -> None:
        worst = self.floors[group.own].min()
        centers = np.stack([n.center for n in nodes])
        norms, radii = np.array([n.norm for n in nodes]), np.array([n.radius for n in nodes])
        bound = centers @ group.center + group.norm * radii + norms * group.radius + group.radius * radii
        near = [nodes[i] for i in np.argsort(-bound) if bound[i] + abs(bound[i]) * 1e-9 + 1e-6 >= worst]
        leaves = [n for n in near if not n.children]
        inner = [n for n in near if n.children]
        if group.children:
            for child in group.children if near else []:
                self.visit(child, [*leaves, *(c for n in inner for c in n.children)])
            return
        if leaves:
            self.score(group.own, np.concatenate([n.own for n in leaves]))
        for n in inner:
            self.visit(group, n.children)

    def score(self, own: np.ndarray, others: np.ndarray) -> None:
        scores = dots(self.queries[own], self.points[others])
        at, to = np.nonzero(scores >= self.floors[own][:, None])
        self.found.append((own[at], others[to], scores[at, to]))
        merged = np.concatenate([self.best[own], scores.astype(float)], axis=1)
        self.best[own] = -np.partition(-merged, self.keep - 1, axis=1)[:, :self.keep]
        self.floors[own] = np.maximum(self.floors[own], self.best[own].min(axis=1))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each vec_id divisible by ``every``: query_id, rank, vec_id, score of its ``k`` best other rows.

    Ties go to the smaller vec_id; fewer rows than ``k`` are all returned.  Rows without a vec_id,
    and vectors that are null or hold null or non-finite components, take no part.  A vec_id that
    comes more than once counts once, with its smallest vector.  A shorter vector counts as
    followed by zeros.  Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    kept = settle(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    asking = settle(rows.where(F.col("vec_id") % every == 0), "queries")
    size = kept.agg(F.max(F.size("v"))).first()[0] or 0
    taken = (kept.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow())
    sample = _matrix(taken["v"].combine_chunks(), size)
    pivots = farthest_first(sample, PIVOTS) if len(sample) else sample
    shared = spark.sparkContext.broadcast((sample, pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centers = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            gap = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)))
            node = gap.argmin(axis=1)
            exact = np.linalg.norm(x - centers[node], axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int32()), pa.array(exact, pa.float64())],
                                             ["v", "ids", "node", "gap"])

    placed = settle(kept.mapInArrow(assign, "v array<double>, ids array<bigint>, node int, gap double"), "placed")
    nodes = {r.node: (r.radius, -(-r.n // BLOCK)) for r in  # one row for each pivot
             placed.groupBy("node").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}
    radii = np.array([nodes.get(i, (-np.inf, 0))[0] for i in range(len(pivots))])
    blocks = np.array([nodes.get(i, (0, 0))[1] for i in range(len(pivots))], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centers = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            scores = dots(x, known).astype(float)
            # the own vector is in the sample at most once, so the (k + 1)-th score is reached by k others
            floors = -np.partition(-scores, k, axis=1)[:, k] if scores.shape[1] > k else np.full(len(x), -np.inf)
            bound = x @ centers.T + np.linalg.norm(x, axis=1)[:, None] * radii
            reach = bound + np.abs(bound) * 1e-9 + 1e-6 >= floors[:, None]
            at, node = np.nonzero(reach & (blocks > 0))
            own = np.repeat(np.arange(len(at)), blocks[node])
            block = np.arange(len(own)) - np.repeat(np.cumsum(blocks[node]) - blocks[node], blocks[node])
            part = batch.take(pa.array(at[own], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("v"), pa.array(floors[at[own]]), pa.array(node[own], pa.int32()),
                 pa.array(block, pa.int64())], ["vec_id", "v", "floor", "node", "block"])

    asks = settle(asking.select("vec_id", "v").mapInArrow(
        route, "vec_id bigint, v array<double>, floor double, node int, block bigint"), "asked")
    loads = asks.groupBy("node", "block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    many = spark.createDataFrame([(n, b) for n, (_, b) in nodes.items()], "node int, blocks bigint")
    held = (placed.join(F.broadcast(many), "node")  # a row for each pivot
            .withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).join(loads, ["node", "block"])
            .select("node", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
                    F.lit(None).cast("bigint").alias("vec_id"), "v", "ids", F.lit(None).cast("double").alias("floor")))
    sent = (asks.join(loads, ["node", "block"])
            .select("node", "block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "v",
                    F.lit(None).cast("array<bigint>").alias("ids"), "floor"))

    def search(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("v").combine_chunks(), size)
        asked = group.column("vec_id").is_valid().to_numpy()
        names = group.column("vec_id").filter(pa.array(asked)).to_pylist()
        ids = group.column("ids").filter(pa.array(~asked)).to_pylist()
        out: list[tuple[int, int, int]] = []
        if names and ids:
            floors = group.column("floor").filter(pa.array(asked)).to_numpy()
            found = Search(v[asked], floors, v[~asked], k + 1).found
            best: dict[int, list[tuple[int, int]]] = {}
            for at, to, scores in found:
                for q, p, s in zip(at.tolist(), to.tolist(), scores.tolist()):
                    best.setdefault(q, []).extend((-int(s), i) for i in ids[p] if i != names[q])
            for q, pairs in best.items():
                out.extend((names[q], i, -s) for s, i in sorted(pairs)[:k])
        return pa.table({n: pa.array([o[c] for o in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    found = (held.unionByName(sent).groupBy("node", "block", "part")
             .applyInArrow(search, "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of ``size`` columns, short ones followed by zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * size:
        return flat.reshape(len(column), size).astype(float)
    out = np.zeros((len(column), size))
    for i, row in enumerate(column.to_pylist()):
        out[i, :len(row)] = row
    return out
