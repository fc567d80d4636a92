"""Operator 12, a Merkle manifest of a dataset: a hash tree per source, and one over the sources.

A leaf is the hash of a row's fields.  The leaves of a source ascend by doc_id; runs of 16 nodes
become their hash until one node is left, the source's subroot.  Subroots in order of their source
become the root the same way.  The levels are built bottom up and stored as node rows that name
their parent (``Manifest.nodes``); a recursive query then ascends from the leaves, appends the
siblings of each level and folds the hash that is to be verified.

The leaves of a run share all siblings above the run, so they ascend in one row: an array with the
folded hash of each leaf, and one proof.  A node near the root is met by all runs below it; it is
repeated, and the runs below are dealt to its copies, so that no copy meets more than ``MEETING``.

Leaves are numbered without bringing a source together: rows are range partitioned by source and
doc_id, numbered inside a partition, and shifted by the counts of the partitions before.

A null field counts as ``-``.  Rows without a source are a source of their own, the first one; rows
without a doc_id come first in their source.  Rows of one doc_id follow each other by their hash,
and every repeated row is a leaf of its own.  Other columns are not read.  An empty table has no
rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treecensus.llm.common import numbered, settle
from treecensus.operators.joins import fits_broadcast

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
DIGEST = 32
#: Runs of leaves that meet in one copy of a node.
MEETING = 4096
#: Stands for the tree over the subroots; the trees of the sources are numbered from 0.
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields can't be shifted into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*texts: Column) -> Column:
    """The binary SHA-256 of texts after each other."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def shown(digests: Column) -> Column:
    """Binary digests, one or several after each other, as lowercase hex text."""
    return F.lower(F.hex(digests))


def leaf(**changed: Column) -> Column:
    """A row's leaf; ``changed`` replaces some of its fields."""
    return hashed(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def leaves(documents: DataFrame, tampered: Column | None = None, **changed: Column) -> DataFrame:
    """(doc_id, source, leaf, offered): the leaf to build from, and the one whose way to the root is verified."""
    own = leaf()
    offered = own if tampered is None else F.when(tampered, leaf(**changed)).otherwise(own)
    return documents.select("doc_id", "source", own.alias("leaf"), offered.alias("offered"))


@dataclass
class Manifest:
    """``runs``: the leaves, 16 to a row. ``nodes``: all inner nodes with their parents. ``root``: binary, None without leaves."""

    runs: DataFrame
    nodes: DataFrame
    root: bytes | None


def parents(level: DataFrame, extra: list[str] = []) -> DataFrame:
    """The next level: runs of 16 nodes (tree, idx, size, hash, below) and their hash; ``extra`` columns as ``members``.

    ``kids`` holds the digests of the run after each other, ``below`` the runs of leaves under the node.
    """
    run = F.array_sort(F.collect_list(F.struct("idx", "hash", *extra)))  # 16 at most
    found = level.groupBy("tree", F.floor(F.col("idx") / RUN).cast("bigint").alias("up")).agg(
        run.alias("run"), F.ceil(F.first("size") / RUN).cast("bigint").alias("size"), F.sum("below").alias("below"))
    kids = F.unhex(F.array_join(F.transform("run", lambda n: F.hex(n["hash"])), ""))
    found = found.withColumn("kids", kids).withColumn("hash", hashed(shown(F.col("kids"))))
    members = [F.transform("run", lambda n: F.struct(*(n[c].alias(c) for c in extra))).alias("members")] if extra else []
    return found.select("tree", F.col("up").alias("idx"), "size", "kids", "hash", "below", *members)


def build(found: DataFrame) -> Manifest:
    """The trees over (doc_id, source, leaf, offered), level by level; as many passes as the highest tree has levels."""
    found = settle(found, "leaves")  # hashing reads the whole texts: once, not again to find ranges and counts
    sources = settle(found.groupBy("source").agg(F.count("*").alias("n")).withColumn("one", F.lit(0)), "sources")
    trees = settle(numbered(sources, "one", ["source"]).select(F.col("source").alias("_source"), F.col("idx").alias("tree"), "n"), "trees")
    many, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    trees = trees.drop("n")
    if fits_broadcast(trees):
        trees = F.broadcast(trees)
    base = (numbered(found, "source", ["doc_id", "leaf"])
            .join(trees, F.col("source").eqNullSafe(F.col("_source")))
            .select("tree", "idx", "size", F.col("leaf").alias("hash"), "doc_id", "offered", F.lit(1).cast("bigint").alias("one")))
    # all leaves are grouped, also the only leaf of a source, which is not hashed again
    runs = parents(base.withColumnRenamed("one", "below"), ["doc_id", "offered"])
    lone = (F.col("size") == 1) & (F.length("kids") == DIGEST) & (F.size("members") == 1) & (F.col("idx") == 0)
    runs = settle(runs.withColumn("below", F.lit(1).cast("bigint"))
                  .withColumn("level", F.when(lone, 0).otherwise(1))
                  .withColumn("hash", F.when(lone, F.col("kids")).otherwise(F.col("hash"))), "runs")

    levels, subroots = [], []
    level, number, size = runs.select("tree", "idx", "size", "kids", "hash", "below", "level"), 1, ceil(largest / RUN)
    while True:
        levels.append(level)
        subroots.append(level.where("size = 1").select("tree", "hash", "below"))
        if size <= 1:
            break
        number, size = number + 1, ceil(size / RUN)
        level = settle(parents(level.where("size > 1")).withColumn("level", F.lit(number)), "level")
    level, number, size = _all(subroots).select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"),
                                                F.lit(many).cast("bigint").alias("size"), "hash", "below"), 0, many
    while size > 1:
        number, size = number + 1, ceil(size / RUN)
        level = settle(parents(level).withColumn("level", F.lit(number)), "level")
        levels.append(level)
    last = level.where("size = 1").select("hash").first()

    inner = _all(levels).select("tree", "level", "idx", "kids", "hash", "size", F.ceil(F.col("below") / MEETING).cast("int").alias("copies"))
    inside, single = F.col("size") > 1, F.lit(many <= 1) | (F.col("tree") == TOP)
    own = F.when(inside, F.col("idx")).otherwise(F.col("tree"))
    linked = (inner
              .withColumn("up_tree", F.when(inside, F.col("tree")).when(~single, F.lit(TOP).cast("bigint")))
              .withColumn("up_level", F.when(inside, F.col("level") + 1).when(~single, F.lit(1)))
              .withColumn("up_idx", F.when(inside | ~single, F.floor(own / RUN).cast("bigint")))
              .withColumn("pos", F.when(inside | ~single, (own % RUN).cast("int"))))
    above = inner.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"),
                         F.col("copies").alias("up_copies"))
    nodes = settle(linked.join(above, ["up_tree", "up_level", "up_idx"], "left"), "nodes")
    return Manifest(runs, nodes, bytes(last["hash"]) if last else None)


def _all(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


#: One row of ``climb`` is a run of leaves at some node; the step goes to the node's parent.
CLIMB = f"""
WITH RECURSIVE climb (tree, idx, folded, proof, subroot, up_tree, up_level, up_idx, pos, up_copy) AS (
  SELECT tree, idx, folded, proof, subroot, up_tree, up_level, up_idx, pos, up_copy FROM {{start}}
  UNION ALL
  SELECT c.tree, c.idx,
         transform(c.folded, own -> unhex(sha2(concat(
           lower(hex(substring(n.kids, 1, {DIGEST} * c.pos))), lower(hex(own)),
           lower(hex(substring(n.kids, {DIGEST} * (c.pos + 1) + 1)))), 256))),
         concat(c.proof, substring(n.kids, 1, {DIGEST} * c.pos), substring(n.kids, {DIGEST} * (c.pos + 1) + 1)),
         IF(n.tree = {TOP}, c.subroot, n.hash),
         n.up_tree, n.up_level, n.up_idx, n.pos,
         CAST(pmod(xxhash64(c.tree, c.idx), n.up_copies) AS INT)
  FROM climb c JOIN {{nodes}} n
    ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx AND c.up_copy = n.copy
)
SELECT tree, idx, folded, proof, subroot FROM climb WHERE up_tree IS NULL
"""


def without(kids: Column, i: Column) -> tuple[Column, Column]:
    """The digests before and after the i-th of a run, as text."""
    return (shown(F.substring(kids, F.lit(1), i * DIGEST)),
            shown(F.substring(kids, (i + 1) * DIGEST + 1, F.length(kids))))


def verify(manifest: Manifest) -> DataFrame:
    """For each leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is what the offered leaf and the original siblings give; it equals the root if
    the row is as it was when the manifest was made.
    """
    runs, nodes, spark = manifest.runs, manifest.nodes, manifest.runs.sparkSession
    link = nodes.drop("kids", "size", "copies", "hash")
    first = F.transform("members", lambda m, n: F.when(F.col("level") == 0, m["offered"]).otherwise(
        hashed(without(F.col("kids"), n)[0], shown(m["offered"]), without(F.col("kids"), n)[1])))
    start = (runs.join(link, ["tree", "level", "idx"])
             .select("tree", "idx", first.alias("folded"), F.unhex(F.lit("")).alias("proof"), F.col("hash").alias("subroot"),
                     "up_tree", "up_level", "up_idx", "pos",
                     F.pmod(F.xxhash64("tree", "idx"), F.col("up_copies")).cast("int").alias("up_copy")))
    copied = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    climbed = _recursive(spark, CLIMB, start=start, nodes=copied)
    back = runs.select("tree", "idx", "members", "kids", "level").join(climbed, ["tree", "idx"])
    each = back.select("kids", "level", "proof", "subroot", F.posexplode(F.arrays_zip("members", "folded")).alias("n", "each"))
    before, after = without(F.col("kids"), F.col("n"))
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    own = F.substring("kids", F.col("n") * DIGEST + 1, F.lit(DIGEST))
    folded = shown(F.col("each.folded"))
    return each.select(
        F.col("each.members.doc_id").alias("doc_id"), shown(own).alias("leaf"), shown(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(F.concat(before, after, shown(F.col("proof"))).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == root).alias("verified"))


def _recursive(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A recursive query, run at once and written: Spark's limit on its rows is lifted only meanwhile."""
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return settle(spark.sql(text, **tables), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)
