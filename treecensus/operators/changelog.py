"""A stored log of what changed between consecutive snapshots, and searches that read it.

Consecutive snapshots are nearly identical.  At ingest the difference of each one to its predecessor
is written once, with the new row of what was created or modified, partitioned by step.  A search of
all snapshots then reads the oldest tree and the log, instead of every tree.

Each version of a path is valid from its step to the path's next change.  Only versions that match
the search carry their columns; of all others the log's path and step are enough to end a validity,
so one shuffle of matches and changes is all that is moved.  A path has one row a step at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from treecensus.operators.search import Search, predicate
from treecensus.options import OptionError

#: Not seen by a comparison: reading a file changes nothing else about it.
UNSEEN = "access_time"
CREATE, MODIFY, DELETE = "CREATE", "MODIFY", "DELETE"


def step(older: DataFrame, newer: DataFrame, seq: int, before: int) -> DataFrame:
    """(seq, before, op, path, columns of the newer row): what changed from one tree to the next.

    A path is modified if any column but the access time differs; also one that is a directory in one
    tree and a file in the other.  Every object has a row of its own, below a new directory as well.
    A deleted path has null columns.
    """
    columns = [c for c in newer.columns if c != "path"]
    seen = [c for c in columns if c != UNSEEN]
    old = older.select("path", F.struct(*seen).alias("_old"))
    new = newer.select("path", F.struct(*seen).alias("_new"), F.struct(*columns).alias("_row"))
    both = old.join(new, "path", "full")  # at most one row of a path on either side
    op = (F.when(F.col("_old").isNull(), CREATE).when(F.col("_new").isNull(), DELETE)
          .when(~F.col("_old").eqNullSafe(F.col("_new")), MODIFY))
    return both.withColumn("op", op).where("op IS NOT NULL").select(
        F.lit(seq).alias("seq"), F.lit(before).alias("before"), "op", "path", *(F.col("_row")[c].alias(c) for c in columns))


def append(older: DataFrame, newer: DataFrame, seq: int, before: int, where: str) -> None:
    """Add a step to the log; repeating a step, as after a failed run, replaces it."""
    (step(older, newer, seq, before).drop("seq").sortWithinPartitions("path")
     .write.mode("overwrite").parquet(f"{where}/seq={seq}"))


def write(trees: Mapping[int, DataFrame], where: str) -> None:
    """The log of trees by the number of their snapshot, in ascending order; of a single one it is empty."""
    numbers = sorted(trees)
    nothing = trees[numbers[0]].limit(0)
    append(nothing, nothing, numbers[0], numbers[0], where)
    for before, seq in zip(numbers, numbers[1:]):
        append(trees[before], trees[seq], seq, before, where)


def read(spark: SparkSession, where: str, base: DataFrame) -> DataFrame:
    """The log, with the columns of a tree."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "path")
    return spark.read.schema(f"before int, op string, path string, {kinds}, seq int").parquet(where)


def find(base: DataFrame, log: DataFrame, first: int, moments: Sequence[int], test: Column) -> DataFrame:
    """The rows that match ``test`` in each of the snapshots ``moments``, with the snapshot as ``seq``.

    ``base`` is the tree of snapshot ``first``, the oldest.  The rows equal those of a search in each tree,
    but for the access time, which may come from an earlier snapshot of an otherwise unchanged object.
    """
    wanted = sorted({int(m) for m in moments})
    if not wanted or wanted[0] < first:
        raise OptionError(f"the snapshots asked for must begin at the oldest tree, {first}")
    columns = [c for c in base.columns if c not in ("path", "seq")]
    row = F.struct(*columns)
    # steps after the last moment end nothing that is asked for
    steps = log.where(F.col("seq") <= wanted[-1]).where(F.col("seq") > first)
    hit = F.coalesce((F.col("op") != DELETE) & test, F.lit(False))
    old = base.where(test).select("path", F.lit(first).alias("seq"), row.alias("_row"))
    new = steps.select("path", "seq", F.when(hit, row).alias("_row"))
    following = F.lead("seq").over(Window.partitionBy("path").orderBy("seq"))
    valid = old.unionByName(new).withColumn("_next", following).where("_row IS NOT NULL")
    listed = F.array(*(F.lit(m) for m in wanted))
    inside = F.filter(listed, lambda m: (m >= F.col("seq")) & (F.col("_next").isNull() | (m < F.col("_next"))))
    return valid.select("path", "_row", F.explode(inside).alias("seq")).select("seq", "path", *(F.col("_row")[c].alias(c) for c in columns))


def checked(opts: Search) -> Search:
    """Refuses what a log of changes can't answer."""
    if opts.max_depth is not None and opts.max_depth >= 0:
        raise OptionError("a limited depth can't be searched incrementally")
    asked = {*opts.ages, opts.time_field if opts.older_than or opts.newer_than else "", opts.between[0] if opts.between else ""}
    if UNSEEN in asked or isinstance(opts.where, str) and UNSEEN in opts.where:
        raise OptionError("the access time can't be searched incrementally: a change of it alone is not in the log")
    return opts


def search(base: DataFrame, log: DataFrame, first: int, moments: Sequence[int], opts: Search) -> DataFrame:
    """``find`` with search options."""
    return find(base, log, first, moments, predicate(base, checked(opts)))
