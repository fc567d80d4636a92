"""Roll-ups over the directory tree.

Rows are summed per containing directory first and only those sums are repeated
for every ancestor, so the exploded volume is directories x depth instead of
objects x depth.  All measures are algebraic: the root, which receives every
row, is absorbed by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import paths, sizes


def capacity() -> Column:
    return sizes.entry_capacity(F.col("datablocks"), F.col("metablocks"), F.col("size"))


def per_directory(matches: DataFrame, root: str = "/", every_level: bool = False) -> DataFrame:
    """Matches and capacity per directory below the root, and a depth-0 total.

    A match counts for the directories that contain it, never for itself.  One
    that lies directly in the root or outside it only counts in the total.  The
    matches are read once: the total is one more directory of every partial sum.
    """
    root = paths.root_text(root)
    base = paths.root_depth(root)
    path = F.col("path")
    inside = paths.below(path, root)
    if every_level:
        home = F.when(inside, paths.parent(path))
        holders = F.coalesce(paths.ancestors_or_self(F.col("_home"), root), F.array().cast("array<string>"))
    else:
        # only the directory right below the root is reported, so nothing deeper is kept
        home = F.when(inside & (paths.depth(path) > base + 1), paths.prefix(paths.clean(path), F.lit(base + 1)))
        holders = F.filter(F.array("_home"), lambda h: h.isNotNull())
    parts = (matches.where(F.length("path") > 0)
             .select(home.alias("_home"), capacity().alias("_cap"))
             .groupBy("_home").agg(F.count("*").alias("files"), F.sum("_cap").alias("capacity")))
    credited = parts.select(F.explode(F.concat(F.array(F.lit(root)), holders)).alias("path"), "files", "capacity")
    nothing = matches.sparkSession.range(1).select(
        F.lit(root).alias("path"), F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("capacity"))
    return (credited.unionByName(nothing).groupBy("path")
            .agg(F.sum("files").alias("files"), F.sum("capacity").alias("capacity"))
            .withColumn("depth", F.when(path == root, F.lit(0)).otherwise(paths.depth(path) - base)))


def directory_aggregates(entries: DataFrame, root: str = "/") -> DataFrame:
    """Recursive totals of every directory at or below the root, empty ones included."""
    root = paths.root_text(root)
    kind = F.col("type")
    counts = {
        "total_files": kind == C.FILE,
        "total_directories": kind == C.DIRECTORY,
        "total_symlinks": kind == C.SYMLINK,
        "total_other": ~kind.isin(C.FILE, C.DIRECTORY, C.SYMLINK),
    }
    # a directory counts in its parent, and is listed in itself without counting
    up = F.struct(paths.parent(F.col("path")).alias("home"), F.lit(True).alias("counts"))
    own = F.struct(paths.clean(F.col("path")).alias("home"), F.lit(False).alias("counts"))
    places = F.when(kind == C.DIRECTORY, F.array(up, own)).otherwise(F.array(up))
    rows = entries.where(paths.below(F.col("path"), root)).select(
        F.explode(places).alias("_at"), "type", capacity().alias("_cap"), "modification_time")
    hit = F.col("_at.counts")
    moment = F.when(hit & (kind != C.DIRECTORY), F.col("modification_time"))
    parts = rows.groupBy(F.col("_at.home").alias("_home")).agg(
        *[F.count_if(hit & test).alias(name) for name, test in counts.items()],
        F.sum(F.when(hit, F.col("_cap")).otherwise(0)).alias("total_capacity"),
        F.min(moment).alias("oldest"), F.max(moment).alias("newest"))
    sums = [*counts, "total_capacity"]
    chain = F.concat(F.array(F.lit(root)), paths.ancestors_or_self(F.col("_home"), root))
    return (parts.select(*sums, "oldest", "newest", F.explode(chain).alias("path")).groupBy("path")
            .agg(*[F.sum(s).alias(s) for s in sums],
                 F.min("oldest").alias("oldest"), F.max("newest").alias("newest")))


def capacity_by_owner(entries: DataFrame, owner: Column, root: str = "/") -> DataFrame:
    """Allocated bytes per owner in every directory subtree."""
    root = paths.root_text(root)
    parts = (entries.where(paths.below(F.col("path"), root))
             .select(paths.parent(F.col("path")).alias("_home"), owner.alias("owner"),
                     capacity().alias("_cap"))
             .where("owner IS NOT NULL")
             .groupBy("_home", "owner").agg(F.sum("_cap").alias("capacity")))
    chain = F.concat(F.array(F.lit(root)), paths.ancestors_or_self(F.col("_home"), root))
    return (parts.select("owner", "capacity", F.explode(chain).alias("path"))
            .groupBy("path", "owner").agg(F.sum("capacity").alias("capacity")))
