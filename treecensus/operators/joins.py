"""Joins that hold when one key owns a large share of the rows.

Inventories are skewed by nature: one owner, one directory or one file size may
hold a third of all objects.

* ``lookup_join`` is for dimensions (identities, mappings).  It broadcasts the
  dimension only after measuring it, and falls back to ``spread_join``.
* ``spread_join`` is for lookups derived from the data.  The most frequent keys
  are salted in proportion to their frequency, so that a slice of a hot key is
  about one partition; all other keys are shuffled as usual.  At least as many
  keys as there are shuffle partitions are looked at, so a key that is left out
  has no more rows than a partition holds on average.  The lookup rows repeated
  for the salts number at most the partitions plus those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus.functions import paths
from treecensus.workspace import settle

HOT_KEYS = 1000
MOST_ROWS = 500_000
MOST_BYTES = 32 << 20
KINDS = {"left": "left", "inner": "inner", "semi": "left_semi", "anti": "left_anti"}


def fits_broadcast(table: DataFrame) -> bool:
    """Measure a small table: reads MOST_ROWS + 1 rows at most."""
    seen = table.limit(MOST_ROWS + 1).agg(
        F.count("*").alias("n"),
        F.sum(F.length(F.to_json(F.struct(*table.columns)))).alias("b")).first()
    return seen["n"] <= MOST_ROWS and (seen["b"] or 0) <= MOST_BYTES


def _values(lookup: DataFrame, key: str, how: str) -> list[str]:
    return [] if how in ("semi", "anti") else [c for c in lookup.columns if c != key]


def spread_join(rows: DataFrame, lookup: DataFrame, on: Column, key: str, how: str = "left",
                spread: str = "path", counts: DataFrame | None = None) -> DataFrame:
    """Join rows to a lookup on ``on = key``; ``how`` is left, inner, semi or anti.

    ``spread`` is a column that differs between the rows of one key.  ``counts``
    may pass the frequency of the keys as (key, n) where the caller has it
    already; otherwise it is a pre-aggregated pass over the key.
    """
    values = _values(lookup, key, how)
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_on", on)
    if counts is None:
        counts = keyed.groupBy("_on").agg(F.count("*"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    # a plain test of the key would be pushed below the count, and evaluate a costly key twice
    hot = (counts.toDF("_k", "n").where("IF(_k IS NULL, 0, n) > 1")
           .orderBy(F.desc("n"), "_k").limit(max(HOT_KEYS, slices))
           .select("_k", F.ceil(share * slices).alias("_w")))
    dealt = F.xxhash64(spread)
    salt = (F.when(F.col("_on").isNull(), F.pmod(dealt, F.lit(slices)))
            .when(F.col("_w").isNotNull(), F.pmod(dealt, F.col("_w"))).otherwise(F.lit(0)))
    left = (keyed.join(F.broadcast(hot), F.col("_on") == F.col("_k"), "left")
            .withColumn("_salt", salt.cast("bigint")).drop("_k", "_w"))
    right = (lookup.select(F.col(key).alias("_key"), *values)
             .join(F.broadcast(hot), F.col("_key") == F.col("_k"), "left")
             .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_w", F.lit(1)) - 1)))
             .drop("_k", "_w"))
    joined = left.join(right, (F.col("_on") == F.col("_key")) & (F.col("_salt") == F.col("_copy")), KINDS[how])
    return joined.select(*rows.columns, *values)


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Column, key: str, how: str = "left",
                spread: str = "path", counts: DataFrame | None = None) -> DataFrame:
    """Join rows to a dimension: without moving the rows if it measures small."""
    if not fits_broadcast(lookup):
        return spread_join(rows, lookup, on, key, how, spread, counts)
    values = _values(lookup, key, how)
    small = F.broadcast(lookup.select(F.col(key).alias("_k"), *values))
    joined = rows.withColumn("_on", on).join(small, F.col("_on") == F.col("_k"), KINDS[how])
    return joined.select(*rows.columns, *values)


def above(rows: DataFrame, table: DataFrame, key: str, measure: Column, name: str,
          path: str = "path", home: Column | None = None) -> DataFrame:
    """Add an aggregate over the table rows whose directory (``key``) contains the object.

    A prefix join as equi joins: the distinct containing directories are tested,
    not the rows.  ``home`` is the innermost directory that counts, the parent
    if not given.  The table is unique on its key.

    The directories asked for and the answers are small beside the rows; they
    are written, so that their size is known and the rows need not move at all
    when it is small.
    """
    table = settle(table, "directories")
    home = paths.parent(F.col(path)) if home is None else home
    # one pass over the paths serves both as the list of directories and as key counts
    homes = rows.groupBy(home.alias("_dir")).agg(F.count("*").alias("n"))
    chain = homes.select("_dir", F.explode(
        F.concat(F.array(F.lit("/")), paths.ancestors_or_self(F.col("_dir")))).alias("_over"))
    found = (lookup_join(chain, table, F.col("_over"), key, "inner", spread="_dir")
             .groupBy("_dir").agg(measure.alias(name)))
    return lookup_join(rows, settle(found, "answers"), home, "_dir", "left", spread=path, counts=homes)


def _bare(directories: DataFrame, key: str) -> DataFrame:
    bare = paths.clean(F.col(key))
    return directories.select(F.when(F.length(bare) > 0, bare).otherwise(F.lit("/")).alias("_wanted")).distinct()


def mark_beneath(rows: DataFrame, directories: DataFrame, name: str, key: str = "path",
                 path: str = "path", home: Column | None = None) -> DataFrame:
    """All rows, with a column that is true below one of the directories and null elsewhere."""
    return above(rows, _bare(directories, key), "_wanted", F.lit(True), name, path, home)


def beneath(rows: DataFrame, directories: DataFrame, key: str = "path", how: str = "semi",
            path: str = "path", home: Column | None = None) -> DataFrame:
    """Rows that lie below one of the directories (semi) or below none (anti)."""
    marked = mark_beneath(rows, directories, "_below", key, path, home)
    hit = F.col("_below").isNotNull()
    return marked.where(hit if how == "semi" else ~hit).drop("_below")


def nearest_above(rows: DataFrame, directories: DataFrame, key: str = "path",
                  path: str = "path") -> DataFrame:
    """Rows below (or equal to) a directory, with the topmost such directory as ``top``.

    Further columns of the directory table come along. It is unique on its key.
    """
    values = [c for c in directories.columns if c != key]
    bare = paths.clean(F.col(key))
    wanted = directories.select(bare.alias("_wanted"), F.struct(bare.alias("top"), *values).alias("_found"))
    marked = above(rows, wanted, "_wanted", F.min_by("_found", F.length("_found.top")), "_top", path)
    # a path meets its own directory row at most once, so this join has no hot key
    own = marked.join(wanted, paths.clean(F.col(path)) == F.col("_wanted"), "left")
    return (own.withColumn("_at", F.coalesce("_top", "_found")).where("_at IS NOT NULL")
            .select(*rows.columns, "_at.*"))
