"""Plans that bring back objects from a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import paths
from treecensus.operators.joins import mark_beneath
from treecensus.functions.rename import with_suffix


def restore_plan(saved: DataFrame, live: DataFrame, on_conflict: str = "skip", suffix: str = "_restored",
                 include_directories: bool = False) -> DataFrame:
    """Write snapshot objects back to their own paths.

    ``on_conflict`` is ``skip``, ``clobber`` or ``rename``.  Directories merge:
    one that still exists is left alone.  Where something else has taken a
    directory's path, it and all that it held are a ``conflict``.  A new name
    that is taken as well is ``skip_exists``.
    """
    rows = saved if include_directories else saved.where(F.col("type") != C.DIRECTORY)
    there = live.select("path", F.col("type").alias("_live"))
    joined = rows.select("path", "type").join(there, "path", "left")
    exists, folder = F.col("_live").isNotNull(), F.col("type") == C.DIRECTORY
    conflict = {"skip": "skip_exists", "clobber": "overwrite", "rename": "rename_on_conflict"}[on_conflict]
    blocked = (saved.where(folder).select("path")
               .join(live.where(F.col("type") != C.DIRECTORY).select("path"), "path", "left_semi"))
    joined = mark_beneath(joined, blocked, "_inside")
    stuck = F.col("_inside").isNotNull() | (folder & exists & (F.col("_live") != C.DIRECTORY))
    action = (F.when(stuck, "conflict").when(~exists, "recreate").when(folder, "merge")
              .when((F.col("_live") == C.DIRECTORY) & F.lit(on_conflict == "clobber"), "skip_exists")
              .otherwise(conflict))
    renamed = paths.join_path(paths.parent(F.col("path")), with_suffix(paths.basename(F.col("path")), suffix))
    plan = joined.select("path", action.alias("action"), F.when(
        action == "rename_on_conflict", renamed).otherwise(F.col("path")).alias("target"))
    if on_conflict != "rename":
        return plan
    taken = live.select(F.col("path").alias("target"), F.lit(True).alias("_taken"))
    full = F.col("_taken").isNotNull() & (F.col("action") == "rename_on_conflict")
    return plan.join(taken, "target", "left").select(
        "path", F.when(full, "skip_exists").otherwise(F.col("action")).alias("action"),
        F.when(full, F.col("path")).otherwise(F.col("target")).alias("target"))


def revert_plan(changes: DataFrame, delete_new: bool = False) -> DataFrame:
    """Undo all changes since a snapshot (a diff from the snapshot to the live tree).

    A path that changed its type is deleted and created in the diff; it is one
    action here, ``replace``, on the path as it was.
    """
    created = "delete" if delete_new else "keep"
    action = (F.when(F.col("op") == "DELETE", "recreate").when(F.col("op") == "MODIFY", "restore")
              .otherwise(created))
    whole = F.when(F.length("path") > 1, F.rtrim(F.col("path"), F.lit("/"))).otherwise(F.col("path"))
    ops = changes.groupBy(whole.alias("_bare")).agg(
        F.min_by("path", F.when(F.col("op") == "DELETE", 0).otherwise(1)).alias("path"),
        F.min_by("op", F.when(F.col("op") == "DELETE", 0).otherwise(1)).alias("op"), F.count_distinct("op").alias("_ops"))
    return ops.select("path", F.when(F.col("_ops") > 1, "replace").otherwise(action).alias("action"))
