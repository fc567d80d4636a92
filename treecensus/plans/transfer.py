"""Plans to rename, move, copy and synchronise objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import paths
from treecensus.operators.joins import above, nearest_above, spread_join

Renamer = Callable[[Column], Column]


def _target_counts(rows: DataFrame, target: str) -> DataFrame:
    return rows.groupBy(F.col(target).alias("_t")).agg(F.count("*").alias("n"))


def _there(live: DataFrame) -> DataFrame:
    return live.select(F.col("path").alias("_t"), F.col("type").alias("dest_type"),
                       F.col("size").alias("dest_size"), F.col("modification_time").alias("dest_mtime"))


def duplicate_targets(rows: DataFrame, target: str = "target") -> DataFrame:
    """Mark rows that share their target with another row as ``shared``.

    Counts are aggregated before they are joined back: one target may draw a
    large share of all rows, which a window would put into one task.
    """
    counts = _target_counts(rows, target)
    many = counts.where("n > 1").select("_t", F.lit(True).alias("_many"))
    marked = spread_join(rows, many, F.col(target), "_t", "left", counts=counts)
    return marked.withColumn("shared", F.coalesce("_many", F.lit(False))).drop("_many")


def destination(rows: DataFrame, live: DataFrame, target: str = "target") -> DataFrame:
    """Add what already lies at the target: ``dest_type``, ``dest_size``, ``dest_mtime``."""
    return spread_join(rows, _there(live), F.col(target), "_t", "left")


def target_facts(rows: DataFrame, live: DataFrame, target: str = "target") -> DataFrame:
    """Both of the above with one join of the rows: facts are gathered per distinct target first."""
    counts = _target_counts(rows, target)
    facts = counts.join(_there(live), "_t", "left").select(
        "_t", (F.col("n") > 1).alias("shared"), "dest_type", "dest_size", "dest_mtime")
    return spread_join(rows, facts, F.col(target), "_t", "left", counts=counts)


def _existing(clobber: bool) -> Column:
    """A directory at the target is never replaced."""
    if not clobber:
        return F.lit("skip_exists")
    return F.when(F.col("dest_type") == C.DIRECTORY, "skip_exists").otherwise("overwrite")


def rename_plan(matches: DataFrame, rename: Renamer, live: DataFrame, clobber: bool = False) -> DataFrame:
    """New names in place."""
    path = F.col("path")
    rows = matches.select("path", paths.basename(path).alias("name")).withColumn("new_name", rename(F.col("name")))
    problem = (F.when(F.col("new_name").isNull(), "skip_no_name")
               .when(F.col("new_name") == F.col("name"), "skip_noop")
               .when((F.col("new_name") == "") | F.col("new_name").contains("/"), "invalid_name"))
    rows = rows.withColumn("_problem", problem).withColumn("target", F.when(
        F.col("_problem").isNull(), paths.join_path(paths.parent(path), F.col("new_name"))))
    rows = target_facts(rows, live)
    action = (F.when(F.col("_problem").isNotNull(), F.col("_problem"))
              .when(F.col("shared"), "skip_multi_source")
              .when(F.col("dest_type").isNotNull(), _existing(clobber)).otherwise("rename"))
    return rows.select("path", "new_name", "target", action.alias("action"))


def _selected(matches: DataFrame, dest: str, include_directories: bool) -> DataFrame:
    """Matches with the reason why one does not travel by itself, if any."""
    folder = F.col("type") == C.DIRECTORY
    if not include_directories:
        return matches.withColumn("_problem", F.when(folder, "skip_directory"))
    dirs = matches.where(folder).select(F.col("path").alias("_d"))
    dest = paths.root_text(dest)
    cycle = folder & (F.lit(dest).startswith(F.concat("path", F.lit("/"))) | (F.col("path") == dest))
    return (above(matches, dirs, "_d", F.lit(True), "_inside")
            .withColumn("_problem", F.when(F.col("_inside"), "pruned").when(cycle, "refused_cycle"))
            .drop("_inside"))


def transfer_plan(matches: DataFrame, dest: str, live: DataFrame, verb: str = "move",
                  rename: Renamer | None = None, include_directories: bool = False,
                  clobber: bool = False, skip_unchanged: bool = False) -> DataFrame:
    """Flatten matches into one directory.

    Rows of a directory that travels as a whole are ``pruned``.  Sources that
    share a target are all skipped, even when overwriting.
    """
    dest = paths.root_text(dest)
    rows = _selected(matches, dest, include_directories)
    name = paths.basename(F.col("path"))
    rows = rows.select("path", "type", "size", "modification_time", "_problem", (
        rename(name) if rename else name).alias("new_name"))
    bad = (F.when(F.col("new_name").isNull(), "skip_no_name")
           .when((F.col("new_name") == "") | F.col("new_name").contains("/"), "invalid_name"))
    target = paths.join_path(F.lit(dest), F.col("new_name"))
    rows = rows.withColumn("_problem", F.coalesce("_problem", bad))
    rows = rows.withColumn("_problem", F.coalesce(
        "_problem", F.when(target == F.col("path"), "skip_noop")))
    rows = rows.withColumn("target", F.when(F.col("_problem").isNull(), target))
    rows = target_facts(rows, live)
    there = F.col("dest_type").isNotNull()
    same = (F.col("dest_size") == F.col("size")) & (F.col("dest_mtime") == F.col("modification_time"))
    action = F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col("shared"), "skip_multi_source")
    if skip_unchanged:
        action = (action.when(F.col("dest_type") == C.DIRECTORY, "skip_exists")
                  .when(there & F.coalesce(same, F.lit(False)), "skip_unchanged")
                  .when(there, f"{verb}_changed").otherwise(f"{verb}_new"))
    else:
        action = action.when(there, _existing(clobber)).otherwise(verb)
    return rows.select("path", "target", action.alias("action"))


def expand_directories(plan: DataFrame, entries: DataFrame, verb: str = "copy") -> DataFrame:
    """Every object that travels with a copied directory, with its own target."""
    tops = plan.where(F.col("action") == verb).select("path", "target")
    inside = nearest_above(entries.select("path", "type"), tops)
    return inside.select(
        "path", "type", F.concat("target", F.substr(F.col("path"), F.length("top") + 1)).alias("target"))


def sync_plan(matches: DataFrame, dest: str, live: DataFrame, rename: Renamer | None = None) -> DataFrame:
    """Copy only what is new or differs in size or modification time."""
    return transfer_plan(matches, dest, live, "copy", rename, skip_unchanged=True)


def preserve(plan: DataFrame, objects: DataFrame, keep: str = "none") -> DataFrame:
    """Which attributes travel with a copy: ``none``, ``permissions`` or ``all``; never change_time."""
    columns = {
        "none": (),
        "permissions": ("owner", "group", "acl", "mode"),
        "all": ("owner", "group", "acl", "mode", "extended_attributes", "tags",
                "creation_time", "modification_time", "access_time"),
    }[keep]
    present = [c for c in columns if c in objects.columns]
    return plan.join(objects.select("path", *present), "path", "left")


def missing_directories(targets: DataFrame, live: DataFrame, target: str = "target") -> DataFrame:
    """Directories that must be made before the targets can be written."""
    homes = targets.where(F.col(target).isNotNull()).select(paths.parent(F.col(target)).alias("_home")).distinct()
    needed = homes.select(F.explode(paths.ancestors_or_self(F.col("_home"))).alias("path")).distinct()
    return needed.join(live.where(F.col("type") == C.DIRECTORY).select("path"), "path", "left_anti")
