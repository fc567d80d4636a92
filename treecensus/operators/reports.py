"""Aggregate reports over matched objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus import constants as C
from treecensus.functions import aces as A, paths, sizes, times
from treecensus.functions.fields import pick
from treecensus.operators.hierarchy import capacity, directory_aggregates
from treecensus.operators.identity import display_names
from treecensus.operators.search import Search, omitted, owner_column
from treecensus.workspace import settle


def _sum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def match_totals(matches: DataFrame) -> DataFrame:
    """Number and capacity of the matches; zeros for none."""
    return matches.agg(F.count("*").alias("total_files"), _sum(capacity()).alias("total_capacity"))


def owned_bytes(entries: DataFrame) -> Column:
    """Allocated bytes of an object; zero where its block counts are unreadable."""
    bad = F.coalesce(pick(entries, "bad_blocks").cast("boolean"), F.lit(False))
    return F.when(bad, F.lit(0)).otherwise(sizes.owner_capacity(F.col("datablocks"), F.col("metablocks")))


def owner_report(entries: DataFrame, ids: DataFrame | None = None, logical: bool = False) -> DataFrame:
    """Bytes, files and directories per owner and a total row (owner null).

    Objects without an owner are left out.  A row whose block counts are
    unreadable counts zero bytes.
    """
    if logical:
        held = F.coalesce(F.col("size"), F.lit(0))
    else:
        held = owned_bytes(entries)
    per = (entries.select(owner_column(entries).alias("owner"), held.alias("_b"),
                          (F.col("type") == C.DIRECTORY).alias("_d"))
           .where("owner IS NOT NULL").groupBy("owner")
           .agg(F.sum("_b").alias("bytes"), F.count_if(~F.col("_d")).alias("files"),
                F.count_if("_d").alias("dirs")))
    total = per.agg(_sum("bytes").alias("bytes"), _sum("files").alias("files"),
                    _sum("dirs").alias("dirs")).withColumn("owner", F.lit(None).cast("string"))
    if ids is not None:
        # one row per owner is left here, so this join has no hot key
        per = per.join(display_names(ids).select(F.col("auth_id").alias("owner"), "shown", "domain"),
                       "owner", "left")
        per = per.withColumn("owner_name", F.coalesce("shown", F.lit("Unknown"))).drop("shown")
        total = total.withColumns({"owner_name": F.lit("TOTAL"),
                                   "domain": F.lit(None).cast("string")})
    return per.unionByName(total)


def scope_summary(entries: DataFrame, root: str = "/") -> DataFrame:
    """Objects by type under a path."""
    kind = F.col("type")
    return entries.where(paths.below(F.col("path"), paths.root_text(root))).agg(
        F.count_if(kind == C.DIRECTORY).alias("directories"),
        F.count_if(kind == C.FILE).alias("files"),
        F.count_if(kind == C.SYMLINK).alias("symlinks"),
        F.count_if(~kind.isin(C.DIRECTORY, C.FILE, C.SYMLINK)).alias("other"),
        F.count("*").alias("total"))


def directory_stats(entries: DataFrame, root: str = "/", max_depth: int = 0,
                    omit_subdirs: Sequence[str] = (), omit_paths: Sequence[str] = ()) -> DataFrame:
    """Totals of the root and of every kept directory down to a depth.

    File filters do not apply, and a kept directory reports its whole subtree.
    """
    root = paths.root_text(root)
    path = F.col("path")
    level = paths.depth(path) - paths.root_depth(root)
    rows = directory_aggregates(entries, root).where(level <= max_depth)
    opts = Search(root=root, omit_subdirs=omit_subdirs, omit_paths=omit_paths)
    for gone in omitted(opts, path, F.lit(C.DIRECTORY)):
        rows = rows.where((path == root) | ~gone)
    return rows.select(
        "path", level.alias("depth"), F.col("total_files").alias("files"),
        F.col("total_directories").alias("subdirectories"), F.col("total_capacity").alias("total_size"),
        F.when(F.col("total_files") > 0, F.floor(F.col("total_capacity") / F.col("total_files")))
        .otherwise(F.lit(0)).alias("average_size"),
        "oldest", "newest")


def with_directory_capacity(directories: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Directory rows with the capacity of their subtree."""
    return directories.join(aggregates.select("path", "total_capacity"), "path", "left")


def completeness(entries: DataFrame) -> DataFrame:
    """Directories whose recorded number of children is not the number of rows found."""
    found = entries.groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count("*").alias("found"))
    dirs = entries.where(F.col("type") == C.DIRECTORY).select("path", "child_count")
    seen = F.coalesce("found", F.lit(0))
    return (dirs.join(found, "path", "left")
            .select("path", "child_count", seen.alias("found"),
                    (F.col("child_count") - seen).alias("missing"))
            .where("missing <> 0"))


def acl_report(objects: DataFrame, group=None) -> DataFrame:
    """One row per object: how many entries, and their texts."""
    aces = F.col("acl.aces")
    inherited = F.size(F.filter(aces, A.is_inherited))
    return objects.select(
        "path", "owner", "group", F.size(aces).alias("ace_count"),
        inherited.alias("inherited_count"), (F.size(aces) - inherited).alias("explicit_count"),
        A.trustee_texts(aces, group).alias("trustees"))


def acl_unique(objects: DataFrame, example: bool = False) -> DataFrame:
    """Distinct ACLs, regardless of the order of their entries, with object counts.

    Counting alone hashes; an example path per list costs a sort of the objects.
    """
    marked = F.transform(F.col("acl.aces"), lambda a: F.concat(
        A.ace_text(a), F.when(A.is_inherited(a), F.lit(":I")).otherwise(F.lit(""))))
    text = F.array_join(F.array_sort(marked), ",")
    return (objects.select("path", text.alias("acl_text")).groupBy("acl_text")
            .agg(F.count("*").alias("objects"), *([F.min("path").alias("example")] if example else []))
            .withColumn("acl_id", F.sha2("acl_text", 256)))


def top(counted: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return counted.orderBy(F.desc(by), tie).limit(n)


def count_by_extension(entries: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent last dotted piece of a name (the whole name without a dot)."""
    last = F.lower(F.substring_index(paths.basename(F.col("path")), ".", -1))
    return top(entries.groupBy(last.alias("extension")).agg(F.count("*").alias("files")),
               "files", "extension", n)


def count_by_owner(entries: DataFrame) -> DataFrame:
    return entries.groupBy("owner").agg(F.count("*").alias("files"), _sum("size").alias("bytes"))


def top_owners(entries: DataFrame, n: int = 20) -> DataFrame:
    return top(count_by_owner(entries), "bytes", "owner", n)


def total_size(entries: DataFrame) -> DataFrame:
    return entries.agg(_sum("size").alias("bytes"))


def count_by_top_path(entries: DataFrame, n: int = 20) -> DataFrame:
    """Objects per first two path components."""
    key = F.array_join(F.slice(F.split("path", "/"), 2, 2), "/")
    return top(entries.groupBy(key.alias("top_path")).agg(F.count("*").alias("files")),
               "files", "top_path", n)


def age_buckets(entries: DataFrame, as_of: datetime | str) -> DataFrame:
    """Count and bytes by age since creation."""
    now = times.utc(as_of)

    def younger(days: int) -> Column:
        return F.col("creation_time") > times.literal(now - timedelta(days=days))

    bucket = (F.when(younger(30), "0-30 days").when(younger(90), "30-90 days")
              .when(younger(365), "90-365 days").otherwise("1+ years"))
    return entries.groupBy(bucket.alias("age_bucket")).agg(
        F.count("*").alias("files"), _sum("size").alias("bytes"))


def growth(entries: DataFrame, days: int = 30, per_owner: bool = True) -> DataFrame:
    """Objects and bytes created per window of whole days (aligned to the epoch)."""
    keys = [F.window("creation_time", f"{days} days").alias("_w")]
    keys += [F.col("owner")] if per_owner else []
    rows = entries.groupBy(*keys).agg(F.count("*").alias("files"), _sum("size").alias("bytes"))
    return rows.select(times.epoch(F.col("_w.start")).alias("window_start"),
                       *(["owner"] if per_owner else []), "files", "bytes")


def stale_alert(stale: DataFrame, threshold: int) -> DataFrame:
    """Is there more stale data than the threshold?"""
    return total_size(stale).select(
        F.col("bytes").alias("stale_bytes"), F.lit(threshold).cast("bigint").alias("threshold"),
        (F.col("bytes") > threshold).alias("alert"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("objects"))


def sort_report(rows: DataFrame, by: str = "size") -> DataFrame:
    """``size`` or ``count`` largest first, ``name`` ascending; ties by path."""
    column = {"size": ("total_size", "capacity", "bytes"), "count": ("files",)}.get(by, ())
    chosen = next((c for c in column if c in rows.columns), None)
    return rows.orderBy(F.desc(chosen), "path") if chosen else rows.orderBy("path")


def placed(ordered: DataFrame) -> DataFrame:
    """Rows of an ordered result with their ``place`` in it, from 1.

    The rows are written as they come; a place is that in the own partition plus the rows of the partitions
    before, so only one count per partition meets in a single task.
    """
    stored = settle(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_before"))
    return (stored.join(F.broadcast(starts), part == F.col("_part"))  # a row for each partition
            .withColumn("place", F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*ordered.columns, "place"))


def limit_matches(matches: DataFrame, n: int, fast: bool = False) -> DataFrame:
    """N matches: the first by path, or any when fast."""
    return matches.limit(n) if fast else matches.orderBy("path").limit(n)


def categories(entries: DataFrame, searches: Mapping[str, Column]) -> DataFrame:
    """One scan for many named searches: a row per object and search it matches."""
    hits = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in searches.items()]),
                    lambda x: x.isNotNull())
    return entries.select("path", F.explode(hits).alias("category"))

