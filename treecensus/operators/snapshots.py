"""Snapshots: listing, searching, comparing and rebuilding trees."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus import constants as C
from treecensus.functions import paths, times
from treecensus.operators.joins import above, fits_broadcast, lookup_join, nearest_above
from treecensus.options import duration
from treecensus.workspace import settle


MOST_LISTED = 10_000


def eligible(snapshots: DataFrame, include_replication: bool = False, path: str | None = None,
             newer_than: str | None = None, older_than: str | None = None,
             as_of: datetime | str | None = None) -> DataFrame:
    """Snapshots a search may use; those in deletion never."""
    rows = snapshots.where(~F.coalesce(F.col("in_deletion"), F.lit(False)))
    if not include_replication:
        for lead in C.REPLICATION_PREFIXES:
            rows = rows.where(~F.col("name").startswith(lead))
    if path is not None:
        rows = rows.where(covers(F.col("source"), path))
    if newer_than is not None:
        rows = rows.where(times.after(F.col("ts"), times.utc(as_of) - duration(newer_than)))
    if older_than is not None:
        rows = rows.where(times.before(F.col("ts"), times.utc(as_of) - duration(older_than)))
    return rows


def covers(source: Column, path: str) -> Column:
    """The source is the path itself or one of its ancestors."""
    bare = paths.root_text(path)
    chain = ["/"] + ["/".join(bare.split("/")[:i + 1]) for i in range(1, bare.count("/") + 1)]
    trimmed = F.when(paths.clean(source) == "", F.lit("/")).otherwise(paths.clean(source))
    return trimmed.isin(*dict.fromkeys(c for c in chain if c))


def coverage(objects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(path, snapshot_id): the snapshots each path can be searched or restored from.

    While the snapshots fit into a broadcast, each object looks its ancestors up
    where it is, and nothing is shuffled.  Beyond that the sources above an
    object are found once for each directory, and the object itself is looked
    up, so objects are never shuffled for ancestors that no snapshot was taken
    of.  Trailing slashes of a source do not matter; rows without a path or a
    source are covered by nothing.
    """
    bare = paths.clean(F.col("source"))
    dimension = settle(snapshots.where("source IS NOT NULL").select(
        F.when(bare == "", F.lit("/")).otherwise(bare).alias("source"), F.col("id").alias("snapshot_id")), "sources")
    objects = objects.where("path IS NOT NULL").select("path")
    if fits_broadcast(dimension):
        chain = objects.select("path", F.explode(
            F.concat(F.array(F.lit("/")), paths.ancestors_or_self(F.col("path")))).alias("_over"))
        small = F.broadcast(dimension)
        return chain.join(small, F.col("_over") == F.col("source")).select("path", "snapshot_id")
    sources = settle(dimension.select("source", F.col("source").alias("_own")).distinct(), "distinct-sources")
    rows = above(objects, sources, "source", F.collect_list("_own"), "_over")
    own = lookup_join(rows, sources, paths.clean(F.col("path")), "source")
    over = F.concat(F.coalesce("_over", F.array().cast("array<string>")), F.array_compact(F.array("_own")))
    chain = own.select("path", F.explode(over).alias("_source"))
    return lookup_join(chain, dimension, F.col("_source"), "source", "inner").select("path", "snapshot_id")


def recent(snapshots: DataFrame, n: int) -> DataFrame:
    """The n newest snapshots, with their rank."""
    order = Window.orderBy(F.desc("ts"), F.desc("id"))
    return snapshots.orderBy(F.desc("ts"), F.desc("id")).limit(n).withColumn(
        "rank", F.row_number().over(order))


def search_all(entries: DataFrame, snapshots: DataFrame, test: Column) -> DataFrame:
    """The same search in many snapshots, one scan; every match names its snapshot.

    A list of snapshots of the usual length becomes a literal, so that a table
    partitioned by snapshot only reads the partitions it needs.
    """
    wanted = [r[0] for r in snapshots.select("id").distinct().limit(MOST_LISTED + 1).collect()]
    if len(wanted) <= MOST_LISTED:
        test = F.col("snapshot_id").isin(*wanted) & test if wanted else F.lit(False)
    dimension = snapshots.select(F.col("id").alias("snapshot_id"), F.col("name").alias("snapshot_name"),
                                 F.col("ts").alias("snapshot_time"))
    return lookup_join(entries.where(test), dimension, F.col("snapshot_id"), "snapshot_id", "inner")


def latest_per_path(matches: DataFrame) -> DataFrame:
    """Only the newest snapshot's row of each path.

    A path has at most one row per snapshot, so no window grows large.
    """
    newest = Window.partitionBy("path").orderBy(F.desc("snapshot_time"), F.desc("snapshot_id"))
    return matches.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def _change(older_hit: Column, newer_hit: Column, changed: Column) -> Column:
    return (F.when(~older_hit, "CREATE").when(~newer_hit, "DELETE").when(changed, "MODIFY"))


def change_token(older: DataFrame, newer: DataFrame) -> list[str]:
    """What tells versions of a file apart: its data revision, else its size and times, as far as both tables have them."""
    both = set(older.columns) & set(newer.columns)
    if "data_revision" in both:
        return ["data_revision"]
    return [c for c in ("size", "modification_time", "change_time") if c in both]


def tree_diff(older: DataFrame, newer: DataFrame, token: Sequence[str] | None = None,
              collapse: bool = True) -> DataFrame:
    """(op, path) between two trees, as a net comparison of the end points.

    A file is modified if its ``token`` columns differ (``change_token`` if none
    are given), so an edit that keeps the size is seen.

    A directory's path ends in ``/``.  When collapsing, a created or deleted
    directory stands for its descendants.  In a tree every descendant of a new
    directory is new as well, so testing the immediate parent is enough.  A
    path that changes its type is deleted and created.
    """
    columns = [F.col("path"), F.col("type"), F.struct(*(token or change_token(older, newer))).alias("token")]
    old = older.select(*columns).withColumn("o", F.lit(True))
    new = newer.select(*columns).withColumn("n", F.lit(True))
    both = old.alias("a").join(new.alias("b"), "path", "full")
    in_old, in_new = F.col("a.o").isNotNull(), F.col("b.n").isNotNull()
    retyped = in_old & in_new & (F.col("a.type") != F.col("b.type"))
    op = F.when(retyped, F.array(F.lit("DELETE"), F.lit("CREATE"))).otherwise(
        F.array(_change(in_old, in_new, (F.col("b.type") != C.DIRECTORY)
                        & ~F.col("a.token").eqNullSafe(F.col("b.token")))))
    changes = both.select("path", F.explode(op).alias("op"),
                          F.col("a.type").alias("_old"), F.col("b.type").alias("_new")
                          ).where("op IS NOT NULL")
    kind = F.when(F.col("op") == "DELETE", F.col("_old")).otherwise(F.col("_new"))
    changes = changes.select("path", "op", (kind == C.DIRECTORY).alias("_dir"))
    if collapse:
        # the differences are few beside the trees, and are read three times from here on
        changes = settle(changes, "diff")
        whole = changes.where(F.col("_dir") & (F.col("op") != "MODIFY")).select(
            F.concat_ws(":", "op", "path").alias("_key"))
        changes = lookup_join(changes, whole, F.concat_ws(":", F.col("op"), paths.parent(F.col("path"))),
                              "_key", "anti")
    return changes.select("op", F.when(F.col("_dir"), F.concat("path", F.lit("/")))
                          .otherwise(F.col("path")).alias("path"))


def expand_diff(changes: DataFrame, older: DataFrame, newer: DataFrame) -> DataFrame:
    """Undo the collapse: one row for every created, deleted or modified object."""
    # both trees go through one join, kept apart by the kind of change as a top directory
    def marked(tree: DataFrame, op: str) -> DataFrame:
        return tree.select(F.concat(F.lit(f"/{op}"), "path").alias("path"), "type")

    trees = marked(newer, "CREATE").unionByName(marked(older, "DELETE"))
    whole = F.col("path").endswith("/") & (F.col("op") != "MODIFY")
    roots = changes.where(whole).select(F.concat(F.lit("/"), "op", "path").alias("path"))
    inside = nearest_above(trees, roots)
    path = F.substr(F.col("path"), F.lit(len("/CREATE") + 1))
    members = inside.select(
        F.substring("path", 2, len("CREATE")).alias("op"),
        F.when(F.col("type") == C.DIRECTORY, F.concat(path, F.lit("/"))).otherwise(path).alias("path"))
    return changes.where(~whole).select("op", "path").unionByName(members)


def asof_versions(history: DataFrame, moments: DataFrame) -> DataFrame:
    """The version of each path in force at each moment.

    ``history`` has one row per change (path, seq, op, version); ``moments`` is
    the short list of snapshot positions (seq).  Each version is valid until the
    path's next change, and is repeated for the moments inside that interval, so
    the rows are never paired with each other.
    """
    following = F.lead("seq").over(Window.partitionBy("path").orderBy("seq"))
    positions = F.array_sort(F.collect_set("seq"))
    listed = moments.agg(positions.alias("_p")).scalar()
    valid = (history.withColumn("_next", following).where("op <> 'DELETE'")
             .withColumn("_all", listed))
    inside = F.filter("_all", lambda s: (s >= F.col("seq")) & (F.col("_next").isNull() | (s < F.col("_next"))))
    return valid.select("path", "version", F.explode(inside).alias("seq"))


def incremental_search(base: DataFrame, changes: DataFrame, changed_rows: DataFrame,
                       moments: DataFrame, test: Column) -> DataFrame:
    """Search many snapshots by reading the oldest in full and then only changes.

    ``base`` is the oldest tree (seq of its snapshot), ``changes`` the diffs of
    consecutive snapshots (seq, op, path) and ``changed_rows`` the rows of the
    created and modified paths at that snapshot.  The result equals a search of
    every snapshot.
    """
    columns = [c for c in base.columns if c not in ("path", "seq")]
    version = F.struct(*columns).alias("version")
    start = base.select("path", "seq", F.lit("CREATE").alias("op"), version)
    gone = changes.where("op = 'DELETE'").select(
        "path", "seq", "op", F.lit(None).cast(start.schema["version"].dataType).alias("version"))
    fresh = changed_rows.select("path", "seq", F.lit("CREATE").alias("op"), version)
    state = asof_versions(start.unionByName(fresh).unionByName(gone), moments)
    return state.select("path", "seq", "version.*").where(test)
