"""Writers; every one writes in parallel, one file per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import aces as A, sizes
from treecensus.functions.fields import epoch_times, pick, select_fields
from treecensus.operators.search import Search
from treecensus.schema import wire, wire_time


def path_lines(rows: DataFrame, show: Sequence[str] = (), links: bool = False) -> DataFrame:
    """One line per object: the path, then names separated by tabs."""
    path = F.col("path")
    if links:
        path = F.when(F.col("symlink_target").isNotNull(),
                      F.concat(path, F.lit(" → "), F.col("symlink_target"))).otherwise(path)
    return rows.select(F.concat_ws("\t", path, *[F.coalesce(F.col(c), F.lit("Unknown")) for c in show]).alias("value"))


def write_paths(rows: DataFrame, target: str, show: Sequence[str] = (), links: bool = False) -> None:
    path_lines(rows, show, links).write.text(target)


def write_ndjson(rows: DataFrame, target: str, columns: Sequence[str] | None = None) -> None:
    """One JSON object per line; missing values are written as null."""
    (rows if columns is None else rows.select(*columns)).write.option("ignoreNullFields", "false").json(target)


def minimal_columns(opts: Search, owner: bool = False, group: bool = False, links: bool = False) -> list[str]:
    """Columns of a plain CSV, chosen by the filters in use.

    Whichever time filter was used, the column is the search's ``time_field``.
    """
    columns = ["path"]
    if opts.older_than or opts.newer_than or any(o or n for o, n in opts.ages.values()):
        columns.append(opts.time_field)
    if opts.larger_than or opts.smaller_than:
        columns.append("size")
    return columns + [c for c, wanted in (
        ("owner", owner), ("group", group), ("symlink_target", links)) if wanted]


def _csv(rows: DataFrame, target: str) -> None:
    rows.write.csv(target, header=True, escape='"', nullValue="", emptyValue="")


def write_csv_minimal(rows: DataFrame, target: str, opts: Search, owner: bool = False, group: bool = False,
                      links: bool = False) -> None:
    def cell(name: str) -> Column:
        if name in ("owner", "group"):
            return F.coalesce(pick(rows, f"{name}_name"), F.lit("Unknown"))
        return wire_time(F.col(name)) if name in C.TIME_FIELDS else F.col(name)

    _csv(rows.select(*[cell(c).alias(c) for c in minimal_columns(opts, owner, group, links)]), target)


def flat(rows: DataFrame) -> DataFrame:
    """Structs, maps and arrays as JSON text."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("struct", "map", "array")}
    return rows.select(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if c in nested else F.col(c)
                         for c in rows.columns])


def all_columns(owner: bool = False, group: bool = False) -> list[str]:
    columns = []
    for c in C.EXPORT_COLUMNS:
        columns.append(c)
        if (c == "owner" and owner) or (c == "group" and group):
            columns.append(f"{c}_name")
    return columns


def write_csv_all(rows: DataFrame, target: str, owner: bool = False, group: bool = False) -> None:
    """Every attribute in canonical order."""
    _csv(flat(wire(rows, all_columns(owner, group))), target)


def details(rows: DataFrame, fields: str, snapshot: bool = False, unix_time: bool = False,
            human: bool = False) -> DataFrame:
    """Projection of a detail listing; sizes are only readable text in a shown table."""
    work = epoch_times(rows) if unix_time else rows
    shown = select_fields(work, ("snapshot_id," if snapshot else "") + fields)
    if human:
        shown = shown.withColumns({c: sizes.human_size(F.col(c)) for c in ("size", "capacity", "total_capacity")
                                   if c in shown.columns})
    return shown


def write_details(rows: DataFrame, target: str, fields: str, kind: str = "csv", snapshot: bool = False,
                  unix_time: bool = False) -> None:
    shown = details(rows, fields, snapshot, unix_time)
    if kind == "csv":
        _csv(flat(shown), target)
    else:
        write_ndjson(shown, target)


def acl_columns(report: DataFrame, most: int | None = None) -> DataFrame:
    """ACL report rows with one column per entry; the widest list sets their number."""
    if most is None:
        most = report.agg(F.coalesce(F.max("ace_count"), F.lit(0))).first()[0]
    return report.select(*[c for c in report.columns if c != "trustees"], *[
        F.try_element_at("trustees", F.lit(i)).alias(f"trustee_{i}") for i in range(1, most + 1)])


def write_acl_csv(report: DataFrame, target: str) -> None:
    _csv(acl_columns(report), target)


def acl_wire(acl: Column) -> Column:
    """An ACL in the nested form of an export."""
    return F.struct(acl["control"].alias("control"), acl["posix_special"].alias("posix_special_permissions"),
                    acl["aces"].cast(f"array<{A.ACE}>").alias("aces"))
