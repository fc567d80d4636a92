"""Table schemas: the raw wire form of an inventory and its typed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from treecensus import constants as C
from treecensus.functions import paths

S, B = T.StringType(), T.BooleanType()


def _struct(names, kind=S) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


DETAILS = _struct(("id_type", "id_value", "auth_id"))
MAJOR_MINOR = _struct(("major", "minor"), T.IntegerType())
EXTENDED = _struct(C.ATTRIBUTES, B)
NESTED = {
    "owner_details": DETAILS,
    "group_details": DETAILS,
    "major_minor_numbers": MAJOR_MINOR,
    "extended_attributes": EXTENDED,
}
NUMBERS = ("file_number", "size", "blocks", "datablocks", "metablocks", "num_links",
           "child_count", "data_revision", "user_metadata_revision")

# Wire numbers come as strings or numbers; both are read as text and then try_cast.
RAW = T.StructType(
    [T.StructField(n, NESTED.get(n, S)) for n in C.EXPORT_COLUMNS]
    + [T.StructField("symlink_target", S), T.StructField("_corrupt", S)])


def typed(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Raw rows as typed inventory rows; unreadable values become null, never an error.

    ``bad_blocks`` remembers that a block count was present but unreadable: the
    owner report counts such a row as zero bytes.
    """
    def column(name: str) -> Column:
        if name == "name":
            return paths.basename(F.col("path"))
        if name == "path":
            bare = paths.clean(F.col("path"))
            return F.when(F.length(bare) > 0, bare).otherwise(F.col("path"))
        if name in NUMBERS:
            return F.col(name).try_cast("bigint")
        if name in C.TIME_FIELDS:
            return F.col(name).try_cast("timestamp")
        return F.col(name)

    bad = F.lit(False)
    for name in ("datablocks", "metablocks"):
        bad = bad | (F.col(name).isNotNull() & F.col(name).try_cast("bigint").isNull())
    return raw.where(F.length("path") > 0).select(
        *[column(n).alias(n) for n in C.EXPORT_COLUMNS], "symlink_target", *extra, bad.alias("bad_blocks"))


def wire_time(moment: Column) -> Column:
    """Timestamp as ``2025-11-06T21:02:43.123456000Z``."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def wire(entries: DataFrame, columns=C.EXPORT_COLUMNS) -> DataFrame:
    """Typed rows back in wire form; columns the table lacks are null."""
    def column(name: str) -> Column:
        if name not in entries.columns:
            return F.lit(None).cast(NESTED.get(name, S))
        if name in C.TIME_FIELDS:
            return wire_time(F.col(name))
        if name in NUMBERS:
            return F.col(name).cast("string")
        return F.col(name)
    return entries.select(*[column(n).alias(n) for n in columns])
