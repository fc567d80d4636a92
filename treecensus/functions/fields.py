"""Choosing and shaping output columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from treecensus import constants as C
from treecensus.functions import times
from treecensus.options import field_paths


def pick(df: DataFrame, path: str) -> Column:
    """A column by dotted path; null when the table has no such column."""
    here: T.DataType = df.schema
    found: Column | None = None
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.fieldNames():
            return F.lit(None).cast("string")
        found = F.col(f"`{part}`") if found is None else found[part]
        here = here[part].dataType
    return found


def select_fields(df: DataFrame, fields: str) -> DataFrame:
    """Project a comma list of fields, in its order."""
    return df.select(*[pick(df, path).alias(name) for name, path in field_paths(fields)])


def detail_fields(fields: str | None, directories: bool = False) -> str:
    """Field list of a detail listing."""
    if fields is None or not fields.strip():
        return ",".join(C.DIRECTORY_DETAIL_FIELDS if directories else C.DETAIL_FIELDS)
    if fields.strip().lower() != "all":
        return fields
    return ",".join(C.EXPORT_COLUMNS + (("capacity",) if directories else ()))


def epoch_times(df: DataFrame) -> DataFrame:
    """The four time columns as whole epoch seconds."""
    return df.withColumns({c: times.epoch(F.col(c)) for c in C.TIME_FIELDS if c in df.columns})


def attr_names(attributes: Column) -> Column:
    """Names of the attributes that are set, in canonical order."""
    return F.filter(
        F.array(*[F.when(attributes[a] == F.lit(True), F.lit(a)) for a in C.ATTRIBUTES]),
        lambda x: x.isNotNull())
