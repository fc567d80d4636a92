"""Plans that change tags and extended attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from treecensus.options import OptionError
from treecensus import constants as C


def add_tag(objects: DataFrame, key: str, value: str, overwrite: bool = False) -> DataFrame:
    """Set a tag; another value is only replaced when asked to."""
    current = F.try_element_at(F.col("tags"), F.lit(key))
    action = (F.when(F.col("tags").isNull(), "unreadable")
              .when(current == value, "unchanged")
              .when(current.isNotNull(), F.lit("overwrite" if overwrite else "skipped_conflict"))
              .otherwise("add"))
    rest = F.map_filter("tags", lambda k, v: k != key)
    after = F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))
    return objects.select("path", action.alias("action"), F.col("tags").alias("before"), F.when(
        action.isin("add", "overwrite"), after).otherwise(F.col("tags")).alias("after"))


def remove_tag(objects: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Drop a tag, optionally only if it has this value; a missing tag is fine."""
    current = F.try_element_at(F.col("tags"), F.lit(key))
    hit = F.coalesce(current.isNotNull() if value is None else current == value, F.lit(False))
    action = (F.when(F.col("tags").isNull(), "unreadable").when(hit, "remove")
              .when(current.isNotNull(), "skipped_value").otherwise("unchanged"))
    return objects.select("path", action.alias("action"), F.col("tags").alias("before"), F.when(
        hit, F.map_filter("tags", lambda k, v: k != key)).otherwise(F.col("tags")).alias("after"))


def set_attributes(objects: DataFrame, on: Sequence[str] = (), off: Sequence[str] = ()) -> DataFrame:
    """The full set of attributes with changes merged in."""
    if set(on) & set(off):
        raise OptionError("an attribute cannot be both set and cleared")
    unknown = (set(on) | set(off)) - set(C.SETTABLE)
    if unknown:
        raise OptionError(f"cannot set {sorted(unknown)[0]!r}; choose from {', '.join(C.SETTABLE)}")
    before = F.col("extended_attributes")
    after = before
    for names, value in ((on, True), (off, False)):
        for name in names:
            after = after.withField(name, F.lit(value))
    # a flag that was never reported counts as clear
    after = F.struct(*[F.coalesce(after[a], F.lit(False)).alias(a) for a in C.ATTRIBUTES])
    changed = F.lit(False)
    for names, value in ((on, True), (off, False)):
        for name in names:
            changed = changed | ~before[name].eqNullSafe(F.lit(value))
    return objects.select("path", F.when(changed, "change").otherwise("unchanged").alias("action"),
                          before.alias("before"), F.when(changed, after).otherwise(before).alias("after"))


def find_and_set(objects: DataFrame, attribute: str, found: bool) -> DataFrame:
    """Flip an attribute where it currently is ``found``: the find and the set value are opposite."""
    hits = objects.where(F.col("extended_attributes")[attribute].eqNullSafe(F.lit(found)))
    return set_attributes(hits, off=[attribute]) if found else set_attributes(hits, on=[attribute])
