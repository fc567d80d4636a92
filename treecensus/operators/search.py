"""Search options compiled to one Column predicate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import identities, paths, patterns, times
from treecensus.functions.fields import pick
from treecensus.operators import joins
from treecensus.operators.hierarchy import directory_aggregates
from treecensus.options import OptionError, size_bytes
from treecensus.workspace import settle


@dataclass(frozen=True)
class Search:
    """All filters are ANDed; an absent or zero option filters nothing."""

    #: The moment that ages count back from; the time of the search if empty.
    as_of: datetime | str = ""
    type: str | None = None
    file_only: bool = False
    names: Sequence[str] = ()
    names_all: Sequence[str] = ()
    names_not: Sequence[str] = ()
    pattern_mode: str = patterns.AUTO
    case_sensitive: bool = False
    larger_than: str | int | None = None
    smaller_than: str | int | None = None
    include_metadata: bool = False
    older_than: float | None = None
    newer_than: float | None = None
    time_field: str = "modification_time"
    ages: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    between: tuple[str, str, str] | None = None
    owners: Sequence[str] | None = None
    attributes_true: Sequence[str] = ()
    attributes_false: Sequence[str] = ()
    root: str = "/"
    max_depth: int | None = None
    omit_subdirs: Sequence[str] = ()
    omit_mode: str = patterns.AUTO
    omit_paths: Sequence[str] = ()
    where: Column | str | None = None


def _all(parts: list[Column]) -> Column:
    kept = F.lit(True)
    for part in parts:
        kept = kept & part
    return kept


def name_test(opts: Search, name: Column, match: Callable[..., Column] | None = None) -> list[Column]:
    match = match or partial(patterns.match_any, name)
    mode, case = opts.pattern_mode, opts.case_sensitive
    tests = []
    if opts.names_not:
        tests.append(~match(opts.names_not, mode, case))
    if opts.names:
        tests.append(match(opts.names, mode, case))
    tests += [match((p,), mode, case) for p in opts.names_all]
    return tests


def size_test(opts: Search, size: Column, metablocks: Column) -> list[Column]:
    if opts.include_metadata:
        size = size + F.coalesce(metablocks, F.lit(0)) * C.BLOCK
    tests = []
    if opts.larger_than:
        tests.append(size > size_bytes(opts.larger_than))
    if opts.smaller_than:
        tests.append(size < size_bytes(opts.smaller_than))
    return tests


def age_test(moment: Column, as_of: datetime, older: float | None, newer: float | None) -> list[Column]:
    """Ages strictly between two day counts; both given must leave a gap."""
    if older and newer and newer <= older:
        raise OptionError("newer-than must be larger than older-than")
    tests = []
    if older:
        tests.append(times.before(moment, as_of - timedelta(days=older)))
    if newer:
        tests.append(times.after(moment, as_of - timedelta(days=newer)))
    return tests


def omitted(opts: Search, path: Column, kind: Column) -> list[Column]:
    """Tests that hold for rows inside (or being) an omitted directory."""
    tests = []
    for text in opts.omit_paths:
        bare = text.rstrip("/")
        if bare and (opts.root == "/" or bare.startswith(paths.root_text(opts.root) + "/")):
            tests.append(path.startswith(bare + "/") | ((path == bare) & (kind == C.DIRECTORY)))
    if opts.omit_subdirs:
        regexes = [
            "(?dU)" + patterns.java_regex(p.rstrip("/")) if opts.omit_mode == patterns.REGEX
            else f"(?s)\\A(?:{patterns.glob_body(p.rstrip('/'))})\\z" for p in opts.omit_subdirs]
        root = paths.root_text(opts.root)
        dirs = F.when(kind == C.DIRECTORY, paths.ancestors_or_self(path, root)).otherwise(
            paths.ancestors(path, root))

        def hit(d: Column) -> Column:
            found = F.lit(False)
            for regex in regexes:
                found = found | d.rlike(regex) | paths.basename(d).rlike(regex)
            return found

        tests.append(F.exists(dirs, hit))
    return tests


def predicate(entries: DataFrame, opts: Search, match: Callable[..., Column] | None = None) -> Column:
    """The search as one expression over an inventory table; ``match`` may test names in another way than one by one."""
    path, kind = F.col("path"), F.col("type")
    # one moment for all ages of a search: now, if none is given
    as_of = times.utc(opts.as_of or datetime.now(timezone.utc))
    tests: list[Column] = []
    root = paths.root_text(opts.root)
    if root != "/":
        # a root that is itself a file or a symlink is the only match; the plain
        # prefix test is implied by the other one, and is the part a scan can use
        tests.append(path.startswith(root))
        tests.append(paths.below(path, root) | ((path == root) & (kind != C.DIRECTORY)))
    if opts.type:
        tests.append(kind == C.TYPE_WORDS[opts.type])
    if opts.file_only:
        tests.append(kind != C.DIRECTORY)
    tests += name_test(opts, paths.basename(path), match)
    tests += size_test(opts, F.col("size"), pick(entries, "metablocks"))
    if opts.older_than or opts.newer_than:
        tests += age_test(F.col(opts.time_field), as_of, opts.older_than, opts.newer_than)
    for column, (older, newer) in opts.ages.items():
        tests += age_test(F.col(column), as_of, older, newer)
    if opts.between:
        column, start, end = opts.between
        tests += [F.col(column) > times.literal(times.utc(start)),
                  F.col(column) < times.literal(times.utc(end))]
    if opts.owners is not None:
        tests.append(owner_column(entries).isin(*opts.owners) if opts.owners else F.lit(False))
    tests += [F.col("extended_attributes")[a].eqNullSafe(F.lit(True)) for a in opts.attributes_true]
    tests += [F.col("extended_attributes")[a].eqNullSafe(F.lit(False)) for a in opts.attributes_false]
    if opts.max_depth is not None and opts.max_depth >= 0:
        tests.append(paths.depth(path) - paths.root_depth(root) <= opts.max_depth)
    tests += [~t for t in omitted(opts, path, kind)]
    if opts.where is not None:
        tests.append(F.expr(opts.where) if isinstance(opts.where, str) else opts.where)
    return _all(tests)


def owner_column(entries: DataFrame, what: str = "owner") -> Column:
    """The id an object is matched by, from ``<what>_details`` or ``<what>``."""
    plain = F.col(what)
    if f"{what}_details" in entries.columns:
        return identities.owner_key(F.col(f"{what}_details"), plain)
    return identities.filled(plain)


def search(entries: DataFrame, opts: Search) -> DataFrame:
    return entries.where(predicate(entries, opts))


def owner_semi_join(entries: DataFrame, ids: DataFrame, key: str = "auth_id") -> DataFrame:
    """Objects of a set of owners given as a table; an empty table matches nothing."""
    return joins.lookup_join(entries, ids.select(key).distinct(), owner_column(entries), key, "semi")


def omit_anti_join(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Drop listed directories with everything beneath; for lists too long for ``omit_paths``."""
    # a listed directory counts as lying in itself, so one join finds it and its content
    home = F.when(F.col("type") == C.DIRECTORY, paths.clean(F.col("path"))).otherwise(paths.parent(F.col("path")))
    return joins.beneath(entries, directories, how="anti", home=home)


def big_directories(entries: DataFrame, limit: int, root: str = "/",
                    root_exempt: bool = False, least_depth: int = 0) -> DataFrame:
    """Topmost directories with more than ``limit`` objects at any depth below.

    Directories less deep than ``least_depth`` (a path of one name has depth 1) are always entered.
    """
    root = paths.root_text(root)
    totals = directory_aggregates(entries, root)
    big = totals.where(F.col("total_files") + F.col("total_directories") > limit)
    if root_exempt:
        big = big.where(F.col("path") != root)
    if least_depth:
        big = big.where(paths.depth(F.col("path")) >= least_depth)
    big = settle(big, "big")
    return joins.beneath(big, big.select(F.col("path").alias("_b")), key="_b", how="anti")


def skip_big_directories(entries: DataFrame, limit: int, root: str = "/",
                         root_exempt: bool = False, least_depth: int = 0) -> DataFrame:
    """Rows that a walk reaches when it does not enter directories over the limit."""
    root = paths.root_text(root)
    inside = entries.where(paths.below(F.col("path"), root))
    return joins.beneath(inside, big_directories(inside, limit, root, root_exempt, least_depth), how="anti")


def skip_summary(skipped: DataFrame) -> DataFrame:
    """What was avoided by not entering directories (rows of ``directory_aggregates``)."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias("skipped_" + name.removeprefix("total_"))
    return skipped.agg(F.count("*").alias("skipped_roots"), total("total_files"),
                       total("total_directories"))


def find_tagged(entries: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Objects with a tag; without key and value any tag counts."""
    tags = F.col("tags")
    if key is not None:
        found = F.map_contains_key(tags, key)
        if value is not None:
            found = found & (F.try_element_at(tags, F.lit(key)) == value)
    elif value is not None:
        found = F.exists(F.map_values(tags), lambda v: v == value)
    else:
        found = F.size(tags) > 0
    return entries.where(F.coalesce(found, F.lit(False)))
