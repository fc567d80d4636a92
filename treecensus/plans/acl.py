"""Plans that change access-control lists, owners and groups."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import aces as A, paths
from treecensus.operators.joins import lookup_join
from treecensus.operators.search import owner_column
from treecensus.workspace import settle


def _scope(objects: DataFrame, root: str, propagate: bool) -> DataFrame:
    """The root object, and everything below it when propagating."""
    root = paths.root_text(root)
    own = F.col("path") == root
    return objects.where(own | paths.below(F.col("path"), root) if propagate else own)


def _plan(objects: DataFrame, after: Column) -> DataFrame:
    rows = objects.withColumn("after", after)
    changed = ~F.col("acl").eqNullSafe(F.col("after"))
    return rows.select(
        "path", F.when(changed, "change").otherwise("unchanged").alias("action"),
        F.col("acl").alias("before"), "after")


def edit_aces(objects: DataFrame, edit: A.Edit, matched: Callable[[Column], Column] | None = None,
              root: str = "/", propagate: bool = True) -> DataFrame:
    """Edit each object's own list and put it in canonical order.

    An inherited entry that the edit matches on the root object breaks
    inheritance there first: the list is protected and all its entries become
    explicit.  Objects below keep their flags.
    """
    acl = F.col("acl")
    breaks = F.lit(False)
    if matched is not None:
        breaks = (F.col("path") == paths.root_text(root)) & F.exists(
            acl["aces"], lambda a: matched(a) & A.is_inherited(a))
    start = F.when(breaks, A.disable_inheritance(acl)).otherwise(acl)
    # a column per step: array functions are dear, and each is then computed once
    rows = (_scope(objects, root, propagate).withColumn("_start", start)
            .withColumn("_aces", edit(F.col("_start")["aces"])))
    # an edit without effect must not reorder a list
    result = F.when(F.col("_aces").eqNullSafe(acl["aces"]), acl).otherwise(
        F.col("_start").withField("aces", A.canonical(F.col("_aces"))))
    return _plan(rows, result)


def disable_inheritance(objects: DataFrame, remove_inherited: bool = False, root: str = "/",
                        propagate: bool = True) -> DataFrame:
    """Plan to stop inheriting; ``left_empty`` marks objects that lose all entries."""
    plan = _plan(_scope(objects, root, propagate), A.disable_inheritance(F.col("acl"), remove_inherited))
    return plan.withColumn("left_empty", (F.size("after.aces") == 0) & (F.size("before.aces") > 0))


def set_mode(objects: DataFrame, mode: str, owner: str | None = None, group: str | None = None,
             kind: str | None = None, root: str = "/", propagate: bool = True) -> DataFrame:
    """Replace lists by an octal mode, optionally with a new owner and group."""
    rows = _scope(objects, root, propagate)
    if kind is not None:
        rows = rows.where(F.col("type") == C.TYPE_WORDS[kind])
    after = A.from_mode(mode, F.col("type") == C.DIRECTORY, owner, group)
    rows = rows.withColumns({
        "after": after,
        "new_owner": F.lit(owner) if owner else F.col("owner"),
        "new_group": F.lit(group) if group else F.col("group")})
    changed = (~F.col("acl").eqNullSafe(F.col("after")) | ~F.col("owner").eqNullSafe(F.col("new_owner"))
               | ~F.col("group").eqNullSafe(F.col("new_group")))
    return rows.select("path", F.when(changed, "change").otherwise("unchanged").alias("action"),
                       F.col("acl").alias("before"), "after", "new_owner", "new_group")


def copy_acl(objects: DataFrame, source: str, target: str, propagate: bool = True,
             copy_owner: bool = False, copy_group: bool = False, only_ownership: bool = False) -> DataFrame:
    """Give a target (and its subtree) the list of one source object.

    Objects below the target get every entry marked as inherited.  A source
    that does not exist is an error: it has no list to give.
    """
    template = objects.where(F.col("path") == paths.root_text(source)).select(
        F.struct("acl", "owner", "group")).scalar()
    missing = F.raise_error(F.lit(f"no object to copy a list from: {source}"))
    rows = _scope(objects, target, propagate).withColumn("_tpl", F.when(template.isNull(), missing).otherwise(template))
    given = F.col("_tpl.acl")
    own = F.col("path") == paths.root_text(target)
    marked = given.withField("aces", A.mark_inherited(given["aces"]))
    after = F.col("acl") if only_ownership else F.when(own, given).otherwise(marked)
    rows = rows.withColumns({
        "after": after,
        "new_owner": F.col("_tpl.owner") if copy_owner else F.col("owner"),
        "new_group": F.col("_tpl.group") if copy_group else F.col("group")})
    changed = (~F.col("acl").eqNullSafe(F.col("after")) | ~F.col("owner").eqNullSafe(F.col("new_owner"))
               | ~F.col("group").eqNullSafe(F.col("new_group")))
    return rows.select("path", F.when(changed, "change").otherwise("unchanged").alias("action"),
                       F.col("acl").alias("before"), "after", "new_owner", "new_group")


def _mapping(table: DataFrame) -> DataFrame:
    """The rows of a mapping that map something, one a source; a source with two targets is an error."""
    found = table.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source").agg(
        F.min("target").alias("target"), F.max("target").alias("_other"))
    twice = F.raise_error(F.concat(F.lit("a source is mapped to two targets: "), "source"))
    return found.select("source", F.when(F.col("target") == F.col("_other"), F.col("target")).otherwise(twice).alias("target"))


#: Rows of a mapping that may stand in the plan as one value.
MOST_MAPPED = 5_000
#: Entries that share a slot of such a value; a map is searched one by one.
IN_A_SLOT = 4


def _used(mapping: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows of a long mapping whose source is a trustee of some object, found per distinct trustee."""
    trustees = objects.select(F.explode("acl.aces.trustee").alias("source")).distinct()
    return mapping.join(trustees, "source", "left_semi")


def _in_the_row(mapping: DataFrame, target: str) -> Callable[[Column], Column] | None:
    """A lookup of ``target`` by source as one constant of the plan; None if the mapping has too many rows.

    At most ``MOST_MAPPED`` rows and one come to the driver.  The constant is a list of small maps, and the
    hash of a source says which of them has it, so a lookup costs the same for any mapping that fits.
    """
    kind = mapping.schema[target].dataType.simpleString()
    rows = mapping.limit(MOST_MAPPED + 1)
    n = rows.count()
    if n > MOST_MAPPED:
        return None
    slots = max(1, n // IN_A_SLOT)

    def slot(source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(slots)).cast("int")

    held = [{} for _ in range(slots)]
    for source, value, at in rows.select("source", target, slot(F.col("source"))).collect():
        held[at][source] = value
    whole = F.from_json(F.lit(json.dumps(held)), f"array<map<string,{kind}>>")
    return lambda source: F.try_element_at(F.get(whole, slot(source)), source)


def _short(mapping: DataFrame, objects: DataFrame, target: str) -> tuple[Callable[[Column], Column] | None, DataFrame]:
    """A lookup in the row, if the mapping or what the objects use of it is short enough, and the rows it needs."""
    found = _in_the_row(mapping, target)
    if found is None:
        mapping = settle(_used(mapping, objects), "used")
        found = _in_the_row(mapping, target)
    return found, mapping


def migrate_trustees(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace trustees in place; type, flags, rights and order of entries stay.

    A short mapping is a constant that each row looks up, and no object moves.
    Of a long one only the sources in use count.  If these are too many as well,
    their trustees are joined with them and looked up by position afterwards; a
    list is bounded, so the regrouping is as well.  Mapping rows without a source or a
    target map nothing.  Paths are unique.
    """
    acl = F.col("acl")
    found, table = _short(settle(_mapping(mapping), "mapping"), objects, "target")
    if found is not None:
        aces = F.transform(acl["aces"], lambda a: a.withField("trustee", F.coalesce(found(a["trustee"]), a["trustee"])))
        return _plan(objects, F.when(F.size(acl["aces"]) > 0, acl.withField("aces", aces)).otherwise(acl))
    # only the first entry carries the list, so it is shuffled once an object
    entries = (objects.select("path", "acl", F.posexplode_outer("acl.aces.trustee").alias("pos", "trustee"))
               .withColumn("acl", F.when(F.coalesce("pos", F.lit(0)) == 0, acl)))
    renamed = lookup_join(entries, table, F.col("trustee"), "source")
    # objects without entries have one row without a position, which is not collected
    rows = renamed.groupBy("path").agg(F.any_value("acl", True).alias("acl"), F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", "target")))).alias("_all"))
    done = acl.withField("aces", F.transform(acl["aces"], lambda a, i: a.withField(
        "trustee", F.coalesce(F.get("_all", i)["target"], a["trustee"]))))
    return _plan(rows, F.when(F.size("_all") > 0, done).otherwise(acl))


_PAIRS = "array<struct<source:string,target:string>>"


def clone_from_map(objects: DataFrame, mapping: DataFrame, sync: bool = False) -> DataFrame:
    """Bulk form of cloning: every (source, target) row whose source has an entry.

    The rows that matter for an object are looked up in the row where the mapping,
    or what the objects use of it, is short, and are joined with its entries
    otherwise.  Copies are taken from the list as it was, so mappings are never
    chained; a type that a target has by then is left alone.  Mapping rows
    without a source or a target map nothing.
    """
    trustees = F.array_distinct(F.transform("acl.aces", lambda a: a["trustee"]))
    pairs = settle(mapping.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "mapping")
    found = None
    if not pairs.isEmpty():
        if pairs.limit(MOST_MAPPED + 1).count() > MOST_MAPPED:
            pairs = settle(_used(pairs, objects), "used")
        if pairs.limit(MOST_MAPPED + 1).count() <= MOST_MAPPED:
            found = _in_the_row(pairs.groupBy("source").agg(F.collect_list("target").alias("targets")), "targets")
    if found is not None:
        none = F.array().cast(_PAIRS)
        each = F.transform(trustees, lambda t: F.coalesce(F.transform(
            found(t), lambda x: F.struct(t.alias("source"), x.alias("target"))), none))
        rows = objects.withColumn("_pairs", F.array_sort(F.flatten(each)))
    else:
        entries = objects.select("path", F.explode(trustees).alias("trustee"))
        joined = (lookup_join(entries, pairs, F.col("trustee"), "source", "inner")
                  .groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("trustee").alias("source"), "target"))).alias("_pairs")))
        rows = objects.join(joined, "path", "left")
    aces = F.aggregate(
        F.col("_pairs"), F.col("acl.aces"),
        lambda done, pair: A.clone(pair["source"], pair["target"], sync)(done, F.col("acl.aces")))
    after = F.when(F.coalesce(F.size("_pairs"), F.lit(0)) > 0, F.col("acl").withField("aces", A.canonical(aces))).otherwise(F.col("acl"))
    return _plan(rows, after)


def backup(plan: DataFrame, objects: DataFrame, stamp: str) -> DataFrame:
    """Lists of the objects about to change, with the id that guards a restore."""
    touched = plan.where("action = 'change'").select("path", F.col("before").alias("acl"))
    return touched.join(objects.select("path", F.col("id").alias("file_id")), "path").select(
        "path", "file_id", "acl", F.lit(stamp).alias("timestamp"))


def common_root(path: Column) -> Column:
    """The deepest path that is, or lies above, all paths of a group: what its first and last one share."""
    first, last = (F.split(paths.clean(end), "/") for end in (F.min(path), F.max(path)))
    n = F.least(F.size(first), F.size(last))
    # in the order of texts all others lie between the first and the last, and begin with what these two share
    unlike = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.element_at(first, i).eqNullSafe(F.element_at(last, i)))
    shared = F.when(F.size(unlike) > 0, F.array_min(unlike) - 1).otherwise(n)
    text = F.array_join(F.slice(first, F.lit(1), shared), "/")
    return F.when(text == "", F.lit("/")).otherwise(text)


def restore(saved: DataFrame, objects: DataFrame, force: bool = False, target: str | None = None) -> DataFrame:
    """Put saved lists back where the file id still is the same, or anywhere when forced.

    With a ``target`` the saved tree is put there: its root goes to the target, and what lies below it goes
    below the target.  The root is the deepest path that is, or lies above, every path of the backup; a
    single object is its own root.  Rows without a path are left out.
    """
    if target is not None:
        saved = saved.where("path IS NOT NULL")
        root, to = saved.agg(common_root(F.col("path"))).scalar(), paths.root_text(target).rstrip("/")
        rest = F.expr("substr(path, length(rtrim('/', _root)) + 1)")
        moved = F.when(F.col("path") == F.col("_root"), F.lit(to or "/")).otherwise(F.concat(F.lit(to), rest))
        saved = saved.withColumn("_root", root).withColumn("path", moved).drop("_root")
    live = objects.select("path", F.col("id").alias("live_id"), F.col("acl").alias("before"))
    rows = saved.select("path", "file_id", F.col("acl").alias("after")).join(live, "path", "left")
    same = F.col("live_id") == F.col("file_id")
    action = (F.when(F.col("live_id").isNull(), "missing")
              .when(~same & ~F.lit(force), "refused")
              .when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("restore"))
    return rows.select("path", action.alias("action"), "before", "after")


def change_ownership(objects: DataFrame, mapping: DataFrame, what: str = "owner", root: str = "/",
                     propagate: bool = True) -> DataFrame:
    """Replace owners (or groups) by a mapping, one step: results are not mapped again."""
    current = owner_column(objects, what)
    rows = _scope(objects, root, propagate).withColumn("before", current)
    joined = lookup_join(rows, mapping.select("source", "target"), F.col("before"), "source")
    changed = F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("before"))
    return joined.select("path", F.when(changed, "change").otherwise("unchanged").alias("action"),
                         "before", F.coalesce("target", "before").alias("after"))
