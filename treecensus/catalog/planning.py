"""Queries that return action plans for names, places, owners, tags and attributes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from treecensus import constants as C, workspace
from treecensus.catalog.data import AS_OF, Data
from treecensus.catalog.registry import query
from treecensus.functions import paths, rename
from treecensus.operators import reports, snapshots
from treecensus.operators.joins import beneath
from treecensus.operators.search import Search, search
from treecensus.plans import acl, marks, restore, transfer

# every number in a name becomes N: names of one kind collide
_COLLIDE = r"{\d+|N}"
_NEW_NAME = r"regexp_replace(name, '\d+', 'N', 'g')"
_FIRST = r"regexp_replace(name, 'order_(\d)', 'o\1_', 'g')"


@query("duplicate_targets", f"""
SELECT path, target, count(*) OVER (PARTITION BY target) > 1 AS shared
FROM (SELECT path, parent || '/' || {_NEW_NAME} AS target FROM fx_files)""")
def duplicate_targets(d: Data) -> DataFrame:
    new = rename.renamer(_COLLIDE)
    target = paths.join_path(paths.parent(F.col("path")), new(paths.basename(F.col("path"))))
    return transfer.duplicate_targets(d.files.select("path", target.alias("target")))


@query("rename_plan", f"""
WITH t AS (SELECT path, name, {_NEW_NAME} AS new_name, parent || '/' || {_NEW_NAME} AS target FROM fx_files)
SELECT path, new_name, target, CASE WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'skip_multi_source'
  ELSE 'rename' END AS action FROM t""")
def rename_plan(d: Data) -> DataFrame:
    return transfer.rename_plan(d.files, rename.renamer(_COLLIDE), d.live)


@query("rename_plan_existing", r"""
WITH t AS (SELECT path, name, k, parent, CASE WHEN regexp_matches(name, '^order_.*1\.log$')
  THEN 'order_' || regexp_extract(name, '^order_(.*)1\.log$', 1) || '0' END AS new_name FROM fx_files),
u AS (SELECT t.*, CASE WHEN new_name IS NOT NULL THEN parent || '/' || new_name END AS target FROM t)
SELECT u.path, new_name, target, CASE WHEN new_name IS NULL THEN 'skip_no_name'
  WHEN l.path IS NOT NULL THEN 'overwrite' ELSE 'rename' END AS action
FROM u LEFT JOIN fx_live l ON l.path = u.target""")
def rename_plan_existing(d: Data) -> DataFrame:
    new = rename.renamer("order_*0", ["order_*1.log"])
    return transfer.rename_plan(d.files, new, d.live, clobber=True)


@query("dest_collision", """
SELECT f.path, a.path AS target, a.type AS dest_type, a.size AS dest_size
FROM fx_files f LEFT JOIN fx_archive a ON a.path = '/archive/' || f.name""")
def dest_collision(d: Data) -> DataFrame:
    rows = d.files.select("path", F.concat(F.lit("/archive/"), paths.basename(F.col("path"))).alias("target"))
    return transfer.destination(rows, d.live).select(
        "path", F.when(F.col("dest_type").isNotNull(), F.col("target")).alias("target"), "dest_type", "dest_size")


@query("move_plan", """
SELECT f.path, '/archive/' || f.name AS target, CASE WHEN a.path IS NOT NULL THEN 'skip_exists' ELSE 'move' END AS action
FROM fx_files f LEFT JOIN fx_archive a ON a.path = '/archive/' || f.name
UNION ALL SELECT path, NULL, 'skip_directory' FROM fx_dirs""")
def move_plan(d: Data) -> DataFrame:
    return transfer.transfer_plan(d.entries, "/archive/", d.live)


@query("move_plan_renamed", f"""
WITH t AS (SELECT path, '/archive/' || {_FIRST} AS target FROM fx_files WHERE starts_with(path, '/ASIA/'))
SELECT path, target, CASE WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'skip_multi_source' ELSE 'move' END AS action FROM t""")
def move_plan_renamed(d: Data) -> DataFrame:
    found = search(d.files, Search(root="/ASIA"))
    return transfer.transfer_plan(found, "/archive", d.live, rename=rename.renamer(r"{order_(\d)|o\1_}"), clobber=True)


_CHOSEN = r"(depth = 3 AND regexp_matches(path, '/MACHINERY$') OR depth = 4 AND regexp_matches(path, '/cust_1[0-9]*$'))"


@query("prune_nested", f"""
WITH s AS (SELECT path FROM fx_dirs WHERE {_CHOSEN})
SELECT path, NOT EXISTS (SELECT 1 FROM s p WHERE starts_with(s.path, p.path || '/')) AS travels FROM s""")
def prune_nested(d: Data) -> DataFrame:
    found = _chosen(d)
    kept = beneath(found, found.select(F.col("path").alias("_d")), key="_d", how="anti").select(
        "path", F.lit(True).alias("travels"))
    return found.select("path").join(kept, "path", "left").select(
        "path", F.coalesce("travels", F.lit(False)).alias("travels"))


def _chosen(d: Data) -> DataFrame:
    level = paths.depth(F.col("path"))
    name = paths.basename(F.col("path"))
    return search(d.entries, Search(type="dir", where=((level == 3) & (name == "MACHINERY"))
                                    | ((level == 4) & name.rlike("^cust_1[0-9]*$"))))


_COPY = f"""s AS (SELECT path, name, depth FROM fx_dirs WHERE {_CHOSEN}),
t AS (SELECT path, CASE WHEN EXISTS (SELECT 1 FROM s p WHERE starts_with(s.path, p.path || '/')) THEN 'pruned' END AS problem,
  '/copies/' || name AS target FROM s),
u AS (SELECT path, CASE WHEN problem IS NULL THEN target END AS target, problem FROM t),
p AS (SELECT path, target, CASE WHEN problem IS NOT NULL THEN problem
  WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'skip_multi_source' ELSE 'copy' END AS action FROM u)"""


@query("copy_plan", f"WITH {_COPY} SELECT path, target, action FROM p")
def copy_plan(d: Data) -> DataFrame:
    return transfer.transfer_plan(_chosen(d), "/copies", d.live, "copy", include_directories=True)


@query("copy_plan_tree", f"""
WITH {_COPY}, e AS (SELECT u.entry AS path, u.path AS top, u.type FROM fx_entry_up u WHERE u.depth > 0
  UNION ALL SELECT path, path, type FROM fx_dirs)
SELECT e.path, e.type, p.target || substring(e.path, length(p.path) + 1) AS target
FROM e JOIN p ON p.path = e.top WHERE p.action = 'copy'""")
def copy_plan_tree(d: Data) -> DataFrame:
    plan = workspace.settle(transfer.transfer_plan(
        _chosen(d), "/copies", d.live, "copy", include_directories=True), "plan")
    return transfer.expand_directories(plan, d.entries)


@query("copy_from_snapshot", """
SELECT s.path, '/archive/' || regexp_extract(s.path, '[^/]*$') AS target,
  CASE WHEN a.path IS NULL THEN 'copy' ELSE 'overwrite' END AS action
FROM fx_snap s LEFT JOIN fx_archive a ON a.path = '/archive/' || regexp_extract(s.path, '[^/]*$')
WHERE snapshot_id = 2 AND s.size > 30000000""")
def copy_from_snapshot(d: Data) -> DataFrame:
    found = d.snapshot(2).where("size > 30000000")
    return transfer.transfer_plan(found, "/archive", d.live, "copy", clobber=True)


_SYNC = """SELECT f.path, '/archive/' || f.name AS target, CASE WHEN a.path IS NULL THEN 'copy_new'
  WHEN a.size = f.size AND a.modification_time = f.modification_time THEN 'skip_unchanged' ELSE 'copy_changed' END AS action
FROM fx_files f LEFT JOIN fx_archive a ON a.path = '/archive/' || f.name"""


@query("sync_plan", _SYNC)
def sync_plan(d: Data) -> DataFrame:
    return transfer.sync_plan(d.files, "/archive", d.live)


@query("unchanged_join", f"SELECT path, target FROM ({_SYNC}) WHERE action = 'skip_unchanged'")
def unchanged_join(d: Data) -> DataFrame:
    return transfer.sync_plan(d.files, "/archive", d.live).where("action = 'skip_unchanged'").select("path", "target")


@query("plan_summary", f"SELECT action, count(*) AS objects FROM ({_SYNC}) GROUP BY action")
def plan_summary(d: Data) -> DataFrame:
    return reports.plan_summary(transfer.sync_plan(d.files, "/archive", d.live))


@query("preserve_columns", """
SELECT f.path, owner, grp, CAST(epoch(f.modification_time) AS BIGINT) AS modification_time,
  CAST(epoch(f.access_time) AS BIGINT) AS access_time, attr_hidden AS hidden
FROM fx_files f LEFT JOIN fx_archive a ON a.path = '/archive/' || f.name WHERE a.path IS NULL""")
def preserve_columns(d: Data) -> DataFrame:
    plan = transfer.transfer_plan(d.files, "/archive", d.live, "copy").where("action = 'copy'")
    kept = transfer.preserve(plan, d.objects, "all")
    assert "change_time" not in kept.columns
    return kept.select("path", "owner", F.col("group").alias("grp"), F.unix_seconds("modification_time").alias(
        "modification_time"), F.unix_seconds("access_time").alias("access_time"), "extended_attributes.hidden")


@query("missing_dirs", """
SELECT DISTINCT array_to_string(string_split(t, '/')[1:u.i + 1], '/') AS path
FROM (SELECT '/backup/2002/' || r_name || '/' || c_mktsegment || '/x' AS t FROM fx_files
      UNION SELECT path FROM fx_files),
  LATERAL (SELECT unnest(range(1, len(string_split(t, '/')) - 1)) AS i) u
WHERE array_to_string(string_split(t, '/')[1:u.i + 1], '/') NOT IN (SELECT path FROM fx_dirs)""")
def missing_dirs(d: Data) -> DataFrame:
    part = F.split("path", "/")
    moved = F.concat_ws("/", F.lit("/backup/2002"), part[1], part[3], paths.basename(F.col("path")))
    targets = d.files.select(moved.alias("target")).unionByName(d.files.select(F.col("path").alias("target")))
    return transfer.missing_directories(targets, d.entries)


_LIVE0 = "(SELECT path FROM fx_snap WHERE snapshot_id = 0)"


@query("restore_plan", f"""
SELECT path, CASE WHEN path IN {_LIVE0} THEN 'rename_on_conflict' ELSE 'recreate' END AS action,
  CASE WHEN path NOT IN {_LIVE0} THEN path WHEN contains(path, '.') THEN
    regexp_replace(path, '\\.([a-z]*)$', '_restored_2002-01-01_00-00-00.\\1')
  ELSE path || '_restored_2002-01-01_00-00-00' END AS target
FROM fx_snap WHERE snapshot_id = 2""")
def restore_plan(d: Data) -> DataFrame:
    suffix = rename.suffix_text(datetime.fromisoformat(AS_OF))
    return restore.restore_plan(d.snapshot(2), d.snapshot(0), "rename", suffix)


@query("restore_plan_tree", f"""
SELECT path, CASE WHEN path IN {_LIVE0} THEN 'overwrite' ELSE 'recreate' END AS action FROM fx_snap WHERE snapshot_id = 2
UNION ALL SELECT path, CASE WHEN path IN (SELECT path FROM fx_snap_dirs WHERE snapshot_id = 0) THEN 'merge' ELSE 'recreate' END
FROM fx_snap_dirs WHERE snapshot_id = 2""")
def restore_plan_tree(d: Data) -> DataFrame:
    return restore.restore_plan(d.snapshot(2), d.snapshot(0), "clobber", include_directories=True).select(
        "path", "action")


@query("revert_plan", """
SELECT path, CASE op WHEN 'DELETE' THEN 'recreate' WHEN 'MODIFY' THEN 'restore' ELSE 'delete' END AS action
FROM fx_diff_collapsed""")
def revert_plan(d: Data) -> DataFrame:
    # the diff runs from the snapshot (2) to the tree to be reverted (4)
    return restore.revert_plan(snapshots.tree_diff(d.snapshot(2), d.snapshot(4)), delete_new=True)


@query("change_owner", """
SELECT path, CASE WHEN target IS NOT NULL THEN 'change' ELSE 'unchanged' END AS action, owner AS before,
  coalesce(target, owner) AS after FROM fx_entries LEFT JOIN fx_owner_map ON source = owner""")
def change_owner(d: Data) -> DataFrame:
    return acl.change_ownership(d.entries, d.owner_map)


@query("change_group", """
SELECT path, CASE WHEN target IS NOT NULL THEN 'change' ELSE 'unchanged' END AS action, grp AS before,
  coalesce(target, grp) AS after FROM fx_files LEFT JOIN fx_group_map ON source = grp WHERE starts_with(path, '/EUROPE/')""")
def change_group(d: Data) -> DataFrame:
    return acl.change_ownership(d.files, d.group_map, "group", root="/EUROPE")


_TEXT = "concat_ws(',', CASE WHEN {p} IS NOT NULL THEN 'project=' || {p} END, CASE WHEN {r} IS NOT NULL THEN 'reviewed=' || {r} END)"


def _tag_text(tags: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")


@query("tag_add", f"""
SELECT path, CASE WHEN reviewed = 'yes' THEN 'unchanged' WHEN reviewed IS NOT NULL THEN 'skipped_conflict' ELSE 'add' END AS action,
  {_TEXT.format(p='project', r="coalesce(reviewed, 'yes')")} AS after FROM fx_tags""")
def tag_add(d: Data) -> DataFrame:
    return marks.add_tag(d.tagged, "reviewed", "yes").select("path", "action", _tag_text("after").alias("after"))


@query("tag_overwrite", f"""
SELECT path, CASE WHEN reviewed = 'yes' THEN 'unchanged' WHEN reviewed IS NOT NULL THEN 'overwrite' ELSE 'add' END AS action,
  {_TEXT.format(p='project', r="'yes'")} AS after FROM fx_tags""")
def tag_overwrite(d: Data) -> DataFrame:
    return marks.add_tag(d.tagged, "reviewed", "yes", overwrite=True).select(
        "path", "action", _tag_text("after").alias("after"))


@query("tag_remove", f"""
SELECT path, CASE WHEN project = 'BUILDING' THEN 'remove' WHEN project IS NOT NULL THEN 'skipped_value' ELSE 'unchanged' END AS action,
  {_TEXT.format(p="CASE WHEN project <> 'BUILDING' THEN project END", r='reviewed')} AS after FROM fx_tags""")
def tag_remove(d: Data) -> DataFrame:
    return marks.remove_tag(d.tagged, "project", "BUILDING").select("path", "action", _tag_text("after").alias("after"))


_AFTER = ", ".join(
    {"archive": "true", "hidden": "false"}.get(a, f"coalesce(attr_{a}, false)") + f" AS {a}" for a in C.ATTRIBUTES)


@query("attr_set", f"""
WITH n AS (SELECT path, attr_archive IS NOT DISTINCT FROM true AND attr_hidden IS NOT DISTINCT FROM false AS same, {_AFTER},
  {', '.join(f'attr_{a}' for a in C.ATTRIBUTES)} FROM fx_files)
SELECT path, CASE WHEN same THEN 'unchanged' ELSE 'change' END AS action,
  {', '.join(f'CASE WHEN same THEN attr_{a} ELSE {a} END AS {a}' for a in C.ATTRIBUTES)} FROM n""")
def attr_set(d: Data) -> DataFrame:
    return marks.set_attributes(d.files, on=["archive"], off=["hidden"]).select("path", "action", "after.*")


@query("attr_find_set", "SELECT path, 'change' AS action, attr_system AS system FROM fx_files WHERE attr_archive")
def attr_find_set(d: Data) -> DataFrame:
    return marks.find_and_set(d.files, "archive", True).where("NOT after.archive").select(
        "path", "action", "after.system")
