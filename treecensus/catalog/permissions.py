"""Queries that return plans for access-control lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.catalog.data import Data
from treecensus.catalog.registry import query
from treecensus.functions import aces as A
from treecensus.options import ace_full, ace_key, ace_rights
from treecensus.plans import acl

_RIGHTS = "['" + "', '".join(C.RIGHTS) + "']"


def _text(value: Column) -> Column:
    """A whole list as text, with inherited entries marked."""
    return F.array_join(F.transform(value["aces"], lambda a: F.concat(
        A.ace_text(a), F.when(A.is_inherited(a), F.lit(":I")).otherwise(F.lit("")))), ",")


def _shown(plan: DataFrame, *more: str) -> DataFrame:
    return plan.select("path", "action", _text(F.col("after")).alias("after"), *more)


_ACE_TEXT = "type || ':' || flags || ':' || trustee || ':' || rights || CASE WHEN inh THEN ':I' ELSE '' END"
_CANONICAL = "inh, type <> 'Deny', pos"


def _edited(rows: str) -> str:
    """SQL of a plan from edited entries: an edit without effect keeps the old order."""
    return f"""
WITH edited AS ({rows}),
b AS (SELECT path, string_agg({_ACE_TEXT}, ',' ORDER BY pos) AS old FROM fx_aces GROUP BY path),
n AS (SELECT path, string_agg({_ACE_TEXT}, ',' ORDER BY pos) AS same,
  string_agg({_ACE_TEXT}, ',' ORDER BY {_CANONICAL}) AS sorted FROM edited GROUP BY path)
SELECT path, CASE WHEN old = coalesce(same, '') THEN 'unchanged' ELSE 'change' END AS action,
  CASE WHEN old = coalesce(same, '') THEN old ELSE coalesce(sorted, '') END AS after FROM b LEFT JOIN n USING (path)"""


def _union(text: str, more: str) -> str:
    return f"array_to_string([x FOR x IN {_RIGHTS} IF contains({text}, x) OR contains('{more}', x)], '')"


_COLUMNS = "path, pos, type, trustee, flags, rights, inh"


@query("ace_remove", _edited(f"SELECT {_COLUMNS} FROM fx_aces WHERE NOT (type = 'Allow' AND trustee = 'Everyone')"))
def ace_remove(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.remove(*ace_key("Allow:Everyone"))))


@query("ace_add", _edited(f"""
SELECT path, pos, type, trustee, CASE WHEN pos = 2 THEN 'fd' ELSE flags END AS flags,
  CASE WHEN pos = 2 THEN {_union('rights', 'rtncy')} ELSE rights END AS rights, inh FROM fx_aces
UNION ALL SELECT DISTINCT path, 9, 'Allow', 'Everyone', 'fd', 'rtncy', false FROM fx_aces WHERE k % 7 <> 0"""))
def ace_add(d: Data) -> DataFrame:
    # flags of a merged entry keep their order, so the new letters follow the old mark
    return _shown(acl.edit_aces(d.objects, A.add(*ace_full("Allow:fd:Everyone:Read"))))


@query("ace_replace", _edited("""
SELECT path, pos, type, trustee, CASE WHEN pos = 2 THEN 'd' ELSE flags END AS flags,
  CASE WHEN pos = 2 THEN 'rx' ELSE rights END AS rights, inh FROM fx_aces"""))
def ace_replace(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.replace(*ace_full("Allow:d:Everyone:rx"))))


@query("ace_replace_new", _edited("""
SELECT path, pos, CASE WHEN pos = 2 THEN 'Deny' ELSE type END AS type, CASE WHEN pos = 2 THEN 'gid:14011' ELSE trustee END AS trustee,
  CASE WHEN pos = 2 THEN 'fd' ELSE flags END AS flags, CASE WHEN pos = 2 THEN 'waTN' ELSE rights END AS rights,
  CASE WHEN pos = 2 THEN false ELSE inh END AS inh FROM fx_aces"""))
def ace_replace_new(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.replace_new(ace_key("Allow:Everyone"), ace_full("Deny:fd:gid:14011:Write"))))


@query("ace_add_rights", _edited(f"""
SELECT path, pos, type, trustee, flags, CASE WHEN pos = 2 THEN {_union('rights', 'xd')} ELSE rights END AS rights, inh FROM fx_aces"""))
def ace_add_rights(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.add_rights(*ace_rights("Allow:Everyone:dx"))))


@query("ace_remove_rights", _edited(f"""
SELECT path, pos, type, trustee, flags, replace(rights, 'w', '') AS rights, inh FROM fx_aces WHERE pos = 2
UNION ALL SELECT {_COLUMNS} FROM fx_aces WHERE pos <> 2"""))
def ace_remove_rights(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.remove_rights(*ace_rights("Allow:Everyone:w"))))


@query("ace_remove_rights_all", _edited(f"SELECT {_COLUMNS} FROM fx_aces WHERE pos <> 3"))
def ace_remove_rights_all(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.remove_rights(*ace_rights("Deny:Everyone:w"))))


@query("ace_clone", _edited(f"""
SELECT {_COLUMNS} FROM fx_aces
UNION ALL SELECT path, 10 + pos, type, 'backup', flags, rights, inh FROM fx_aces WHERE trustee = 'Everyone'"""))
def ace_clone(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.clone("Everyone", "backup")))


@query("ace_clone_sync", _edited("""
SELECT a.path, a.pos, a.type, a.trustee, a.flags, CASE WHEN a.pos = 2 THEN 'rx' ELSE a.rights END AS rights, a.inh
FROM fx_aces a WHERE a.k % 2 = 0 OR true
UNION ALL SELECT path, 10, type, 'Everyone', flags, rights, inh FROM fx_aces WHERE pos = 1 AND trustee = 'g5' AND k % 7 <> 0
""").replace("CASE WHEN a.pos = 2 THEN 'rx'",
             "CASE WHEN a.pos = 2 AND a.path IN (SELECT path FROM fx_aces WHERE trustee = 'g5') THEN 'rx'")
       .replace(" WHERE a.k % 2 = 0 OR true", ""))
def ace_clone_sync(d: Data) -> DataFrame:
    return _shown(acl.edit_aces(d.objects, A.clone("g5", "Everyone", sync=True)))


@query("ace_clone_map", _edited(f"""
SELECT {_COLUMNS} FROM fx_aces
UNION ALL SELECT path, 10, type, target, flags, rights, inh FROM fx_aces JOIN fx_group_map ON source = trustee WHERE pos = 1"""))
def ace_clone_map(d: Data) -> DataFrame:
    return _shown(acl.clone_from_map(d.objects, d.group_map))


_MIGRATED = """
WITH n AS (SELECT path, k, pos, type, flags, rights, inh, coalesce(target, trustee) AS trustee, target IS NOT NULL AS hit
  FROM fx_aces LEFT JOIN {map} ON source = trustee)
SELECT path, CASE WHEN bool_or(hit) THEN 'change' ELSE 'unchanged' END AS action,
  string_agg({text}, ',' ORDER BY pos) AS after FROM n GROUP BY path"""


@query("ace_migrate", _MIGRATED.format(map="fx_group_map", text=_ACE_TEXT))
def ace_migrate(d: Data) -> DataFrame:
    return _shown(acl.migrate_trustees(d.objects, d.group_map))


@query("migrate_trustees", _MIGRATED.format(
    map="(SELECT * FROM fx_group_map UNION ALL SELECT * FROM fx_owner_map UNION ALL SELECT auth_id, 'new-' || auth_id "
        "FROM fx_identities WHERE k % 10 <> 0)", text=_ACE_TEXT))
def migrate_trustees(d: Data) -> DataFrame:
    # every customer is mapped: more rows than fit a map value, so entries are joined
    k = F.col("c_custkey")
    rest = d.table("customer").where(k % 10 != 0).select(
        k.cast("string").alias("source"), F.concat(F.lit("new-"), k.cast("string")).alias("target"))
    return _shown(acl.migrate_trustees(d.objects, d.group_map.unionByName(d.owner_map).unionByName(rest)))


@query("inheritance_disable", f"""
SELECT path, 'change' AS action, string_agg(type || ':' || flags || ':' || trustee || ':' || rights, ',' ORDER BY pos) AS after,
  false AS left_empty, 'PROTECTED' AS control FROM fx_aces GROUP BY path""")
def inheritance_disable(d: Data) -> DataFrame:
    return _shown(acl.disable_inheritance(d.objects), "left_empty").join(
        acl.disable_inheritance(d.objects).select("path", F.array_join("after.control", ",").alias("control")), "path")


@query("inheritance_remove", f"""
SELECT path, 'change' AS action, string_agg({_ACE_TEXT}, ',' ORDER BY pos) AS after, false AS left_empty
FROM fx_aces WHERE NOT inh GROUP BY path""")
def inheritance_remove(d: Data) -> DataFrame:
    return _shown(acl.disable_inheritance(d.objects, remove_inherited=True), "left_empty")


_MODE_SQL = """
SELECT path, 'change' AS action, 'Allow::uid:1001:rwax,Allow::gid:5000:rwax,Allow::EVERYONE@:rx' AS after,
  CASE WHEN type = 'FS_FILE_TYPE_DIRECTORY' THEN 'SET_GID,STICKY_BIT' ELSE 'STICKY_BIT' END AS special,
  'uid:1001' AS new_owner, 'gid:5000' AS new_group FROM {rows}"""


@query("set_mode", _MODE_SQL.format(rows="(SELECT path, type FROM fx_entries WHERE starts_with(path, '/ASIA/') OR path = '/ASIA')"))
def set_mode(d: Data) -> DataFrame:
    none = F.lit(None).cast(A.ACL)
    plan = acl.set_mode(d.entries.withColumn("acl", none), "3775", "uid:1001", "gid:5000", root="/ASIA")
    return _shown(plan.withColumn("special", F.array_join("after.posix_special", ",")), "special", "new_owner", "new_group")


@query("set_mode_files", """
SELECT path, 'change' AS action, 'Allow::OWNER@:rwa,Allow::GROUP@:r' AS after, owner AS new_owner, grp AS new_group
FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE'""")
def set_mode_files(d: Data) -> DataFrame:
    return _shown(acl.set_mode(d.objects, "0640", kind="file"), "new_owner", "new_group")


_TEMPLATE = "(SELECT max(path) FROM fx_files)"


@query("acl_copy", f"""
WITH t AS (SELECT string_agg(type || ':' || flags || ':' || trustee || ':' || rights || ':I', ',' ORDER BY pos) AS marked,
  any_value(f.owner) AS owner FROM fx_aces JOIN (SELECT path, owner FROM fx_files) f USING (path) WHERE path = {_TEMPLATE}),
o AS (SELECT path, string_agg({_ACE_TEXT}, ',' ORDER BY pos) AS old FROM fx_aces GROUP BY path)
SELECT path, CASE WHEN old = marked AND f.owner = t.owner THEN 'unchanged' ELSE 'change' END AS action, marked AS after,
  t.owner AS new_owner, grp AS new_group FROM o JOIN (SELECT path, owner, grp FROM fx_files) f USING (path), t
WHERE starts_with(path, '/AMERICA/')""")
def acl_copy(d: Data) -> DataFrame:
    last = d.files.agg(F.max("path")).first()[0]
    return _shown(acl.copy_acl(d.objects, last, "/AMERICA", copy_owner=True), "new_owner", "new_group")


_BACKUP = f"""
SELECT path, CAST(any_value(k) AS VARCHAR) AS file_id, string_agg({_ACE_TEXT}, ',' ORDER BY pos) AS acl,
  '2002-01-01T00:00:00Z' AS timestamp FROM fx_aces GROUP BY path HAVING bool_or(pos = 2)"""


def _saved(d: Data) -> DataFrame:
    plan = acl.edit_aces(d.objects, A.remove(*ace_key("Allow:Everyone")))
    return acl.backup(plan, d.objects, "2002-01-01T00:00:00Z")


@query("acl_backup", _BACKUP)
def acl_backup(d: Data) -> DataFrame:
    return _saved(d).withColumn("acl", _text(F.col("acl")))


@query("acl_restore", f"""
SELECT path, 'restore' AS action, acl AS after FROM ({_BACKUP})""")
def acl_restore(d: Data) -> DataFrame:
    # the live lists have lost the entry that the backup holds
    edited = acl.edit_aces(d.objects, A.remove(*ace_key("Allow:Everyone"))).select("path", F.col("after").alias("acl"))
    live = d.files.select("path", "id").join(edited, "path")
    return _shown(acl.restore(_saved(d), live))


# no saved path lies above the others; nothing is there yet
@query("acl_restore_target", f"""
WITH b AS (SELECT path, acl FROM ({_BACKUP}) WHERE starts_with(path, '/AFRICA/') AND path LIKE '%1.___'),
p AS (SELECT string_split(min(path), '/') AS lo, string_split(max(path), '/') AS hi FROM b),
r AS (SELECT coalesce(min(i) - 1, len(lo)) AS n, any_value(lo) AS lo FROM p LEFT JOIN LATERAL
  (SELECT unnest(range(1, len(lo) + 1)) AS i) u ON lo[i] IS DISTINCT FROM hi[i] GROUP BY lo),
m AS (SELECT '/elsewhere' || substring(path, length(array_to_string(lo[:n], '/')) + 1) AS path, acl FROM b, r)
SELECT path, 'missing' AS action, acl AS after FROM m""")
def acl_restore_target(d: Data) -> DataFrame:
    some = F.col("path").startswith("/AFRICA/") & F.col("path").like("%1.___")
    return _shown(acl.restore(_saved(d).where(some), d.objects, target="/elsewhere"))


@query("acl_restore_join", f"""
SELECT path, CASE WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN 'refused' ELSE 'unchanged' END AS action, acl AS after FROM ({_BACKUP})""")
def acl_restore_join(d: Data) -> DataFrame:
    # a third of the paths has been taken by another object since
    other = F.when(F.col("id").cast("bigint") % 3 == 0, F.concat(F.lit("new"), "id")).otherwise(F.col("id"))
    return _shown(acl.restore(_saved(d), d.objects.withColumn("id", other)))


@query("ace_chain", _edited(f"""
SELECT path, pos, type, trustee, flags, CASE WHEN pos = 1 THEN {_union('rights', 'w')} ELSE rights END AS rights, inh FROM
  (SELECT * FROM fx_aces WHERE trustee <> 'Everyone') WHERE trustee = 'g3' OR pos <> 1
UNION ALL SELECT {_COLUMNS} FROM fx_aces WHERE pos = 1 AND trustee <> 'g3'
UNION ALL SELECT DISTINCT path, 20, 'Deny', 'Everyone', '', 'd', false FROM fx_aces"""))
def ace_chain(d: Data) -> DataFrame:
    edit = A.chain(A.remove(*ace_key("Allow:Everyone")), A.remove(*ace_key("Deny:Everyone")),
                   A.add_rights(*ace_rights("Allow:g3:w")), A.add(*ace_full("Deny::Everyone:d")))
    return _shown(acl.edit_aces(d.objects, edit))
