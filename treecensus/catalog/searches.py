"""Queries that filter an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus.catalog.data import AS_OF, Data
from treecensus.catalog.registry import query
from treecensus.functions import aces, paths
from treecensus.operators import identity, presets, reports, search as S
from treecensus.operators.search import Search


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("path", "size")


@query("filter_type", "SELECT path, size FROM fx_entries WHERE type = 'FS_FILE_TYPE_DIRECTORY'")
def filter_type(d: Data) -> DataFrame:
    return _found(S.search(d.entries, Search(type="dir")))


@query("filter_file_only", "SELECT path, size FROM fx_entries WHERE type <> 'FS_FILE_TYPE_DIRECTORY'")
def filter_file_only(d: Data) -> DataFrame:
    return _found(S.search(d.entries, Search(file_only=True)))


@query("filter_name_any", r"""
SELECT path, size FROM fx_files WHERE regexp_matches(name, '(?i)\A.*\.log\z') OR regexp_matches(name, '(?i)_12[0-9]+\.')""")
def filter_name_any(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(names=("*.LOG", r"_12[0-9]+\."))))


@query("filter_name_all", r"""
SELECT path, size FROM fx_files WHERE regexp_matches(name, '\Aorder_1.*\z') AND regexp_matches(name, '\A.*9\..*\z')""")
def filter_name_all(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(names_all=("order_1*", "*9.*"))))


@query("filter_name_not", r"""
SELECT path, size FROM fx_files WHERE NOT regexp_matches(name, '(?i)\A.*\.log\z') AND NOT regexp_matches(name, '^order_[0-4]')""")
def filter_name_not(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(names_not=("*.log", "^order_[0-4]"))))


@query("filter_name_case", r"SELECT path, size FROM fx_files WHERE regexp_matches(name, '\Aorder_.*7\.log\z')")
def filter_name_case(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(names=("order_*7.log", "ORDER_*"), case_sensitive=True, pattern_mode="glob")))


@query("filter_size", """
SELECT path, size FROM fx_files WHERE size + CASE WHEN k % 13 = 0 THEN 0 ELSE 4096 END > 10000000
  AND size + CASE WHEN k % 13 = 0 THEN 0 ELSE 4096 END < 31457280""")
def filter_size(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(larger_than="10MB", smaller_than="30MiB", include_metadata=True)))


@query("filter_age", """
SELECT path, size FROM fx_files WHERE access_time < TIMESTAMP '2002-01-01' - INTERVAL 1200 DAY""")
def filter_age(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(as_of=AS_OF, older_than=1200, time_field="access_time")))


@query("filter_age_by_field", """
SELECT path, size FROM fx_files WHERE access_time < TIMESTAMP '2002-01-01' - INTERVAL 300 DAY
  AND creation_time < TIMESTAMP '2002-01-01' - INTERVAL 1000 DAY
  AND modification_time > TIMESTAMP '2002-01-01' - INTERVAL 2000 DAY
  AND change_time > TIMESTAMP '2002-01-01' - INTERVAL 1980 DAY""")
def filter_age_by_field(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(as_of=AS_OF, ages={
        "access_time": (300, None), "creation_time": (1000, None), "modification_time": (None, 2000),
        "change_time": (None, 1980)})))


@query("filter_age_window", """
SELECT path, size FROM fx_files WHERE modification_time < TIMESTAMP '2002-01-01' - INTERVAL 500 DAY
  AND modification_time > TIMESTAMP '2002-01-01' - INTERVAL 1500 DAY""")
def filter_age_window(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(as_of=AS_OF, older_than=500, newer_than=1500)))


@query("filter_time_range", """
SELECT path, size FROM fx_files WHERE modification_time > TIMESTAMP '1998-02-01' AND modification_time < TIMESTAMP '1998-05-01'""")
def filter_time_range(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(between=(
        "modification_time", "1998-02-01T00:00:00", "1998-05-01T00:00:00"))))


@query("filter_owner", "SELECT path, size FROM fx_files WHERE owner IN ('7', '42', '99')")
def filter_owner(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(owners=("7", "42", "99"))))


@query("filter_owner_unresolved", """
SELECT path, size FROM fx_files WHERE owner IN (SELECT auth_id FROM fx_identities WHERE name = 'Nobody at all')""")
def filter_owner_unresolved(d: Data) -> DataFrame:
    return _found(S.owner_semi_join(d.files, identity.resolve_owners(d.identities, ["Nobody at all"])))


@query("owner_semi_join", """
SELECT path, size FROM fx_files WHERE owner IN (SELECT auth_id FROM fx_identities WHERE domain = 'LOCAL')""")
def owner_semi_join(d: Data) -> DataFrame:
    return _found(S.owner_semi_join(d.files, d.identities.where("domain = 'LOCAL'")))


@query("filter_attributes", "SELECT path, size FROM fx_files WHERE attr_hidden AND attr_archive AND NOT attr_system")
def filter_attributes(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(attributes_true=("hidden", "archive"), attributes_false=("system",))))


@query("filter_scope", "SELECT path, size FROM fx_entries WHERE starts_with(path, '/ASIA/')")
def filter_scope(d: Data) -> DataFrame:
    return _found(S.search(d.entries, Search(root="/ASIA/")))


@query("filter_max_depth", """
SELECT path, size FROM fx_entries WHERE starts_with(path, '/ASIA/') AND len(string_split(path, '/')) - 1 <= 3""")
def filter_max_depth(d: Data) -> DataFrame:
    return _found(S.search(d.entries, Search(root="/ASIA", max_depth=2)))


_OMIT_SQL = r"""
SELECT e.path, e.size FROM fx_entries e WHERE NOT EXISTS (
  SELECT 1 FROM fx_entry_up u WHERE u.entry = e.path AND u.depth > 0 AND {test})
  AND NOT (e.type = 'FS_FILE_TYPE_DIRECTORY' AND {own})"""


def _omit_sql(test: str) -> str:
    return _OMIT_SQL.format(test=test.format(p="u.path"), own=test.format(p="e.path"))


@query("omit_subdirs", _omit_sql(
    r"(regexp_matches({p}, '\A/EUROPE/NATION_1.*\z') OR regexp_extract({p}, '[^/]*$') = 'BUILDING'"
    r" OR regexp_matches(regexp_extract({p}, '[^/]*$'), '\Acust_1.*\z'))"))
def omit_subdirs(d: Data) -> DataFrame:
    return _found(S.search(d.entries, Search(omit_subdirs=("BUILDING", "/EUROPE/NATION_1*", "cust_1*/"))))


@query("omit_paths", _omit_sql("({p} = '/ASIA' OR {p} = '/AFRICA/NATION_5')"))
def omit_paths(d: Data) -> DataFrame:
    return _found(S.search(d.entries, Search(omit_paths=("/ASIA/", "/AFRICA/NATION_5", "/nowhere"))))


@query("omit_anti_join", _omit_sql("{p} IN (SELECT path FROM fx_dirs WHERE child_count <> found AND depth > 2)"))
def omit_anti_join(d: Data) -> DataFrame:
    unread = reports.completeness(d.entries).where(paths.depth(F.col("path")) > 2)
    return _found(S.omit_anti_join(d.entries, unread))


_BIG_SQL = """SELECT path FROM fx_entry_up WHERE depth > 0 AND type IN ('FS_FILE_TYPE_FILE', 'FS_FILE_TYPE_DIRECTORY')
  GROUP BY path HAVING count(*) > 130"""


@query("skip_big_dirs", f"""
SELECT e.path, e.size FROM fx_entries e WHERE NOT EXISTS (
  SELECT 1 FROM fx_entry_up u WHERE u.entry = e.path AND u.path IN ({_BIG_SQL}) AND len(string_split(u.path, '/')) > 3)""")
def skip_big_dirs(d: Data) -> DataFrame:
    # the root and the two levels below it are entered, whatever their size
    return _found(S.skip_big_directories(d.entries, 130, least_depth=3))


@query("skip_summary", f"""
WITH big AS (SELECT d.path FROM fx_dirs d WHERE d.path IN ({_BIG_SQL.replace('130', '1500')}))
SELECT (SELECT count(*) FROM big WHERE NOT EXISTS (SELECT 1 FROM fx_entry_up v WHERE v.entry = big.path
    AND v.path IN (SELECT path FROM big))) AS skipped_roots,
  coalesce(sum(CASE WHEN u.type = 'FS_FILE_TYPE_FILE' THEN 1 ELSE 0 END), 0)::BIGINT AS skipped_files,
  coalesce(sum(CASE WHEN u.type = 'FS_FILE_TYPE_DIRECTORY' THEN 1 ELSE 0 END), 0)::BIGINT AS skipped_directories
FROM fx_entry_up u JOIN big USING (path)
WHERE NOT EXISTS (SELECT 1 FROM fx_entry_up v WHERE v.entry = u.path AND v.path IN (SELECT path FROM big))""")
def skip_summary(d: Data) -> DataFrame:
    return S.skip_summary(S.big_directories(d.entries, 1500, root_exempt=True))


@query("filter_empty_dirs", """
SELECT path FROM fx_dirs WHERE depth = 4 AND path NOT IN (
  SELECT regexp_replace(path, '/[^/]*$', '') FROM fx_snap WHERE snapshot_id = 1)""")
def filter_empty_dirs(d: Data) -> DataFrame:
    # customer directories of the live tree with the number of children they had in snapshot 1
    then = d.snapshot(1, directories=False).groupBy(paths.parent(F.col("path")).alias("path")).agg(
        F.count("*").alias("n"))
    dirs = (S.search(d.entries, Search(type="directory")).where(paths.depth(F.col("path")) == 4)
            .drop("child_count").join(then, "path", "left").withColumn("child_count", F.coalesce("n", F.lit(0))))
    return dirs.where("child_count = 0").select("path")


@query("find_tagged", "SELECT path, size FROM fx_files JOIN fx_tags USING (path) WHERE reviewed = 'yes'")
def find_tagged(d: Data) -> DataFrame:
    return _found(S.find_tagged(d.tagged, "reviewed", "yes"))


@query("find_tagged_any", """
SELECT path, 'any' AS how FROM fx_tags WHERE reviewed IS NOT NULL OR project IS NOT NULL
UNION ALL SELECT path, 'key' FROM fx_tags WHERE project IS NOT NULL
UNION ALL SELECT path, 'value' FROM fx_tags WHERE project = 'BUILDING' OR reviewed = 'BUILDING'""")
def find_tagged_any(d: Data) -> DataFrame:
    ways = {"any": (None, None), "key": ("project", None), "value": (None, "BUILDING")}
    found = [S.find_tagged(d.tagged, *w).select("path", F.lit(how).alias("how")) for how, w in ways.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("find_acl_rights", "SELECT path FROM fx_aces WHERE pos = 2")
def find_acl_rights(d: Data) -> DataFrame:
    return d.objects.where(aces.allows(F.col("acl.aces"), "w", "Everyone")).select("path")


@query("named_searches", r"""
WITH f AS (SELECT *, TIMESTAMP '2002-01-01' - INTERVAL 1 DAY * 0 AS now FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE')
SELECT path, 'stale' AS category FROM f WHERE access_time < now - INTERVAL 730 DAY AND modification_time < now - INTERVAL 730 DAY
UNION ALL SELECT path, 'cold' FROM f WHERE access_time < now - INTERVAL 90 DAY
UNION ALL SELECT path, 'cold_large' FROM f WHERE access_time < now - INTERVAL 365 DAY AND size > 100000000
UNION ALL SELECT path, 'retention' FROM f WHERE creation_time < now - INTERVAL 2555 DAY
UNION ALL SELECT path, 'privacy_retention' FROM f WHERE modification_time < now - INTERVAL 1095 DAY
UNION ALL SELECT path, 'temporary' FROM f WHERE modification_time < now - INTERVAL 30 DAY
  AND regexp_matches(name, '(?i)(\.(tmp|temp|bak)\z)|\A~')
UNION ALL SELECT path, 'old_logs' FROM f WHERE modification_time < now - INTERVAL 90 DAY
  AND regexp_matches(name, '(?i)\.log(\..*)?\z')
UNION ALL SELECT path, 'core_dumps' FROM f WHERE modification_time < now - INTERVAL 30 DAY
  AND regexp_matches(name, '(?i)\Acore\.|\.core\z')
UNION ALL SELECT path, 'compressible' FROM f WHERE size > 100000000 AND regexp_matches(name, '(?i)\.(log|txt|csv|json)\z')
UNION ALL SELECT path, 'ransomware' FROM f WHERE regexp_matches(name, '(?i)\.(encrypted|locked|crypto|crypt|enc|crypted)\z')
UNION ALL SELECT path, 'ransom_notes' FROM f WHERE modification_time > now - INTERVAL 7 DAY
  AND regexp_matches(name, '(?i)README|DECRYPT|RECOVER|INSTRUCTION|HOW_TO')
UNION ALL SELECT path, 'recent_executables' FROM f WHERE creation_time > now - INTERVAL 7 DAY
  AND regexp_matches(name, '(?i)\.(exe|dll|bat|ps1|sh|py|js)\z')
UNION ALL SELECT path, 'media' FROM f WHERE size > 1000000000
  AND regexp_matches(name, '(?i)\.(mov|mp4|mxf|r3d|ari|braw|prores)\z')
UNION ALL SELECT path, 'archive_candidates' FROM f WHERE size > 100000000 AND access_time < now - INTERVAL 180 DAY
  AND modification_time < now - INTERVAL 180 DAY
UNION ALL SELECT path, 'render_cache' FROM f WHERE modification_time < now - INTERVAL 30 DAY
  AND regexp_matches(name, '(?i)\.(tmp|peak|pek|pkf)\z|cache|preview')
UNION ALL SELECT path, 'proxies' FROM f WHERE regexp_matches(name, '(?i)proxy|_lowres|_small')
UNION ALL SELECT path, 'originals' FROM f WHERE size > 1000000000 AND regexp_matches(name, '(?i)\.(r3d|braw|ari)\z')""")
def named_searches(d: Data) -> DataFrame:
    return presets.named_searches(d.files, AS_OF)


@query("custom_predicate", "SELECT path, size FROM fx_files WHERE size % 7 = 3 AND type = 'FS_FILE_TYPE_FILE'")
def custom_predicate(d: Data) -> DataFrame:
    return _found(S.search(d.files, Search(type="file", where=F.col("size") % 7 == 3)))


@query("combined_search", r"""
SELECT path, size FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE' AND starts_with(path, '/EUROPE/')
  AND regexp_matches(name, '(?i)\.(pdf|docx)\z') AND NOT regexp_matches(name, '(?i)\Aorder_2')
  AND size > 1000000 AND modification_time < TIMESTAMP '2002-01-01' - INTERVAL 400 DAY
  AND attr_hidden = false AND owner IN (SELECT auth_id FROM fx_identities WHERE domain = 'POSIX_USER')""")
def combined_search(d: Data) -> DataFrame:
    opts = Search(as_of=AS_OF, type="file", root="/EUROPE", names=("*.pdf", "*.docx"), names_not=("order_2*",),
                  larger_than="1MB", older_than=400, attributes_false=("hidden",))
    return _found(S.owner_semi_join(S.search(d.files, opts), d.identities.where("domain = 'POSIX_USER'")))


@query("scan_single_object", "SELECT path, size FROM fx_files WHERE path = (SELECT min(path) FROM fx_files)")
def scan_single_object(d: Data) -> DataFrame:
    first = d.files.agg(F.min("path")).first()[0]
    return _found(S.search(d.entries, Search(root=first)))


