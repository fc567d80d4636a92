"""Queries that aggregate, sort or limit, and those about identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus.catalog.data import AS_OF, Data
from treecensus.catalog.registry import query
from treecensus.functions import aces
from treecensus.operators import hierarchy, identity, reports
from treecensus.operators.search import Search, owner_column, search

_PER_TOP = """
SELECT array_to_string(string_split(path, '/')[1:2], '/') AS path, count(*) AS files,
  CAST(sum(capacity) AS BIGINT) AS capacity, 1 AS depth FROM {rows} GROUP BY 1
UNION ALL SELECT '/', count(*), coalesce(CAST(sum(capacity) AS BIGINT), 0), 0 FROM {rows}"""
_WINDOW = ("(SELECT * FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE' "
           "AND modification_time > TIMESTAMP '2002-01-01' - INTERVAL 1000 DAY)")


@query("entry_report", _PER_TOP.format(rows=_WINDOW))
def entry_report(d: Data) -> DataFrame:
    """Bytes modified in a window, per top directory, largest first."""
    found = search(d.files, Search(as_of=AS_OF, type="file", newer_than=1000))
    return reports.sort_report(hierarchy.per_directory(found), "size")


@query("per_directory_matches", """
SELECT array_to_string(string_split(path, '/')[1:3], '/') AS path, count(*) AS files,
  CAST(sum(capacity) AS BIGINT) AS capacity, 1 AS depth
FROM fx_entries WHERE starts_with(path, '/ASIA/') AND len(string_split(path, '/')) > 3 GROUP BY 1
UNION ALL SELECT '/ASIA', count(*), CAST(sum(capacity) AS BIGINT), 0 FROM fx_entries""")
def per_directory_matches(d: Data) -> DataFrame:
    # the search spans the whole tree, the report starts at /ASIA: the rest only counts in the total
    return hierarchy.per_directory(d.entries, "/ASIA/")


@query("per_directory_matches_all", """
SELECT path, count(*) AS files, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(depth AS INTEGER) AS depth FROM fx_up
WHERE type = 'FS_FILE_TYPE_FILE' GROUP BY path, depth
UNION ALL SELECT '/', count(*), CAST(sum(capacity) AS BIGINT), 0 FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE'""")
def per_directory_matches_all(d: Data) -> DataFrame:
    return hierarchy.per_directory(search(d.files, Search(type="file")), every_level=True)


@query("grand_total", """
SELECT path, count(*) AS files, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(depth - 1 AS INTEGER) AS depth FROM fx_up
WHERE starts_with(path, '/EUROPE/') AND depth <= 3 GROUP BY path, depth
UNION ALL SELECT '/EUROPE', count(*), CAST(sum(capacity) AS BIGINT), 0 FROM fx_files WHERE starts_with(path, '/EUROPE/')""")
def grand_total(d: Data) -> DataFrame:
    found = search(d.files, Search(root="/EUROPE"))
    return hierarchy.per_directory(found, "/EUROPE", every_level=True).where("depth <= 2")


@query("match_totals", f"""
SELECT count(*) AS total_files, CAST(sum(capacity) AS BIGINT) AS total_capacity FROM {_WINDOW}""")
def match_totals(d: Data) -> DataFrame:
    return reports.match_totals(search(d.files, Search(as_of=AS_OF, type="file", newer_than=1000)))


_AGGREGATES = """
SELECT path, count(*) FILTER (type = 'FS_FILE_TYPE_FILE') AS total_files,
  count(*) FILTER (type = 'FS_FILE_TYPE_DIRECTORY') AS total_directories,
  count(*) FILTER (type = 'FS_FILE_TYPE_SYMLINK') AS total_symlinks, CAST(0 AS BIGINT) AS total_other,
  CAST(sum(capacity) AS BIGINT) AS total_capacity,
  CAST(epoch(min(modification_time) FILTER (type <> 'FS_FILE_TYPE_DIRECTORY')) AS BIGINT) AS oldest,
  CAST(epoch(max(modification_time) FILTER (type <> 'FS_FILE_TYPE_DIRECTORY')) AS BIGINT) AS newest
FROM fx_entry_up GROUP BY path"""


@query("dir_aggregates", _AGGREGATES)
def dir_aggregates(d: Data) -> DataFrame:
    return hierarchy.directory_aggregates(d.entries).withColumns(
        {c: F.unix_seconds(c) for c in ("oldest", "newest")})


@query("dir_stats", f"""
WITH a AS ({_AGGREGATES})
SELECT path, CAST(CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END AS INTEGER) AS depth, total_files AS files,
  total_directories AS subdirectories, total_capacity AS total_size, total_capacity // total_files AS average_size,
  oldest, newest
FROM a WHERE path = '/' OR (len(string_split(path, '/')) - 1 <= 3 AND NOT starts_with(path, '/ASIA')
  AND regexp_extract(path, '[^/]*$') NOT IN ('MACHINERY', 'NATION_3'))
  AND NOT contains(path, '/NATION_3/')""")
def dir_stats(d: Data) -> DataFrame:
    stats = reports.directory_stats(d.entries, "/", 3, omit_subdirs=("MACHINERY", "NATION_3"), omit_paths=("/ASIA",))
    return stats.withColumns({c: F.unix_seconds(c) for c in ("oldest", "newest")})


@query("capacity_by_owner_dir", """
SELECT path, owner, CAST(sum(capacity) AS BIGINT) AS capacity FROM fx_entry_up GROUP BY path, owner""")
def capacity_by_owner_dir(d: Data) -> DataFrame:
    return hierarchy.capacity_by_owner(d.entries, owner_column(d.entries))


_HELD = """(SELECT owner, type, CASE WHEN type = 'FS_FILE_TYPE_DIRECTORY' THEN 4096
  WHEN CAST(id AS BIGINT) % 13 = 0 THEN 0 ELSE capacity END AS held FROM
  (SELECT owner, type, capacity, CASE WHEN type = 'FS_FILE_TYPE_DIRECTORY' THEN '0' ELSE id END AS id FROM fx_entries))"""


@query("owner_report", f"""
WITH per AS (SELECT owner, CAST(sum(held) AS BIGINT) AS bytes, count(*) FILTER (type <> 'FS_FILE_TYPE_DIRECTORY') AS files,
  count(*) FILTER (type = 'FS_FILE_TYPE_DIRECTORY') AS dirs FROM {_HELD} GROUP BY owner)
SELECT owner, bytes, files, dirs, coalesce(shown, 'Unknown') AS owner_name, domain
FROM per LEFT JOIN fx_shown ON auth_id = owner
UNION ALL SELECT NULL, CAST(sum(bytes) AS BIGINT), CAST(sum(files) AS BIGINT), CAST(sum(dirs) AS BIGINT), 'TOTAL', NULL FROM per""")
def owner_report(d: Data) -> DataFrame:
    return reports.owner_report(d.entries, d.identities)


@query("owner_report_logical", """
SELECT owner, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files, CAST(0 AS BIGINT) AS dirs FROM fx_files
WHERE creation_time > TIMESTAMP '2002-01-01' - INTERVAL 900 DAY GROUP BY owner
UNION ALL SELECT NULL, CAST(sum(size) AS BIGINT), count(*), 0 FROM fx_files
WHERE creation_time > TIMESTAMP '2002-01-01' - INTERVAL 900 DAY""")
def owner_report_logical(d: Data) -> DataFrame:
    found = search(d.files, Search(as_of=AS_OF, newer_than=900, time_field="creation_time"))
    return reports.owner_report(found, logical=True)


@query("scope_summary", """
SELECT count(*) FILTER (type = 'FS_FILE_TYPE_DIRECTORY') AS directories, count(*) FILTER (type = 'FS_FILE_TYPE_FILE') AS files,
  count(*) FILTER (type = 'FS_FILE_TYPE_SYMLINK') AS symlinks, CAST(0 AS BIGINT) AS other, count(*) AS total
FROM fx_entries WHERE starts_with(path, '/AMERICA/')""")
def scope_summary(d: Data) -> DataFrame:
    return reports.scope_summary(d.entries, "/AMERICA")


@query("dir_capacity_join", """
SELECT d.path, CAST(sum(u.capacity) AS BIGINT) AS total_capacity FROM fx_dirs d JOIN fx_entry_up u ON u.path = d.path GROUP BY 1""")
def dir_capacity_join(d: Data) -> DataFrame:
    dirs = search(d.entries, Search(type="directory"))
    return reports.with_directory_capacity(dirs, hierarchy.directory_aggregates(d.entries)).select(
        "path", "total_capacity")


@query("completeness_check", """
SELECT path, child_count, found, child_count - found AS missing FROM fx_dirs WHERE child_count <> found""")
def completeness_check(d: Data) -> DataFrame:
    return reports.completeness(d.entries)


@query("acl_report", """
SELECT path, any_value(owner) AS owner, any_value(grp) AS grp, CAST(count(*) AS INTEGER) AS ace_count,
  CAST(count(*) FILTER (inh) AS INTEGER) AS inherited_count, CAST(count(*) FILTER (NOT inh) AS INTEGER) AS explicit_count,
  string_agg(type || ':' || flags || ':' || trustee || ':' || rights, '|' ORDER BY pos) AS trustees
FROM fx_aces JOIN (SELECT path, owner, grp FROM fx_files) USING (path) GROUP BY path""")
def acl_report(d: Data) -> DataFrame:
    return reports.acl_report(d.objects).withColumnRenamed("group", "grp").withColumn(
        "trustees", F.array_join("trustees", "|"))


@query("acl_unique", """
WITH t AS (SELECT path, string_agg(x, ',' ORDER BY x) AS acl_text FROM (
  SELECT path, type || ':' || flags || ':' || trustee || ':' || rights || CASE WHEN inh THEN ':I' ELSE '' END AS x FROM fx_aces)
  GROUP BY path)
SELECT acl_text, count(*) AS objects, sha256(acl_text) AS acl_id FROM t GROUP BY acl_text""")
def acl_unique(d: Data) -> DataFrame:
    return reports.acl_unique(d.objects)


@query("count_by_extension", """
SELECT lower(string_split(name, '.')[-1]) AS extension, count(*) AS files FROM fx_files GROUP BY 1
ORDER BY files DESC, extension LIMIT 20""")
def count_by_extension(d: Data) -> DataFrame:
    return reports.count_by_extension(d.files)


@query("count_by_owner", "SELECT owner, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM fx_entries GROUP BY owner")
def count_by_owner(d: Data) -> DataFrame:
    return reports.count_by_owner(d.entries)


@query("sum_size", "SELECT CAST(sum(size) AS BIGINT) AS bytes FROM fx_files")
def sum_size(d: Data) -> DataFrame:
    return reports.total_size(d.files)


@query("top_owners", """
SELECT owner, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM fx_files GROUP BY owner
ORDER BY bytes DESC, owner LIMIT 10""")
def top_owners(d: Data) -> DataFrame:
    return reports.top_owners(d.files, 10)


@query("count_by_top_path", """
SELECT array_to_string(string_split(path, '/')[2:3], '/') AS top_path, count(*) AS files FROM fx_files GROUP BY 1
ORDER BY files DESC, top_path LIMIT 20""")
def count_by_top_path(d: Data) -> DataFrame:
    return reports.count_by_top_path(d.files)


@query("age_buckets", """
SELECT CASE WHEN creation_time > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY THEN '0-30 days'
  WHEN creation_time > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN '30-90 days'
  WHEN creation_time > TIMESTAMP '2001-08-01' - INTERVAL 365 DAY THEN '90-365 days' ELSE '1+ years' END AS age_bucket,
  count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM fx_files GROUP BY 1""")
def age_buckets(d: Data) -> DataFrame:
    return reports.age_buckets(d.files, "2001-08-01T00:00:00")


@query("growth_by_window", """
SELECT CAST(floor(epoch(creation_time) / 2592000) AS BIGINT) * 2592000 AS window_start, owner, count(*) AS files,
  CAST(sum(size) AS BIGINT) AS bytes FROM fx_files GROUP BY 1, 2""")
def growth_by_window(d: Data) -> DataFrame:
    return reports.growth(d.files)


@query("stale_alert", """
SELECT CAST(sum(size) AS BIGINT) AS stale_bytes, CAST(1000000000 AS BIGINT) AS threshold, sum(size) > 1000000000 AS alert
FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE' AND access_time < TIMESTAMP '2002-01-01' - INTERVAL 365 DAY""")
def stale_alert(d: Data) -> DataFrame:
    return reports.stale_alert(search(d.files, Search(as_of=AS_OF, type="file", ages={"access_time": (365, None)})), 10 ** 9)


@query("sort_report", """
SELECT path, files, capacity, row_number() OVER (ORDER BY files DESC, path) AS place FROM (
  SELECT path, count(*) AS files, CAST(sum(capacity) AS BIGINT) AS capacity FROM fx_up GROUP BY path)""")
def sort_report(d: Data) -> DataFrame:
    per = hierarchy.per_directory(d.files, every_level=True).where("depth > 0")
    return reports.placed(reports.sort_report(per, "count").select("path", "files", "capacity"))


@query("limit_matches", "SELECT path, size FROM fx_files WHERE type = 'FS_FILE_TYPE_FILE' ORDER BY path LIMIT 100")
def limit_matches(d: Data) -> DataFrame:
    return reports.limit_matches(search(d.files, Search(type="file")), 100).select("path", "size")


# --- identities ---


@query("resolve_names", """
SELECT path, coalesce(shown, 'Unknown') AS owner_name, 'Unknown' AS group_name
FROM fx_entries LEFT JOIN fx_shown ON auth_id = owner""")
def resolve_names(d: Data) -> DataFrame:
    return identity.resolve_names(d.entries, d.identities).select("path", "owner_name", "group_name")


@query("best_identity_name", """
WITH b AS (SELECT auth_id, arg_min(name, rank * 10 + position) AS name, arg_min(domain, rank * 10 + position) AS domain
  FROM fx_ranked GROUP BY auth_id)
SELECT i.auth_id, i.domain, coalesce(i.name, b.name) AS name, CASE WHEN i.name IS NULL THEN b.domain END AS display_domain
FROM fx_identities i LEFT JOIN b USING (auth_id)""")
def best_identity_name(d: Data) -> DataFrame:
    return identity.best_names(d.identities, d.equivalents)


@query("identity_rank", """
SELECT auth_id, name, domain, CAST(place AS INTEGER) AS place FROM (SELECT auth_id, name, domain,
  row_number() OVER (PARTITION BY auth_id ORDER BY rank, position) AS place FROM fx_ranked)""")
def identity_rank(d: Data) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("auth_id").orderBy("rank", "position")
    return identity.ranked_equivalents(d.identities, d.equivalents).select(
        "auth_id", "name", "domain", F.row_number().over(order).alias("place"))


_MEMBERS = """SELECT auth_id, auth_id AS member FROM fx_identities
  UNION SELECT auth_id, other_id FROM fx_equivalents UNION SELECT auth_id, nfs_id FROM fx_identities"""


@query("expand_identity", _MEMBERS)
def expand_identity(d: Data) -> DataFrame:
    return identity.expand(d.identities, d.equivalents)


@query("resolve_owner_filter", """
SELECT path, owner FROM fx_files WHERE owner IN (SELECT auth_id FROM fx_identities
  WHERE name = 'Customer#000000041' OR uid = 10038 OR auth_id = '7')""")
def resolve_owner_filter(d: Data) -> DataFrame:
    from treecensus.operators.search import owner_semi_join

    found = identity.resolve_owners(d.identities, ["Customer#000000041", "uid:10038", "auth_id:7", "nobody"])
    return owner_semi_join(d.files, found).select("path", "owner")


@query("owner_id_union", f"""
SELECT DISTINCT member AS auth_id FROM ({_MEMBERS}) WHERE auth_id IN (
  SELECT auth_id FROM fx_identities WHERE domain = 'LOCAL' AND name IS NOT NULL)""")
def owner_id_union(d: Data) -> DataFrame:
    local = d.identities.where("domain = 'LOCAL' AND name IS NOT NULL").select("auth_id")
    return identity.expand_owners(local, d.identities, d.equivalents)


@query("ace_canonical_order", """
SELECT path, string_agg(type || ':' || trustee, '|' ORDER BY inh, type <> 'Deny', pos) AS entries FROM fx_aces GROUP BY path""")
def ace_canonical_order(d: Data) -> DataFrame:
    return d.objects.select("path", F.array_join(F.transform(
        aces.canonical(F.col("acl.aces")), lambda a: F.concat(a["type"], F.lit(":"), a["trustee"])), "|").alias("entries"))


