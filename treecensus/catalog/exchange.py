"""Queries that write an inventory with a sink and read it back with a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treecensus import constants as C, workspace
from treecensus.catalog.data import AS_OF, Data
from treecensus.catalog.permissions import _text
from treecensus.catalog.registry import query
from treecensus.functions import aces as A
from treecensus.operators import hierarchy, identity, reports
from treecensus.operators.search import Search, search
from treecensus.options import ace_key
from treecensus.plans import acl
from treecensus.schema import wire
from treecensus.sources import sinks, tables

_COLUMNS = ("path", "type", "size", "owner_id", "modified", "hidden")
_SELECT = """SELECT path, type, size, owner_id, CAST(epoch(modification_time) AS BIGINT) AS modified, attr_hidden AS hidden
FROM fx_files UNION ALL SELECT path, type, size, NULL, CAST(epoch(modification_time) AS BIGINT), NULL FROM fx_dirs"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("path", "type", "size", F.col("owner_details.id_value").alias("owner_id"),
                       F.unix_seconds("modification_time").alias("modified"),
                       F.col("extended_attributes.hidden").alias("hidden"))


#: Rows of a raw page at least, and how many pages of that size a table has at most.
PAGE_ROWS, MOST_PAGES = 1000, 384


def page_rows(entries: DataFrame) -> int:
    """Rows of a page: larger tables have larger pages, not more of them."""
    return max(PAGE_ROWS, -(-entries.count() // MOST_PAGES))


def raw_pages(d: Data) -> str:
    """The raw NDJSON rendering of all entries in compressed pages, written once per application like an ingested export."""
    def write(where: str) -> None:
        (wire(d.entries, (*C.EXPORT_COLUMNS, "symlink_target")).write.option("maxRecordsPerFile", page_rows(d.entries))
         .option("ignoreNullFields", "false").option("compression", "lz4").json(where))

    return d.stored_at("ndjson", write)


@query("scan_inventory", _SELECT)
def scan_inventory(d: Data) -> DataFrame:
    return _shown(tables.scan_inventory(d.spark, raw_pages(d)))


@query("sink_ndjson", "SELECT path, owner, CAST(size AS VARCHAR) AS size FROM fx_files")
def sink_ndjson(d: Data) -> DataFrame:
    where = workspace.folder(d.spark, "ndjson")
    sinks.write_ndjson(wire(d.files), where, ["path", "owner", "size"])
    lines = d.spark.read.text(where)
    return lines.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("path", "owner", "size")])


@query("scan_inventory_csv", _SELECT)
def scan_inventory_csv(d: Data) -> DataFrame:
    where = workspace.folder(d.spark, "csv")
    sinks.write_csv_all(d.entries, where)
    return _shown(tables.scan_inventory_csv(d.spark, where))


@query("sink_csv_all", """
SELECT path, owner, coalesce(shown, 'Unknown') AS owner_name, 'Unknown' AS group_name, type
FROM fx_entries LEFT JOIN fx_shown ON auth_id = owner""")
def sink_csv_all(d: Data) -> DataFrame:
    where = workspace.folder(d.spark, "csv")
    sinks.write_csv_all(identity.resolve_names(d.entries, d.identities), where, owner=True, group=True)
    back = tables.scan_inventory_csv(d.spark, where, names=True)
    return back.select("path", "owner", "owner_name", "group_name", "type")


@query("sink_csv_minimal", """
SELECT path, strftime(modification_time, '%Y-%m-%dT%H:%M:%S.000000000Z') AS modification_time, CAST(size AS VARCHAR) AS size,
  coalesce(shown, 'Unknown') AS owner
FROM fx_files LEFT JOIN fx_shown ON auth_id = owner
WHERE size > 20000000 AND access_time < TIMESTAMP '2002-01-01' - INTERVAL 500 DAY""")
def sink_csv_minimal(d: Data) -> DataFrame:
    # an access-time filter is used, yet the column is the search's time field
    opts = Search(as_of=AS_OF, larger_than="20MB", ages={"access_time": (500, None)})
    where = workspace.folder(d.spark, "csv")
    found = identity.resolve_names(search(d.files, opts), d.identities, who=("owner",))
    sinks.write_csv_minimal(found, where, opts, owner=True)
    return d.spark.read.csv(where, header=True, escape='"')


@query("sink_paths", r"""
SELECT path || CASE WHEN symlink_target IS NOT NULL THEN ' → ' || symlink_target ELSE '' END || chr(9)
  || coalesce(shown, 'Unknown') AS value FROM fx_files LEFT JOIN fx_shown ON auth_id = owner""")
def sink_paths(d: Data) -> DataFrame:
    where = workspace.folder(d.spark, "text")
    sinks.write_paths(identity.resolve_names(d.files, d.identities, who=("owner",)), where, ["owner_name"], links=True)
    return d.spark.read.text(where)


@query("sink_details", """
SELECT '0' AS snapshot_id, path, CAST(u.capacity AS VARCHAR) AS capacity,
  CAST(CAST(epoch(modification_time) AS BIGINT) AS VARCHAR) AS change_time
FROM fx_dirs JOIN (SELECT path, CAST(sum(capacity) AS BIGINT) AS capacity FROM fx_entry_up GROUP BY path) u USING (path)""")
def sink_details(d: Data) -> DataFrame:
    from treecensus.functions.fields import detail_fields

    rows = reports.with_directory_capacity(d.dirs, hierarchy.directory_aggregates(d.entries))
    where = workspace.folder(d.spark, "details")
    sinks.write_details(rows, where, detail_fields(None, directories=True), snapshot=True, unix_time=True)
    return d.spark.read.csv(where, header=True, escape='"')


_ENTRY = "type || ':' || flags || ':' || trustee || ':' || rights"


@query("sink_acl_csv", f"""
SELECT path, CAST(count(*) AS VARCHAR) AS ace_count, {', '.join(
    f"(list({_ENTRY} ORDER BY pos))[{i}] AS trustee_{i}" for i in range(1, 5))}
FROM fx_aces GROUP BY path""")
def sink_acl_csv(d: Data) -> DataFrame:
    where = workspace.folder(d.spark, "acl")
    sinks.write_acl_csv(reports.acl_report(d.objects), where)
    return d.spark.read.csv(where, header=True, escape='"').select(
        "path", "ace_count", *[f"trustee_{i}" for i in range(1, 5)])


@query("scan_acls", f"""
SELECT path, string_agg({_ENTRY} || CASE WHEN inh THEN ':I' ELSE '' END, ',' ORDER BY pos) AS acl FROM fx_aces GROUP BY path""")
def scan_acls(d: Data) -> DataFrame:
    # half of the rows carry the list inside an ``acl`` member, the others directly
    where = workspace.folder(d.spark, "acls")
    wired = d.objects.select("path", sinks.acl_wire(F.col("acl")).alias("acl"), (F.col("id").cast("bigint") % 2).alias("h"))
    rows = wired.select("path", F.when(F.col("h") == 0, F.col("acl")).alias("acl"), *[
        F.when(F.col("h") == 1, F.col("acl")[c]).alias(c) for c in ("control", "posix_special_permissions", "aces")])
    rows.write.json(where)
    back = tables.scan_acls(d.spark, where)
    return back.select("path", _text(F.col("acl")).alias("acl"))


@query("scan_acl_backup", f"""
SELECT path, CAST(any_value(k) AS VARCHAR) AS file_id,
  string_agg({_ENTRY} || CASE WHEN inh THEN ':I' ELSE '' END, ',' ORDER BY pos) AS acl
FROM fx_aces GROUP BY path HAVING bool_or(pos = 3)""")
def scan_acl_backup(d: Data) -> DataFrame:
    plan = acl.edit_aces(d.objects, A.remove(*ace_key("Deny:Everyone")))
    where = workspace.folder(d.spark, "backup")
    sinks.write_ndjson(acl.backup(plan, d.objects, "2002-01-01T00:00:00Z"), where)
    return tables.scan_acl_backup(d.spark, where).select("path", "file_id", _text(F.col("acl")).alias("acl"))


@query("scan_tags", """
SELECT path, reviewed, project, CASE WHEN k % 4 = 2 THEN '' END AS note FROM fx_tags""")
def scan_tags(d: Data) -> DataFrame:
    # values are Base64; the note is not, and becomes empty
    k = F.col("id").cast("bigint")
    entries = F.transform(F.map_entries("tags"), lambda e: F.struct(
        e["key"].alias("key"), F.base64(F.encode(e["value"], "UTF-8")).alias("value")))
    bad = F.when(k % 4 == 2, F.array(F.struct(F.lit("note").alias("key"), F.lit("a").alias("value")))).otherwise(
        F.array().cast("array<struct<key:string,value:string>>"))
    where = workspace.folder(d.spark, "tags")
    d.tagged.select("path", F.concat(entries, bad).alias("entries")).write.json(where)
    tags = tables.scan_tags(d.spark, where)
    return tags.select("path", *[F.try_element_at("tags", F.lit(c)).alias(c) for c in ("reviewed", "project", "note")])


@query("scan_identities", "SELECT auth_id, domain, name, uid, gid FROM fx_identities")
def scan_identities(d: Data) -> DataFrame:
    where = workspace.folder(d.spark, "identities")
    d.identities.write.json(where)
    return tables.scan_identities(d.spark, where, "json").select("auth_id", "domain", "name", "uid", "gid")


@query("scan_mapping_csv", r"""
SELECT CASE c_custkey % 4 WHEN 0 THEN 'CORP\' || c_name WHEN 1 THEN 'uid:' || c_custkey WHEN 2 THEN 'S-1-5-21-' || c_custkey
  ELSE 'uid:' || c_custkey END AS source, 'gid:' || (c_custkey + 1) AS target FROM customer""")
def scan_mapping_csv(d: Data) -> DataFrame:
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit("CORP\\"), "c_name")).when(k % 4 == 1, F.concat(F.lit("uid:"), k.cast("string")))
            .when(k % 4 == 2, F.concat(F.lit("sid:S-1-5-21-"), k.cast("string"))).otherwise(k.cast("string")))
    where = workspace.folder(d.spark, "mapping")
    # every file starts with the header and a comment, as hand-made lists do
    rows = d.table("customer").select(F.concat_ws(", ", text, F.concat(F.lit("gid:"), (k + 1).cast("string"))).alias("value"))
    head = d.spark.createDataFrame([("source,target",), ("# moved with the merger",)], "value string")
    head.unionByName(rows).write.text(where)
    return tables.scan_mapping_csv(d.spark, where)
