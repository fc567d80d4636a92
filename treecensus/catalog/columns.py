"""Queries over single rows: projections, scalar functions and names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.catalog.data import AS_OF, Data
from treecensus.catalog.registry import query
from treecensus.functions import aces, fields, identities, paths, patterns, rename, sizes, times
from treecensus.operators import hierarchy, reports


@query("select_fields", """
SELECT path, size, owner_id, CAST(NULL AS VARCHAR) AS nothing, attr_hidden AS hidden, type FROM fx_files""")
def select_fields(d: Data) -> DataFrame:
    return fields.select_fields(d.files, "path, size,owner_id,,nothing,attr.hidden,path,type").withColumnRenamed(
        "attr.hidden", "hidden")


@query("field_aliases", """
SELECT path, owner_type, owner_id, 'NFS_GID' AS group_type, CAST(c_nationkey AS VARCHAR) AS group_id,
  attr_archive AS archive FROM fx_files""")
def field_aliases(d: Data) -> DataFrame:
    return fields.select_fields(d.files, "path,owner_type,owner_id,group_type,group_id,attr.archive").toDF(
        "path", "owner_type", "owner_id", "group_type", "group_id", "archive")


@query("detail_fields", """
SELECT d.path, (SELECT CAST(sum(u.capacity) AS BIGINT) FROM fx_entry_up u WHERE u.path = d.path) AS capacity,
  CAST(epoch(d.modification_time) AS BIGINT) AS change_time FROM fx_dirs d""")
def detail_fields(d: Data) -> DataFrame:
    rows = reports.with_directory_capacity(d.dirs, hierarchy.directory_aggregates(d.entries))
    return fields.select_fields(fields.epoch_times(rows), fields.detail_fields(None, directories=True))


@query("to_epoch", """
SELECT path, CAST(epoch(creation_time) AS BIGINT) AS creation_time,
  CAST(epoch(modification_time) AS BIGINT) AS modification_time, CAST(epoch(access_time) AS BIGINT) AS access_time,
  CAST(epoch(change_time) AS BIGINT) AS change_time FROM fx_files""")
def to_epoch(d: Data) -> DataFrame:
    return fields.epoch_times(d.files).select("path", *C.TIME_FIELDS)


@query("parse_ts", """
SELECT path, CASE WHEN k % 17 <> 0 THEN CAST(epoch(change_time) AS BIGINT) + 3723 END AS seconds FROM fx_files""")
def parse_ts(d: Data) -> DataFrame:
    text = F.concat(F.date_format(F.col("change_time"), "yyyy-MM-dd"), F.lit("T01:02:03.123368885Z"))
    rows = d.files_k.select("path", F.when(F.col("k") % 17 != 0, text).otherwise(
        F.concat(F.lit("no time "), F.col("id"))).alias("text"))
    return rows.select("path", times.epoch(times.parse(F.col("text"))).alias("seconds"))


@query("path_parts", """
SELECT e.path, name, parent, len(string_split(e.path, '/')) - 1 AS depth,
  coalesce((SELECT string_agg(u.path, '|' ORDER BY u.depth) FROM fx_entry_up u
            WHERE u.entry = e.path AND u.depth > 0), '') AS ancestors
FROM fx_entries e""")
def path_parts(d: Data) -> DataFrame:
    # a directory may be written with a trailing slash
    given = F.when(F.col("type") == C.DIRECTORY, F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    rows = d.entries.select("path", given.alias("p"))
    p = F.col("p")
    return rows.select("path", paths.basename(p).alias("name"), paths.parent(p).alias("parent"),
                       paths.depth(p).cast("bigint").alias("depth"),
                       F.array_join(paths.ancestors(p), "|").alias("ancestors"))


@query("entry_capacity", "SELECT path, capacity FROM fx_entries")
def entry_capacity(d: Data) -> DataFrame:
    return d.entries.select("path", hierarchy.capacity().alias("capacity"))


_UNITS = ("", "B", "KB", "MB", "gb", "TiB", "XB", "kib")


@query("size_text_to_bytes", """
SELECT path, CAST(floor(CAST(size % 1000 || '.' || k % 10 AS DOUBLE) * CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 1
  WHEN 2 THEN 1000 WHEN 3 THEN 1000000 WHEN 4 THEN 1000000000 WHEN 5 THEN 1099511627776 WHEN 7 THEN 1024 END)
  AS BIGINT) AS bytes FROM fx_files""")
def size_text_to_bytes(d: Data) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("k") % 8 + 1).cast("int"))
    text = F.concat((F.col("size") % 1000).cast("string"), F.lit("."), (F.col("k") % 10).cast("string"), unit)
    return d.files_k.select("path", sizes.text_to_bytes(text).alias("bytes"))


def _shown_sql(step: int, labels: tuple[str, ...], short: bool) -> str:
    cases = []
    for i, label in enumerate(labels[:5]):
        value = "CAST(size AS DOUBLE)" + f" / {step}.0" * i
        if short:
            text = (f"size || ' {label}'" if i == 0 else
                    f"regexp_replace(format('{{:.1f}}', {value}), '\\.0$', '') || ' {label}'")
        else:
            text = f"format('{{:.2f}}', {value}) || ' {label}'"
        cases.append(f"WHEN {value} < {step} THEN {text}")
    return "CASE " + " ".join(cases) + " END"


@query("human_size", f"""
SELECT path, {_shown_sql(1024, C.BINARY_LABELS, True)} AS binary_text,
  {_shown_sql(1000, C.DECIMAL_LABELS, True)} AS decimal_text FROM fx_files""")
def human_size(d: Data) -> DataFrame:
    return d.files.select("path", sizes.human_size(F.col("size")).alias("binary_text"),
                          sizes.human_size(F.col("size"), base10=True).alias("decimal_text"))


@query("format_bytes", f"""
SELECT path, {_shown_sql(1024, C.BINARY_LABELS, False)} AS binary_text,
  {_shown_sql(1000, C.DECIMAL_LABELS, False)} AS decimal_text FROM fx_files""")
def format_bytes(d: Data) -> DataFrame:
    return d.files.select("path", sizes.format_bytes(F.col("size")).alias("binary_text"),
                          sizes.format_bytes(F.col("size"), base10=True).alias("decimal_text"))


@query("raw_id", """
SELECT path, CASE owner_type WHEN 'NFS_UID' THEN 'UID:' || owner_id WHEN 'NFS_GID' THEN 'GID:' || owner_id
  WHEN 'SMB_SID' THEN 'SID:' || owner_id WHEN 'LOCAL_USER' THEN 'auth_id:' || owner_id
  ELSE 'auth_id:' || owner END AS owner, 'GID:' || c_nationkey AS grp FROM fx_files""")
def raw_id(d: Data) -> DataFrame:
    return d.files.select("path", identities.raw_id(F.col("owner_details"), F.col("owner")).alias("owner"),
                          identities.raw_id(F.col("group_details"), F.col("group")).alias("grp"))


@query("owner_name", "SELECT auth_id, shown FROM fx_shown")
def owner_name(d: Data) -> DataFrame:
    return d.identities.select("auth_id", identities.owner_name(
        F.col("name"), F.col("domain"), F.col("uid"), F.col("gid")).alias("shown"))


@query("match_name", r"""
SELECT path, regexp_matches(name, '(?i)\Aorder_1.*\.log\z') AS as_glob,
  regexp_matches(name, '(?i)er_1[0-9]*\.(log|tmp)$') AS as_regex,
  regexp_matches(name, '\Aorder_[13579][^0-4].*\z') AS as_class FROM fx_entries""")
def match_name(d: Data) -> DataFrame:
    name = paths.basename(F.col("path"))
    return d.entries.select(
        "path", patterns.match_name(name, "ORDER_1*.log", patterns.GLOB).alias("as_glob"),
        patterns.match_name(name, r"er_1[0-9]*\.(log|tmp)$").alias("as_regex"),
        patterns.match_name(name, "order_[13579][!0-4]*", patterns.GLOB, True).alias("as_class"))


@query("pattern_conflicts", r"""
SELECT path, regexp_matches(name, '(?i)order_1.*') AS as_regex,
  regexp_matches(name, '(?i)\Aorder_1\..*\z') AS as_glob FROM fx_files
WHERE regexp_matches(name, '(?i)order_1.*') <> regexp_matches(name, '(?i)\Aorder_1\..*\z')""")
def pattern_conflicts(d: Data) -> DataFrame:
    pattern = "order_1.*"
    name = paths.basename(F.col("path"))
    return d.files.select(
        "path", patterns.match_name(name, pattern, patterns.REGEX).alias("as_regex"),
        patterns.match_name(name, pattern, patterns.GLOB).alias("as_glob")).where("as_regex <> as_glob")


_NAMES_SQL = ", ".join(f"CASE WHEN attr_{a} THEN '{a}' END" for a in C.ATTRIBUTES)


@query("attr_names", f"SELECT path, concat_ws(',', {_NAMES_SQL}) AS attributes FROM fx_files")
def attr_names(d: Data) -> DataFrame:
    return d.files.select("path", F.array_join(
        fields.attr_names(F.col("extended_attributes")), ",").alias("attributes"))


@query("symlink_target_abs", """
SELECT path, CASE WHEN starts_with(symlink_target, '/') THEN symlink_target
  ELSE parent || '/order_' || (k + 1) END AS target FROM fx_files WHERE symlink_target IS NOT NULL""")
def symlink_target_abs(d: Data) -> DataFrame:
    return d.files.where("symlink_target IS NOT NULL").select(
        "path", paths.link_target(F.col("path"), F.col("symlink_target")).alias("target"))


@query("rename_substitute", r"""
SELECT path, regexp_replace(regexp_replace(regexp_replace(name, 'order_(\d+)', 'o\1-\1', 'g'), '.log', '.txt', 'g'),
  'o(.)', 'x\1y', 'g') AS new_name FROM fx_files""")
def rename_substitute(d: Data) -> DataFrame:
    new = rename.renamer(r"{order_(\d+)|o\1-\1}{.log|.txt}{o?|x?y}")
    return d.files.select("path", new(paths.basename(F.col("path"))).alias("new_name"))


@query("rename_template", r"""
SELECT path, CASE WHEN regexp_matches(name, '^order_.*\.log$') THEN 'log-' || regexp_extract(name, '^order_(.*)\.log$', 1)
  || '.bak' WHEN regexp_matches(name, '^.*7.*\.tmp$') THEN 'log-' || regexp_extract(name, '^(.*)7(.*)\.tmp$', 1) || '.bak'
  END AS new_name FROM fx_files""")
def rename_template(d: Data) -> DataFrame:
    new = rename.renamer("log-*.bak", ["plain.log", "order_*.log", "*7*.tmp"])
    return d.files.select("path", new(paths.basename(F.col("path"))).alias("new_name"))


@query("custom_rename", "SELECT path, upper(name) || '.old' AS new_name FROM fx_files")
def custom_rename(d: Data) -> DataFrame:
    def upper(name: Column) -> Column:
        return F.concat(F.upper(name), F.lit(".old"))

    return d.files.select("path", rename.renamer(upper)(paths.basename(F.col("path"))).alias("new_name"))


@query("conflict_suffix", """
SELECT path, CASE WHEN contains(name, '.') THEN string_split(name, '.')[1] || '_restored_2002-01-01_00-00-00.'
  || string_split(name, '.')[2] ELSE name || '_restored_2002-01-01_00-00-00' END AS new_name FROM fx_files""")
def conflict_suffix(d: Data) -> DataFrame:
    suffix = rename.suffix_text(datetime.fromisoformat(AS_OF))
    return d.files.select("path", rename.with_suffix(paths.basename(F.col("path")), suffix).alias("new_name"))


@query("trustee_text", """
SELECT path, pos, type || ':' || flags || CASE WHEN pos = 1 THEN 'g' ELSE '' END || ':' || trustee || ':' || rights
  AS entry FROM fx_aces""")
def trustee_text(d: Data) -> DataFrame:
    texts = aces.trustee_texts(F.col("acl.aces"), lambda who: who.rlike(r"^g\d+$"))
    # the position of a left-out entry is not stored, so it is told from the entry itself
    rows = d.objects.select("path", F.explode(texts).alias("entry"))
    place = (F.when(F.col("entry").startswith("Deny"), 3).when(F.col("entry").contains(":Everyone:"), 2)
             .when(F.col("entry").contains(":fdg:"), 1).otherwise(0))
    return rows.select("path", place.alias("pos"), "entry")
