"""Readers with fixed schemas; nothing is inferred from the data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from treecensus import constants as C
from treecensus.functions import aces as A, paths
from treecensus.options import OptionError
from treecensus.schema import NESTED, RAW, typed

IDENTITY = "auth_id string, domain string, name string, uid bigint, gid bigint, sid string, nfs_id string, smb_id string"
SNAPSHOT = "id int, ts timestamp, name string, source string, in_deletion boolean"
_WIRE_ACE = ("array<struct<type:string,trustee:string,flags:array<string>,rights:array<string>>>")
_WIRE_ACL = f"control array<string>, posix_special_permissions array<string>, aces {_WIRE_ACE}"


def raw_inventory(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(RAW).option("columnNameOfCorruptRecord", "_corrupt").json(path))


def scan_inventory(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON export with all attributes. A broken line yields no row; a bad value yields null."""
    return typed(raw_inventory(spark, path))


def scan_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an NDJSON export that hold no usable row."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", RAW, {"columnNameOfCorruptRecord": "_corrupt"})
    return (lines.withColumn("_p", parsed).where((F.trim("value") != "") & (
        F.coalesce(F.length(F.col("_p.path")), F.lit(0)) == 0)).select(F.col("value").alias("line")))


def scan_inventory_csv(spark: SparkSession, path: str, names: bool = False,
                       multiline: bool = False) -> DataFrame:
    """CSV export with all attributes; nested cells hold JSON text.

    ``names`` tells that the export has owner_name and group_name columns.
    Multi-line records (names with line feeds) cannot be split between tasks.
    """
    header = []
    for column in C.EXPORT_COLUMNS:
        header.append(column)
        if names and column in ("owner", "group"):
            header.append(f"{column}_name")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=multiline)
    rows = rows.withColumns({c: F.from_json(c, s) for c, s in NESTED.items()})
    return typed(rows.withColumn("symlink_target", F.lit(None).cast("string")),
                 [f"{c}_name" for c in ("owner", "group")] if names else [])


def scan_snapshot(entries: DataFrame, snapshot_id: int) -> DataFrame:
    """The tree as of one snapshot; prunes a table partitioned by ``snapshot_id``."""
    return entries.where(F.col("snapshot_id") == snapshot_id)


def scan_object(entries: DataFrame, path: str) -> DataFrame:
    """A root that is itself a file or symlink."""
    return entries.where((F.col("path") == paths.root_text(path)) & (F.col("type") != C.DIRECTORY))


def trustee_column(text: Column) -> Column:
    """One spelling per trustee, like ``options.trustee``."""
    bare = F.trim(text)
    return (F.when(bare.rlike(r"^\d+$"), F.concat(F.lit("uid:"), bare))
            .when(F.lower(bare).startswith("sid:s-"), F.substr(bare, F.lit(5))).otherwise(bare))


def scan_mapping_csv(spark: SparkSession, path: str, trustees: bool = True) -> DataFrame:
    """``source,target`` rows; header and ``#`` lines are skipped, a repeated source is an error."""
    rows = spark.read.csv(path, schema="source string, target string", comment="#", escape='"')
    rows = rows.select(F.trim("source").alias("source"), F.trim("target").alias("target")).where(
        "source IS NOT NULL AND target IS NOT NULL AND NOT (lower(source) = 'source' AND lower(target) = 'target')")
    if trustees:
        rows = rows.select(trustee_column(F.col("source")).alias("source"),
                           trustee_column(F.col("target")).alias("target"))
    twice = rows.groupBy("source").count().where("count > 1").limit(1).collect()
    if twice:
        raise OptionError(f"mapping lists {twice[0]['source']!r} more than once")
    return rows


def _table(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def scan_identities(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _table(spark, path, IDENTITY, kind)


def scan_snapshots(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _table(spark, path, SNAPSHOT, kind)


def decode_tag(value: Column) -> Column:
    """Base64 text to UTF-8; what is not Base64 becomes empty."""
    binary = F.try_to_binary(value, F.lit("base64"))
    return F.coalesce(F.make_valid_utf8(binary.cast("string")), F.lit(""))


def decode_tags(entries: Column) -> Column:
    """Wire tags as a map: null stays null (unreadable), no tags is an empty map."""
    keyed = F.filter(entries, lambda e: e["key"].isNotNull())
    # the last value of a repeated key wins
    final = F.filter(keyed, lambda e, i: ~F.array_contains(
        F.transform(F.slice(keyed, i + 2, F.greatest(F.size(keyed), F.lit(1))), lambda x: x["key"]), e["key"]))
    return F.map_from_entries(F.transform(final, lambda e: F.struct(e["key"], decode_tag(e["value"]))))


def scan_tags(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON rows ``{path, entries: [{key, value}]}``."""
    rows = spark.read.schema("path string, entries array<struct<key:string,value:string>>").json(path)
    return rows.select("path", decode_tags(F.col("entries")).alias("tags"))


# --- fixed values: wire names of entry types and inheritance flags ---
_WIRE_TYPES = {"ALLOWED": C.ALLOW, "DENIED": C.DENY}
_WIRE_FLAGS = {"OBJECT_INHERIT": "f", "CONTAINER_INHERIT": "d"}


def _words(column: Column, words: dict[str, str]) -> Column:
    shown = column
    for wire, short in words.items():
        shown = F.when(column == wire, F.lit(short)).otherwise(shown)
    return shown


def normal_acl(acl: Column, special: str = "posix_special_permissions") -> Column:
    """A wire ACL in the package's form; absent lists are empty."""
    empty = F.array().cast("array<string>")
    aces = F.transform(acl["aces"], lambda a: F.struct(
        _words(a["type"], _WIRE_TYPES).alias("type"), a["trustee"].alias("trustee"),
        F.transform(F.coalesce(a["flags"], empty), lambda f: _words(f, _WIRE_FLAGS)).alias("flags"),
        A.ordered(F.coalesce(a["rights"], empty)).alias("rights")))
    return F.struct(F.coalesce(acl["control"], empty).alias("control"),
                    F.coalesce(acl[special], empty).alias("posix_special"),
                    F.coalesce(aces, F.array().cast(f"array<{A.ACE}>")).alias("aces"))


def _trustee_text(aces: Column) -> Column:
    """A trustee may be a bare id or an object with an auth_id; the reader gives its JSON text."""
    return F.transform(aces, lambda a: a.withField("trustee", F.coalesce(
        F.get_json_object(F.when(a["trustee"].startswith("{"), a["trustee"]), "$.auth_id"), a["trustee"])))


def scan_acls(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON rows with a path and a list, wrapped in ``acl`` or not."""
    rows = spark.read.schema(f"path string, acl struct<{_nested(_WIRE_ACL)}>, {_WIRE_ACL}").json(path)
    plain = F.struct("control", "posix_special_permissions", "aces")
    either = F.when(F.col("acl.aces").isNotNull(), F.col("acl")).otherwise(plain)
    return rows.withColumn("_acl", either).select("path", normal_acl(
        F.col("_acl").withField("aces", _trustee_text(F.col("_acl.aces")))).alias("acl"))


def scan_acl_backup(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON backup rows: path, file id, list, time."""
    return spark.read.schema(f"path string, file_id string, acl {A.ACL}, timestamp string").json(path)


def _nested(fields: str) -> str:
    """DDL of columns as DDL of struct members."""
    return T.StructType.fromDDL(fields).simpleString()[len("struct<"):-1]


def scan_file_content(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, size, content)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("size"), "content"))


#: Tasks that read ranges of files, at most; with more ranges a task reads several.
MOST_TASKS = 50_000


def read_ranges(ranges: DataFrame, piece: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """The bytes of listed ranges of files (path, size, no, offset, bytes) as rows (path, size, no, part, data).

    Nothing but the ranges is read, each in parts of ``piece`` bytes.  This is the one reader with Python tasks:
    Spark's own one takes a file as a single value.  A row stands for much work, so the number of tasks is
    stated, else Spark would join the small-looking partitions.
    """
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", row["path"]))
                with store.open_input_file(name) as file:
                    for i, start in enumerate(range(0, row["bytes"], piece)):
                        data = file.read_at(min(piece, row["bytes"] - start), row["offset"] + start)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["path"]]), *(pa.array([v], pa.int64()) for v in (row["size"], row["no"], i)),
                             pa.array([data], pa.binary())], ["path", "size", "no", "part", "data"])

    tasks = min(MOST_TASKS, max(1, ranges.count() if tasks is None else tasks))
    return (ranges.select("path", *(F.col(c).cast("bigint").alias(c) for c in ("size", "no", "offset", "bytes")))
            .repartition(tasks, "path", "no").mapInArrow(read, "path string, size bigint, no bigint, part bigint, data binary"))


def scan_chunks(spark: SparkSession, path: str, chunk: int = C.CHUNK, span: int = 64 << 20) -> DataFrame:
    """Files of any size as rows (path, chunk, size, data), see ``operators.chunks``.

    Only names and lengths are listed; every task then opens the spans (of about ``span`` bytes) dealt to it, so
    one large file is read by many tasks.  Spark does not list empty files, so they have no rows.
    """
    each = max(1, span // chunk)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .select("path", F.col("length").alias("size")))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / (each * chunk)).cast("bigint"))
    offset = F.col("no") * each * chunk
    spans = (listed.select("path", "size", F.explode(numbers).alias("no"))
             .select("*", offset.alias("offset"), F.least(F.lit(each * chunk), F.col("size") - offset).alias("bytes")))
    return read_ranges(spans, chunk).select("path", (F.col("no") * each + F.col("part")).alias("chunk"), "size", "data")


def read_range(content: Column, offset: int | Column, length: int | Column) -> Column:
    """A zero-based range of a content column."""
    start = offset if isinstance(offset, Column) else F.lit(offset)
    count = length if isinstance(length, Column) else F.lit(length)
    return F.substr(content, start + 1, count)


def stream_inventory(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Pages of an NDJSON export as they arrive."""
    reader = spark.readStream.schema(RAW).option("columnNameOfCorruptRecord", "_corrupt")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return typed(reader.json(path))
