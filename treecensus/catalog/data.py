"""Inventory tables derived from the given tables; all work grows with their size."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treecensus import constants as C, workspace
from treecensus.functions import paths
from treecensus.operators import changelog, chunks

AS_OF = "2002-01-01T00:00:00"

# id, time, name, source (see FIXTURES.md)
SNAPSHOTS = (
    (1, "1997-01-01", "daily_1", "/"),
    (2, "1998-07-01", "daily_2", "/"),
    (3, "1999-06-01", "replication_from_x", "/"),
    (4, "2000-01-01", "daily_4", "/"),
    (5, "2001-06-01", "africa_5", "/AFRICA"),
    (0, "2002-01-01", "live", "/"),
)
#: Snapshots of the same root, oldest first.
DAILY = (1, 2, 4)
ATTRIBUTE_STEPS = {
    "read_only": 2, "hidden": 3, "system": 5, "archive": 7, "temporary": 11,
    "compressed": 17, "not_content_indexed": 19, "sparse_file": 10, "offline": 23,
}


#: Rows of a range of paths that one task sorts and writes: larger tables have more ranges, not larger ones.
RANGE_ROWS = 50_000

# where the derived inventories of this application were written
_STORED: dict[tuple[str, str, str], str] = {}


class Data:
    """Lazy tables for one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str, write: Callable[[str], None]) -> DataFrame:
        """A table that is written once per application and folder, like an ingested export."""
        return self.spark.read.parquet(self.stored_at(name, write))

    def stored_at(self, name: str, write: Callable[[str], None]) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            where = workspace.folder(self.spark, name)
            write(where)
            _STORED[key] = where
        return _STORED[key]

    def _base(self) -> DataFrame:
        """One row per order with the numbers all other columns are made from."""
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        owners = self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        shipped = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"))
        orders = self.table("orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        k, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
        ext = (F.when(k % 50 == 0, "").when(first == "1", ".log").when(first == "2", ".tmp")
               .when(first == "3", ".py").when(first == "4", ".pdf").otherwise(".docx"))
        created = F.col("o_orderdate").cast("timestamp")
        return orders.join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
            k.alias("k"), "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "r_name",
            F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment",
                     F.lit("/cust_"), F.col("c_custkey").cast("string"),
                     F.lit("/order_"), k.cast("string"), ext).alias("path"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
            created.alias("creation_time"),
            F.coalesce(F.col("m").cast("timestamp"), created).alias("modification_time"))

    def _files(self) -> DataFrame:
        """Files and symlinks in path order; the narrow rows are brought into order before the wide columns are made."""
        k, size, day = F.col("k"), F.col("size"), F.col("modification_time").cast("date")
        link = k % 50 == 0
        blocks = F.when(k % 10 == 0, F.lit(1)).otherwise(F.ceil(size / F.lit(4096.0))).cast("bigint")
        plain = F.when(k % 13 != 0, F.lit(1)).cast("bigint")
        owner = F.col("c_custkey").cast("string")
        who = F.col("c_custkey") % 5
        kind = (F.when(who == 0, "NFS_UID").when(who == 1, "NFS_GID").when(who == 2, "SMB_SID")
                .when(who == 3, "LOCAL_USER"))
        value = (F.when(who == 0, (F.col("c_custkey") + 10000).cast("string"))
                 .when(who == 1, (F.col("c_custkey") + 20000).cast("string"))
                 .when(who == 2, F.concat(F.lit("S-1-5-21-"), owner))
                 .when(who == 3, F.col("c_name")))
        group = F.concat(F.lit("g"), F.col("c_nationkey").cast("string"))
        ranges = max(1, -(-self.table("orders").count() // RANGE_ROWS))
        rows = self._base().repartitionByRange(ranges, "path").sortWithinPartitions("path")
        return rows.withColumns({
            "snapshot_id": F.lit(0),
            "type": F.when(link, C.SYMLINK).otherwise(C.FILE),
            "id": k.cast("string"),
            "datablocks": F.when(k % 13 != 0, blocks),
            "metablocks": plain,
            "blocks": F.when(k % 13 != 0, blocks) + plain,
            "owner": owner,
            "group": group,
            "owner_details": F.struct(kind.alias("id_type"), value.alias("id_value"), owner.alias("auth_id")),
            "group_details": F.struct(F.lit("NFS_GID").alias("id_type"),
                                      F.col("c_nationkey").cast("string").alias("id_value"),
                                      group.alias("auth_id")),
            "access_time": F.date_add(day, (k % 400).cast("int")).cast("timestamp"),
            "change_time": F.date_add(day, (k % 30).cast("int")).cast("timestamp"),
            "child_count": F.lit(None).cast("bigint"),
            "extended_attributes": F.struct(*[
                F.when(k % 29 != 0, k % step == 0).alias(a) for a, step in ATTRIBUTE_STEPS.items()]),
            "symlink_target": F.when(k % 100 == 0, F.concat(
                F.lit("../cust_"), owner, F.lit("/order_"), (k + 1).cast("string")))
            .when(link, F.concat(F.lit("/"), "r_name", F.lit("/order_"), (k + 1).cast("string"))),
        })

    COLUMNS = ("snapshot_id", "path", "type", "id", "size", "blocks", "datablocks", "metablocks", "owner",
               "owner_details", "group", "group_details", *C.TIME_FIELDS, "child_count",
               "extended_attributes", "symlink_target")

    def _write_inventory(self, where: str) -> None:
        """Ingest: rows in path order, so that a search below a directory skips row groups."""
        self._files().select(*self.COLUMNS).write.parquet(where)
        self._dirs(self.spark.read.parquet(where)).select(*self.COLUMNS).write.mode("append").parquet(where)

    @cached_property
    def inventory(self) -> DataFrame:
        """All objects; lists and tags follow from these columns and are made where they are asked for."""
        return self.stored("inventory", self._write_inventory)

    @cached_property
    def entries(self) -> DataFrame:
        return self.inventory.select(*self.COLUMNS)

    @cached_property
    def files(self) -> DataFrame:
        """Files and symlinks."""
        return self.entries.where(F.col("type") != C.DIRECTORY)

    @cached_property
    def files_k(self) -> DataFrame:
        """The same with the order key as a number."""
        return self.files.withColumn("k", F.col("id").cast("bigint"))

    @cached_property
    def dirs(self) -> DataFrame:
        return self.entries.where(F.col("type") == C.DIRECTORY)

    @staticmethod
    def _dirs(files: DataFrame) -> DataFrame:
        """All directories that contain a file, at every level."""
        homes = workspace.settle(files.groupBy(paths.parent(F.col("path")).alias("home")).agg(
            F.count("*").alias("n"), F.min("creation_time").alias("born"),
            F.max("modification_time").alias("touched")), "homes")  # read twice: for the totals and for the directories inside
        own = F.col("path") == F.col("home")
        rolled = (homes.select("*", F.explode(paths.ancestors_or_self(F.col("home"))).alias("path"))
                  .groupBy("path").agg(
                      F.min("born").alias("creation_time"), F.max("touched").alias("modification_time"),
                      F.sum(F.when(own, F.col("n")).otherwise(0)).alias("direct")))
        inner = rolled.groupBy(paths.parent(F.col("path")).alias("up")).agg(F.count("*").alias("subdirs"))
        extra = F.when(F.length("path") % 9 == 0, 1).otherwise(0)
        nothing = F.lit(None).cast("string")
        zero = F.lit(0).cast("bigint")
        return rolled.join(inner, F.col("path") == F.col("up"), "left").select(
            F.lit(0).alias("snapshot_id"), "path", F.lit(C.DIRECTORY).alias("type"),
            F.concat(F.lit("d:"), "path").alias("id"), zero.alias("size"),
            F.lit(1).cast("bigint").alias("blocks"), zero.alias("datablocks"),
            F.lit(1).cast("bigint").alias("metablocks"), F.lit("root").alias("owner"),
            F.struct(nothing.alias("id_type"), nothing.alias("id_value"), F.lit("root").alias("auth_id"))
            .alias("owner_details"),
            F.lit("g0").alias("group"),
            F.struct(nothing.alias("id_type"), nothing.alias("id_value"), F.lit("g0").alias("auth_id"))
            .alias("group_details"),
            "creation_time", "modification_time", F.col("modification_time").alias("access_time"),
            F.col("modification_time").alias("change_time"),
            (F.col("direct") + F.coalesce("subdirs", F.lit(0)) + extra).alias("child_count"),
            F.struct(*[F.lit(None).cast("boolean").alias(a) for a in C.ATTRIBUTES]).alias("extended_attributes"),
            nothing.alias("symlink_target"))

    @cached_property
    def snapshots(self) -> DataFrame:
        rows = ", ".join(f"({i}, timestamp'{t}', '{n}', '{s}', false)" for i, t, n, s in SNAPSHOTS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, ts, name, source, in_deletion)")

    def _snap_files(self, moment: str, source: str) -> DataFrame:
        """Files of one snapshot."""
        k, path = F.col("k"), F.col("path")
        born, changed = F.col("creation_time"), F.col("modification_time")
        ts = F.lit(moment).cast("timestamp")
        held = (born <= ts) & ((k % 6 != 0) | (ts < F.date_add(changed.cast("date"), 200).cast("timestamp")))
        if source != "/":
            held = held & path.startswith(source + "/")
        return self.files_k.where(held).select(
            "path", "type", "id", "owner", (F.col("size") + F.when(changed <= ts, 4096).otherwise(0)).alias("size"),
            "creation_time", F.when(changed <= ts, changed).otherwise(born).alias("modification_time"))

    def _write_snapshots(self, where: str) -> None:
        """One partition a snapshot; the inventory is in path order already, so nothing is shuffled or sorted."""
        for number, moment, _, source in SNAPSHOTS:
            self._snap_files(moment, source).write.parquet(f"{where}/snapshot_id={number}")
        homes = self.spark.read.parquet(where).select(
            "snapshot_id", paths.parent(F.col("path")).alias("home")).distinct()
        dirs = homes.select("snapshot_id", F.explode(paths.ancestors_or_self(F.col("home"))).alias("path")).distinct()
        dirs = dirs.select(
            "snapshot_id", "path", F.lit(C.DIRECTORY).alias("type"), F.concat(F.lit("d:"), "path").alias("id"),
            F.lit("root").alias("owner"), F.lit(0).cast("bigint").alias("size"),
            *[F.lit(None).cast("timestamp").alias(c) for c in ("creation_time", "modification_time")])
        (dirs.sortWithinPartitions("snapshot_id", "path").write.mode("append")
         .partitionBy("snapshot_id").parquet(where))

    @cached_property
    def snap_entries(self) -> DataFrame:
        """Files of every snapshot and the directories that contain them."""
        return self.stored("snapshots", self._write_snapshots)

    @cached_property
    def snap_files(self) -> DataFrame:
        return self.snap_entries.where(F.col("type") != C.DIRECTORY)

    def snapshot(self, number: int, directories: bool = True) -> DataFrame:
        rows = self.snap_entries if directories else self.snap_files
        return rows.where(F.col("snapshot_id") == number)

    @cached_property
    def daily(self) -> tuple[DataFrame, DataFrame]:
        """The oldest of the daily snapshots, and the stored log of changes from each one to the next."""
        base = self.snapshot(DAILY[0]).drop("snapshot_id")
        where = self.stored_at("changes", lambda where: changelog.write(
            {n: self.snapshot(n).drop("snapshot_id") for n in DAILY}, where))
        return base, changelog.read(self.spark, where, base)

    @cached_property
    def identities(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.cast("string").alias("auth_id"),
            F.when(k % 4 == 0, "ACTIVE_DIRECTORY").when(k % 4 == 1, "LOCAL")
            .when(k % 4 == 2, "POSIX_USER").otherwise("POSIX_GROUP").alias("domain"),
            F.when(k % 5 != 0, F.col("c_name")).alias("name"),
            F.when(k % 4 == 2, k + 10000).alias("uid"), F.when(k % 4 == 3, k + 20000).alias("gid"),
            F.lit(None).cast("string").alias("sid"),
            (k + 3).cast("string").alias("nfs_id"), F.lit(None).cast("string").alias("smb_id"))

    @cached_property
    def equivalents(self) -> DataFrame:
        k = F.col("c_custkey")
        pairs = self.table("customer").select(
            k.cast("string").alias("auth_id"),
            F.explode(F.array(*[F.struct(F.lit(i).alias("position"), (k + i).cast("string").alias("other_id"))
                                for i in (1, 2)])).alias("e")).select("auth_id", "e.position", "e.other_id")
        known = self.table("customer").select(k.cast("string").alias("other_id"))
        return pairs.join(known, "other_id", "left_semi")

    @cached_property
    def owner_map(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").where(k % 10 == 0).select(
            k.cast("string").alias("source"), (k + 1).cast("string").alias("target"))

    @cached_property
    def group_map(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").where(n % 2 == 0).select(
            F.concat(F.lit("g"), n.cast("string")).alias("source"),
            F.concat(F.lit("g"), (n + 1).cast("string")).alias("target"))

    @staticmethod
    def _acl() -> Column:
        k = F.col("k")

        none = F.array().cast("array<string>")

        def ace(kind: str, who: Column, flags: str, rights: str, inherited: bool = False) -> Column:
            marks = [*flags, C.INHERITED] if inherited else [*flags]
            return F.struct(F.lit(kind).alias("type"), who.alias("trustee"),
                            (F.array(*[F.lit(m) for m in marks]) if marks else none).alias("flags"),
                            F.array(*[F.lit(r) for r in rights]).alias("rights"))

        def either(test: Column, kind: str, who: Column, flags: str, rights: str) -> Column:
            return F.when(test, ace(kind, who, flags, rights, True)).otherwise(ace(kind, who, flags, rights))

        everyone = F.lit("Everyone")
        listed = F.array(
            ace(C.ALLOW, F.col("owner"), "", C.RIGHTS),
            either(k % 2 == 0, C.ALLOW, F.col("group"), "fd", "rx"),
            F.when(k % 7 == 0, either(k % 14 == 0, C.ALLOW, everyone, "", "rw")),
            F.when(k % 11 == 0, ace(C.DENY, everyone, "", "w")))
        return F.struct(none.alias("control"), none.alias("posix_special"),
                        F.filter(listed, lambda a: a.isNotNull()).alias("aces"))

    @cached_property
    def objects(self) -> DataFrame:
        """Files with their access-control list."""
        return self.files_k.select(*self.COLUMNS, self._acl().alias("acl"))

    @staticmethod
    def _tags() -> Column:
        k, segment = F.col("k"), F.split_part("path", F.lit("/"), F.lit(4))
        pairs = F.array(
            F.when(k % 4 == 0, F.struct(F.lit("reviewed").alias("key"), F.lit("yes").alias("value")))
            .when(k % 4 == 1, F.struct(F.lit("reviewed").alias("key"), F.lit("no").alias("value"))),
            F.when(k % 3 == 0, F.struct(F.lit("project").alias("key"), segment.alias("value"))))
        return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))

    @cached_property
    def tagged(self) -> DataFrame:
        """Files with their tags."""
        return self.files_k.select("path", "type", "id", "size", "owner", "modification_time", self._tags().alias("tags"))

    @cached_property
    def archive(self) -> DataFrame:
        """Objects already lying in /archive."""
        k = F.col("k")
        return self.files_k.where(k % 9 == 0).select(
            F.concat(F.lit("/archive/"), paths.basename(F.col("path"))).alias("path"),
            F.lit(C.FILE).alias("type"),
            (F.col("size") + F.when(k % 18 == 0, 0).otherwise(1)).alias("size"), "modification_time")

    @cached_property
    def live(self) -> DataFrame:
        """The tree that plans are checked against: all entries and the archive."""
        columns = ("path", "type", "size", "modification_time")
        return self.entries.select(*columns).unionByName(self.archive)

    @cached_property
    def content(self) -> DataFrame:
        d = F.col("doc_id")
        text = F.col("text")
        half = F.left(text, F.floor(F.col("n_chars") / 2).cast("int"))
        marked = F.concat(F.left(text, F.lit(100)), F.lit("#"), F.substr(text, F.lit(102)))
        old = F.when(d % 5 == 0, half).when((d % 3 == 0) & (F.col("n_chars") > 100), marked).otherwise(text)
        return self.table("documents").select(
            F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source", F.lit("/doc_"), d.cast("string"),
                     F.lit(".txt")).alias("path"),
            F.lit(C.FILE).alias("type"), d.cast("string").alias("id"), F.col("n_chars").alias("size"),
            F.ceil(F.col("n_chars") / F.lit(4096.0)).cast("bigint").alias("datablocks"),
            text.alias("content"), old.alias("content_old"))

    def chunks(self, column: str, chunk: int) -> DataFrame:
        """A version of the contents as stored chunks."""
        return self.stored(f"chunks-{column}-{chunk}", lambda where: chunks.write(chunks.cut(self.content, column, chunk), where))

    @cached_property
    def change_feed(self) -> DataFrame:
        kind = F.col("event_type")
        op = (F.when(kind.isin("signup", "purchase"), "CREATE").when(kind.isin("click", "view"), "MODIFY")
              .otherwise("DELETE"))
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), op.alias("op"),
            F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"),
                     (k % 10).cast("string")).alias("path"))
