"""Scalar functions and options."""

import pytest
from pyspark.sql import functions as F

from treecensus import options as O
from treecensus.functions import fields, identities, paths, sizes, times


def one(spark, value, kind, function):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("100MB", 10 ** 8), ("1.5GiB", 1610612736), ("12", 12), ("1.", 1), ("2kib", 2048), ("3B", 3), ("1.0005KB", 1000),
    ("1EB", None), ("MB", None), ("-1", None), ("1 MB", None), ("", None)])
def test_sizes(spark, text, expected):
    assert one(spark, text, "string", sizes.text_to_bytes) == expected
    if expected is None:
        with pytest.raises(O.OptionError):
            O.size_bytes(text)
    else:
        assert O.size_bytes(text) == expected


@pytest.mark.parametrize("n,short,long", [
    (16, "16 B", "16.00 B"), (1023, "1023 B", "1023.00 B"), (1024, "1 KiB", "1.00 KiB"), (1280, "1.2 KiB", "1.25 KiB"),
    (1536 * 1024, "1.5 MiB", "1.50 MiB"), (1048575, "1024 KiB", "1024.00 KiB"), (2 ** 62, "4 EiB", "4.00 EiB")])
def test_shown_sizes(spark, n, short, long):
    assert one(spark, n, "bigint", sizes.human_size) == short
    assert one(spark, n, "bigint", sizes.format_bytes) == long


def test_shown_sizes_equal_python_rounding(spark):
    values = [n * 50 for n in range(20, 400)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(
        "v", sizes.human_size(F.col("v"), base10=True).alias("s")).collect()
    for v, s in rows:
        text = f"{v / 1000:.1f}"
        assert s == (text[:-2] if text.endswith(".0") else text) + " KB"
    assert one(spark, None, "bigint", sizes.human_size) == ""


def test_capacity_rules(spark):
    rows = [(1, 1, 9), (None, 1, 9), (2, None, 9), (None, None, 9), (None, None, None), (0, 0, 9)]
    frame = spark.createDataFrame(rows, "d bigint, m bigint, s bigint")
    got = [tuple(r) for r in frame.select(
        sizes.entry_capacity(F.col("d"), F.col("m"), F.col("s")), sizes.owner_capacity(F.col("d"), F.col("m"))).collect()]
    assert got == [(8192, 8192), (4096, 4096), (8192, 8192), (9, 0), (0, 0), (0, 0)]


def test_paths(spark):
    rows = [("/a/b/c.txt", "c.txt", "/a/b", 3, ["/a", "/a/b"]), ("/a/", "a", "/", 1, []), ("/", "", "/", 0, []),
            ("/x y/z/", "z", "/x y", 2, ["/x y"])]
    frame = spark.createDataFrame([(r[0],) for r in rows], "p string")
    p = F.col("p")
    got = [tuple(r) for r in frame.select(
        "p", paths.basename(p), paths.parent(p), paths.depth(p), paths.ancestors(p)).collect()]
    assert got == rows
    assert one(spark, "/a/b/c/d", "string", lambda v: paths.ancestors(v, "/a")) == ["/a/b", "/a/b/c"]


@pytest.mark.parametrize("target,expected", [
    ("/x/y", "/x/y"), ("z", "/a/b/z"), ("../z", "/a/z"), ("./q/../z", "/a/b/z"), ("../../../../z", "/z"), (None, None)])
def test_links(spark, target, expected):
    assert one(spark, target, "string", lambda t: paths.link_target(F.lit("/a/b/link"), t)) == expected


def test_times(spark):
    assert one(spark, "2025-11-06T21:02:43.123368885Z", "string", lambda t: times.epoch(times.parse(t))) == 1762462963
    assert one(spark, "nope", "string", lambda t: times.epoch(times.parse(t))) is None


@pytest.mark.parametrize("details,plain,raw", [
    (("NFS_UID", "1001", "9"), "9", "UID:1001"), (("NFS_GID", "5", "9"), "9", "GID:5"),
    (("SMB_SID", "S-1-5", "9"), "9", "SID:S-1-5"), (("LOCAL_USER", "joe", "9"), "9", "auth_id:joe"),
    (("LOCAL_USER", "", "9"), "9", "auth_id:9"), ((None, None, None), "9", "auth_id:9"), (None, "9", "auth_id:9"),
    (None, None, "Unknown"), ((None, "", None), "", "Unknown")])
def test_raw_id(spark, details, plain, raw):
    frame = spark.createDataFrame([(details, plain)], "d struct<id_type:string,id_value:string,auth_id:string>, p string")
    assert frame.select(identities.raw_id(F.col("d"), F.col("p"))).first()[0] == raw


@pytest.mark.parametrize("name,domain,uid,gid,shown", [
    ("joe", "POSIX_USER", 7, None, "joe (UID 7)"), ("Unknown-x", "POSIX_USER", 7, None, "UID 7"),
    (None, "POSIX_USER", 7, None, "UID 7"), ("", "POSIX_GROUP", None, 8, "GID 8"), ("joe", "POSIX_USER", None, None, "joe"),
    ("dev", "POSIX_GROUP", None, 8, "dev (GID 8)"), ("ad", "ACTIVE_DIRECTORY", 7, 8, "ad"), (None, None, None, None, "Unknown")])
def test_owner_name(spark, name, domain, uid, gid, shown):
    frame = spark.createDataFrame([(name, domain, uid, gid)], "n string, d string, u bigint, g bigint")
    assert frame.select(identities.owner_name(F.col("n"), F.col("d"), F.col("u"), F.col("g"))).first()[0] == shown


def test_field_lists():
    assert O.field_paths("path, size,,path,owner_id,attr.hidden,a.b") == [
        ("path", "path"), ("size", "size"), ("owner_id", "owner_details.id_value"),
        ("attr.hidden", "extended_attributes.hidden"), ("a.b", "a.b")]
    for bad in ("attr.", "a.b.c"):
        with pytest.raises(O.OptionError):
            O.field_paths(bad)
    assert fields.detail_fields(None) == "path,size,change_time"
    assert fields.detail_fields("ALL", directories=True).endswith(",capacity")


def test_option_texts():
    assert O.attributes("sparse, ReadOnly,nci,sparse_file") == ["sparse_file", "read_only", "not_content_indexed"]
    assert "".join(O.rights("Read+w")) == "rwtncy" and "".join(O.rights("FullControl")) == "rwaxdDtTnNcCoy"
    assert O.ace_key("Allow:gid:14011") == ("Allow", "gid:14011") and O.ace_key("deny:14011") == ("Deny", "uid:14011")
    assert O.ace_rights("Allow:gid:5:rx") == ("Allow", "gid:5", ["r", "x"])
    assert O.ace_full("Allow:fd:sid:S-1-5-21:Modify")[:3] == ("Allow", ["f", "d"], "S-1-5-21")
    assert O.mapping_pair("uid:1001:uid:2001") == ("uid:1001", "uid:2001")
    assert O.mapping_pair("uid:1001:DOMAIN\\user") == ("uid:1001", "DOMAIN\\user")
    assert O.mapping_pair("olduser:newuser") == ("olduser", "newuser")
    assert O.duration("12h").total_seconds() == 43200 and O.duration("5").days == O.duration("5d").days == 5
    for bad in (lambda: O.ace_key("Everyone"), lambda: O.ace_full("Allow:q:a:r"), lambda: O.rights("z"),
                lambda: O.attributes("nothing"), lambda: O.duration("5w")):
        with pytest.raises(O.OptionError):
            bad()


def test_places_follow_the_order_over_partitions(spark):
    from treecensus.operators import reports

    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS v", "concat('/', id) AS path").repartition(6)
    assert all(r.place == r.v + 1 for r in reports.placed(rows.orderBy("v")).collect())
    assert reports.placed(rows.limit(0).orderBy("v")).count() == 0
