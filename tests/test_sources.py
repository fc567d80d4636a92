"""Readers and writers: bad input, quoting, wire forms."""

import json

import pytest
from conftest import column
from pyspark.sql import functions as F

from treecensus.operators.search import Search
from treecensus.options import OptionError
from treecensus.sources import sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_bad_values_never_fail_a_read(spark, tmp_path):
    rows = [{"path": "/ok/", "size": "12", "type": "FS_FILE_TYPE_DIRECTORY", "modification_time": "2025-11-06T21:02:43.123368885Z",
             "owner_details": {"auth_id": "5"}, "extended_attributes": {"hidden": True}, "surprise": 1},
            {"path": "/number", "size": 12, "datablocks": "abc", "metablocks": "2"}, {"path": "/abc", "size": "abc"},
            {"path": "/missing"}, {"path": "/time", "modification_time": "nope"}, {"size": "1"},
            {"path": "/attr", "extended_attributes": {"hidden": "yes", "archive": True}}]
    where = write(tmp_path / "x.json", "\n".join(map(json.dumps, rows)) + "\n{broken\n")
    got = {r.path: r for r in tables.scan_inventory(spark, where).collect()}
    assert set(got) == {"/ok", "/number", "/abc", "/missing", "/time", "/attr"}
    assert got["/ok"].size == 12 and got["/ok"].name == "ok" and got["/ok"].extended_attributes.hidden is True
    assert got["/ok"].modification_time.microsecond == 123368
    assert got["/number"].size == 12 and got["/number"].bad_blocks and got["/number"].metablocks == 2
    assert got["/abc"].size is None and not got["/abc"].bad_blocks
    assert got["/time"].modification_time is None
    assert got["/attr"].extended_attributes.hidden is None
    assert sorted(r.line for r in tables.scan_rejects(spark, where).collect()) == ['{"size": "1"}', "{broken"]


def test_csv_round_trip(spark, make, tmp_path):
    rows = make('/q"uote, comma', "/back\\slash", "/é", ("/n", {"size": None, "owner": None}))
    target = str(tmp_path / "csv")
    sinks.write_csv_all(rows, target)
    back = {r.path: r for r in tables.scan_inventory_csv(spark, target).collect()}
    assert set(back) == set(column(rows))
    assert back["/n"].size is None and back["/é"].size == 10
    header = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()[0].split(",")
    assert header[:3] == ["path", "name", "type"] and header[-1] == "user_metadata_revision" and len(header) == 26
    assert sinks.all_columns(owner=True, group=True)[9:14] == ["owner", "owner_name", "owner_details", "group", "group_name"]


def test_line_feeds_in_names_survive(spark, make, tmp_path):
    target = str(tmp_path / "csv")
    sinks.write_csv_all(make("/a\nb"), target)
    assert column(tables.scan_inventory_csv(spark, target, multiline=True)) == ["/a\nb"]
    sinks.write_ndjson(make("/a\nb"), str(tmp_path / "json"))
    assert column(tables.scan_inventory(spark, str(tmp_path / "json"))) == ["/a\nb"]


def test_minimal_columns():
    assert sinks.minimal_columns(Search()) == ["path"]
    opts = Search(ages={"access_time": (5, None)}, smaller_than="1KB")
    assert sinks.minimal_columns(opts, owner=True, links=True) == ["path", "modification_time", "size", "owner", "symlink_target"]
    assert sinks.minimal_columns(Search(older_than=1, time_field="change_time"), group=True) == ["path", "change_time", "group"]


def test_ndjson_writes_nulls(make, tmp_path):
    sinks.write_ndjson(make(("/a", {"size": None})), str(tmp_path / "j"), ["path", "size"])
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("part-*.json")).strip() == '{"path":"/a","size":null}'


def test_details(make):
    rows = make(("/a", {"size": 1536}))
    shown = sinks.details(rows, "path,size,change_time", unix_time=True, human=True).first()
    assert tuple(shown) == ("/a", "1.5 KiB", 978307200)


def test_mapping_files(spark, tmp_path):
    text = "source,target\n# comment\nCORP\\joe, 1001\nsid:S-1-5-21,gid:7\n1002,uid:3\n"
    rows = tables.scan_mapping_csv(spark, write(tmp_path / "m.csv", text))
    assert {tuple(r) for r in rows.collect()} == {("CORP\\joe", "uid:1001"), ("S-1-5-21", "gid:7"), ("uid:1002", "uid:3")}
    with pytest.raises(OptionError):
        tables.scan_mapping_csv(spark, write(tmp_path / "d.csv", "a,b\na,c\n"))


def test_tags(spark, tmp_path):
    rows = [{"path": "/a", "entries": [{"key": "k", "value": "eWVz"}, {"key": "bad", "value": "a"}, {"key": "u", "value": "/w=="},
                                       {"key": "k", "value": "bm8="}, {"value": "eA=="}]},
            {"path": "/none", "entries": []}, {"path": "/unreadable"}]
    got = {r.path: r.tags for r in tables.scan_tags(spark, write(tmp_path / "t.json", "\n".join(map(json.dumps, rows)))).collect()}
    assert got == {"/a": {"k": "no", "bad": "", "u": "�"}, "/none": {}, "/unreadable": None}


def test_acl_wire_forms(spark, tmp_path):
    ace = {"type": "ALLOWED", "trustee": {"auth_id": "500"}, "flags": ["OBJECT_INHERIT", "INHERITED"], "rights": ["x", "r"]}
    deny = {"type": "DENIED", "trustee": "uid:7", "rights": ["w"]}
    rows = [{"path": "/in", "acl": {"control": ["PRESENT"], "aces": [ace, deny]}}, {"path": "/out", "aces": [deny]}]
    got = {r.path: r.acl for r in tables.scan_acls(spark, write(tmp_path / "a.json", "\n".join(map(json.dumps, rows)))).collect()}
    assert [tuple(a) for a in got["/in"].aces] == [
        ("Allow", "500", ["f", "INHERITED"], ["r", "x"]), ("Deny", "uid:7", [], ["w"])]
    assert got["/in"].control == ["PRESENT"] and got["/out"].aces[0].type == "Deny" and got["/out"].control == []


def test_file_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"0123456789")
    row = tables.scan_file_content(spark, str(tmp_path)).select("size", tables.read_range(F.col("content"), 3, 4)).first()
    assert (row[0], bytes(row[1])) == (10, b"3456")
