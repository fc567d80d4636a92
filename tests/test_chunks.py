"""Contents as tables of chunks."""

import random

import pytest

from treecensus.operators import chunks, regions, similarity
from treecensus.sources.tables import read_ranges, scan_chunks


def versions(count, seed=2):
    draw = random.Random(seed)
    for i in range(count):
        good = "".join(draw.choices("ab", k=draw.choice([0, 1, 3, 4, 8, 9, 40])))
        live = list(good)
        for _ in range(draw.randrange(4)):
            if live:
                live[draw.randrange(len(live))] = "x"
        live = "".join(live)
        live = draw.choice([live, live, live + "tail", live[:len(live) // 2], "", None])
        yield f"/f{i}", good, live


def applied(live, good, steps):
    out = live
    for kind, offset, size in sorted(steps, key=lambda s: s[0] == "truncate"):
        if kind == "whole":
            out = good
        elif kind == "truncate":
            out = out[:offset]
        else:
            out = out[:offset] + good[offset:offset + size] + out[offset + size:]
    return out


@pytest.mark.parametrize("kind,threshold", [("string", 0), ("string", 5), ("binary", 0), ("binary", 5)])
def test_the_difference_restores_the_good_version(spark, kind, threshold):
    rows = list(versions(250))
    if kind == "binary":
        rows = [(p, g.encode(), v if v is None else v.encode()) for p, g, v in rows]
    frame = spark.createDataFrame([*rows, ("/only/live", None, rows[0][1])], f"path string, good {kind}, live {kind}")
    found = chunks.byte_diff(chunks.cut(frame, "good", 4), chunks.cut(frame, "live", 4), 4, threshold).collect()
    steps = {}
    for r in found:
        steps.setdefault(r.path, []).append((r.kind, r.offset, r.bytes))
    assert set(steps) <= {p for p, *_ in rows}
    for path, good, live in rows:
        own = steps.get(path, [])
        assert (not own) == (good == live), path
        assert applied(live, good, own) == good, path
        assert all(k == "whole" for k, *_ in own) == (live is None or len(good) < threshold) or not own, path
    whole = regions.byte_diff(frame.where("good IS NOT NULL"), "good", "live", 4, threshold).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole))


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_a_range_reads_the_chunks_it_touches(spark, kind):
    texts = {"/a": "abcdefghijklmnopqrstuvwxyz", "/b": "abcde", "/none": "", "/c": "0123456789"}
    rows = [(p, t if kind == "string" else t.encode()) for p, t in texts.items()]
    table = chunks.cut(spark.createDataFrame(rows, f"path string, content {kind}"), "content", 4)
    for offset, length in ((0, 3), (3, 2), (4, 4), (6, 11), (25, 9), (30, 5), (2, 0)):
        got = {r.path: (r.size, r.data if kind == "string" else r.data.decode()) for r in chunks.read_range(table, offset, length, 4).collect()}
        assert got == {p: (len(t), t[offset:offset + length]) for p, t in texts.items()}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    draw = random.Random(1)
    parts = {"large": draw.randbytes(200_003), "exact": draw.randbytes(8192), "tiny": b"x"}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    table = scan_chunks(spark, str(tmp_path), chunk=1000, span=8000)
    rows = table.selectExpr("*", "spark_partition_id() AS task").collect()
    for name, data in parts.items():
        own = sorted((r.chunk, bytes(r.data), r.size, r.task) for r in rows if r.path.endswith("/" + name))
        assert b"".join(d for _, d, *_ in own) == data and {s for *_, s, _ in own} == {len(data)}
        assert [c for c, *_ in own] == list(range(max(1, -(-len(data) // 1000))))
    assert not [r for r in rows if r.path.endswith("/empty")]
    assert len({r.task for r in rows if r.path.endswith("/large")}) > 1
    assert max(len(r.data) for r in rows) <= 1000


def test_two_scanned_folders_are_compared(spark, tmp_path):
    draw = random.Random(3)
    good = bytearray(draw.randbytes(50_000))
    live = bytearray(good)
    live[12_345] ^= 1
    for name, data in (("good", good), ("live", live + b"more")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "file").write_bytes(data)
    both = [scan_chunks(spark, str(tmp_path / n), 1000, 4000).selectExpr("regexp_extract(path, '[^/]*$', 0) AS path", "chunk", "size", "data")
            for n in ("good", "live")]
    found = chunks.byte_diff(*both, chunk=1000, threshold=0).collect()
    assert sorted((r.kind, r.offset, r.bytes) for r in found) == [("data", 12_000, 1000), ("truncate", 50_000, 4)]


def copies(tmp_path):
    """Files of some sizes, with copies and near copies; the sample size below is 16, with 3 samples a file."""
    draw = random.Random(5)
    out = {}
    for i, size in enumerate([5, 5, 48, 48, 49, 49, 49, 700, 700, 700, 33, 2000]):
        out[f"f{i}"] = draw.randbytes(size)
    out |= {"c1": out["f0"], "c2": out["f2"], "c3": out["f4"], "c4": out["f7"]}
    middle = bytearray(out["f8"])
    middle[100] ^= 1  # between the samples
    out["near"] = bytes(middle)
    for name, data in out.items():
        (tmp_path / name).write_bytes(data)
    return out


def test_only_the_samples_are_read(spark, tmp_path):
    parts = copies(tmp_path)
    listed = (spark.read.format("binaryFile").load(str(tmp_path))
              .selectExpr("path", "length AS size", "CAST('FS_FILE_TYPE_FILE' AS string) AS type", "CAST(1 AS bigint) AS datablocks"))
    ranges = similarity.sample_ranges(listed, 16, 3)
    pieces = read_ranges(ranges, 10)
    told = similarity.estimate(listed, 16, 3).first()
    assert pieces.selectExpr("sum(length(data))").first()[0] == told.bytes_to_read < sum(map(len, parts.values()))
    assert ranges.select("path").distinct().count() == told.files
    groups = {}
    for r in similarity.sampled_ranges(listed, pieces).collect():
        groups.setdefault(r.group_id, set()).add(r.path.rsplit("/", 1)[1])
    assert sorted(map(sorted, groups.values())) == [["c1", "f0"], ["c2", "f2"], ["c3", "f4"], ["c4", "f7"], ["f8", "near"]]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_samples_from_chunks_equal_samples_of_whole_contents(spark, tmp_path, kind):
    rows = [(f"/{n}", len(d), "FS_FILE_TYPE_FILE", 1, d.hex()[:len(d)] if kind == "string" else d) for n, d in copies(tmp_path).items()]
    files = spark.createDataFrame(rows, f"path string, size bigint, type string, datablocks bigint, content {kind}")
    want = similarity.sampled(files, 16, 3).select("path", "group_id", "files")
    for chunk in (7, 16, 64):
        found = similarity.sampled_ranges(files.drop("content"), chunks.pick(
            chunks.cut(files, "content", chunk), similarity.sample_ranges(files.drop("content"), 16, 3), chunk))
        assert sorted(map(tuple, found.select("path", "group_id", "files").collect())) == sorted(map(tuple, want.collect()))
