"""Changed regions against brute force."""

import random

from pyspark.sql import functions as F

from treecensus.operators import regions


def texts(count, seed=3):
    rng = random.Random(seed)
    for i in range(count):
        good = "".join(rng.choice("abé😀\n") for _ in range(rng.randrange(0, 60)))
        live = list(good)
        for _ in range(rng.randrange(0, 4)):
            if live:
                live[rng.randrange(len(live))] = "#"
        live = "".join(live)[:rng.randrange(0, 61)] + "x" * rng.choice([0, 0, 5])
        yield f"/f{i}", good, None if i % 17 == 0 else live


def patched(live, good, steps):
    """Apply the steps to the live content."""
    for kind, offset, size in sorted(steps, key=lambda s: s[0] == "truncate"):
        if kind == "whole":
            return good
        if kind == "truncate":
            live = live[:offset]
        else:
            live = live[:offset] + good[offset:offset + size] + live[offset + size:]
    return live


def check(spark, rows, kind, **options):
    frame = spark.createDataFrame(rows, f"path string, good {kind}, live {kind}")
    steps = {}
    for r in regions.byte_diff(frame, "good", "live", chunk=4, **options).collect():
        steps.setdefault(r.path, []).append((r.kind, r.offset, r.bytes))
    for path, good, live in rows:
        assert patched(live, good, steps.get(path, [])) == good, path
        if good == live:
            assert path not in steps
    return steps


def test_applying_a_diff_restores_the_good_version(spark):
    rows = list(texts(300))
    steps = check(spark, rows, "string", threshold=0)
    assert {k for s in steps.values() for k, _, _ in s} == {"data", "tail", "truncate", "whole"}
    small = check(spark, rows, "string", threshold=30)
    assert all(s == [("whole", 0, len(g))] for p, g, _ in rows if len(g) < 30 and (s := small.get(p)))


def test_bytes_work_like_text(spark):
    rows = [(p, g.encode(), None if v is None else v.encode()) for p, g, v in texts(150, 5)]
    check(spark, rows, "binary", threshold=0)


def test_merging_equals_brute_force_at_every_span(spark):
    rng = random.Random(1)
    chunks = {(f"/f{i % 3}", rng.randrange(40)) for i in range(70)} | {("/all", c) for c in range(33)}
    frame = spark.createDataFrame([(p, c, 1) for p, c in chunks], "path string, chunk int, bytes bigint")
    want = set()
    for path in {p for p, _ in chunks}:
        places = sorted(c for p, c in chunks if p == path)
        start = places[0]
        for here, after in zip(places, places[1:] + [None]):
            if after != here + 1:
                want.add((path, start, here, here - start + 1))
                start = after
    for span in (1, 4, 1 << 16):
        assert {tuple(r) for r in regions.merge_regions(frame, span=span).collect()} == want


def test_chunk_tables_give_the_same_changes(spark):
    rows = [("/a", "aaaabbbbcc", "aaaaXbbbcc"), ("/b", "aaaa", "aaaabbbb"), ("/c", "aaaabbbb", "aaaa")]
    frame = spark.createDataFrame(rows, "path string, good string, live string")
    changed = regions.changed_chunks(regions.chunk_hashes(frame, "good", 4), regions.chunk_hashes(frame, "live", 4))
    assert {tuple(r) for r in changed.collect()} == {("/a", 1, 4), ("/c", 1, 4)}
    binary = frame.select("path", F.encode("good", "UTF-8").alias("good"))
    got = regions.chunk_hashes(binary, "good", 4)
    assert {(r.path, r.chunk, r.bytes) for r in got.collect()} == {
        ("/a", 0, 4), ("/a", 1, 4), ("/a", 2, 2), ("/b", 0, 4), ("/c", 0, 4), ("/c", 1, 4)}
