"""The Merkle manifest against plain Python."""

import random
import zlib
from hashlib import sha256

import pytest

from treecensus.llm import manifest, queries
from treecensus.llm.common import importable

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ", tree string, idx string, size string, leaf string, offered string, members string, kids string"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """The root, and the siblings (before, after) of each hash at each level."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, i in zip(ways, at):
            run = i // 16 * 16
            way.append((hashes[run:i], hashes[i + 1:run + 16]))
        at = [i // 16 for i in at]
        hashes = [digest(*hashes[i:i + 16]) for i in range(0, len(hashes), 16)]
    return hashes[0], ways


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for row, way in zip(groups[s], trees[s][1]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf((row[0], lowered(row[1]), *row[2:])) if hit else leaf(row)
            for before, after in way + top:
                folded = digest(*before, folded, *after)
            proof = digest(*(h for before, after in way + top for h in before + after))
            out.append((row[0], leaf(row), trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def made(counts, seed=5):
    draw, rows = random.Random(seed), []
    for source, n in counts:
        for _ in range(n):
            text = draw.choice([None, "", "Plain Text", "lower only", "ÄÖ ß 日本 " + "Long " * draw.randrange(400)])
            rows.append((draw.randrange(10_000), text, draw.choice([None, "en", "de"]), source, draw.choice([None, 7, -3])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("counts", [
    [("a", 1)], [("a", 16)], [("a", 17)], [(None, 1), ("", 1)], [("hot", 700), ("é", 33), ("e", 16), ("z", 1), (None, 5), ("", 257)],
    [(f"s{i}", 1 + i % 3) for i in range(40)],
])
def test_equals_plain_python(spark, monkeypatch, tmp_path, counts):
    monkeypatch.setattr(manifest, "MEETING", 3)  # nodes in several copies
    rows = made(counts)
    rows += rows[:3] + [(None, "No Id", "en", counts[0][0], 5)] * 2
    table = spark.createDataFrame([(*r, *"abcdefg") for r in rows], FIELDS + CLASHING).repartition(5)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.select(*NAMES).collect()), key=repr) == brute(rows)


def test_nothing(spark):
    importable(spark)
    empty = spark.createDataFrame([], FIELDS)
    made = manifest.build(manifest.leaves(empty))
    assert made.root is None
    assert manifest.verify(made).count() == 0


def test_fields_cannot_be_shifted_into_each_other(spark):
    rows = [(1, "ab", "c", "s", 1), (1, "b", "ca", "s", 1), (1, None, "-", "s", 1), (1, "-", None, "s", 1)]
    found = manifest.leaves(spark.createDataFrame(rows, FIELDS)).select("leaf").distinct()
    assert found.count() == 4


def test_numbers_of_a_group_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "id % 50 AS v")
    found = manifest.numbered(rows.repartition(6), "g", ["v"]).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.g, []).append((r.idx, r.v, r.size))
    for each in groups.values():
        each.sort()
        assert [i for i, _, _ in each] == list(range(len(each)))
        assert [v for _, v, _ in each] == sorted(v for _, v, _ in each)
        assert {s for _, _, s in each} == {len(each)}
