"""Nearest neighbours by vantage-point trees, against all distances."""

import numpy as np
import pytest

from treecensus.llm import queries, vantage
from treecensus.llm.common import importable, matrix

SCHEMA = "vec_id bigint, embedding array<double>, leaf string, ring string, gap string, v string, ids string, query string, score string"


def vectors(seed, n, size, spread):
    draw = np.random.default_rng(seed)
    centers = draw.standard_normal((8, size))
    return centers[draw.integers(0, 8, n)] + spread * draw.standard_normal((n, size))


def brute(rows, k=10, every=100):
    want = []
    for q, v in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if (i, w) != (q, v))[:k]
            want += [(q, n + 1, i, pytest.approx(d, rel=1e-12)) for n, (d, i) in enumerate(near)]
    return want


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size,spread,shard,block", [(4, 0.05, 40, 3), (12, 1.0, 100, 2), (3, 0.3, 4096, 4096)])
def test_factor_one_is_exact(spark, monkeypatch, size, spread, shard, block):
    monkeypatch.setattr(vantage, "SHARD", shard)
    monkeypatch.setattr(vantage, "BLOCK", block)
    monkeypatch.setattr(vantage, "SAMPLE", 64)  # fewer leaves than shards: leaves fall into rings
    importable(spark)
    x = vectors(3, 900, size, spread)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[200][1]) for i in range(260)]  # equal vectors, some of them queries
    rows += [(100, rows[7][1])]  # another vector of a known id
    odd = [(2000, None), (2100, [float("nan")] * size), (2200, [None] * size), (2300, [0.0] * size), (None, [1.0] * size),
           (2400, [float("inf")] * size), (2500, []), rows[300], rows[300], rows[5]]
    found = vantage.nearest(table(spark, rows + odd), factor=1.0).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    want = brute(rows)
    key = lambda r: (r[0], r[1])
    # the two queries of id 100 share its rows in the result
    assert [r for r in got if r[0] != 100] == sorted((r for r in want if r[0] != 100), key=key)
    assert sorted(r[1:3] for r in got if r[0] == 100) == sorted(r[1:3] for r in want if r[0] == 100)


def test_few_none_and_short_vectors(spark):
    importable(spark)
    rows = [(0, [1.0, 2.0]), (3, [1.0]), (7, [1.0, 2.0, 2.0])]
    assert [tuple(r) for r in vantage.nearest(table(spark, rows)).orderBy("rank").collect()] == [(0, 1, 3, 2.0), (0, 2, 7, 2.0)]
    assert vantage.nearest(table(spark, rows[:1])).count() == 0
    assert vantage.nearest(table(spark, [])).count() == 0


def test_recall_of_the_query(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vantage, "SHARD", 300)
    x = vectors(9, 3000, 16, 0.4)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op13_nearest_neighbours"](spark, str(tmp_path)).collect()
    want = {(q, i) for q, _, i, _ in brute(rows)}
    assert len(found) == len(want)
    assert len({(r.query_id, r.vec_id) for r in found} & want) >= 0.9 * len(want)


def test_a_tree_skips_and_stays_exact():
    x = vectors(1, 4000, 3, 0.1)
    queries = x[:200]
    run = vantage.Search(queries, np.full(200, np.inf), x, 6, 1.0)
    assert run.met < 0.3 * 4000 * 200
    for q, row in enumerate(vantage.gaps(queries, x)):
        got = np.sort(np.concatenate([gap[at == q] for at, _, gap in run.found]))[:6]
        assert np.array_equal(got, np.sort(row)[:6])
    loose = vantage.Search(queries, np.full(200, np.inf), x, 6, 2.0)
    assert loose.met < run.met


def test_rows_of_lists_as_a_matrix():
    import pyarrow as pa

    column = pa.array([[9.0], [1.0, 2.0], [], [3.0]]).slice(1)
    assert matrix(column, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
