"""Exact top-k search against brute force: repeated ids, large components, outliers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import topk


def brute(rows, k, every):
    """rows: (id, list of floats); every query row against all other rows, in Python integers."""
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for a, (q, v) in enumerate(whole):
        if q % every == 0:
            near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(whole) if a != b and len(v) == len(w))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, k=5, every=50):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(1) for c in ("query", "class", "score", "near", "h1", "id")})
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % every == 0, k).collect())


def test_rows_of_one_id_all_count(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0]), (50, [3.0, 1.0]), (50, [3.0, 1.0]), (50, [-1.0, 0.5]), (2, [2.0, 2.0])]
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, [(0, [1.0]), (1, [2.0]), (1, [3.0])]) == [(0, 1, 1, 256 * 768), (0, 2, 1, 256 * 512)]


def test_large_components_are_exact_and_what_overflows_raises(spark):
    rows = [(0, [1e7]), (1, [1.1e7]), (2, [1.2e7]), (3, [1.1e7 + 1 / 256])]
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, rows)[0] == (0, 1, 2, 7864320000000000000)
    with pytest.raises(Exception, match="score doesn't fit"):
        found(spark, [(0, [1e9]), (1, [1e9])])
    with pytest.raises(Exception, match="component doesn't fit"):
        found(spark, [(0, [1e300]), (1, [1.0])])


def test_an_outlier_widens_one_cell_only(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 512)
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(0, 0.5, (3000, 16))
    counts = {}
    for outlier in (0.0, 1e6):
        v = vectors.copy()
        v[7, 3] += outlier
        rows = [(i, [float(x) for x in own]) for i, own in enumerate(v)]
        assert found(spark, rows) == brute(rows, 5, 50)
        whole = np.floor(256 * v).astype(np.int64)
        queries, kept = whole[::50], 0
        parts = [topk.bounds(queries, *topk.cells_of(whole[at : at + 512])) for at in range(0, 3000, 512)]
        lower, upper = (np.concatenate([p[k] for p in parts], 1) for k in (0, 1))
        kept = int((upper >= -np.sort(-lower, 1)[:, 5:6]).sum())
        counts[outlier] = kept
    assert counts[1e6] < 1.5 * counts[0.0] < 0.5 * 3000 * 60


def test_bounds_hold(spark):
    rnd = np.random.default_rng(5)
    for scale in (1, 10**9, 10**17):
        v = rnd.integers(-9, 10, (300, 5)) * scale + rnd.integers(-3, 4, (300, 5))
        q = rnd.integers(-9, 10, (20, 5))
        lower, upper = topk.bounds(q, *topk.cells_of(v))
        exact = q.astype(object) @ v.T.astype(object)
        assert all(lower[i, j] <= exact[i, j] <= upper[i, j] for i in range(20) for j in range(300))
    cells, low, high = topk.cells_of(np.zeros((1, 3), np.int64))
    assert cells.max() == 0 and low.shape == high.shape == (1, 3)
    assert topk._scanned(pa.table({"query": []}), pa.table({"class": []}), 3, True).num_rows == 0


def test_a_group_of_equal_vectors_and_few_rows(spark):
    rnd = np.random.default_rng(6)
    hot = [float(x) for x in rnd.normal(0, 1, 6)]
    rows = [(i, hot if i % 3 else [float(x) for x in rnd.normal(0, 1, 6)]) for i in range(400)] + [(1000, [1.0]), (1050, [])]
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, []) == []


def test_a_query_of_zeros_keeps_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 256)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(0, 0.5, (1200, 4)))]
    rows[0], rows[50] = (0, [0.0] * 4), (50, [0.0, 0.0, 0.25, 0.0])
    rows[100:400] = [(i, [v[0], v[1], 0.5, v[3]]) for i, v in rows[100:400]]  # ties of the second query
    assert found(spark, rows) == brute(rows, 5, 50)
    table = pa.table({"dim": [4] * 1200, "block": [0] * 1200, "class": list(range(1200)), "first": [i for i, _ in rows], "vector": [[int(np.floor(256 * x)) for x in v] for _, v in rows]})
    file_ = topk._block(table)
    asked = pa.table({"query": [0], "dim": [4], "vector": pa.array([[0] * 4], pa.list_(pa.int64())), "certain": [0.0]})
    kept = topk._scanned(asked, file_, 6, True)
    assert sorted(kept.column("class").to_pylist()) == list(range(6))
