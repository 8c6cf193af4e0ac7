"""Whitening against plain numpy and exact integers."""

import math

import numpy as np

from skein.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows):
    """{index: (deviation, components x whitened up to sign, explained)} by numpy and Python integers."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows])
    n = len(x)
    sums = [sum(int(a) for a in x[:, j]) for j in range(x.shape[1])]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    off = x - np.array([s / n for s in sums])
    values, directions = np.linalg.eigh(off.T @ off / n)
    values, directions = values[::-1], directions[:, ::-1]
    return deviation, off @ directions[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def test_query_equals_numpy(spark):
    got = queries.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    deviation, white, explained = plain(source["embedding"])
    n = len(source)
    assert len(got) == 8 * n and (got["n"] == n).all()
    assert got["deviation"].tolist() == [d for d in deviation for _ in range(8)]
    found = got["whitened"].to_numpy().reshape(n, 8)
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found * signs, white, atol=1e-6)
    assert np.allclose(got["explained"].to_numpy().reshape(n, 8), explained, rtol=1e-6)
    assert np.allclose(found.T @ found / n, np.eye(8), atol=1e-6)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-6


def vectors(spark, rows):
    full = [(i, v, 3, "x", 1.0) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, n int, component string, whitened double")


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [0.5, -7.25]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1e200, 1.0]), (9, [0.0, 0.0, 4.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    by = sorted((str(r.vec_id), r.component) for r in got)
    assert by == sorted([("1", 1), ("1", 2), *[("2", c) for c in (1, 1, 2, 2)], ("None", 1), ("None", 2), ("9", 1), ("9", 2), ("9", 3)])
    alone = [r for r in got if r.vec_id == 9]
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in alone)
    deviation, _, _ = plain([[1.0, 2.0], [3.0, 1.0], [3.0, 1.0], [0.5, -7.25]])
    assert {r.vec_id: r.deviation for r in got if r.vec_id in (1, 2)} == {1: deviation[0], 2: deviation[1]}


def test_no_rows_and_a_flat_direction(spark):
    assert whitening.whiten(vectors(spark, [(3, None)])).collect() == []
    got = whitening.whiten(vectors(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) and r.identity_error < 1e-9 for r in got)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 10**9), 5.0]) for i in range(4)] + [(9, [4.0e12, 5.0])]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((len(x) * a - s) ** 2 for a, s in zip(r, sums)) for (i, _), r in zip(rows, x)}
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()} and None in got.values()
    assert whitening._sums(np.array([[2**52, -(2**52)]] * 5000)).sums == [5000 * 2**52, -5000 * 2**52]
