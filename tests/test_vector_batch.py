"""Batch search by blocks of products, against brute force."""

import math
import random

import numpy as np

from skein.operators import vector


def brute(rows, asked, k, digits):
    out = []
    for name, q in asked:
        scored = []
        for i, v in rows:
            if v is None or q is None or len(v) != len(q) or None in (*v, *q):
                continue
            length = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
            if length != 0:
                s = sum(x * y for x, y in zip(v, q, strict=True)) / length
                scored.append((-math.inf if math.isnan(s) else -round(s, digits), i))
        out += [(name, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_batches_equal_brute_force(spark, monkeypatch):
    for name, value in {"QUERY_LIMIT": 7, "ROW_BLOCK": 16, "QUERY_BLOCK": 3}.items():
        monkeypatch.setattr(vector, name, value)
    rng = random.Random(5)
    rows = [(f"v{i:04}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    # Equal vectors, and ones of other lengths whose cosines differ by rounding only: ties go to the smaller id.
    rows += [(f"t{i:04}", [x * (i % 7 + 1) for x in rows[i % 4][1]]) for i in range(120)]
    rows += [("a", None), ("b", [0.0] * 6), ("c", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("d", []), *((f"s{i}", [rng.random(), rng.random()]) for i in range(3))]
    rng.shuffle(rows)
    for odd in ([], [("n1", [math.nan] * 6), ("n0", [math.inf, *[1.0] * 5])]):
        asked = [(i, v) for i, (_, v) in enumerate(rows + odd) if i % 9 == 0 or v is None or len(v) < 6 or None in v or not math.isfinite(sum(v))]
        got = vector.top_k_batch(spark.createDataFrame(rows + odd, "vec_id string, embedding array<double>"), spark.createDataFrame(asked, "query_id int, vector array<double>"), 5, digits=9).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, math.inf if math.isnan(r.similarity) else round(r.similarity, 9)) for r in got) == brute(rows + odd, asked, 5, 9)


def test_one_group_of_copies_makes_few_pairs(spark, monkeypatch):
    """Of copies only k are compared with each query."""
    compared = []
    merge = vector.Nearest._merge
    monkeypatch.setattr(vector.Nearest, "_merge", lambda self, q, p, s: (compared.append(len(q)), merge(self, q, p, s))[1])
    found = vector.Nearest(np.ones((50, 4)), 5, 9)
    found.add(np.arange(2000), np.ones((2000, 4)))
    assert sum(compared) == 250 and (found.place == np.arange(5)).all()


def test_no_vectors_or_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    ask = lambda df: df.selectExpr("vec_id AS query_id", "embedding AS vector")
    assert vector.top_k_batch(none, ask(some), 3).collect() == [] and vector.top_k_batch(some, ask(none), 3).collect() == []
    assert [tuple(r)[:3] for r in vector.top_k_batch(some, ask(some), 3).collect()] == [(1, 1, 1)]
