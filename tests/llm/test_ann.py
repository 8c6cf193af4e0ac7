import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ann


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 5 == 0:
            scored = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i) for i, b in good if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(600)]
    same = rows[3][1]
    rows += [(600 + i, same) for i in range(40)] + [(900, [2.0 * x for x in same])]
    bad = [(1000, None), (1005, [0.0] * 16), (1010, [float("nan")] * 16), (1015, [None] * 16), (1020, [float("inf")] + [0.0] * 15), (1025, [1.0]), (None, same)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<float>, rank int, score int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows + bad, 5)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.97 * 5 * len(want)
    assert got[605] == [3, 600, 601, 602, 603] or got[605] == want[605]


def test_each_length_among_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).astype("float32").tolist()) for i in range(90)] + [(200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, 90, 10))
    for q, found in got.items():
        a = np.array(rows[q][1], float)
        scored = sorted((-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, v in rows if i != q and len(v) == len(a) and (b := np.array(v, float)) is not None)
        assert found == [i for _, i in scored[:3]]


def test_few_repeated_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)] and abs(got[0][3] - math.sqrt(0.5)) < 1e-12
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df, F.col("vec_id") == 77).count() == 0


@pytest.mark.parametrize("times", [2, 6])
def test_repeated_ids_leave_room_for_equal_vectors(times):
    vectors = np.array([[1.0, 0.5]] * 8 + [[0.0, 1.0]])
    ids, rows = np.repeat(np.arange(9), times), np.repeat(vectors, times, axis=0)
    turn = ann.rotation(2)
    found = ann.Search(np.array([0, 100]), vectors[[0, 0]], turn, 5, 2.5)
    found.add(ids, rows, ann.encode(rows, turn))
    assert found.found.tolist() == [[1, 2, 3, 4, 5], [0, 1, 2, 3, 4]]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    turn = ann.rotation(64)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    guess, error = ann.estimate(ann.encode(v, turn), unit @ turn.T, 2.5)
    true = v / np.linalg.norm(v, axis=1, keepdims=True) @ unit.T
    assert (np.abs(guess - true) <= error[:, None]).mean() > 0.97
