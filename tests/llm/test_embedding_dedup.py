"""Links and components of near-equal vectors against brute force."""

import math

import numpy as np
import pytest

from skein.llm import embedding_dedup, queries
from tests.compare import rows_of, rows_of_sql


def plain(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs and walking along links."""

    def unit(v):
        if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        scaled = np.array(v, dtype=float) / max(abs(c) for c in v)
        return scaled / np.linalg.norm(scaled)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    near = [
        [j for j in range(len(rows)) if i != j and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
        for i in range(len(rows))
    ]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(near[i]), component, component == vec_id))
    return sorted(out, key=repr)


def frame(spark, rows):
    full = [(i, v, label, 1, 2, "x") for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, node int, place int, code string").repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(queries.op12_embedding_dedup(spark, sf)) == rows_of_sql(queries.oracle_sql()["op12_embedding_dedup"], sf)


@pytest.mark.parametrize("block", [embedding_dedup.FAMILY_BLOCK, 7])
def test_families_pairs_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup.family_links, "__defaults__", (block,))
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=16).tolist(), i % 3) for i in range(300)]
    for base in range(40):  # pairs around the threshold
        rows.append((1000 + base, (np.array(rows[base][1]) + r.normal(size=16) * 0.2).tolist(), rows[base][2]))
    centre = r.normal(size=16)
    rows += [(2000 + i, (centre + r.normal(size=16) * 0.1).tolist(), 1) for i in range(120)]  # a family of which only some are links
    rows += [(3000 + i, [math.cos(i * 0.15), math.sin(i * 0.15), *[0.0] * 14], 0) for i in range(20)]  # a chain
    want = plain(rows)
    assert found(embedding_dedup.classes(frame(spark, rows))) == want
    assert sum(n for _, n, _, _ in want) > 1000


def test_order_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup.neighbours, "__defaults__", (64, 64))
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=24).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, (np.array(rows[i * 3][1]) * 7 + r.normal(size=24) * 0.3).tolist(), 0) for i in range(200)]
    assert found(embedding_dedup.classes(frame(spark, rows), window=64)) == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (2, [2.0, 4.0, 6.0], 0), (None, v, 0), (3, v, 1), (4, v, None), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0)]
    rows += [(9, [nan, 1.0, 1.0], 0), (10, [inf, 1.0, 1.0], 0), (11, [None, 2.0, 3.0], 0), (12, [1e200, 2e200, 3e200], 0), (13, [1e-200, 2e-200, 3e-200], 0), (14, [1.0, 2.0], 0), (None, [5.0, 0.0, -5.0], 1), (15, [-1.0, -2.0, -3.0], 0)]
    got = found(embedding_dedup.classes(frame(spark, rows)))
    assert got == plain(rows)
    assert (1, 5, 1, True) in got and (12, 5, 1, False) in got and (None, 0, None, True) in got


def test_no_rows_and_no_links(spark):
    assert embedding_dedup.classes(frame(spark, [])).collect() == []
    assert found(embedding_dedup.classes(frame(spark, [(1, None, 0), (2, [1.0], None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embedding_dedup.classes(frame(spark, [(1, None, 0)])).dtypes == embedding_dedup.classes(frame(spark, [(1, [1.0], 0), (2, [1.0], 0)])).dtypes


def test_passes_follow_the_number_of_vectors():
    counts = [embedding_dedup.passes(n, 0.98) for n in (10, 10**4, 10**6, 10**9)]
    assert counts[0] == 1 and counts == sorted(counts) and counts[-1] < 100
