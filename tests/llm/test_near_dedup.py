import math
import random

import numpy as np
import pytest

from skein.llm import near_dedup as N


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("cell", [256, 16])
def test_classes_against_brute_force(docs, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL", cell)
    rng = random.Random(8)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(len(rows) + i, edited(rng, words, rng.randint(0, 4))) for i in range(60 if base == 0 else 5)]
    rows += [(len(rows) + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(30)]
    shingled = {i: sets(t) for i, t in rows}
    pairs = [(a, b) for a in shingled for b in shingled if a < b and len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])]
    found = {r["doc_id"]: r for r in N.classes(docs(rows)).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == closure(pairs, shingled)
    assert all(r["kept"] == (r["class_id"] == i) for i, r in found.items())


def test_links_within_a_hot_family_of_different_texts(docs, monkeypatch):
    monkeypatch.setattr(N, "CELL", 8)
    monkeypatch.setattr(N, "BLOCK", 16, raising=False)
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(300)], []
    for _ in range(100):
        # Most texts of the template are alike by less than 0.8; texts of a pair share two edits and reach it.
        shared = edited(rng, base, 2).split()
        rows += [edited(rng, shared, 3), edited(rng, shared, 3)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    shingled = {i: sets(t) for i, t in rows}
    pairs = [(a, b) for a in shingled for b in shingled if a < b and len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])]
    want = closure(pairs, shingled)
    assert 1 < len(set(want.values())) and len(pairs) < 0.2 * 200 * 199 / 2
    assert {r["doc_id"]: r["class_id"] for r in N.classes(docs(rows)).collect()} == want


def test_either_similarity_links(docs):
    rng = random.Random(5)
    rows, want = [], {}
    for family in range(20):
        words = [f"f{family}w{rng.randrange(10**6)}" for _ in range(300)]
        # Alike as sets: one copy of the text repeats its last line.
        rows += [(4 * family, " ".join(words)), (4 * family + 1, " ".join(words + words[-12:] * 20))]
        # Alike as weighted sets: a line repeated often outweighs all that differs.
        line = [f"l{family}w{rng.randrange(10**6)}" for _ in range(12)]
        rows += [(4 * family + 2 + i, " ".join(line * 60 + [f"{i}-{family}-{k}" for k in range(30)])) for i in range(2)]
        want |= {4 * family + i: 4 * family + i // 2 * 2 for i in range(4)}
    one, repeated, *heavy = (N.shingles(t, N.Words()) for _, t in rows[:4])
    a, b = N.similarity(one, repeated), N.similarity(*heavy)
    assert a[0] > 0.95 and a[1] < 0.6 and b[0] < 0.6 and b[1] > 0.8
    assert {r["doc_id"]: r["class_id"] for r in N.classes(docs(rows)).collect()} == want


def test_edges(docs, edges):
    found = [(r["doc_id"], r["class_id"], r["kept"]) for r in N.classes(docs(edges)).collect()]
    assert len(found) == len(edges)
    assert {(1, 1, True), (2, 2, True), (4, 4, True), (5, 4, False), (None, None, True)} <= set(found)
    assert sum(kept for _, class_id, kept in found if class_id == 4) == 1
    assert N.classes(docs(edges).limit(0)).count() == 0


def test_gate_loses_few_pairs_at_the_threshold():
    n, p = N.REGISTERS, 0.8 + 0.2 / 256
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if k / n < 0.8 - N.MARGIN)
    assert lost < 2e-6


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    weights = rng.integers(1, 6, len(a))
    keep = rng.random(len(a)) < 0.8
    x, y = (a, weights), (a[keep], weights[keep] + (rng.random(keep.sum()) < 0.2))
    estimate = (N.signature(*x, registers=4096) == N.signature(*y, registers=4096)).mean()
    exact = sum(1 / sum(max(wa / wx, wb / wy) for wa, wb in zip(x[1], np.where(keep, 0, 0) + _spread(y, x))) for wx, wy in _common(x, y))
    assert abs(N.similarity(x, y)[1] - exact) < 1e-9
    assert abs(estimate - exact) < 0.03


def _spread(y, x):
    by = dict(zip(y[0].tolist(), y[1].tolist()))
    return np.array([by.get(k, 0) for k in x[0].tolist()])


def _common(x, y):
    by = dict(zip(y[0].tolist(), y[1].tolist()))
    return [(w, by[k]) for k, w in zip(x[0].tolist(), x[1].tolist()) if k in by]


def test_repeated_rows_and_ids_with_several_texts(docs):
    rng = random.Random(7)
    one, other = ([f"{x}{rng.randrange(10**6)}" for _ in range(100)] for x in "ab")
    rows = [(3, " ".join(one))] * 5 + [(2, " ".join(other)), (3, edited(rng, other, 1)), (9, edited(rng, one, 1)), (8, None), (8, None)]
    got = N.classes(docs(rows)).collect()
    assert len(got) == len(rows)
    # Both texts of id 3 are compared, so that all but the null texts are one class, of which one row stays.
    assert {r["class_id"] for r in got if r["doc_id"] != 8} == {2}
    assert [r["doc_id"] for r in got if r["kept"]].count(2) == 1 and sum(r["kept"] for r in got) == 3
    left = N.one_of_each(docs(rows))
    assert left.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 8, 8]
    again = N.one_of_each(docs(rows[:5] + rows[8:])).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in again) == [(3, len(rows[0][1])), (8, 0), (8, 0)]
