import hashlib
import random

import numpy as np

from skein.llm import fingerprints as G


def test_entropy_steps_equal_their_definition():
    rng = random.Random(1)
    data = np.array([rng.choice([1, 2, 3, 200, rng.randrange(256)]) for _ in range(700)], np.uint8)
    for scale in G.SCALES:
        steps = G.entropies(data, scale.window)
        for i in range(len(steps)):
            _, counts = np.unique(data[i : i + scale.window], return_counts=True)
            assert steps[i] == (G.TERMS[scale.window] - G.TERMS[counts].sum()) * (G.STEPS - 1) // G.TERMS[scale.window]


def test_texts_together_or_alone():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.choice([0, 1, 20, 100, 500, 3000]))) for _ in range(60)]
    ranks = np.stack([np.random.default_rng(i).permutation(G.STEPS) for i in range(2)])
    for a, t in zip(G.digests(texts, ranks), texts):
        b = G.digests([t], ranks)[0]
        assert G.text_of(a) == G.text_of(b) and G.likeness(a, b) == 1.0


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by.values())


def test_against_brute_force(docs):
    rng = random.Random(3)
    rows = [(i * 3, " ".join(rng.choice(["alpha", "beta", "é", "gamma"]) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    check(rows, G.fingerprint(docs(rows), bytes_each=4000).collect())


def test_edges(docs, edges):
    rows = [e for e in edges if e != (5, "word")] + [(5, "word"), (5, "other")]
    check(rows, G.fingerprint(docs(rows)).collect())
    check([(1, "one text alone")], G.fingerprint(docs([(1, "one text alone")])).collect())
    assert G.fingerprint(docs([])).count() == 0


def test_likeness_of_edited_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = G.fingerprint(docs).where("n_chars >= 200").collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.97


def test_places(spark):
    from pyspark.sql import functions as F

    for bounds in ([], [0], [0, 5, 6], list(range(0, 300, 3)), list(range(-40_000, 40_000, 4))):
        got = spark.range(-2, 310).select("id", G._place(F.col("id"), bounds).alias("p")).collect()
        assert all(r["p"] == sum(b <= r["id"] for b in bounds) for r in got)


def features_by_hand(data, ranks, scale):
    """The values that count, in order of place: contest by contest, window by window."""
    n = len(data) - scale.window + 1
    if len(data) < scale.window + scale.contest - 1:
        return list(dict.fromkeys(data[i : i + G.TINY] for i in range(max(1, len(data) - G.TINY + 1))))
    place = [ranks[(G.TERMS[scale.window] - sum(int(G.TERMS[data[i : i + scale.window].count(c)]) for c in set(data[i : i + scale.window]))) * (G.STEPS - 1) // G.TERMS[scale.window]] for i in range(n)]
    wins = {}
    for i in range(n - scale.contest + 1):
        at = min(range(i, i + scale.contest), key=lambda j: (place[j], j))
        wins[at] = wins.get(at, 0) + 1
    good = [i for i in sorted(wins) if wins[i] >= scale.wins] or sorted(wins)
    return list(dict.fromkeys(data[i : i + scale.window] for i in good))


def test_features_and_likeness_against_brute_force():
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh ,.") for _ in range(1600))
    texts = [base, base[:380], base[200:1300], base[:900] + bytes(rng.choice(b"abcdefgh") for _ in range(700)), b"", b"x", b"tiny text", b"tiny test", bytes(rng.choice(b"abcdefgh ,.") for _ in range(1500))]
    ranks = np.stack([np.random.default_rng(i).permutation(G.STEPS) for i in range(2)])
    found = G.digests(texts, ranks)
    shared = {}
    for k, t in enumerate(texts):
        for i, scale in enumerate(G.SCALES):
            if not G.wanted(len(t), i):
                assert i not in found[k]
                continue
            want = features_by_hand(t, ranks[i], scale)
            assert int(found[k][i][1].sum()) == len(want)
            shared[k, i] = want
    for a in range(len(texts)):
        for b in range(len(texts)):
            scales = [i for i in range(2) if (a, i) in shared and (b, i) in shared]
            got = G.likeness(found[a], found[b])
            assert abs(got - G.likeness(found[b], found[a])) < 0.2
            if not texts[a] or not texts[b]:
                assert got == float(texts[a] == texts[b])
                continue
            x, y = shared[a, scales[0]], shared[b, scales[0]]
            if max(len(x), len(y)) <= G.FILTER_FEATURES:
                # One filter each: the overlap of bits follows the share of the smaller set's features.
                assert abs(got - len(set(x) & set(y)) / min(len(x), len(y))) < 0.25
    assert G.likeness(found[0], found[1]) > 0.8 and G.likeness(found[0], found[8]) < 0.2 and 0.3 < G.likeness(found[6], found[7]) < 1
