import hashlib
import random

import numpy as np
import pytest

from skein.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for s in range(len(b := (t or "").encode()) - length + 1):
            w = b[s : s + length]
            seen[w] = min(seen.get(w, float("inf")), float("inf") if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (float("inf") if i is None else i):
                gone[s : s + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(i, set()).add((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return out


@pytest.mark.parametrize("length, seed", [(50, 1), (30, 2)])
def test_against_brute_force(docs, length, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 1500)
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 120))) for _ in range(15)] + ["a" * 90, "xy" * 60]
    rows = [(rng.randint(0, 80), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    assert got(S.remove_repeats(docs(rows), length)) == brute(rows, length)


def test_edges_and_carried_columns(docs, edges):
    df = docs(edges)
    result = S.remove_repeats(df, carry=("text", "block", "score"), with_text=True)
    assert result.count() == len(edges) and got(result) == brute(edges, 50)
    assert {r["block"] for r in result.collect()} == {"x"}
    assert all(r["kept_text"] == (r["text"] or "") for r in result.where("n_removed = 0").collect())
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_suffix_order():
    data = np.frombuffer(b"banana_banana_bandana" * 3, np.uint8)
    at = np.arange(len(data) - 12)
    order, new = S.suffix_order(data, at, 12)
    words = [data[i : i + 12].tobytes() for i in at[order]]
    assert words == sorted(words)
    assert new.tolist() == [True] + [a != b for a, b in zip(words, words[1:])]


def test_texts_whose_rolling_hashes_collide(docs):
    """Words of a Thue-Morse sequence and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    rng = random.Random(6)
    morse = [bin(i).count("1") & 1 for i in range(1024)]
    for other in ("01", "xy"):
        between = [rng.choice(other) for _ in range(1024)]
        one, two = ("".join(a + b for a, b in zip(("ab"[m ^ flip] for m in morse), between)) for flip in (0, 1))
        rows = [(1, one), (2, two)]
        assert got(S.remove_repeats(docs(rows))) == brute(rows, 50)
    assert sum(x[1] for v in got(S.remove_repeats(docs(rows))).values() for x in v) == 0


def test_repeated_rows_and_periodic_texts(docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
    rows = [(7, "pq" * 300)] * 40 + [(i, "z" * (49 + i)) for i in range(6)] + [(3, "pq" * 40), (7, "q" + "pq" * 100), (None, "pq" * 60)]
    result = S.remove_repeats(docs(rows))
    assert result.count() == len(rows) and got(result) == brute(rows, 50)
