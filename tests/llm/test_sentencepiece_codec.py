import random
from functools import cache

import numpy as np
import pytest

from skein.llm import sentencepiece_codec as S
from skein.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return S.Model(f.read())


def score(m, ids):
    by = {i: s for s, i in m.pieces.values()}
    return sum(by.get(i, 0.0) for i in ids)


def exhaustive(m, s):
    @cache
    def best(i):
        if i == len(s):
            return 0.0
        options = [m.pieces[s[i:j]][0] + best(j) for j in range(i + 1, min(len(s), i + m.longest) + 1) if s[i:j] in m.pieces]
        return max(options + ([m.unknown + best(i + 1)] if s[i] not in m.pieces else []))

    return best(0)


def some_text(rng):
    return "".join(rng.choice(["a", "b", "th", "the ", "e", " ", "  ", "in", "tion", "\n", "é", "梦", "zz"]) for _ in range(rng.randint(1, 120)))


def test_best_score(model):
    rng = random.Random(1)
    for _ in range(200):
        t = some_text(rng)[:60]
        total = sum(model.whole(p)[0] for p in model.segment.findall(model.prepare(t)))
        assert total == exhaustive(model, model.prepare(t))


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "x\ny\n\n z", "▁lit eral▁", "héé 梦 \U0001f600 \x00", " lead", "trail  ", "a" * 300, "日本語" * 50])
def test_round_trip(model, text):
    assert model.decode(model.encode(text)) == text


def test_chunks_give_the_ids_of_one_go(model):
    rng = random.Random(2)
    for trial in range(1500):
        t = some_text(rng) if trial % 2 else "".join(rng.choice("abeinostrhl") for _ in range(rng.randint(1, 150)))
        t = t.replace(" ", "" if trial % 3 == 0 else " ")
        chunks = S.chunked(model, t, rng.randint(1, 40), rng.choice([1, 5, 1024]))
        before = S.befores([model.transfer(*c) for c in chunks])
        found = S.states([model.lefts(*c, b) for c, b in zip(chunks, before)])
        ids = np.frombuffer(b"".join(model.between(s, n, *x) for (s, n), x in zip(chunks, found)), "<u4")
        assert model.decode(ids) == t and score(model, ids.tolist()) == score(model, model.encode(t).tolist())
        assert ids.tolist() == model.encode(t).tolist()


def test_products_are_associative():
    rng = np.random.default_rng(1)
    ms = [np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.integers(-9, 0, (5, 5)).astype(float)) for _ in range(9)]
    one = ms[0]
    for m, p in zip(ms[1:], S.scan(ms)[1:]):
        one = S.combine(one, m)
        assert (one == p).all()


def test_operator(docs, edges, model):
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    rows = [*edges, (20, "unbroken" * 3000), (21, None), (22, "▁ \ufdd0▁" * 900), (23, "\ufdd0")]
    got = S.codec(docs(rows), raw, chunk_chars=1000, with_ids=True).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    by = {i: t for i, t in rows}
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == model.encode(by[r["doc_id"]]).tolist()
    assert S.codec(docs([]), raw).count() == 0


@pytest.mark.parametrize("together", [4096, 32])
def test_segments_found_together_are_those_found_alone(model, monkeypatch, together):
    """Also with ties, unknown characters, U+2581 of the text, NUL and more segments than are remembered."""
    monkeypatch.setattr(S, "TOGETHER", together)
    rng = random.Random(5)
    segments = {"".join(rng.choice("▁aehinorst,.éñ字\udfff\x00😀 \n") for _ in range(rng.choice([1, 3, 8, 20, 64, 65]))) for _ in range(600)}
    alone = {s: (lambda score, back: (score[-1], model.trace(s, back, 0, len(s))))(*model.best(s, 0, len(s))) for s in segments}
    model.known.clear()
    model.learn(segments)
    assert len(model.known) > 400 and all(model.known[s] == alone[s] for s in model.known)
    monkeypatch.setattr(S, "KNOWN", 100)
    model.learn({s + "x" for s in segments} | set(list(segments)[:50]))
    assert {s: model.whole(s) for s in segments} == alone
    model.known.clear()
