import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import packing as P
from skein.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    e, rng = P.Encoder(PATH), random.Random(4)
    letters = "ab'sSTé É ñİıßſ ,.!?;: é 1²½ ª \x85\x1c  　日ΣςÅ'r\n\t_-ǅǆ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(5000)] + ["a <|endoftext|> b<|startoftext|>c", "x" * 300, ""]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, pieces, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    by, sequences = {}, {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((p for p in by[doc_id] if p["doc_tokens"] == len(ids)), key=lambda p: p["start"])
        assert sorted({p["start"] for p in own} | {len(ids)}) == [0] + [p["start"] + p["length"] for p in {p["start"]: p for p in own}.values()]
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in own)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0, *(p["length"] for p in s)])[:-1].tolist()
        assert sum(p["length"] for p in s) <= capacity
    return sequences


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sequences = check([tuple(r) for r in df.collect()], P.pack(df, PATH).collect())
    sizes = [sum(p["length"] for p in s) for s in sequences.values()]
    assert sum(4096 - n for n in sizes if n & (n - 1)) < 0.03 * sum(sizes)


def test_edges(docs, edges):
    pieces = P.pack(docs(edges), PATH).collect()
    check([e for e in edges if e[0] != 5], pieces)
    assert sum(p["doc_id"] == 5 for p in pieces) == 2
    assert [p["doc_tokens"] for p in pieces if p["doc_id"] == 1] == [1]
    assert P.pack(docs(edges).limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 4000) for _ in range(200)] + [1 << i for i in range(11)] * 6
    found = P.windows(sizes, 4096)
    assert sorted(i for x in found for i in x) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in x) for x in found) <= 4096
    assert len(found) <= sum(sizes) / 4096 * 1.08 + 1
    assert P.difference([8, 7, 6, 5, 4], 2) in ([[0, 3], [1, 2, 4]], [[1, 2, 4], [0, 3]], [[0, 2], [1, 3, 4]], [[1, 3, 4], [0, 2]])


@pytest.mark.parametrize(("low", "high"), [(2100, 4000), (3000, 4095), (1, 4000), (2049, 2060)])
def test_little_padding_whatever_the_lengths(low, high):
    rests = [random.Random(low).randint(low, high) for _ in range(1024)]
    found = P.levelled(rests, 4096, 8, 0.01)
    sizes = [sum(rests[i] if k < 0 else P.powers(rests[i])[k] for i, k in w) for w in found]
    assert max(sizes) <= 4096 and sum(sizes) == sum(rests) and len(found) <= sum(rests) / 4096 * 1.02 + 2
    assert len({x for w in found for x in w}) == sum(map(len, found))


def test_no_rest_and_few_rests():
    assert P.levelled([5], 4096, 8, 0.01) == [[(0, 0), (0, 1)]]
    assert sum(map(len, P.levelled([1] * 9, 4, 8, 0.01))) == 9


def test_dealing_does_not_depend_on_the_order_of_a_task(docs, spark):
    """Tasks that run again over rows in another order give each group the same pieces."""
    rows = [(i % 40, f"a{i % 40} b c") for i in range(400)]
    pieces = [P.pack(docs(x).coalesce(1), PATH, docs_per_group=20) for x in (rows, rows[::-1])]
    found = [Counter((p["doc_id"], p["start"], p["length"], p["sequence_id"] >> 32) for p in x.collect()) for x in pieces]
    assert found[0] == found[1] and sum(n for (_, start, _, _), n in found[0].items() if start == 0) == 400


def test_a_full_memory_forgets_its_older_half():
    asked = []
    m = P.Remembered(lambda k: asked.append(k) or k.encode(), 4)
    assert [m[k] for k in "abacadaeaf"] == [k.encode() for k in "abacadaeaf"]
    assert asked.count("a") == 1 and len(m) + len(m.older) <= 4


def test_more_windows_when_one_overflows():
    assert len(P.windows([3, 3, 3], 4)) == 3


def test_repeated_rows_are_dealt_over_groups(docs):
    rows = [(2**60 + 1, "a b c")] * 3000 + [(None, "x y")]
    pieces = P.pack(docs(rows).repartition(4), PATH, docs_per_group=64).collect()
    assert len(pieces) == 3001 and {p["doc_id"] for p in pieces} == {2**60 + 1, None}
    sizes = Counter(p["sequence_id"] >> 32 for p in pieces)
    assert len(sizes) > 40 and max(sizes.values()) < 130
