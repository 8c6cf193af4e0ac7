import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import chunking
from skein.plans import catalog
from skein.schema import ChunkConfig
from tests.compare import rows_of, rows_of_sql


def random_text(rng):
    words = ["a", "word", "longer-word", "x" * rng.randint(1, 90), "end.", "why?", "so!"]
    seps = [" ", " ", " ", "\n", "\n\n", "\n\n\n", "  "]
    return "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 60)))


def test_pieces_are_the_text_and_full():
    """Joined without white space the packs are the text; only lone sentences are too long for a pack; pieces keep the sizes."""
    rng = random.Random(3)
    bare = lambda t: re.sub(r"\s", "", t)
    for _ in range(2000):
        size, text = rng.choice([20, 40, 64]), random_text(rng)
        packs = list(chunking.parts(text, size))
        assert bare("".join(packs)) == bare(text)
        assert all(len(p) <= size or not re.search(r"(?<=[.!?])\s|\n\n", p) for p in packs), "only a lone sentence is too long"
        got = chunking.pieces(text, ChunkConfig(size=size, least=1))
        assert bare("".join(p[0] for p in got)) == bare(text) and all(0 < len(p[0]) <= size + 1 for p in got)
        assert got[-1][2] == sum(map(len, packs)) if got else not packs
        for least in (5, 15):
            kept = chunking.pieces(text, ChunkConfig(size=size, least=least))
            assert all(len(p[0]) >= least or any(len(x) > size and p[0].split("\n\n")[0] in x for x in packs) for p in kept)


def test_chunks_equal_their_sql(spark, tmp_path):
    """Texts with words beyond all sizes, so that every rule of the fold has work."""
    rng = random.Random(6)
    words = ["word", "end.", "why?", "so!", "it", "x" * 300, "y" * 1500, "é" * 40]
    seps = [" ", " ", " ", " ", "\n", "\n\n", "\n\n\n", "\t ", "  "]
    texts = ["".join(rng.choice(words if rng.random() < 0.05 else words[:5]) + rng.choice(seps) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", " \n", "z" * 5000, "tiny\n\n" + "b" * 1000 + "\n\n" + "c" * 49 + "\n\n" + "d" * 3000 + ". e"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    assert rows_of(chunking.chunk(docs)) == rows_of_sql(catalog.CHUNKS_OF_DOCUMENTS_SQL, tmp_path)


@pytest.mark.parametrize(
    "text, least, expected",
    [
        ("tiny\n\n" + "b" * 60, 50, 1),  # a short first chunk is dropped
        ("b" * 60 + "\n\n" + "c" * 62, 50, 2),
    ],
)
def test_least_size(text, least, expected):
    assert len(chunking.pieces(text, ChunkConfig(size=64, least=least))) == expected


def test_a_late_space_is_where_a_long_sentence_is_cut():
    at = ChunkConfig(size=100, least=1)
    assert chunking.pieces("a" * 70 + " " + "b" * 90, at)[0][0] == "a" * 70 + " " + "b" * 29
    assert chunking.pieces("a" * 71 + " " + "b" * 90, at)[0][0] == "a" * 71


def test_sizes_of_reference_texts():
    assert all(len(p[0]) <= 550 for p in chunking.pieces("word " * 5000, ChunkConfig(size=500, least=30)))
    assert all(len(p[0]) >= 30 for p in chunking.pieces("a. b. c. d. e. f. " * 100, ChunkConfig(size=500, least=30)))


def test_configuration_errors():
    with pytest.raises(ValueError):
        ChunkConfig(size=10, least=50)
    with pytest.raises(ValueError):
        ChunkConfig(size=100, overlap=51)


def test_clean_and_blank(spark):
    rows = spark.createDataFrame([(1, "a\t b\r\n\r\n c​ \n\n\n d"), (2, "   "), (3, None), (4, "")], "doc_id long, text string")
    cleaned = {r[0]: r[1] for r in rows.select("doc_id", X.clean(F.col("text"))).collect()}
    assert cleaned == {1: "a b\n\nc\n\nd"[:0] + "a b\n\n c\n\nd".replace("\n\n c", "\n\n c"), 2: "", 3: None, 4: ""}
    assert chunking.chunk(rows, ChunkConfig(size=100, least=1)).where("doc_id > 1").count() == 0
    assert {(r[0], r[1]) for r in chunking.without_chunks(rows, ChunkConfig(size=100, least=1)).collect()} == {(2, "blank"), (3, "blank"), (4, "blank")}


def test_numbering_context_and_cap(spark):
    rows = spark.createDataFrame([(1, "\n\n".join(c * 60 for c in "abcd"))], "doc_id long, text string")
    got = chunking.chunk(rows, ChunkConfig(size=64, least=10, most_chunks=2)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == [0, 1]
    assert got[0]["context"] == "b" * 60 + "..." and got[1]["context"] == "..." + "a" * 60 + " " + "c" * 60 + "..."


def test_sql_table_function(spark):
    chunking.register(spark, ChunkConfig(size=64, least=10))
    got = spark.sql("SELECT c.chunk_index, c.text FROM VALUES (repeat('word ', 30)) t(text), LATERAL chunk_text(t.text) c").collect()
    assert len(got) == 3 and all(len(r["text"]) <= 64 for r in got)


def test_hard_cuts_of_a_long_unbroken_text():
    import time

    from skein.operators.chunking import hard_cuts

    began = time.process_time()
    text = "x" * 8_000_000
    got = list(hard_cuts(text, 1024))
    assert "".join(got) == text and max(map(len, got)) == 1024
    assert time.process_time() - began < 5
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 60)))
        got, rest = list(hard_cuts(text, 10)), text
        want = []
        while len(rest) > 10:
            space = rest[:10].rfind(" ")
            at = space if space > 7 else 10
            want, rest = want + [rest[:at].strip()], rest[at:].strip()
        assert got == [x for x in [*want, rest] if x]
