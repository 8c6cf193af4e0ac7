"""Results that jobs leave in the shared folder."""

import hashlib
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import chunking, embed
from skein.schema import ChunkConfig
from skein.session import SLICE_BYTES, Scratch, exists, results_freed, sliced


def leave(spark, n):
    scratch = Scratch(spark)
    df = scratch.write(spark.range(n), "result")
    scratch.close(keep="result")
    return df, scratch.path


def test_a_block_frees_its_own_results(spark):
    with results_freed(spark):
        df, inside = leave(spark, 3)
        assert df.count() == 3
    assert not exists(spark, inside)
    df, outside = leave(spark, 4)
    assert df.count() == 4 and exists(spark, outside)


def test_nested_blocks_and_errors(spark):
    with results_freed(spark):
        _, first = leave(spark, 1)
        with results_freed(spark):
            _, second = leave(spark, 1)
        assert exists(spark, first) and not exists(spark, second)
    assert not exists(spark, first)
    with pytest.raises(RuntimeError), results_freed(spark):
        _, third = leave(spark, 1)
        raise RuntimeError
    assert not exists(spark, third)


def test_two_threads_keep_their_results_apart(spark):
    ready, freed, got = threading.Event(), threading.Event(), []

    def other():
        with results_freed(spark):
            df, path = leave(spark, 5)
            ready.set()
            assert freed.wait(120)
            got.append(df.count())
        got.append(exists(spark, path))

    t = threading.Thread(target=other)
    with results_freed(spark):
        t.start()
        assert ready.wait(120)
        _, mine = leave(spark, 2)
    assert not exists(spark, mine)
    freed.set()
    t.join()
    assert got == [5, False]


def test_batches_are_taken_in_slices():
    """A worker made Python's objects of a whole batch before, some thousands of texts."""
    texts = pa.array(["x" * (1 << 18)] * 40 + ["y"] * 40)
    assert [t for part in sliced(iter([texts])) for t in part.to_pylist()] == texts.to_pylist()
    assert max(len(part) for part in sliced(iter([texts]))) <= 8 and list(sliced(iter([pa.array([], pa.string())]))) == []


def test_chunks_and_vectors_over_several_slices(spark):
    texts = [None if i % 9 == 0 else (f"{i} " + "word. " * (i * 700 % 9000)).strip() for i in range(100)]
    assert sum(len(t or "") for t in texts) > 2 * SLICE_BYTES
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [(i, n, *p) for i, t in enumerate(texts) for n, p in enumerate(chunking.pieces(t, ChunkConfig()) if t else [])]
    got = chunking.chunk(rows).select("doc_id", "chunk_index", "content", "start_char", "end_char", "tokens").orderBy("doc_id", "chunk_index").collect()
    assert [tuple(r) for r in got] == want
    found = {r.text_hash: list(r.embedding) for r in embed.embed(rows.withColumn("model", F.lit("m")), embed.HashProvider).collect()}
    assert len(found) == len([t for t in texts if t])
    for t in texts[1:3]:
        v = embed.HashProvider().embed([t], "m")[0]
        assert found[hashlib.sha256(t.encode()).hexdigest()] == pytest.approx([x / sum(y * y for y in v) ** 0.5 for x in v])
