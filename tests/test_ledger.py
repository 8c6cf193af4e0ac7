"""Commits of several tables by several writers."""

import re
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import embed
from skein.operators.cache import EmbeddingCache
from skein.operators.ledger import Conflict, Ledger, Table
from skein.operators.workers import SharedQueue
from skein.plans.standins import task_documents, tasks

SF = "/root/testdata/sf0.001"


def NOW():
    return F.lit("2024-01-05").cast("timestamp")


def ledger(spark, tmp_path, buckets=0):
    return Ledger(spark, f"file://{tmp_path}/l", {"a": Table("k int, v string", ("k",), buckets), "b": Table("k int, v string", ("k",))})


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "k int, v string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("buckets", [0, 4])
def test_rows_replace_those_of_their_keys(spark, tmp_path, buckets):
    book = ledger(spark, tmp_path, buckets)
    assert found(book.read("a")) == []
    first = book.commit({"a": rows(spark, (1, "x"), (2, "y")), "b": rows(spark, (1, "b"))})
    old = book.last()
    book.commit({"a": rows(spark, (2, "z"), (3, None))}, gone={"b": rows(spark, (1, None)).select("k")})
    assert first == 1 and found(book.read("a")) == [(1, "x"), (2, "z"), (3, None)] and found(book.read("b")) == []
    assert found(book.read("a", old)) == [(1, "x"), (2, "y")] and found(book.read("b", old)) == [(1, "b")]
    book.compact("a", F.col("k") > 1)
    assert found(book.read("a")) == [(2, "z"), (3, None)] and book.last()["tables"]["a"]["deltas"] == []
    book.commit({"a": rows(spark, (1, "again"))})
    assert found(book.read("a")) == [(1, "again"), (2, "z"), (3, None)]


def test_a_first_commit_is_the_base(spark, tmp_path):
    """Else all rows of a new table met a list of their own keys, which was sent to all tasks."""
    book = ledger(spark, tmp_path, 4)
    book.commit({"a": rows(spark, (1, "x"), (2, "y"))}, gone={"b": rows(spark, (7, None)).select("k")})
    assert book.last()["tables"]["a"]["base"] and book.last()["tables"]["a"]["deltas"] == [] and found(book.read("b")) == []
    book.commit({"a": rows(spark, (2, "z"))})
    book.commit({"a": rows(spark, (2, "q")).where("k = 0")})
    assert found(book.read("a")) == [(1, "x"), (2, "z")]


def test_large_deltas_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("skein.operators.ledger.SENT_ROWS", 3)
    book = ledger(spark, tmp_path)
    book.commit({"a": rows(spark, *((k, "x") for k in range(9)))})
    book.commit({"a": rows(spark, *((k, "y") for k in range(3)))})
    plan = lambda: book.read("a")._jdf.queryExecution().toString()
    assert "BroadcastExchange" in plan()
    book.commit({"a": rows(spark, (3, "y"))})
    assert "BroadcastExchange" not in plan()
    assert found(book.read("a")) == [(k, "y" if k < 4 else "x") for k in range(9)]


def test_two_writers(spark, tmp_path):
    book = ledger(spark, tmp_path)
    book.commit({"a": rows(spark, (1, "x"), (2, "y"))})
    seen = book.last()
    assert book.commit({"a": rows(spark, (1, "first"))}, seen) == 2
    assert book.commit({"a": rows(spark, (2, "other key"))}, seen) == 3
    with pytest.raises(Conflict):
        book.commit({"a": rows(spark, (1, "late"))}, seen)
    assert found(book.read("a")) == [(1, "first"), (2, "other key")]
    assert book.commit({"b": rows(spark, (9, "batch"))}, book.last(), tag="batch 1") == 4
    assert book.commit({"b": rows(spark, (9, "batch"))}, seen, tag="batch 1") == 4, "a replayed batch changes nothing"


def test_a_stale_note_of_the_last_commit(spark, tmp_path):
    book = ledger(spark, tmp_path)
    for i in range(3):
        book.commit({"a": rows(spark, (i, "x"))})
    note = tmp_path / "l/_commits/last"
    for text in ("1", "", "not a number"):
        note.write_text(text)
        (tmp_path / "l/_commits/.last.crc").unlink(missing_ok=True)
        assert book.last()["version"] == 3
    note.unlink()
    assert len(found(book.read("a"))) == 3


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    book = ledger(spark, tmp_path)
    book.commit({"a": rows(spark, (1, "x"))})
    before = book.last()
    book.commit({"a": rows(spark, (2, "y"))})
    newest, book.last = book.last, lambda: before
    take = book._take

    def once(commit):
        book.last, book._take = newest, take
        return take(commit)

    book._take = once
    book.compact("a")
    assert found(book.read("a")) == [(1, "x"), (2, "y")] and len(book.last()["tables"]["a"]["deltas"]) == 1


def shared(spark, tmp_path):
    state, documents = tasks(spark, SF), task_documents(spark, SF)
    kinds = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for df in (state, documents)]
    q = SharedQueue(spark, f"file://{tmp_path}/q", *kinds)
    q.put(state, documents)
    return q


def test_eight_workers_claim_each_task_once(spark, tmp_path):
    q = shared(spark, tmp_path)
    n, got, errors = 5, {}, []

    def work(name):
        try:
            got[name] = q.claim(name, n, NOW())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    claimed = [i for ids in got.values() for i in ids]
    assert len(claimed) == len(set(claimed)) == 8 * n
    held = {r.id: (r.worker_id, r.status) for r in q.tasks().where("worker_id IS NOT NULL").collect()}
    assert held == {i: (w, "processing") for w, ids in got.items() for i in ids}
    assert q.tasks().count() == tasks(spark, SF).count()


def test_a_failed_task_and_its_document_change_in_one_commit(spark, tmp_path):
    q = shared(spark, tmp_path)
    ids = q.claim("w", 30, NOW())
    before = q.ledger.last()["version"]
    q.fail(spark.createDataFrame([(i, "boom") for i in ids], "id long, error string"), NOW())
    assert q.ledger.last()["version"] == before + 1 and set(q.ledger.last()["changed"]) == {"tasks", "documents"}
    after = {r.id: r for r in q.tasks().collect()}
    out = {after[i].document_id for i in ids if after[i].attempt_count >= 3}
    assert {after[i].status for i in ids} == {"retrying", "failed"} and out
    assert {r.id for r in q.documents().where("error_message = 'boom'").collect()} == out
    done = spark.createDataFrame([(ids[0], {"k": "v"})], "id long, attributes map<string,string>")
    q.finish(done, NOW())
    assert q.tasks().where(F.col("id") == ids[0]).first().status == "done"
    assert q.claim("w", 3, NOW(), ("no such type",)) == []


def test_cache_of_base_and_deltas(spark, tmp_path):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/c", 8)
    asked = spark.createDataFrame([(f"text {i}", "m") for i in range(200)], "text string, model string")
    got = cache.embed(asked, NOW(), embed.HashProvider)
    assert got.where("hit").count() == 0 and got.where("size(embedding) = 64").count() == 200
    files = {p for p in (tmp_path / "c").rglob("*.parquet")}
    more = spark.createDataFrame([("text 1", "m"), ("text 1", "other"), ("new", "m"), ("new", "m"), (None, "m")], "text string, model string")
    got = {(r.text, r.model): r.hit for r in cache.embed(more, NOW(), embed.HashProvider).collect()}
    assert got == {("text 1", "m"): True, ("text 1", "other"): False, ("new", "m"): False, (None, "m"): False}
    assert files < {p for p in (tmp_path / "c").rglob("*.parquet")}, "storing leaves the files that are there alone"
    one = cache.looked_up(more.where("text = 'new'"), NOW())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_bucket", plan) and one.where("hit").count() == 2
    cache.put(spark.createDataFrame([("h", "m", [1.0], datetime(2024, 1, 1))], "text_hash string, model string, embedding array<double>, expires_at timestamp"))
    assert cache.entries().count() == 203
    cache.compact(NOW())
    assert cache.entries().count() == 202
    cache.evict(cache.entries().select("text_hash").limit(2))
    assert cache.entries().count() == 200 or cache.entries().count() == 199
    assert cache.looked_up(asked, NOW()).count() == 200
