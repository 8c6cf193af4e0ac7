import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import dead_letters, dedup, embed, ingest, limits, metrics, queue, validate, vector
from skein.operators.tables import Snapshots
from skein.schema import BackoffConfig, BreakerConfig, LimiterConfig, QualityConfig


def NOW():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def sequential_leaders(texts, threshold):
    kept, seen, out = [], set(), []
    for t in texts:
        key, words = t.strip().lower(), set(t.lower().split())
        dup = key in seen or any(words and k and len(words & k) / len(words | k) > threshold for k in kept)
        out.append(dup)
        seen.add(key)
        if not dup:
            kept.append(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(12)]
    texts = [" ".join(w for w in base if rng.random() < 0.9) + rng.choice(["", " X", " x"]) for _ in range(60)] + ["", " ", "a", "A"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = [r["is_duplicate"] for r in dedup.leaders(rows, "seq", "0.75").orderBy("seq").collect()]
    assert got == sequential_leaders(texts, 0.75)


def test_leaders_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    exact = dedup.exact_duplicates(docs, "doc_id").where("is_duplicate").count()
    assert (exact, dedup.leaders(docs, "doc_id").where("is_duplicate").count()) == (73, 82)


def test_validation_cases(spark):
    texts = ["This is a finished and quite long sentence about nothing at all.", "Short", "This text has no end and goes on for long enough to be", "-", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r for r in validate.validated(rows, QualityConfig()).collect()}
    assert got[0]["is_valid"] and got[0]["reasons"] == []
    assert got[1]["issues"] == ["too_few_tokens", "too_few_chars", "truncated_content"] and got[1]["reasons"][0] == "Token count 1 < minimum 10"
    assert got[2]["issues"] == ["truncated_content"]
    assert "low_content_quality" in got[4]["issues"] and "truncated_content" not in got[4]["issues"]
    assert 0 <= got[3]["quality_score"] <= 1


def test_top_k_ties_zero_and_opposite_vectors(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])], "chunk_id int, embedding array<float>")
    assert [r[0] for r in vector.top_k(rows, [1.0, 0.0], 10, -1.0).collect()] == [1, 3, 4]
    assert vector.top_k(rows, [1.0, 0.0], 1, 0.5).collect()[0]["chunk_id"] == 1
    normal = rows.select("chunk_id", vector.clamped(F.lit(1.00000004)))
    assert normal.first()[1] == 1.0


def test_insert_is_all_or_nothing(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    good = spark.createDataFrame([(2, [1.0, 1.0])], table.schema)
    assert vector.inserted(table, good, "id", 2).count() == 2
    for bad in ([(1, [1.0, 1.0])], [(3, [1.0])]):
        with pytest.raises(Exception):
            vector.inserted(table, spark.createDataFrame(bad, table.schema), "id", 2).collect()


class Flaky(embed.HashProvider):
    calls = 0

    def embed(self, texts, model):
        Flaky.calls += 1
        if Flaky.calls % 2:
            raise embed.TransientError
        return super().embed(texts, model)


def test_embedding_and_cache(spark):
    rows = spark.createDataFrame([(1, "a", "m"), (2, "a", "m"), (3, "b", "m"), (4, "a", "n")], "id long, text string, model string")
    made = embed.embed(rows, lambda: Flaky(8)).collect()
    assert len(made) == 3 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in made)
    cache = embed.stored(spark.createDataFrame([], "text_hash string, model string, embedding array<double>, expires_at timestamp"), spark.createDataFrame(made), NOW())
    filled, fresh = embed.cached_embed(rows, cache, NOW(), embed.HashProvider)
    assert filled.where("hit").count() == 4 and fresh.count() == 0
    late, _ = embed.cached_embed(rows, cache, NOW() + F.expr("INTERVAL 31 DAYS"), embed.HashProvider)
    assert late.where("hit").count() == 0 and late.where("embedding is null").count() == 0


def tasks(spark, rows):
    return spark.createDataFrame([(i, 1, "parse_pdf", s, p, a, 3, None, {"dlq": "true"} if d else {}, None, c, c, None) for i, s, p, a, d, c in rows], "id long, document_id long, task_type string, status string, priority int, attempt_count int, max_attempts int, error_message string, attributes map<string,string>, worker_id string, created_at timestamp, updated_at timestamp, completed_at timestamp")


def test_queue_edges(spark):
    t0 = datetime(2024, 1, 1, 23, 55)
    state = tasks(spark, [(1, "pending", 1, 0, 0, t0), (2, "retrying", 9, 2, 0, t0), (3, "pending", 9, 3, 0, t0), (4, "processing", 0, 1, 0, t0), (5, "processing", 0, 1, 0, t0 - timedelta(seconds=1)), (6, "failed", 0, 3, 0, t0), (7, "failed", 0, 3, 1, t0), (8, "failed", 0, 2, 0, t0)])
    assert [r["id"] for r in queue.next_tasks(state, 5).collect()] == [2, 1]
    stuck = {r["id"]: r["status"] for r in queue.unstuck(state, NOW()).collect()}
    assert (stuck[4], stuck[5]) == ("processing", "pending")  # exactly at the cutoff stays
    errors = state.where("id in (2, 6)").select("id", F.lit("x").alias("error"))
    after = {r["id"]: r["status"] for r in queue.failed(state, errors, NOW()).collect()}
    assert (after[2], after[6]) == ("retrying", "failed")
    moved, letters = dead_letters.moved(state, NOW())
    assert [r["task_id"] for r in letters.collect()] == [6]
    assert dead_letters.moved(moved, NOW())[1].count() == 0  # a second scan finds nothing
    again = {r["id"]: (r["status"], r["attempt_count"]) for r in dead_letters.replayed_all(moved, NOW()).collect()}
    assert again[6] == again[7] == ("pending", 0) and again[8] == ("failed", 2)
    retried = queue.retried(moved, F.lit(1), NOW()).collect()
    assert all(r["status"] == "pending" and "dlq" not in r["attributes"] for r in retried) and {r["attempt_count"] for r in retried} == {0, 1, 2, 3}


def test_limits_against_loops(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 600)), rng.randint(1, 12), rng.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, client string, ts timestamp, tokens int, succeeded boolean")
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    left, last, expected = {}, {}, {}
    for i, c, ts, n, _ in ordered:
        at = ts.timestamp()
        left[c] = min(10, left.get(c, 10) + (at - last.get(c, at)) * 0.5)
        last[c] = at
        expected[i] = left[c] >= n
        left[c] -= n if expected[i] else 0
    got = {r["id"]: r for r in limits.token_bucket(df, LimiterConfig(burst=10), rate=0.5).collect()}
    assert {i: r["taken"] for i, r in got.items()} == expected
    assert all((r["wait_seconds"] is None) == (rows[i][3] > 10) for i, r in got.items() if not r["taken"])
    start, n, expected = {}, {}, {}
    for i, c, ts, *_ in ordered:
        if c not in start or (ts - start[c]).total_seconds() >= 60:
            start[c], n[c] = ts, 0
        n[c] += 1
        expected[i] = n[c] <= 3
    assert {r["id"]: r["allowed"] for r in limits.anchored(df, 3).collect()} == expected


def test_breaker_life():
    c, b = BreakerConfig(failures=2, recovery_seconds=10, trials=3, successes=2), None
    seen = []
    for at, ok in [(0, False), (1, True), (2, False), (3, False), (4, True), (14, True), (15, True), (16, False), (17, False), (28, True), (29, False), (30, True)]:
        b, admitted = limits.breaker_step(b, at, ok, c)
        seen.append((b.state, admitted))
    assert seen[3] == ("open", True) and seen[4] == ("open", False) and seen[5] == ("half_open", True) and seen[6] == ("closed", True)
    assert seen[8] == ("open", True) and seen[9] == ("half_open", True) and seen[10] == ("open", True) and seen[11] == ("open", False)


def test_backoff_and_health(spark):
    row = spark.range(20).select(F.max(limits.exponential(F.col("id"), BackoffConfig())), F.max(limits.linear(F.col("id"), BackoffConfig()))).first()
    assert tuple(row) == (300.0, 20.0)
    parts = spark.createDataFrame([("a", "healthy"), ("b", "healthy"), ("b", "degraded"), ("c", "unhealthy"), ("c", "degraded")], "s string, status string")
    assert {r[0]: r[1] for r in metrics.health(parts, ["s"]).collect()} == {"a": "healthy", "b": "degraded", "c": "unhealthy"}


def test_minute_boundary(spark):
    rows = spark.createDataFrame([(i, "a", datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate([58, 59])] + [(2, "a", datetime(2024, 1, 1, 0, 1, 0))], "id long, client string, ts timestamp")
    assert [r["allowed"] for r in limits.tumbling(rows, 1).orderBy("id").collect()] == [True, False, True]


def test_snapshots(spark, tmp_path):
    docs = Snapshots(spark, str(tmp_path), "rag_chunks")
    assert docs.read().count() == 0
    row = docs.read().schema
    one = spark.createDataFrame([("1", "d", 0, "text", None, "done", 1, None, None, None)], row)
    docs.publish(one)
    docs.publish(docs.read().unionByName(one))
    assert docs.read().count() == 2 and len(docs.versions()) == 2
    assert docs.clear() == 2 and docs.read().count() == 0


def test_first_of_key_and_unseen(spark):
    rows = spark.createDataFrame([(2, "u", "h"), (1, "u", "h"), (3, "v", "h")], "id long, uri string, hash string")
    assert sorted(r["id"] for r in ingest.first_of_key(rows, ["uri", "hash"], ["id"]).collect()) == [1, 3]
    assert [r["id"] for r in ingest.unseen(rows, rows.where("uri = 'u'"), ["uri", "hash"]).collect()] == [3]


def test_errors(spark):
    from skein.errors import EngineError, status_of

    e = EngineError("TASK_NOT_FOUND", "no task", task_id=7)
    assert e.as_row() == {"code": "TASK_NOT_FOUND", "status": 404, "message": "no task", "details": {"task_id": "7"}}
    rows = spark.createDataFrame([("VALIDATION_ERROR",), ("other",), (None,)], "code string")
    assert [r[0] for r in rows.select(status_of(F.col("code"))).collect()] == [422, 500, 500]


def test_strip_takes_linear_time(spark):
    import time

    from skein.functions.text import clean, strip

    text = "  a" + " " * 200_000 + "b" + " \t \n" * 50_000
    rows = spark.createDataFrame([(text,), (" " * 200_000,), (" x ",), (None,)], "text string")
    began = time.time()
    got = [r[0] for r in rows.select(strip(F.col("text"))).collect()]
    assert got == [text.strip(), "", "x", None]
    rows.select(clean(F.col("text")), validate.truncated(strip(F.col("text")))).collect()
    assert time.time() - began < 20


@pytest.mark.parametrize("cut", [0, 17, 40])
def test_leaders_over_several_calls(spark, cut):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(12)]
    texts = [" ".join(w for w in base if rng.random() < 0.9) for _ in range(50)] + ["", "  ", "b a", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    first = dedup.leaders(rows.where(F.col("seq") < cut), "seq", "0.75")
    kept = first.where(~F.col("is_duplicate")).select("seq", "text")
    second = dedup.leaders(rows.where(F.col("seq") >= cut), "seq", "0.75", seen=kept)
    got = [r["is_duplicate"] for r in first.unionByName(second).orderBy("seq").collect()]
    assert got == sequential_leaders(texts, 0.75)


def test_valid_texts_keep_their_places(spark):
    texts = ["short", "This is a finished and quite long sentence about nothing at all.", None, "Another finished and rather long sentence, about something else.", "-"]
    rows = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "seq int, text string")
    got = validate.valid_only(validate.validated(rows), "seq").collect()
    assert sorted((r["index"], r["text"]) for r in got) == [(1, texts[1]), (3, texts[3])]
    assert validate.valid_only(validate.validated(rows.limit(0)), "seq").count() == 0


def test_taking_tokens_without_a_refill():
    b = limits.Bucket(5.0, 0.0)
    assert limits.consume(b, 2, 1.0).tokens == 3.0
    with pytest.raises(limits.RateLimited) as e:
        limits.consume(b, 8, 2.0)
    assert e.value.retry_after == 2


def test_providers():
    p = limits.Providers({"a": LimiterConfig(requests_per_minute=60, burst=4)})
    assert [p.acquire("a", 0.0, 3)[0], p.acquire("a", 0.0, 3)] == [True, (False, 2.0)]
    assert p.acquire("a", 0.0, 5) == (False, None) and p.status("a") == {"tokens": 1.0, "capacity": 4.0, "refill_per_second": 1.0, "share": 0.25}
    p.reset()
    assert p.status("a")["tokens"] == 4.0
    p.register("b", LimiterConfig())
    assert p.status("b")["refill_per_second"] == 50.0
    for call in (p.status, lambda n: p.acquire(n, 0.0), p.reset):
        with pytest.raises(ValueError):
            call("nobody")


def test_waits_are_bounded_and_take_nothing(spark):
    rows = spark.createDataFrame([(0.0, 10.0, 0.0), (20.0, 10.0, 0.0), (0.0, 600.0, 0.0), (0.0, 100.0, 260.0)], "tokens double, wanted double, waited double")
    got = [r[0] for r in rows.select(limits.waiting(F.col("tokens"), F.col("wanted"), 2.0, F.col("waited"))).collect()]
    assert got == [5.0, 0.0, 300.0, None]


def test_chunks_become_rows_and_tasks(spark):
    from skein.operators import chunking

    texts = spark.createDataFrame([(1, "A sentence of the first document that is long enough. " * 40), (2, "short"), (3, None)], "doc_id long, text string")
    documents = spark.createDataFrame([(i, "chunking") for i in (1, 2, 3)], "id long, status string")
    rows, tasks, moved = ingest.chunks_accepted(documents, chunking.chunk(texts, with_page=True), NOW())
    got = rows.collect()
    assert len(got) > 1 and {r["document_id"] for r in got} == {1} and {r["attributes"]["page_num"] for r in got} == {1}
    assert {r["attributes"]["chunk_id"] for r in tasks.collect()} == {r["id"] for r in got} and {r["priority"] for r in tasks.collect()} == {0}
    assert {r["id"]: r["status"] for r in moved.collect()} == {1: "embedding", 2: "chunking", 3: "chunking"}


def test_text_search_needs_text(spark):
    rows = spark.createDataFrame([(1, [0.0] * 64, "t")], "chunk_id int, embedding array<float>, text string")
    with pytest.raises(ValueError):
        vector.search_text(rows, "  ", "m", embed.HashProvider())
    assert vector.search_text(rows, "x", "m", embed.HashProvider(), keep=["text"]).columns == ["chunk_id", "text", "score"]


class Shaky(embed.HashProvider):
    """Fails with a lost connection on its first call in a process."""

    calls = 0

    def embed(self, texts, model):
        Shaky.calls += 1
        if Shaky.calls == 1:
            raise ConnectionError
        return super().embed(texts, model)


def test_a_request_for_a_batch(spark):
    rows = spark.createDataFrame([(f"text {i}", "m") for i in range(3)], "text string, model string")
    results, totals = embed.embed_batch(rows.coalesce(1), Shaky, backoff=BackoffConfig(initial=0.01))
    assert results.count() == 3 and totals.first()["embeddings"] == 3
    for bad in (rows.limit(0), rows.crossJoin(spark.range(40)).select("text", "model")):
        with pytest.raises(ValueError):
            embed.embed_batch(bad, embed.HashProvider)
    with pytest.raises(ValueError):
        embed.embed(rows, embed.HashProvider, batch=2049)


def test_clearing_the_cache(spark):
    cache = spark.createDataFrame([("a", "m"), ("b", "m"), ("a", "n"), ("c", None)], "text_hash string, model string")
    rest, n = embed.cleared(cache, "m")
    assert n == 2 and sorted(r[0] for r in rest.collect()) == ["a", "c"]
    assert embed.cleared(cache)[1] == 4


def test_breakers_by_name():
    b = limits.Breakers()
    b.register("x", BreakerConfig(failures=1))
    assert b.call("x", 0.0, False) and not b.call("x", 1.0, True)
    b.register("x")
    assert b.status("x").state == "open"
    b.reset()
    assert b.status("x").state == "closed" and b.call("x", 2.0, False) and b.status("x").state == "open"
    with pytest.raises(ValueError):
        b.call("y", 0.0, True)


def test_rendering(spark):
    from skein.operators.tables import rendered

    rows = spark.createDataFrame([(1, "a"), (22, None)], "id int, name string").coalesce(1)
    assert rendered(rows, "json") == ['{"id":1,"name":"a"}', '{"id":22}']
    assert rendered(rows) == ["id  name", "1   a", "22"]
    with pytest.raises(ValueError):
        rendered(rows, "xml")
