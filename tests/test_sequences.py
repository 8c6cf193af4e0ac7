"""Automata over ranges: effects against the steps themselves, and keys that fill many ranges."""

import pickle
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import limits
from skein.schema import BreakerConfig, LimiterConfig

TIMES = st.lists(st.integers(0, 40), min_size=1, max_size=40)


def led(effect, rows, start):
    for row in rows:
        effect.feed(row)
    return pickle.loads(pickle.dumps(effect)).end(start)


def stepped(step, rows, start):
    for row in rows:
        start = step(start, row)[0]
    return start


@settings(deadline=None, max_examples=200)
@given(TIMES, st.integers(-30, 0), st.integers(1, 9), st.booleans())
def test_effect_of_windows(gaps, before, count, fresh):
    at, rows = 0, []
    for g in gaps:
        rows.append((at,))
        at += g % 9
    start = None if fresh else limits.Anchor(before, count)
    assert led(limits.AnchorEffect(12), rows, start) == stepped(lambda s, r: limits.anchored_step(s, r[0], 3, 12), rows, start)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), min_size=1, max_size=60), st.integers(0, 10 * 10**6), st.sampled_from([(0.25, 10), (1 / 3, 8), (0.0, 5), (2.0, 10)]), st.booleans())
def test_effect_of_a_bucket(calls, held, limit, fresh):
    at, rows = 0, []
    for gap, tokens in calls:
        at += gap * 300_000
        rows.append((at, float(tokens), *map(float, limit)))
    u = limits.Units.of(*map(float, limit))
    start = None if fresh else limits.Bucket(min(held * u.token // 10**6, u.most), -500_000)
    assert led(limits.BucketEffect(), rows, start) == stepped(limits.units_step, rows, start)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(0, 15), st.booleans()), min_size=1, max_size=60), st.integers(-20, 0), st.sampled_from(["closed", "open", "half_open", None]), st.integers(0, 2))
def test_effect_of_a_breaker(calls, opened, state, n):
    at, rows = 0, []
    for gap, ok in calls:
        rows.append((at, ok, 3, 10, 3, 2))
        at += gap if gap > 8 else gap % 3
    start = {"closed": limits.Breaker(failures=n), "open": limits.Breaker("open", opened=opened), "half_open": limits.Breaker("half_open", successes=n % 2, trials=n + 1), None: None}[state]
    assert led(limits.BreakerEffect(limits._breaker_row), rows, start) == limits.plain_breaker(stepped(limits._breaker_row, rows, start))


def test_pieces_of_a_bucket_stay_few():
    r = random.Random(1)
    e, at = limits.BucketEffect(), 0
    for _ in range(3000):
        at += r.randrange(300_000)
        e.feed((at, float(r.randrange(1, 8)), 1.0, 100.0))
    assert len(e.lo) < 300


@pytest.fixture
def hot(spark):
    """Client a has four fifths of all calls; null is a client too, and so are rows without a time."""
    r = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(i, r.choice("aaaaaaaabc") if i % 50 else None, start + timedelta(seconds=r.randrange(40_000), milliseconds=r.randrange(3) * 250) if i % 97 else None, r.choice([1, 1, 2, 5, 30]), r.random() < 0.7) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id long, client string, ts timestamp, tokens int, ok boolean").repartition(5)


def by_loop(rows, step, row_of):
    state, out = {}, {}
    for row in sorted(rows, key=lambda r: (r[2] or datetime.min, r[0])):
        us = -(2**62) if row[2] is None else round((row[2] - datetime(1970, 1, 1)).total_seconds() * 1e6)
        state[row[1]], *out[row[0]] = step(state.get(row[1]), row_of(us, row))
    return out


@pytest.mark.parametrize("ranges", ["3", "40"])
def test_a_hot_key_over_many_ranges(spark, hot, ranges):
    rows, df = hot
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r.id: [r.taken, r.wait_seconds, r.left] for r in limits.token_bucket(df, LimiterConfig(burst=10), rate=0.3).collect()}
        assert got == by_loop(rows, limits.units_step, lambda us, r: (us, float(r[3]), 0.3, 10.0))
        got = {r.id: [r.allowed] for r in limits.anchored(df, 4).collect()}
        assert got == by_loop(rows, lambda s, r: limits.anchored_step(s, r[0], 4, 60_000_000), lambda us, r: (us,))
        got = {r.id: [r.admitted, r.state] for r in limits.circuit_breaker(df, BreakerConfig(failures=2, recovery_seconds=20.0), key="client", succeeded="ok").collect()}
        assert got == by_loop(rows, limits._breaker_row, lambda us, r: (us, r[4], 2, 20_000_000, 3, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_range_holds_a_hot_key(spark):
    calls = spark.range(40_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id ELSE -1 END AS client", "timestamp_millis(id * 977 % 100000000) AS ts", "1 AS tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        n = calls.repartitionByRange(20, "client", "ts", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert n < 40_000 / 20 * 2
        assert limits.token_bucket(calls, LimiterConfig(burst=5), rate=1.0).count() == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_calls(spark):
    none = spark.createDataFrame([], "id long, client string, ts timestamp, tokens int, succeeded boolean")
    assert limits.anchored(none, 3).collect() == [] and limits.token_bucket(none, LimiterConfig()).collect() == []
    assert limits.circuit_breaker(none, key="client").dtypes == [("key", "string"), ("id", "bigint"), ("admitted", "boolean"), ("state", "string")]


def test_limits_by_provider_and_breakers_by_name(spark):
    calls = spark.createDataFrame([(i, "ab"[i % 2], datetime(2024, 1, 1, 0, 0, i), 3, i > 5) for i in range(10)], "id long, provider string, ts timestamp, tokens int, succeeded boolean")
    providers = spark.createDataFrame([("a", 60, 120, 10), ("b", 600, 30, 4), ("c", 1, 1, 7)], "provider string, requests_per_minute int, tokens_per_minute int, burst int")
    got = limits.provider_acquired(calls, providers)
    status = {r.provider: (r.calls, r.taken, round(r.tokens, 6), r.share) for r in limits.provider_status(got, providers).collect()}
    assert status["c"] == (0, 0, 7.0, 1.0)
    assert status["a"][:3] == (5, 5, 3.0) and status["b"][:3] == (5, 2, 2.0)
    with pytest.raises(Exception, match="unknown provider: b"):
        limits.provider_acquired(calls, providers.where("provider <> 'b'"))
    registry = spark.createDataFrame([("a", 1, 5.0, 3, 1)], "name string, failures int, recovery_seconds double, trials int, successes int")
    state = {r.id: (r.admitted, r.state) for r in limits.circuit_breaker(calls, key="provider", registry=registry).collect()}
    assert state[0] == (True, "open") and state[2] == (False, "open") and state[6] == (True, "closed")
    assert state[1] == (True, "closed") and state[5] == (True, "closed")
