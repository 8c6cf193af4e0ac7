"""Duplicates over a stream equal those of one batch; alerts and quantiles at their edges."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import dedup, metrics
from skein.streaming.dedup import Decisions


def texts(n):
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(words[:40] if i % 3 else words[i % 7 :]) + (f" extra{i % 2}" if i % 4 == 0 else "")) for i in range(n)]


def test_a_stream_decides_as_one_batch(spark, tmp_path):
    rows = texts(24)
    for k in range(3):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        decisions = Decisions(spark, f"file://{tmp_path}/d")
        assert decisions.run(stream, str(tmp_path / "c")).awaitTermination(300)
    want = {r.doc_id: r.is_duplicate for r in dedup.leaders(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert {r.doc_id: r.is_duplicate for r in decisions.decided().collect()} == want and set(want.values()) == {True, False}


def test_a_repeated_batch_and_forgotten_rows(spark, tmp_path):
    decisions = Decisions(spark, f"file://{tmp_path}/d")
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    decisions.take(rows, "0", now="2024-01-01 00:00:00")
    version = decisions.ledger.last()["version"]
    decisions.take(rows, "0", now="2024-01-01 00:00:00")
    assert decisions.ledger.last()["version"] == version
    decisions.forget(7, "2024-01-05 00:00:00")
    decisions.take(spark.createDataFrame([(3, "a b c d e")], "doc_id long, text string"), "1", now="2024-01-05 00:00:00")
    decisions.forget(7, "2024-01-09 00:00:00")
    decisions.take(spark.createDataFrame([(4, "a b c d e")], "doc_id long, text string"), "2", now="2024-01-09 00:00:00")
    assert {r.doc_id: r.is_duplicate for r in decisions.decided().collect()} == {1: False, 2: True, 3: True, 4: False}


def test_quantiles_of_buckets(spark):
    inf = float("inf")
    rows = [("even", 1.0, 10), ("even", 2.0, 20), ("even", inf, 20), ("all above", 1.0, 0), ("all above", inf, 5), ("none", 1.0, 0), ("none", inf, 0), ("no end", 1.0, 3), ("skips", 1.0, 0), ("skips", 2.0, 0), ("skips", 4.0, 8), ("skips", inf, 8), (None, 1.0, 4), (None, inf, 4)]
    counted = spark.createDataFrame(rows, "k string, le double, n long")
    got = {r.k: (r.a, r.b) for r in metrics.histogram_quantile(counted, ["k"], {"a": 0.5, "b": 0.9}).collect()}
    assert got["even"] == (1.0, 1.8) and got["all above"] == (1.0, 1.0) and got["none"] == got["no end"] == (None, None)
    assert got["skips"] == (3.0, pytest.approx(3.8)) and got[None] == (0.5, 0.9)


def test_alerts_fire_after_their_time(spark):
    t0 = datetime(2024, 1, 1)
    bad = {"x": [1, 2, 3, 4, 8, 9, 12, 13, 14], "y": [5], None: [1, 2, 3]}
    rows = [(k, t0 + timedelta(minutes=m), m in ms or None) for k, ms in bad.items() for m in range(20) if not (k == "x" and m == 13 - 1 + 1 and False)]
    series = spark.createDataFrame([*rows, ("x", t0 + timedelta(minutes=1), True)], "k string, at timestamp, bad boolean")
    minute = lambda t: None if t is None else int((t - t0).total_seconds() / 60)
    got = sorted(((r.k, minute(r.pending_at), minute(r.firing_at), minute(r.ended_at), r.steps) for r in metrics.alerts(series, ["k"], F.col("bad"), 60, 120).collect()), key=repr)
    assert got == sorted([("x", 1, 3, 5, 4), ("x", 8, None, 10, 2), ("x", 12, 14, 15, 3), ("y", 5, None, 6, 1), (None, 1, 3, 4, 3)], key=repr)
    assert metrics.alerts(series.limit(0), ["k"], F.col("bad"), 60, 120).collect() == []


def test_lines_of_metrics_are_escaped(spark):
    rows = spark.createDataFrame([('a\\b"c\nd', 1.5, 2)], "k string, total double, n long")
    assert metrics.exposition(rows, "m", ["k"], "n").first().line == 'm{k="a\\\\b\\"c\\nd"} 2'
    lines = metrics.family(metrics.exposition(rows, "m", ["k"], "n"), "m", "counter", "two\nlines").orderBy("place").collect()
    assert [r.line for r in lines[:2]] == ["# HELP m two\\nlines", "# TYPE m counter"]
    with pytest.raises(ValueError):
        metrics.family(rows, "m", "number", "")
