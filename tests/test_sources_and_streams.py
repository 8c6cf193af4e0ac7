from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators.tables import Snapshots
from skein.schema import LimiterConfig
from skein.sources import documents
from skein.streaming import limits, worker


class TwoPages:
    def parse(self, raw):
        if not raw.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        return documents.Parsed([documents.Page(0, "first", True), documents.Page(1, " ", True), documents.Page(2, "", False, "broken")], title="T")


class Shelf:
    def get(self, url):
        if "missing" in url:
            raise OSError("404")
        return f"<p>{url}</p>"


def test_files_and_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "t.txt").write_text("héllo\nworld")
    empty = spark.createDataFrame([("x/c.pdf", bytearray(), 0)], "path string, content binary, length long")
    parsed = documents.parsed(documents.files(spark, [str(tmp_path / "*.pdf")]).unionByName(empty), TwoPages)
    by = {r["filename"]: r for r in parsed.collect()}
    assert by["a.pdf"]["num_pages"] == 3 and by["a.pdf"]["title"] == "T" and "not a PDF" in by["b.pdf"]["error"] and "empty" in by["c.pdf"]["error"]
    pages = {r["page_num"]: r["text"] for r in documents.pages(parsed).collect()}
    assert pages == {0: "first", 1: "[Image-only page 2]", 2: ""}
    assert documents.pages(parsed, skip_failed=True).count() == 2
    assert documents.texts(spark, [str(tmp_path / "t.txt")]).first()["text"] == "héllo\nworld"


def test_paths_and_fetching(spark):
    rows = spark.createDataFrame([("file:///a%20b+c",), ("/x/y",)], "uri string")
    assert [r[0] for r in rows.select(documents.local_path(F.col("uri"))).collect()] == ["/a b+c", "/x/y"]
    with pytest.raises(Exception):
        spark.createDataFrame([("s3://b/k",)], "uri string").select(documents.local_path(F.col("uri"))).collect()
    got = {r["url"]: r for r in documents.fetched(spark.createDataFrame([("http://a",), ("http://missing",)], "url string"), Shelf).collect()}
    assert got["http://a"]["body"] == "<p>http://a</p>" and "404" in got["http://missing"]["error"]


def test_streamed_limits(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, i % 2, t0 + timedelta(seconds=i), 3) for i in range(20)] + [(99, 0, t0 + timedelta(hours=1), 1)]
    spark.createDataFrame(rows, "id long, client long, ts timestamp, tokens int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, client long, ts timestamp, tokens int").parquet(str(tmp_path / "in"))
    for name, df in (("windows", limits.over_limit(stream, 5)), ("bucket", limits.token_bucket(stream, LimiterConfig(burst=10), rate=0.1))):
        # Windows close in a batch without data; states with timeouts would have such batches for ever.
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(name == "windows").lower())
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {(r["client"], r["n"], r["rejected"]) for r in spark.table("windows").collect()} == {(0, 10, 5), (1, 10, 5)}
    taken = {r["id"]: r["taken"] for r in spark.table("bucket").collect()}
    assert len(taken) == 21 and sum(taken[i] for i in range(0, 20, 2)) == 3 and taken[99]


def test_worker_turn(spark, tmp_path):
    queue_ = Snapshots(spark, str(tmp_path), "processing_tasks")
    t = datetime(2024, 1, 1)
    rows = [(str(i), "d", "parse_pdf" if i < 3 else "other", "pending", i, 0, 3, None, {}, None, t, t, None) for i in range(5)]
    queue_.publish(spark.createDataFrame(rows, queue_.read().schema))
    handlers = {"parse_pdf": lambda d: d.select("id", F.when(F.col("id") == "0", "bad").alias("error"))}
    worker.turn(queue_, handlers, 10, "2024-01-01 00:01:00")
    got = {r["id"]: (r["status"], r["attempt_count"]) for r in queue_.read().collect()}
    assert got == {"0": ("retrying", 1), "1": ("done", 1), "2": ("done", 1), "3": ("retrying", 1), "4": ("retrying", 1)}
    version = worker.turn(queue_, handlers, 1, "2024-01-01 00:02:00", tag="q/7")
    assert worker.turn(queue_, handlers, 1, "2024-01-01 00:03:00", tag="q/7") == version == len(queue_.versions())


def test_streamed_breaker_keeps_types(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(str(i), i // 10, t0 + timedelta(seconds=i), i % 10 > 7) for i in range(20)]
    schema = "id string, name int, ts timestamp, succeeded boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    df = limits.circuit_breaker(stream)
    assert df.schema["key"].dataType.simpleString() == "int" and df.schema["id"].dataType.simpleString() == "string"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = df.writeStream.format("memory").queryName("breakers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r["id"]: (r["admitted"], r["state"]) for r in spark.table("breakers").collect()}
    assert len(got) == 20 and got["4"] == (True, "open") and got["9"] == (False, "open")
