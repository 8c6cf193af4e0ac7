"""The engine's tables as views over the driver's tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import table

TASK_STATUS = """CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'failed' END
 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'retrying' END END"""
TASK_TYPE = "CASE o_orderkey % 4 WHEN 0 THEN 'parse_pdf' WHEN 1 THEN 'chunk_document' WHEN 2 THEN 'embed_chunk' ELSE 'insert_vector' END"
#: Tasks from orders; `flagged` stands for the dead-letter mark, which Spark keeps in attributes.
TASKS_SQL = f"""tasks AS (SELECT o_orderkey AS id, o_custkey AS document_id, {TASK_STATUS} AS status, {TASK_TYPE} AS task_type,
 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 4 AS INT) AS attempt_count, 3 AS max_attempts,
 o_orderkey % 5 = 0 AS flagged, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders)"""
DOC_STATUS = "CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'embedding' WHEN 2 THEN 'done' ELSE 'failed' END"
#: Chunks from lineitem: the order is the document, the line status D or not. Chunks with an odd part have an embedding.
CHUNKS_SQL = "chunks AS (SELECT l_orderkey AS document_id, CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'pending' END AS status, l_partkey % 2 = 1 AS embedded FROM lineitem)"
NOW = "1998-01-01 00:00:00"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS document_id", f"{TASK_TYPE} AS task_type", f"{TASK_STATUS} AS status",
        "5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority", "CAST(o_orderkey % 4 AS INT) AS attempt_count", "3 AS max_attempts",
        "CAST(NULL AS STRING) AS error_message",
        "CASE WHEN o_orderkey % 5 = 0 THEN map('dlq', 'true', 'source', 'orders') ELSE map('source', 'orders') END AS attributes",
        "CAST(NULL AS STRING) AS worker_id", "CAST(o_orderdate AS TIMESTAMP) AS created_at", "CAST(o_orderdate AS TIMESTAMP) AS updated_at", "CAST(NULL AS TIMESTAMP) AS completed_at",
    )


def task_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{DOC_STATUS} AS status", "CAST(NULL AS STRING) AS error_message")


def line_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, embeddings). A line has no key of its own: its id is a hash of its columns and place among equals."""
    lines = table(spark, sf_dir, "lineitem")
    chunks = lines.select(F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("status"), (F.col("l_partkey") % 2 == 1).alias("embedded"))
    return chunks.select("id", "document_id", "status"), chunks.where("embedded").select(F.col("id").alias("chunk_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the user is the client, errors are failures, |value| the latency in seconds."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.abs(F.col("value") / 20).alias("seconds"), (F.col("event_type") != "error").alias("succeeded"))
