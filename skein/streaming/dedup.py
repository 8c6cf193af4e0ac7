"""Ordered near duplicates over a stream: each micro-batch is decided against the rows that earlier ones kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import dedup
from skein.operators.ledger import Ledger, Table


class Decisions:
    """Kept rows and decisions of a stream, which change together, once for each micro-batch. Rows arrive in order: those of a batch
    are larger than all before. Kept rows older than `days` are forgotten at `forget`, and rows like them are kept again."""

    def __init__(self, spark: SparkSession, root: str, order: str = "doc_id", text: str = "text", kind: str = "long"):
        self.order, self.text = order, text
        tables = {"kept": Table(f"{order} {kind}, {text} string, kept_at timestamp", (order,)), "decided": Table(f"{order} {kind}, is_duplicate boolean", (order,))}
        self.ledger = Ledger(spark, root, tables)

    def decided(self) -> DataFrame:
        return self.ledger.read("decided")

    def take(self, rows: DataFrame, tag: str, threshold: str = "0.95", now: str | None = None) -> None:
        """Decide a batch. A batch whose tag is the last one's is Spark's repetition and changes nothing."""
        known = self.ledger.last()
        if known["tag"] == tag:
            return
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        rows = rows.select(self.order, self.text)
        found = dedup.leaders(rows, self.order, threshold, self.text, seen=self.ledger.read("kept", known).select(self.order, self.text))
        kept = found.where(~F.col("is_duplicate")).select(self.order, self.text, at.alias("kept_at"))
        self.ledger.commit({"kept": kept, "decided": found.select(self.order, "is_duplicate")}, known, tag=tag)

    def forget(self, days: int, now: str) -> None:
        self.ledger.compact("kept", F.col("kept_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))

    def run(self, stream: DataFrame, checkpoint: str, threshold: str = "0.95", **trigger):
        """Start a query that decides every micro-batch of stream."""

        def work(rows: DataFrame, batch: int) -> None:
            self.take(rows, f"{checkpoint}/{batch}", threshold)

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).trigger(**(trigger or {"availableNow": True})).start()
