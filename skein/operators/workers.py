"""A task queue and its documents as a ledger: workers claim, finish and fail tasks at the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import queue
from skein.operators.ledger import Ledger, Table


class SharedQueue:
    """tasks and documents that change together. No task is claimed twice: a worker that chose tasks which another one claimed
    meanwhile chooses again."""

    def __init__(self, spark: SparkSession, root: str, tasks_schema: str, documents_schema: str):
        self.ledger = Ledger(spark, root, {"tasks": Table(tasks_schema, ("id",)), "documents": Table(documents_schema, ("id",))})

    def tasks(self) -> DataFrame:
        return self.ledger.read("tasks")

    def documents(self) -> DataFrame:
        return self.ledger.read("documents")

    def put(self, tasks: DataFrame | None = None, documents: DataFrame | None = None) -> int:
        return self.ledger.commit({n: df for n, df in (("tasks", tasks), ("documents", documents)) if df is not None})

    def claim(self, worker: str, n: int, now: Column, types: tuple[str, ...] = ()) -> list:
        """Ids of up to n next tasks, which are now in this worker's hands."""

        def change(commit: dict) -> tuple[dict[str, DataFrame], list]:
            chosen = queue.next_tasks(self.ledger.read("tasks", commit), n, types)
            ids = [r.id for r in chosen.select("id").collect()]
            if not ids:
                return {}, []
            # The ids are fixed: at most n of them.
            mine = self.ledger.read("tasks", commit).where(F.col("id").isin(ids))
            return {"tasks": queue.claimed(mine, mine.select("id"), F.lit(worker), now)}, ids

        return self.ledger.tried(change)

    def finish(self, done: DataFrame, now: Column) -> None:
        """done(id, attributes)."""

        def change(commit: dict) -> tuple[dict[str, DataFrame], None]:
            return {"tasks": queue.finished(self.ledger.read("tasks", commit).join(done.select("id"), "id", "left_semi"), done, now)}, None

        self.ledger.tried(change)

    def fail(self, errors: DataFrame, now: Column) -> None:
        """errors(id, error): tasks, and documents whose task has no attempt left, in one commit."""

        def change(commit: dict) -> tuple[dict[str, DataFrame], None]:
            hit = self.ledger.read("tasks", commit).join(errors.select("id"), "id", "left_semi")
            out = hit.where(F.col("attempt_count") >= F.col("max_attempts")).select(F.col("document_id").alias("id")).distinct()
            documents = self.ledger.read("documents", commit).join(out, "id", "left_semi")
            return {"tasks": queue.failed(hit, errors, now), "documents": queue.failed_documents(documents, hit, errors)}, None

        self.ledger.tried(change)
