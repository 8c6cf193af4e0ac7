"""The task queue as functions from one state of its tables to the next. Times are passed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.ingest import merged_attributes

CLAIMABLE = ("pending", "retrying")
DLQ_KEYS = ("dlq", "dlq_at")


def claimable(status: Column, attempts: Column, most: Column) -> Column:
    return status.isin(*CLAIMABLE) & (attempts < most)


def retryable(status: Column, attempts: Column, most: Column) -> Column:
    return (status == "failed") & (attempts < most)


def fresh(status: Column, attempts: Column, most: Column) -> Column:
    """Claimable as a task itself says: pending only."""
    return (status == "pending") & (attempts < most)


def next_tasks(tasks: DataFrame, n: int, types: tuple[str, ...] = ()) -> DataFrame:
    """The n claimable tasks of highest priority, oldest first, ties by id."""
    open_ = tasks.where(claimable(F.col("status"), F.col("attempt_count"), F.col("max_attempts")))
    if types:
        open_ = open_.where(F.col("task_type").isin(*types))
    return open_.orderBy(F.desc("priority"), "created_at", "id").limit(n)


def enqueued(tasks: DataFrame, new: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """tasks with new(id, document_id, task_type[, priority, attributes]) added as pending; priority is 0 where none is given."""
    known = {"status": F.lit("pending"), "priority": F.coalesce("priority", F.lit(0)) if "priority" in new.columns else F.lit(0), "attempt_count": F.lit(0), "max_attempts": F.lit(most_attempts), "created_at": now, "updated_at": now}
    added = [known[c] if c in known else F.col(c) if c in new.columns else F.lit(None) for c in tasks.columns]
    return tasks.unionByName(new.select(*(x.cast(tasks.schema[c].dataType).alias(c) for x, c in zip(added, tasks.columns, strict=True))))


def task(tasks: DataFrame, id_: Column) -> DataFrame:
    return tasks.where(F.col("id") == id_)


def tasks_of(tasks: DataFrame, document_id: Column, status: str | None = None) -> DataFrame:
    """A document's tasks, of one status if it is named."""
    own = tasks.where(F.col("document_id") == document_id)
    return own if status is None else own.where(F.col("status") == status)


def document_status(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, id_: Column) -> DataFrame:
    """One document's columns with its counts and progress; its chunks alone are counted."""
    own = documents.where(F.col("id") == id_)
    return own.join(progress(own, chunks.where(F.col("document_id") == id_), embeddings), "id")


def coordinator(tasks: DataFrame, workers: list[tuple[str, int]]) -> DataFrame:
    """(worker_id, room, assigned, completed, failed, free): what each pool of workers holds and has done, one row per pool."""
    pools = tasks.sparkSession.createDataFrame(workers, "worker_id string, room int")
    s = F.col("status")
    by = tasks.where(F.col("worker_id").isNotNull()).groupBy("worker_id").agg(F.count_if(s == "processing").alias("assigned"), F.count_if(s == "done").alias("completed"), F.count_if(s == "failed").alias("failed"))
    joined = pools.join(by, "worker_id", "left")
    held = [F.coalesce(c, F.lit(0)).alias(c) for c in ("assigned", "completed", "failed")]
    return joined.select("worker_id", "room", *held, F.greatest(F.col("room") - F.coalesce("assigned", F.lit(0)), F.lit(0)).alias("free"))


def claimed(tasks: DataFrame, chosen: DataFrame, worker: Column, now: Column) -> DataFrame:
    """tasks with the chosen ids in work. One writer claims for a queue, as there is no row lock."""
    took = tasks.join(chosen.select("id", F.lit(True).alias("_took"), worker.alias("_worker")), "id", "left")
    hit = F.coalesce("_took", F.lit(False))
    return took.select(*(_changed(tasks, hit, {"status": F.lit("processing"), "worker_id": F.col("_worker"), "attempt_count": F.col("attempt_count") + 1, "updated_at": now})))


def _changed(tasks: DataFrame, hit: Column, new: dict[str, Column]) -> list[Column]:
    def value(c: str) -> Column:
        kind = tasks.schema[c].dataType
        return new[c] if isinstance(kind, T.MapType) else new[c].cast(kind)

    return [F.when(hit, value(c)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns]


def dealt(tasks: DataFrame, workers: list[tuple[str, int]]) -> DataFrame:
    """(id, worker_id): workers in turn take as many of the next tasks as they have room for."""
    chosen = next_tasks(tasks, sum(n for _, n in workers))
    # The rank spans at most the workers' total room, which bounds the one window.
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), "created_at", "id"))
    out, reach = F.lit(None).cast("string"), sum(n for _, n in workers)
    for name, n in reversed(workers):
        out = F.when(rank <= reach, name).otherwise(out)
        reach -= n
    return chosen.select("id", out.alias("worker_id"))


def finished(tasks: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """tasks with done(id, attributes) marked so and their attributes merged."""
    joined = tasks.join(done.select("id", F.col("attributes").alias("_new"), F.lit(True).alias("_hit")), "id", "left")
    merged = F.when(F.col("_new").isNotNull(), merged_attributes(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.col("_new"))).otherwise(F.col("attributes"))
    return joined.select(*_changed(tasks, F.coalesce("_hit", F.lit(False)), {"status": F.lit("done"), "completed_at": now, "updated_at": now, "attributes": merged}))


def failed(tasks: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """tasks with errors(id, error) back to retrying while they have attempts left, failed otherwise."""
    joined = tasks.join(errors.select("id", F.col("error").alias("_error"), F.lit(True).alias("_hit")), "id", "left")
    status = F.when(F.col("attempt_count") < F.col("max_attempts"), "retrying").otherwise("failed")
    return joined.select(*_changed(tasks, F.coalesce("_hit", F.lit(False)), {"status": status, "error_message": F.col("_error"), "updated_at": now}))


def failed_documents(documents: DataFrame, tasks: DataFrame, errors: DataFrame) -> DataFrame:
    """documents of which an erring task has no attempt left become failed, with the message of the smallest such task."""
    out = tasks.join(errors.select("id", F.col("error").alias("_error")), "id").where(F.col("attempt_count") >= F.col("max_attempts"))
    by = out.groupBy(F.col("document_id").alias("id")).agg(F.min_by("_error", "id").alias("_error"), F.lit(True).alias("_hit"))
    return documents.join(by, "id", "left").select(*_changed(documents, F.coalesce("_hit", F.lit(False)), {"status": F.lit("failed"), "error_message": F.col("_error")}))


def unstuck(tasks: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Tasks in work since before now - seconds become pending again; attempts stay."""
    stuck = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return tasks.select(*_changed(tasks, F.coalesce(stuck, F.lit(False)), {"status": F.lit("pending"), "worker_id": F.lit(None), "updated_at": now}))


def marked(tasks: DataFrame, ids: DataFrame, status: str, now: Column, message: str | None = None) -> DataFrame:
    """All tasks among ids get the status, whatever their attempts; documents aren't touched."""
    new = {"status": F.lit(status), "updated_at": now} | ({"completed_at": now} if status == "done" else {}) | ({"error_message": F.lit(message)} if message is not None else {})
    return tasks.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").select(*_changed(tasks, F.coalesce("_hit", F.lit(False)), new))


def counts(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, status, n) of tasks and documents, and of each in total with status `total`."""
    both = tasks.select(F.lit("task").alias("kind"), "status").unionByName(documents.select(F.lit("document").alias("kind"), "status"))
    by = both.groupBy("kind", "status").agg(F.count("*").alias("n"))
    return by.unionByName(by.groupBy("kind").agg(F.lit("total").alias("status"), F.sum("n").alias("n")).select("kind", "status", "n"))


def retried(tasks: DataFrame, document_id: Column, now: Column, reset_attempts: bool = False) -> DataFrame:
    """Every task of the document is pending again, without worker, error and dead-letter marks."""
    new = {"status": F.lit("pending"), "worker_id": F.lit(None), "error_message": F.lit(None), "attributes": without_marks(F.col("attributes")), "updated_at": now}
    if reset_attempts:
        new["attempt_count"] = F.lit(0)
    return tasks.select(*_changed(tasks, F.coalesce(F.col("document_id") == document_id, F.lit(False)), new))


def without_marks(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, _: ~k.isin(*DLQ_KEYS))


def listed(documents: DataFrame, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """A page of documents, newest first, ties by id."""
    rows = documents if status is None else documents.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def progress(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, chunk_count, embedding_count, progress): chunks are counted by document before any join with documents."""
    embedded = embeddings.select("chunk_id").distinct().withColumn("_e", F.lit(1))
    by = chunks.select("document_id", F.col("id").alias("chunk_id")).join(embedded, "chunk_id", "left").groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count("_e").alias("embedding_count"))
    joined = documents.select("id").join(by, F.col("id") == F.col("document_id"), "left")
    chunk_count, embedding_count = F.coalesce("chunk_count", F.lit(0)), F.coalesce("embedding_count", F.lit(0))
    return joined.select("id", chunk_count.alias("chunk_count"), embedding_count.alias("embedding_count"), F.when(chunk_count > 0, embedding_count / chunk_count * 100).otherwise(F.lit(0.0)).alias("progress"))


def completion(chunks: DataFrame) -> DataFrame:
    """(document_id, status): done once every chunk is, else embedding."""
    return chunks.groupBy("document_id").agg(F.when(F.bool_and(F.col("status") == "done"), "done").otherwise("embedding").alias("status"))


def outcomes(tasks: DataFrame) -> DataFrame:
    """(task_type, completed, retried, failed) of tasks(task_type, attempt_count, max_attempts, succeeded)."""
    left = F.col("attempt_count") < F.col("max_attempts")
    return tasks.groupBy("task_type").agg(F.count_if("succeeded").alias("completed"), F.count_if(~F.col("succeeded") & left).alias("retried"), F.count_if(~F.col("succeeded") & ~left).alias("failed"))


def dispatched(tasks: DataFrame, handlers: dict) -> DataFrame:
    """Runs each type's handler, a function from its tasks to (id, error); types without a handler fail."""
    out = None
    for kind, handler in handlers.items():
        part = handler(tasks.where(F.col("task_type") == kind)).select("id", "error")
        out = part if out is None else out.unionByName(part)
    rest = tasks.where(~F.col("task_type").isin(*handlers)).select("id", F.concat(F.lit("No handler for "), F.col("task_type")).alias("error"))
    return rest if out is None else out.unionByName(rest)
