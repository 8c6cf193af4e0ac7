"""Dead letters: tasks that failed for good, how they are listed, counted and replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.queue import _changed, without_marks


def flagged(attributes: Column) -> Column:
    return F.coalesce(F.element_at(attributes, "dlq") == "true", F.lit(False))


def due(tasks: DataFrame, most: int = 3) -> DataFrame:
    """Failed tasks without attempts left that aren't flagged yet."""
    return tasks.where((F.col("status") == "failed") & (F.col("attempt_count") >= most) & ~flagged(F.col("attributes")))


def moved(tasks: DataFrame, now: Column, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(tasks with those that are due flagged, rows for the dead-letter table)."""
    hit = (F.col("status") == "failed") & (F.col("attempt_count") >= most) & ~flagged(F.col("attributes"))
    marks = F.create_map(F.lit("dlq"), F.lit("true"), F.lit("dlq_at"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
    kept = F.coalesce(F.map_filter("attributes", lambda k, _: ~k.isin("dlq", "dlq_at")), F.create_map().cast("map<string,string>"))
    new = tasks.select(*_changed(tasks, F.coalesce(hit, F.lit(False)), {"attributes": F.map_concat(kept, marks)}))
    letters = due(tasks, most).select(F.col("id").alias("task_id"), "document_id", "task_type", F.col("error_message").alias("reason"), "attempt_count", now.alias("created_at"))
    return new, letters


def listed(tasks: DataFrame) -> DataFrame:
    """Flagged failures, the last updated first."""
    return tasks.where((F.col("status") == "failed") & flagged(F.col("attributes"))).orderBy(F.desc("updated_at"), "id")


def counts(tasks: DataFrame) -> DataFrame:
    """One row: all failed tasks, and those that are flagged."""
    return tasks.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "failed") & flagged(F.col("attributes"))).alias("flagged"))


def replayed(tasks: DataFrame, hit: Column, now: Column) -> DataFrame:
    """The tasks start anew: pending, no attempts, no marks."""
    new = {"status": F.lit("pending"), "attempt_count": F.lit(0), "attributes": without_marks(F.col("attributes")), "updated_at": now}
    return tasks.select(*_changed(tasks, F.coalesce(hit, F.lit(False)), new))


def replayed_all(tasks: DataFrame, now: Column) -> DataFrame:
    return replayed(tasks, (F.col("status") == "failed") & flagged(F.col("attributes")), now)


def report(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by status, the ten newest dead letters)."""
    return tasks.groupBy("status").agg(F.count("*").alias("n")), listed(tasks).limit(10)


def after_error(tasks: DataFrame, errors: DataFrame, now: Column, enabled: bool = True) -> DataFrame:
    """(id, attempt_count, status, to_dlq, details) of tasks that met errors(id, type, message)."""
    n = F.col("attempt_count") + 1
    details = F.to_json(F.struct(F.col("type"), F.col("message"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), n.alias("attempt")))
    return tasks.join(errors.select("id", "type", "message"), "id").select("id", n.alias("attempt_count"), F.lit("failed").alias("status"), (F.lit(enabled) & (n >= F.col("max_attempts"))).alias("to_dlq"), details.alias("details"))
