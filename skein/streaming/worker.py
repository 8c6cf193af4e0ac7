"""Working the queue as a stream: each micro-batch claims tasks, runs their handlers and publishes the next state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import queue
from skein.operators.tables import Snapshots


def turn(tasks: Snapshots, handlers: dict[str, Callable[[DataFrame], DataFrame]], batch: int, now: str, worker: str = "worker", tag: str | None = None) -> int:
    """One turn at a fixed time: reset stuck tasks, claim, run, record. Returns the new version.

    Handlers give (id, error), error null on success. Publishing is the only side effect, so a turn that fails
    before it can be run again; handlers must bear being run twice. A turn whose tag was published already does nothing.
    """
    if tag is not None and (done_before := tasks.tagged(tag)) is not None:
        return done_before
    at = F.lit(now).cast("timestamp")
    state = queue.unstuck(tasks.read(), at)
    chosen = queue.next_tasks(state, batch)
    working = queue.claimed(state, chosen, F.lit(worker), at)
    results = queue.dispatched(working.join(chosen.select("id"), "id", "left_semi"), handlers)
    done = results.where(F.col("error").isNull()).select("id", F.lit(None).cast("map<string,string>").alias("attributes"))
    after = queue.failed(queue.finished(working, done, at), results.where(F.col("error").isNotNull()), at)
    return tasks.publish(after, tag)


def run(ticks: DataFrame, tasks: Snapshots, handlers: dict, batch: int, checkpoint: str):
    """Start a query that works the queue on every micro-batch of ticks(now)."""

    def work(rows: DataFrame, batch_id: int) -> None:
        last = rows.agg(F.date_format(F.max("now"), "yyyy-MM-dd HH:mm:ss").alias("now")).first()
        if last and last["now"]:
            # A micro-batch that Spark replays has the same number.
            turn(tasks, handlers, batch, last["now"], tag=f"{checkpoint}/{batch_id}")

    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).start()
