"""Streaming twins of the windowed and stateful limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.limits import Breaker, Bucket, breaker_step, bucket_step
from skein.schema import BreakerConfig, LimiterConfig
from skein.session import ensure_importable


def over_limit(requests: DataFrame, limit: int, seconds: int = 60, key: str = "client", ts: str = "ts", late: str = "5 minutes") -> DataFrame:
    """(client, start, n, rejected) of each fixed window once the watermark has passed it."""
    by = requests.withWatermark(ts, late).groupBy(F.col(key).alias("client"), F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return by.select("client", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def sliding_rate(events: DataFrame, failed: Column, minutes: int = 5, step: int = 1, ts: str = "ts", late: str = "5 minutes") -> DataFrame:
    by = events.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes", f"{step} minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
    return by.select(F.col("w.start").alias("start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_ratio"))


def _stateful(rows: DataFrame, key: str, columns: list[str], out: str, state_schema: str, load, step, idle_ms: int, over) -> DataFrame:
    """(key, id, the columns out): key and id keep their types. A state that was idle is forgotten once over(state) says that a
    new one would act alike. As states time out, a query with an availableNow trigger ends only if
    spark.sql.streaming.noDataMicroBatches.enabled is false."""
    ensure_importable(rows.sparkSession)
    out = f"key {rows.schema[key].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, {out}"

    def run(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if over(load(state.get)):
                state.remove()
            else:
                state.setTimeoutDuration(idle_ms)
            return
        current = load(state.get) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["at", "id"])
        found = []
        for row in pdf.itertuples(index=False):
            current, *got = step(current, row)
            found.append((key_[0], row.id, *got))
        state.update(tuple(current))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=[c.split()[0] for c in out.split(", ")])

    cut = rows.select(F.col(key).alias("key"), F.col("id"), (F.unix_micros("ts") / 1e6).alias("at"), *columns)
    return cut.groupBy("key").applyInPandasWithState(run, out, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def token_bucket(requests: DataFrame, config: LimiterConfig, rate: float | None = None, key: str = "client", tokens: str = "tokens", idle_ms: int = 3_600_000) -> DataFrame:
    """(key, id, taken, wait_seconds) of requests(client, id, ts, tokens), in order within each micro-batch."""
    speed = config.refill_per_second if rate is None else rate

    def step(state, row):
        state, taken, wait = bucket_step(state, row.at, float(getattr(row, tokens)), speed, config.burst)
        return state, taken, wait

    # A full bucket is as good as a new one.
    full = lambda s: s.tokens + idle_ms / 1000 * speed >= config.burst
    return _stateful(requests, key, [tokens], "taken boolean, wait_seconds double", "tokens double, at double", lambda s: Bucket(*s), step, idle_ms, full)


def circuit_breaker(calls: DataFrame, config: BreakerConfig | None = None, key: str = "name", idle_ms: int = 3_600_000) -> DataFrame:
    """(key, id, admitted, state) of calls(name, id, ts, succeeded)."""
    c = config or BreakerConfig()

    def step(state, row):
        state, admitted = breaker_step(state, row.at, bool(row.succeeded), c)
        return state, admitted, state.state

    # A breaker that is open, or counts failures, must be remembered however long nothing happens.
    calm = lambda s: s.state == "closed" and not s.failures
    return _stateful(calls, key, ["succeeded"], "admitted boolean, state string", "state string, failures int, successes int, opened double, trials int", lambda s: Breaker(*s), step, idle_ms, calm)
