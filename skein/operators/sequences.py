"""Automata over the rows of each key in order of time, however many rows a key has.

Rows are sorted into ranges by key and time. Only the first key of a range can have begun in an earlier one, so its rows are
summed up as an effect: a function from the automaton's state before the range to the state after it. The effects, one for each
range, are followed from range to range; then all ranges run at once, each from its own first state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skein.session import Scratch, checkpointed, ensure_importable


class Automaton(NamedTuple):
    """initial: the state before a key's first row. step(state, row): (state, *outputs), row being (time in microseconds,
    *extra columns). effect(): an object that is fed with rows by feed(row) and then tells by end(state) where a state leads."""

    initial: Any
    step: Callable
    effect: Callable


def _keyed(batch: pa.RecordBatch, extra: list[str]) -> Iterator[tuple[Any, list[tuple]]]:
    """(key, rows) of each run of equal keys."""
    keys = batch.column("key")
    same = pc.equal(keys[1:], keys[:-1]).fill_null(False)
    both_null = pc.and_(keys[1:].is_null(), keys[:-1].is_null())
    starts = [0, *(np.flatnonzero(~np.asarray(pc.or_(same, both_null), dtype=bool)) + 1).tolist(), batch.num_rows]
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("us", *extra)), strict=True))
    for lo, hi in zip(starts, starts[1:], strict=False):
        yield keys[lo].as_py(), rows[lo:hi]


def in_order(rows: DataFrame, key: str, ts: str, order: str, extra: list[str], columns: str, automaton: Automaton) -> DataFrame:
    """(key, id, us, the columns out): the automaton's outputs for each row, by key in order of time, then `order`.

    A row without a time comes before all others. Null is a key like others. Rows of one key, time and order are one range, in
    which ties keep no order. The ranges' number is that of shuffle partitions, and so is what the driver gets: a state each.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.select(F.col(key).alias("key"), F.col(order).alias("id"), F.coalesce(F.unix_micros(ts), F.lit(-(2**62))).alias("us"), *extra)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    ordered, release = checkpointed(cut.repartitionByRange(n, "key", "us", "id").sortWithinPartitions("key", "us", "id").withColumn("part", F.spark_partition_id()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, effect, state, keys = None, None, None, None, None, 0
        for batch in filter(len, batches):
            part = batch.column("part")[0].as_py()
            for name, found in _keyed(batch, extra):
                if not keys or name != last:
                    keys, last, state = keys + 1, name, automaton.initial
                    if keys == 1:
                        first, effect = name, automaton.effect()
                for row in found:
                    if keys == 1:
                        effect.feed(row)
                    else:
                        state = automaton.step(state, row)[0]
        if part is not None:
            values = [[part], [pickle.dumps((first, effect, keys == 1, last, state))]]
            yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32()), pa.array(values[1], pa.binary())], names=["part", "summary"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, automaton.initial
        for batch in batches:
            starts = []
            for summary in batch.column("summary").to_pylist():
                first, effect, alone, last, ended = pickle.loads(summary)
                begin = state if before == (first,) else automaton.initial
                starts.append(pickle.dumps(begin))
                before, state = (last,), effect.end(begin) if alone else ended
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(starts, pa.binary())], names=["part", "state"])

    summaries = ordered.drop("id").mapInArrow(summed, "part int, summary binary")
    states = summaries.repartition(1).sortWithinPartitions("part").mapInArrow(followed, "part int, state binary").collect()
    begins = {r.part: bytes(r.state) for r in states}
    out_schema = f"key {kinds['key']}, id {kinds['id']}, us long, {columns}"
    arrow = to_arrow_schema(spark.createDataFrame([], out_schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in filter(len, batches):
            out = []
            for name, found in _keyed(batch, extra):
                if current is None:
                    state = pickle.loads(begins[batch.column("part")[0].as_py()])
                elif current != (name,):
                    state = automaton.initial
                current = (name,)
                for row in found:
                    state, *got = automaton.step(state, row)
                    out.append(got)
            made = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("us"), *made], schema=arrow)

    scratch = Scratch(spark)
    result = scratch.write(ordered.mapInArrow(run, out_schema), "result")
    release()
    scratch.close(keep="result")
    return result
