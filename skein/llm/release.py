"""Quarantine and cascading release: rows of a conversation are delivered, retried, given up or blocked by their parent.

Many conversations at once lie ragged in flat arrays; all of them advance by one position together: parents' outcomes are
gathered, attempts are evaluated by masks. Long conversations are cut where no later row has an earlier parent, and everything
that runs along a conversation (places, cuts, release numbers, states) is summed in levels of bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import Scratch, ensure_importable

#: Places of a conversation that are one group, as a power of two; so are the groups of the next level.
LEVEL = 12
#: Seconds in which releases are one group, as a power of two.
SECONDS = 15
#: Rows of many conversations that advance together.
PACK = 1 << 16
DELIVERED, DEAD, BLOCKED = 0, 1, 2
STATUS = ("delivered", "dead", "blocked")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right, by equal keys; nulls are equal."""
    named = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [left[k].eqNullSafe(named[f"{k}_"]) for k in keys]
    return left.join(named, on, "left").drop(*(f"{k}_" for k in keys))


def running(groups: DataFrame, at: str, columns: list[str], combine, size: int, level: int = LEVEL) -> DataFrame:
    """Adds before_<column>: what combine (F.sum, F.max) gives of the same key's groups with a smaller `at`, null if there are
    none. (key, at) is unique, `at` at least 0 and below size. No task sees more than 2^level groups of a key at once."""
    near = Window.partitionBy("key", "above").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = groups.withColumn("above", F.shiftright(at, level))
    local = local.select("*", *(combine(c).over(near).alias(f"before_{c}") for c in columns))
    if size <= 1 << level:
        return local.drop("above")
    sums = local.groupBy("key", "above").agg(*(combine(c).alias(c) for c in columns))
    upper = running(sums.withColumnRenamed("above", "at"), "at", columns, combine, (size >> level) + 1, level)
    upper = upper.select("key", F.col("at").alias("above"), *(F.col(f"before_{c}").alias(f"far_{c}") for c in columns))

    def both(c: str) -> Column:
        a, b = F.col(f"far_{c}"), F.col(f"before_{c}")
        together = F.greatest(a, b) if combine is F.max else a + b
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(together).cast(local.schema[f"before_{c}"].dataType)

    found = _joined(local, upper, ["key", "above"])
    return found.withColumns({f"before_{c}": both(c) for c in columns}).drop("above", *(f"far_{c}" for c in columns))


def placed(rows: DataFrame, level: int = LEVEL) -> DataFrame:
    """Adds p: the number of a key's rows before it, by turn, nulls last, then weight."""
    span = rows.agg(F.min("turn"), F.max("turn")).first()
    low, high = (0, 0) if span[0] is None else (span[0] >> level, span[1] >> level)
    bucket = F.coalesce(F.shiftright(F.col("turn").cast("long"), level) - low, F.lit(high - low + 1)).cast("long")
    w = Window.partitionBy("key", "bucket").orderBy(F.asc_nulls_last("turn"), "weight", "plan")
    local = rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(w).cast("long") - 1)
    counts = local.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = running(counts, "bucket", ["n"], F.sum, high - low + 2, level).select("key", "bucket", "before_n")
    return _joined(local, before, ["key", "bucket"]).withColumn("p", F.col("place") + F.coalesce("before_n", F.lit(0))).drop("bucket", "place", "before_n")


def segmented(rows: DataFrame, reach: int, level: int = LEVEL) -> DataFrame:
    """Adds segment: the place of the nearest cut at or before the row, one in each group of places that has any. A cut is a
    place at and after which no row of the key has a parent before it; only the next reach - 1 rows could. `distance` is 0
    without a parent."""
    most = rows.agg(F.max("p")).first()[0] or 0
    if most < 1 << level:
        return rows.withColumn("segment", F.lit(0).cast("long"))
    cut = Window.partitionBy("key", "block").orderBy("p")
    blocks = rows.withColumn("block", F.shiftright("p", level))
    clean = F.col("distance") == 0
    for i in range(1, reach):
        clean = clean & F.coalesce(F.lead("distance", i).over(cut) <= i, F.lit(False))
    marked = blocks.withColumn("clean", clean)
    cuts = marked.groupBy("key", "block").agg(F.min(F.when(F.col("clean"), F.col("p"))).alias("cut"))
    cuts = running(cuts, "block", ["cut"], F.max, (most >> level) + 1, level)
    found = _joined(blocks, cuts, ["key", "block"])
    here = F.when(F.col("p") >= F.col("cut"), F.col("cut")).otherwise(F.coalesce("before_cut", F.lit(0)))
    return found.withColumn("segment", here.cast("long")).drop("block", "cut", "before_cut")


def advance(p: np.ndarray, starts: np.ndarray, lengths: np.ndarray, distance: np.ndarray, plan: np.ndarray, spacing: int, waits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(status, attempts, first, last) of runs of rows in flat arrays, position after position. plan: bit a says that attempt
    a + 1 of a faulty row fails in any case; above those bits, 0 for a row that isn't faulty, else seconds to repair and 1."""
    tries, arrival = len(waits), p * spacing
    status, attempts = np.zeros(len(p), dtype=np.int8), np.zeros(len(p), dtype=np.int32)
    first, last = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    repair = plan >> tries
    sound, repaired = repair == 0, arrival + repair - 1
    certain = (plan[:, None] >> np.arange(tries)) & 1 == 1
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    for step, k in enumerate(active):
        at = starts[:k] + step
        parent = at - distance[at]
        child = parent < at
        blocked = child & (status[parent] != DELIVERED)
        begin = np.where(child & ~blocked, np.maximum(arrival[at], last[parent]), arrival[at])
        times = begin[:, None] + waits
        good = sound[at, None] | (times >= repaired[at, None]) & ~certain[at]
        there = good.any(axis=1)
        tried = np.where(there, good.argmax(axis=1), tries - 1)
        status[at] = np.where(blocked, BLOCKED, np.where(there, DELIVERED, DEAD))
        attempts[at] = np.where(blocked, 0, tried + 1)
        first[at], last[at] = begin, times[np.arange(k), tried]
    return status, attempts, first, last


def _replayed(rows: DataFrame, spacing: int, waits: list[int]) -> DataFrame:
    """(key, turn, p, weight, status, attempts, first, last) of whole segments."""
    spark = rows.sparkSession
    waited = np.array(waits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < PACK:
                continue
            together = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            # A segment begins where its name is the row's own place; the last one may go on.
            whole = int(np.flatnonzero(np.asarray(together.column("p")) == np.asarray(together.column("segment")))[-1])
            held = [together.slice(whole)]
            if whole:
                yield found(together.slice(0, whole))
        if sum(b.num_rows for b in held):
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        p = np.asarray(rows.column("p"))
        starts = np.flatnonzero(p == np.asarray(rows.column("segment")))
        lengths = np.diff([*starts, len(p)])
        got = advance(p, starts, lengths, np.asarray(rows.column("distance")).astype(np.int64), np.asarray(rows.column("plan")), spacing, waited)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("key", "turn", "p", "weight")), *map(pa.array, got)], names=["key", "turn", "p", "weight", "status", "attempts", "first", "last"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.select("key", "turn", "p", "segment", "distance", "plan", "weight").repartition(n, "key", "segment").sortWithinPartitions("key", "segment", "p")
    return ordered.mapInArrow(run, f"key {kinds['key']}, turn {kinds['turn']}, p long, weight long, status byte, attempts int, first long, last long")


def _wrapped(x: Column) -> Column:
    """A whole number as a long, modulo 2^64."""
    half, whole = (F.lit(str(v)).cast("decimal(38,0)") for v in (2**63, 2**64))
    low = F.pmod(x, whole)
    return F.when(low >= half, low - whole).otherwise(low).cast("long")


def _released(rows: DataFrame, level: int = LEVEL, seconds: int = SECONDS) -> DataFrame:
    """Adds release_no and state to delivered rows: their number by time, and the sum of number times weight so far."""
    most = rows.where(F.col("status") == DELIVERED).agg(F.max("last")).first()[0] or 0
    out = F.col("status") == DELIVERED
    # Rows that aren't delivered lie in bounded groups of their own, where nothing is read.
    group = F.when(out, F.shiftright("last", seconds)).otherwise(-1 - F.shiftright("p", level))
    w = Window.partitionBy("key", "group").orderBy("last", F.asc_nulls_last("turn"), "p")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("weight").cast("decimal(38,0)")
    local = rows.withColumn("group", group).withColumn("i", F.row_number().over(w).cast("long"))
    local = local.withColumns({"c": F.sum(whole).over(so_far), "s": F.sum(whole * F.col("i")).over(so_far)})
    sums = local.where(out).groupBy("key", "group").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.max("s").alias("s"))
    size = (most >> seconds) + 1
    sums = running(sums, "group", ["n"], F.sum, size, level).withColumn("off", F.coalesce("before_n", F.lit(0)))
    sums = running(sums.select("key", "group", "off", (F.col("s") + F.col("c") * F.col("off")).cast("decimal(38,0)").alias("t")), "group", ["t"], F.sum, size, level)
    found = _joined(local, sums.select("key", "group", "off", "before_t"), ["key", "group"])
    state = F.coalesce(F.col("before_t"), F.lit(0)) + F.col("c") * F.col("off") + F.col("s")
    return found.select("*", F.when(out, F.col("off") + F.col("i")).alias("release_no"), F.when(out, _wrapped(state)).alias("state"))


def replay(
    rows: DataFrame, key: str, turn: str, distance: Column, plan: Column, weight: Column, reach: int, spacing: int = 7, tries: int = 6, first_wait: int = 10, level: int = LEVEL, seconds: int = SECONDS
) -> DataFrame:
    """(key, turn, status, attempts, first_at, last_at, release_no, state), a row for each row.

    A key's rows are numbered p from 0 by turn, nulls last, repeated turns by weight; row p arrives at spacing * p seconds.
    distance: how many rows earlier the parent is, up to reach; 0, null or before the first row: none. plan: see advance; null:
    sound. An attempt comes at arrival or when the parent is delivered, if later; after the a-th failure the next comes
    first_wait * 2^(a-1) seconds later; a row whose last attempt fails is dead. A dead or blocked parent blocks. Delivered rows
    are released in the order of their last attempt, then turn, then p. weight: a whole number from 0 to 2^32 - 1, null: 0; state
    is kept modulo 2^64. What doesn't apply is null. Null is a key like others; repeated rows are rows of their own; other
    columns are left out; no rows give no rows. Rows that repeat one turn of one key more often than 2^level are numbered in one
    task; nothing else of a key, however long, is.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    near = F.coalesce(distance, F.lit(0)).cast("int")
    cut = rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), near.alias("distance"), F.coalesce(plan, F.lit(0)).cast("long").alias("plan"), F.coalesce(weight, F.lit(0)).cast("long").alias("weight"))
    numbered = placed(cut, level).withColumn("distance", F.when(F.col("distance").between(1, F.least(F.lit(reach).cast("long"), F.col("p"))), F.col("distance")).otherwise(0))
    numbered = scratch.write(numbered, "placed")
    waits = [first_wait * (2**a - 1) for a in range(tries)]
    done = scratch.write(_replayed(segmented(numbered, reach, level), spacing, waits), "replayed")
    scratch.drop("placed")
    tried = F.col("attempts") > 0
    status = F.element_at(F.array(*map(F.lit, STATUS)), F.col("status") + 1)
    out = _released(done, level, seconds).select(
        F.col("key").alias(key), F.col("turn").alias(turn), status.alias("status"), "attempts", F.when(tried, F.col("first")).alias("first_at"), F.when(tried, F.col("last")).alias("last_at"), "release_no", "state"
    )
    out = scratch.write(out, "result")
    scratch.close(keep="result")
    return out


def by_hash(conv_id: str, turn: str, tries: int = 6) -> tuple[Column, Column]:
    """(distance, plan) from h(k), the CRC-32 of `k:conv_id:turn`; a null is written as nothing."""
    name = F.concat(F.lit(":"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit("")))

    def h(k: int) -> Column:
        return F.crc32(F.concat(F.lit(str(k)), name).cast("binary"))

    certain = F.lit(0).cast("long")
    for a in range(tries):
        certain = certain + F.when(h(a + 3) % 3 == 0, F.lit(1 << a)).otherwise(0)
    plan = F.when(h(1) % 101 < 50, certain + (h(2) % 101 + 1) * (1 << tries)).otherwise(0)
    return h(0) % 5, plan
