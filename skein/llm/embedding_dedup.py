"""Near-duplicate embeddings by sorted projection passes: vectors in the lexicographic order of concatenated random hashes
are compared with their next neighbours, pass by pass; what the passes join is compared in full, blocks against blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.near_dedup import components
from skein.session import Scratch, ensure_importable

#: Hashes concatenated for the order of a pass.
BITS = 62
#: Rows that are compared with each other at once, and how many of the next such rows they see besides.
BLOCK, WINDOW = 1024, 256
#: Rows of a family that meet in one cell from each side.
FAMILY_BLOCK = 4096
#: A pair at the threshold is missed by all passes with this probability at most.
MISS = 1e-5
#: Single precision chooses pairs up to so much below the threshold; double precision decides.
SLACK = 1e-4


def passes(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """How many passes find a pair at the threshold among n vectors: two vectors at an angle t agree in a hash with
    probability 1 - t/pi, and are neighbours once they agree in as many as tell n vectors from a window's."""
    agree = 1 - math.acos(min(threshold, 1.0)) / math.pi
    found = agree ** math.log2(max(2 * n / window, 1))
    return 1 if found >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-found)))


def planes(dimension: int, number: int, seed: int = 12) -> np.ndarray:
    """Random normals of the hyperplanes of one pass, a column each."""
    return np.random.default_rng((seed, number)).normal(size=(dimension, BITS))


def _units(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, unit vectors) by length, of the vectors that take part."""
    column = batch.column(name)
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(np.maximum(lengths, 0))
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        rows = values[(ends[at] - d)[:, None] + np.arange(d)]
        largest = np.abs(rows).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        if good.any():
            rows = rows[good] / largest[good, None]
            yield at[good], rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _prepared(rows: DataFrame) -> DataFrame:
    """(node, vec_id, label, length, unit): a row that takes no part has no unit. Nodes count rows of this table's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, units = np.zeros(batch.num_rows, dtype=np.int32), [None] * batch.num_rows
            for at, unit in _units(batch, "vector"):
                length[at] = unit.shape[1]
                for i, u in zip(at.tolist(), unit, strict=True):
                    units[i] = u
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(length), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "length", "unit"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, length int, unit array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _hashed(batch: pa.RecordBatch, number: int) -> np.ndarray:
    """The concatenated hashes of pass `number`, as a number of BITS bits."""
    lengths = np.asarray(batch.column("length"))
    out = np.zeros(batch.num_rows, dtype=np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        bits = _matrix(batch.column("unit").take(pa.array(at))) @ planes(int(d), number) > 0
        out[at] = bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
    return out


def _order(units: DataFrame, number: int) -> DataFrame:
    """(node, label, length, unit, code) with the hashes of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hashed(batch, number))], names=[*batch.schema.names, "code"])

    label = units.schema["label"].dataType.simpleString()
    return units.mapInArrow(run, f"node long, label {label}, length int, unit array<double>, code long")


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a have a cosine of the threshold or more with which rows of b."""
    near = a.astype(np.float32) @ b.astype(np.float32).T >= threshold - SLACK
    x, y = np.nonzero(near)
    for i in range(0, len(x), 1 << 16):
        p, q = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
        near[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return near


def _least_linked(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the first row of its component."""
    label = np.arange(len(near))
    while True:
        after = np.minimum(np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)), label)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys together; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            v = np.asarray(c)
            new[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
            if i or held and any(held[-1].column(k)[held[-1].num_rows - 1] != c[lo] for k, c in zip(keys, columns, strict=True)):
                yield _one(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def neighbours(scratch: Scratch, units: DataFrame, number: int, threshold: float, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b): links that one pass found, as a forest over each block of the sorted order. Each vector was compared with the
    `window` next ones at least. The order's places follow from the sorted table's partitions and their sizes."""
    spark = units.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["label", "length", "code", "node"]
    ordered = _order(units, number).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.write(ordered, f"pass{number}")
    # As many rows as partitions, whatever the input.
    sizes = ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect()
    starts, total = {}, 0
    for part, size in sorted(sizes):
        starts[part] = total
        total += size
    started = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part long, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(started), "part").withColumn("place", place)
    own = F.floor(F.col("place") / block).cast("long")
    also = F.when((F.col("place") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select("node", "label", "length", "unit", "place", F.explode(also).alias("block")).repartition(n, "block").sortWithinPartitions("block", "place").select("block", "node", "label", "length", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["block"]):
            nodes, lengths = np.asarray(rows.column("node")), np.asarray(rows.column("length"))
            labels = np.asarray(rows.column("label").dictionary_encode().indices)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                unit = _matrix(rows.column("unit").take(pa.array(at)))
                near = _close(unit, unit, threshold) & (labels[at][:, None] == labels[at][None, :])
                linked = np.flatnonzero(near.sum(axis=1) > 1)
                first = linked[_least_linked(near[np.ix_(linked, linked)])]
                other = linked != first
                yield pa.RecordBatch.from_pydict({"a": nodes[at[first[other]]], "b": nodes[at[linked[other]]]})

    return dealt.mapInArrow(run, "a long, b long")


def family_links(members: DataFrame, threshold: float, block: int = FAMILY_BLOCK) -> DataFrame:
    """(node, n_links) of members(family, size, node, unit): all rows of a family against all, blocks against blocks. A
    family's rows are dealt to blocks by hash; each cell of two blocks counts, nothing else leaves it."""
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("lo"), F.greatest(x, F.col("own")).alias("hi")))
    dealt = members.withColumn("own", own).select("family", "node", "own", "unit", F.explode(cells).alias("cell")).select("family", "cell.lo", "cell.hi", "own", "node", "unit")
    dealt = dealt.repartition(n, "family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["family", "lo", "hi"]):
            nodes, own = np.asarray(rows.column("node")), np.asarray(rows.column("own"))
            unit, lo = _matrix(rows.column("unit")), rows.column("lo")[0].as_py()
            same = lo == rows.column("hi")[0].as_py()
            left = np.arange(len(nodes)) if same else np.flatnonzero(own == lo)
            right = left if same else np.flatnonzero(own != lo)
            count = np.zeros(len(nodes), dtype=np.int64)
            for i in range(0, len(left), BLOCK):
                for j in range(0, len(right), BLOCK):
                    p, q = left[i : i + BLOCK], right[j : j + BLOCK]
                    near = _close(unit[p], unit[q], threshold)
                    count[p] += near.sum(axis=1)
                    if not same:
                        count[q] += near.sum(axis=0)
            # In a block with itself each row has met itself.
            yield pa.RecordBatch.from_pydict({"node": nodes, "n": count - same})

    return dealt.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def classes(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", window: int = WINDOW) -> DataFrame:
    """One row for each vector: (vec_id, n_links, component_id, kept).

    Vectors of equal labels and lengths are linked from a cosine of threshold up, in double precision. Vectors that are null,
    empty or zero or hold null or non-finite components, and those with a null label, link with nothing. A repeated row is a
    vector of its own and links with its like; rows that share a vec_id are all kept or none. component_id is the smallest
    vec_id that isn't null, null if there is none; kept compares nulls as equal. Other columns are left out; no rows give no
    rows. Passes are as many as find a pair at the threshold but for MISS; in what they join no link is missed.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    prepared = scratch.write(_prepared(rows).withColumn("node", F.monotonically_increasing_id()), "prepared")
    units = prepared.where(F.col("unit").isNotNull() & F.col("label").isNotNull()).select("node", "label", "length", "unit")
    most = units.groupBy("label", "length").count().agg(F.max("count")).first()[0]
    result = prepared.select("node", "vec_id")
    links = None
    for number in range(passes(most, threshold, window) if most else 0):
        found = scratch.write(neighbours(scratch, units, number, threshold, window), f"found{number}")
        scratch.drop(f"pass{number}")
        links = found if links is None else links.union(found)
    if links is None or links.isEmpty():
        out = result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        out = scratch.write(out, "result")
        scratch.close(keep="result")
        return out
    labels = scratch.write(components(scratch, links, "component"), "families").select("node", F.col("label").alias("family"))
    sizes = labels.groupBy("family").agg(F.count("*").alias("size"))
    members = labels.join(sizes, "family").join(units.select("node", "unit"), "node").select("family", "size", "node", "unit")
    counted = family_links(members, threshold)
    named = labels.join(result, "node").groupBy("family").agg(F.min("vec_id").alias("component_id"))
    known = labels.join(counted, "node").join(named, "family").select("node", "n_links", "component_id", F.lit(True).alias("linked"))
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = result.join(known, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )
    out = scratch.write(out, "result")
    scratch.close(keep="result")
    return out
