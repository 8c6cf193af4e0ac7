"""Embedding whitening in two passes: exact integer sums give the mean, then tasks multiply centred blocks, a tree of
additions merges them, and the projection on the leading eigenvectors goes to every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ensure_importable

#: Fixed values of whole entries: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows multiplied at once.
BLOCK = 4096
#: An eigenvalue below this share of the largest is one of a direction in which the vectors don't differ.
FLAT = 1e-13
_LONG = 2**63 - 1


def _vectors(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix of whole entries) by length, of the vectors that take part."""
    column = batch.column(name)
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(np.maximum(lengths, 0))
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        entries = values[(ends[at] - d)[:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            whole = np.floor(SCALE * entries) + SHIFT
            good = (np.abs(whole) < 2.0**53).all(axis=1)
        if good.any():
            yield at[good], whole[good].astype(np.int64)


class Mean(NamedTuple):
    """Vectors and their sums by dimension, exact."""

    n: int
    sums: list[int]


class Moments(NamedTuple):
    """Vectors, their mean and their centred outer products."""

    n: int
    mean: np.ndarray
    products: np.ndarray


def _added(a: Mean, b: Mean) -> Mean:
    return Mean(a.n + b.n, [x + y for x, y in zip(a.sums, b.sums, strict=True)])


def _merged(a: Moments, b: Moments) -> Moments:
    """Moments of both, centred at the common mean."""
    n, gap = a.n + b.n, b.mean - a.mean
    return Moments(n, a.mean + gap * (b.n / n), a.products + b.products + np.outer(gap, gap) * (a.n * b.n / n))


def _gathered(vectors: DataFrame, name: str, of_block: Callable, merge: Callable) -> dict:
    """What of_block gives of each block of vectors, merged by length within tasks and then along a tree over tasks."""

    def both(a: dict, b: dict) -> dict:
        return {d: reduce(merge, [x[d] for x in (a, b) if d in x]) for d in a.keys() | b.keys()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        found: dict = {}
        for batch in batches:
            for _, whole in _vectors(batch, name):
                for i in range(0, len(whole), BLOCK):
                    found = both(found, {whole.shape[1]: of_block(whole[i : i + BLOCK])})
        yield pa.RecordBatch.from_pydict({"found": pa.array([pickle.dumps(found)], pa.binary())})

    ensure_importable(vectors.sparkSession)
    parts = vectors.select(F.col(name)).mapInArrow(run, "found binary").rdd

    def opened(row) -> dict:
        import pickle

        return pickle.loads(row.found)

    return parts.map(opened).treeAggregate({}, both, both, depth=2)


def _sums(whole: np.ndarray) -> Mean:
    low, high = whole & 0xFFFFFFFF, whole >> 32
    return Mean(len(whole), [int(a) + (int(b) << 32) for a, b in zip(low.sum(axis=0), high.sum(axis=0), strict=True)])


def _centred(whole: np.ndarray, mean: Mean) -> np.ndarray:
    """x - S/n as doubles. The difference from the mean's whole part is exact, so nothing cancels afterwards."""
    floor = np.array([s // mean.n for s in mean.sums])
    rest = np.array([(s % mean.n) / mean.n for s in mean.sums])
    return (whole - floor).astype(np.float64) - rest


def _deviations(whole: np.ndarray, mean: Mean) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None beyond a long."""
    floor = np.array([s // mean.n for s in mean.sums])
    gap = whole - floor
    widest = (int(np.abs(gap).max()) + 1) * mean.n
    if widest * widest * whole.shape[1] <= _LONG:
        off = gap * mean.n - np.array([s % mean.n for s in mean.sums])
        return (off * off).sum(axis=1).tolist()
    over = np.array([s % mean.n for s in mean.sums], dtype=object)
    exact = ((gap.astype(object) * mean.n - over) ** 2).sum(axis=1)
    return [int(x) if x <= _LONG else None for x in exact]


class Whitening(NamedTuple):
    """mean: of the fit list; directions: one column for each component; values: their eigenvalues; total: the trace."""

    mean: Mean
    directions: np.ndarray
    values: np.ndarray
    total: float

    def apply(self, whole: np.ndarray) -> np.ndarray:
        """Whitened values, a column for each component; NaN in a direction in which the fit list doesn't differ."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
            return _centred(whole, self.mean) @ self.directions * scale


def fit(vectors: DataFrame, components: int = 8, vector: str = "embedding") -> dict[int, Whitening]:
    """A whitening for each length of vector. The driver holds sums and one matrix for each length, tasks the same."""
    means = _gathered(vectors, vector, _sums, _added)

    def of_block(whole: np.ndarray) -> Moments:
        off = _centred(whole, means[whole.shape[1]])
        return Moments(len(off), np.zeros(off.shape[1]), off.T @ off)

    # Every block is centred at the mean of all, so merging only adds.
    moments = _gathered(vectors, vector, of_block, _merged)
    out = {}
    for d, m in moments.items():
        covariance = m.products / m.n
        values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        kept = np.where(values[order] > FLAT * max(values.max(), 0), values[order], 0.0)
        out[d] = Whitening(means[d], directions[:, order], kept, float(np.trace(covariance)))
    return out


def identity_errors(vectors: DataFrame, fitted: dict[int, Whitening], vector: str = "embedding") -> dict[int, float | None]:
    """By length of vector: the largest absolute entry of the whitened values' covariance less the identity, over components
    in which the vectors differ; None if there are none."""

    def of_block(whole: np.ndarray) -> Moments:
        w = fitted[whole.shape[1]]
        found = w.apply(whole)[:, w.values > 0]
        mean = found.mean(axis=0)
        return Moments(len(found), mean, (found - mean).T @ (found - mean))

    out = {}
    for d, m in _gathered(vectors, vector, of_block, _merged).items():
        out[d] = float(np.abs(m.products / m.n - np.eye(len(m.mean))).max()) if len(m.mean) else None
    return out


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Entries become whole numbers, floor(1024 * c) + 100000. Vectors that are null or empty, hold null or non-finite entries
    or entries beyond 2^53 as whole numbers take no part. Vectors of each length are whitened among themselves. In a direction
    in which they don't differ (one vector, equal vectors) whitened is null, and so is explained if they differ in none; a
    deviation beyond a long is null. Repeated rows count and come back as often as they occur, with a null id too; other
    columns are left out; no rows give no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    fitted = fit(rows, components, "vector")
    errors = identity_errors(rows, fitted, "vector")
    sent = spark.sparkContext.broadcast((fitted, errors))
    schema = pa.schema([("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, errors = sent.value
        for batch in batches:
            for at, whole in _vectors(batch, "vector"):
                w, error = fitted[whole.shape[1]], errors[whole.shape[1]]
                k = len(w.values)
                found = w.apply(whole).ravel()
                explained = w.values / w.total if w.total > 0 else np.full(k, np.nan)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                columns = [
                    np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                    np.full(len(found), w.mean.n),
                    pa.array([x for x in _deviations(whole, w.mean) for _ in range(k)], pa.int64()),
                    pa.array(found, pa.float64(), from_pandas=True),
                    pa.array(np.tile(explained, len(at)), pa.float64(), from_pandas=True),
                    pa.array([error] * len(found), pa.float64()),
                ]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["vec_id", *schema.names])

    ensure_importable(spark)
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
