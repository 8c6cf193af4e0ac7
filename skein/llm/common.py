"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from skein.session import ensure_importable


SLICE_BYTES = 4 << 20


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch, in slices of about SLICE_BYTES; fn returns a dict of columns. State in fn's closure
    lives for one task."""
    ensure_importable(df.sparkSession)
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # What Python makes of a batch takes several times its bytes.
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for i in range(0, batch.num_rows, step):
                out = fn(batch.slice(i, step))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    """The named columns of df as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def held_out(divisor: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo divisor, equals remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def hash_sample(df: DataFrame, key: str, at_most: int, seed: int) -> DataFrame:
    """About at_most keys with all their rows (all, if fewer), chosen by a hash: the bound holds in expectation. Null is a key."""
    n = df.agg(F.count_distinct(F.coalesce(F.xxhash64(key), F.lit(0)))).first()[0]
    if n <= at_most:
        return df
    share = int(at_most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < share)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wraps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
