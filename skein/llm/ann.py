"""Nearest neighbours from randomly rotated one-bit codes: packed bits and a correction scalar estimate each inner
product within an error bound, and only vectors whose bound reaches the best found so far are scored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.session import Scratch, ensure_importable

#: Queries sent to all tasks at once, and rows whose codes are compared with them at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048


def rotation(dimension: int, seed: int = 2) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


class Codes(NamedTuple):
    """bits: signs of the rotated unit vectors, packed; scale: inner product of each unit vector with its code."""

    bits: np.ndarray
    scale: np.ndarray


def encode(vectors: np.ndarray, turn: np.ndarray) -> Codes:
    rotated = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ turn.T
    return Codes(np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(vectors.shape[1]))


def estimate(codes: Codes, queries: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of each coded vector with rotated unit queries, and the error bound of each vector."""
    d = queries.shape[1]
    signs = np.unpackbits(codes.bits, axis=1, count=d).astype(np.float32) * 2 - 1
    scale = np.maximum(codes.scale, 1e-9)
    found = signs @ queries.T.astype(np.float32) / (scale * np.sqrt(d)).astype(np.float32)[:, None]
    return found, sigmas * np.sqrt(np.maximum(1 - scale**2, 0)) / scale / np.sqrt(max(d - 1, 1))


class Search:
    """The k nearest vectors so far of each query of a block, among the rows that one task has seen."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int, sigmas: float):
        self.ids, self.vectors, self.k, self.sigmas = ids, vectors, k, sigmas
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.rotated = vectors / self.norms[:, None] @ turn.T
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def _exact(self, rows: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for i in range(0, len(at), 1 << 16):
            x, y = rows[at[i : i + (1 << 16)]], self.vectors[query[i : i + (1 << 16)]]
            out[i : i + (1 << 16)] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * self.norms[query[i : i + (1 << 16)]])
        return out

    def _merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched, at = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        s = np.concatenate([self.score[touched].ravel(), score])
        v = np.concatenate([self.found[touched].ravel(), ids])
        # An id counts once, with its best score.
        order = np.lexsort((-s, v, q))
        q, s, v = q[order], s[order], v[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])]) | (s == -np.inf)
        q, s, v = q[once], s[once], v[once]
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        score_, found = np.full((len(touched), self.k), -np.inf), np.full((len(touched), self.k), np.iinfo(np.int64).max)
        score_[q[top], rank[top]], found[q[top], rank[top]] = s[top], v[top]
        self.score[touched], self.found[touched] = score_, found

    def add(self, ids: np.ndarray, rows: np.ndarray, codes: Codes) -> None:
        """Of equal vectors only the k + 1 smallest ids can be among the nearest: the others are left out first, after
        rows that repeat an id with its vector."""
        order = np.lexsort((ids, *rows.T[::-1]))
        ids, rows = ids[order], rows[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        once = new.copy()
        once[1:] |= ids[1:] != ids[:-1]
        order, ids, rows, new = order[once], ids[once], rows[once], new[once]
        codes = Codes(codes.bits[order], codes.scale[order])
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        keep = np.arange(len(ids)) - start <= self.k
        ids, rows, codes = ids[keep], rows[keep], Codes(codes.bits[keep], codes.scale[keep])
        for i in range(0, len(ids), ROW_BLOCK):
            self._add(ids[i : i + ROW_BLOCK], rows[i : i + ROW_BLOCK], Codes(codes.bits[i : i + ROW_BLOCK], codes.scale[i : i + ROW_BLOCK]))

    def _add(self, ids: np.ndarray, rows: np.ndarray, codes: Codes) -> None:
        guess, error = estimate(codes, self.rotated, self.sigmas)
        guess[ids[:, None] == self.ids[None, :]] = -np.inf
        most = min(self.k, len(ids))
        first = np.argpartition(-guess, most - 1, axis=0)[:most]
        at, query = first.ravel(), np.tile(np.arange(len(self.ids)), most)
        real = guess[at, query] > -np.inf
        self._merge(query[real], ids[at[real]], self._exact(rows, at[real], query[real]))
        at, query = np.nonzero(guess + error[:, None].astype(np.float32) >= self.score[:, -1][None, :].astype(np.float32))
        real = guess[at, query] > -np.inf
        at, query = at[real], query[real]
        score = self._exact(rows, at, query)
        good = score >= self.score[query, -1]
        self._merge(query[good], ids[at[good]], score[good])


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 5, sigmas: float = 2.5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 2) -> DataFrame:
    """The k vectors with the largest cosine to each query: query_id, rank (from 1), vec_id, score.

    Every usable vector is indexed and a candidate of every query but those with its own id; is_query marks the
    queries. Scores are exact cosines in double precision, ties go to the smaller id; which vectors are found depends
    on bounds of `sigmas` standard deviations. Null, zero and non-finite vectors and null ids take no part. Vectors of
    each length are searched among themselves, as no cosine is defined between two lengths. An id that occurs repeatedly
    counts once, with its best score, and as a query with its smallest vector of each length. Fewer than k candidates are
    all returned; other columns are ignored; no rows give no rows.

    Queries go to all tasks in blocks of about QUERY_BLOCK, one pass over the index of their length each. The indexes and
    what is found are written to the shared folder.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = good.groupBy(F.size("vector").alias("d")).agg(F.bool_or("asks").alias("asked")).where("asked").orderBy("d").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    scratch, parts = Scratch(spark), []
    try:
        for d in (r["d"] for r in sizes):
            turn = spark.sparkContext.broadcast(rotation(d, seed))
            index = scratch.write(map_batches(good.where(F.size("vector") == d), _coded(turn, d), "vec_id long, asks boolean, vector binary, bits binary, scale double"), f"index{d}")
            asking = index.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
            blocks = max(1, -(-asking.count() // QUERY_BLOCK))
            for block in range(blocks):
                asked = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
                if asked:
                    scratch.write(_pass(index, asked, turn, d, k, sigmas), f"found{d}-{block}")
                    parts.append(f"{scratch.path}/found{d}-{block}")
        if not parts:
            return spark.createDataFrame([], schema)
        # One scan of all that was found, however many passes there were.
        best = spark.read.schema("query_id long, vec_id long, score double").parquet(*parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
        best = best.select("query_id", F.posexplode("best").alias("at", "x"))
        result = scratch.write(best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")), "result")
    finally:
        scratch.close(keep="result")
    return result


def _coded(turn, d: int):
    def run(batch):
        rows = np.array(batch["vector"].flatten()).reshape(-1, d)
        codes = encode(rows, turn.value)
        return {"vec_id": batch["vec_id"], "asks": batch["asks"], "vector": [x.tobytes() for x in rows], "bits": [x.tobytes() for x in codes.bits], "scale": codes.scale}

    return run


def _pass(index: DataFrame, asked: list, turn, d: int, k: int, sigmas: float) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query among the rows of each task."""
    ids = np.array([r["vec_id"] for r in asked], np.int64)
    queries = index.sparkSession.sparkContext.broadcast((ids, np.frombuffer(b"".join(r["vector"] for r in asked)).reshape(-1, d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = state or Search(*queries.value, turn.value, k, sigmas)
                rows = np.frombuffer(b"".join(batch["vector"].to_pylist())).reshape(-1, d)
                bits = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint8).reshape(len(rows), -1)
                state.add(batch["vec_id"].to_numpy(), rows, Codes(bits, batch["scale"].to_numpy()))
        if state is not None:
            query, rank = np.nonzero(state.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(state.ids[query]), pa.array(state.found[query, rank]), pa.array(state.score[query, rank])], ["query_id", "vec_id", "score"])

    return index.select("vec_id", "vector", "bits", "scale").mapInArrow(run, "query_id long, vec_id long, score double")
