"""Cosine search and the mutations of a vector table. Mutations return the new table; snapshots publish it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.vectors import cosine, norm
from skein.operators.ingest import merged_attributes
from skein.session import Scratch, ensure_importable, exists


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.7, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest cosine to query, of those at threshold or more, best first, ties by id; similarity is
    clamped to [0, 1] after the choice."""
    literal = F.lit(np.asarray(query, float).tolist()).cast("array<double>")
    scored = vectors.withColumn("similarity", cosine(F.col(vector_col), literal))
    best = scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), id_col).limit(k)
    return best.withColumn("similarity", clamped(F.col("similarity")))


#: Fixed value: most characters of a query.
LONGEST_QUERY = 10_000


def search_text(vectors: DataFrame, text: str, model: str, provider, k: int = 10, threshold: float = 0.7, id_col: str = "chunk_id", vector_col: str = "embedding", keep: Sequence[str] = ("text", "attributes")) -> DataFrame:
    """(id, the columns keep, score): the rows of vectors nearest to a text, which provider (an embed.Provider) embeds with model.

    The vector comes from the driver, as one text is one call; the search is top_k().
    """
    if not text.strip() or len(text) > LONGEST_QUERY:
        raise ValueError(f"a query is a text of 1 to {LONGEST_QUERY} characters")
    found = top_k(vectors, provider.embed([text], model)[0], k, threshold, id_col, vector_col)
    return found.select(id_col, *keep, F.col("similarity").alias("score"))


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


#: Queries that a batch search sends to every task; more go in further passes.
QUERY_LIMIT = 8192
#: Most rows of one task, rows and queries that are multiplied at once, what the products may be off by.
TASK_ROWS, ROW_BLOCK, QUERY_BLOCK, OFF = 200_000, 1024, 2048, 1e-8


class Nearest:
    """The k rows of largest cosine to each of some queries of one length, ties to the row that came first."""

    def __init__(self, queries: np.ndarray, k: int, digits: int | None):
        self.queries, self.k, self.digits = queries, k, digits
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.units = queries / self.norms[:, None]
        self.score = np.full((len(queries), k), -np.inf)
        self.place = np.full((len(queries), k), -1)

    def add(self, places: np.ndarray, rows: np.ndarray) -> None:
        """Of equal rows only the first k can be among the nearest: the others are left out before anything is compared."""
        _, same = np.unique(np.ascontiguousarray(rows + 0.0).view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)
        order = np.argsort(same, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        kept = np.sort(order[nth < self.k])
        places, rows = places[kept], rows[kept]
        norms = np.sqrt((rows * rows).sum(axis=1))
        for i in range(0, len(rows), ROW_BLOCK):
            part = slice(i, i + ROW_BLOCK)
            for j in range(0, len(self.queries), QUERY_BLOCK):
                self._add(j, places[part], rows[part], norms[part])

    def _add(self, start: int, places: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> None:
        near = self.units[start : start + QUERY_BLOCK] @ (rows / norms[:, None]).T
        least = self.score[start : start + QUERY_BLOCK, -1]
        if len(rows) > self.k and (new := np.flatnonzero(least == -np.inf)).size:
            least = least.copy()
            least[new] = np.partition(near[new], -self.k, axis=1)[:, -self.k]
        query, at = np.nonzero(near >= least[:, None] - OFF)
        for i in range(0, len(query), 1 << 16):
            q, x = query[i : i + (1 << 16)] + start, at[i : i + (1 << 16)]
            # Worked out pair by pair, so that it doesn't depend on what else is compared.
            score = (self.queries[q] * rows[x]).sum(axis=1) / (self.norms[q] * norms[x])
            self._merge(q, places[x], score if self.digits is None else np.round(score, self.digits))

    def _merge(self, query: np.ndarray, places: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.score[query, -1]
        query, places, score = query[good], places[good], score[good]
        touched, at = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        s, p = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.place[touched].ravel(), places])
        order = np.lexsort((p, -s, q))
        q, s, p = q[order], s[order], p[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.score[touched], self.place[touched] = s[top].reshape(-1, self.k), p[top].reshape(-1, self.k)


def _nearest(vectors: DataFrame, asked: pa.Table, kind: T.StructField, k: int, digits: int | None) -> DataFrame:
    """(query, id, similarity): the k nearest of each query among the rows of each task of vectors(id, vector), which come by id."""
    spark = vectors.sparkSession
    lengths = np.asarray(pc.list_value_length(asked["vector"]))
    groups = [(np.flatnonzero(lengths == d), int(d)) for d in np.unique(lengths)]
    groups = [(at, d, np.asarray(pc.list_flatten(asked["vector"].take(pa.array(at)))).reshape(-1, d)) for at, d in groups]
    sent = spark.sparkContext.broadcast((groups, asked["query"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, names = sent.value
        found = {d: Nearest(queries, k, digits) for _, d, queries in groups}
        ids, n = [], 0
        for batch in batches:
            rows = batch.column("vector")
            d_of = np.asarray(rows.value_lengths())
            for d in np.unique(d_of):
                if d in found:
                    at = np.flatnonzero(d_of == d)
                    found[d].add(n + at, np.asarray(rows.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, d))
            ids.append(batch.column("id"))
            n += batch.num_rows
        for of, d, _ in groups if n else ():
            query, rank = np.nonzero(found[d].score > -np.inf)
            got = pa.chunked_array(ids).take(pa.array(found[d].place[query, rank])).combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[query])), got, pa.array(found[d].score[query, rank])], names=["query", "id", "similarity"])

    return vectors.mapInArrow(run, T.StructType([kind, vectors.schema["id"], T.StructField("similarity", T.DoubleType())]))


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", digits: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest of each of queries(query_id, vector), ties by id; digits: similarities
    are rounded before they are ranked. Null and zero vectors, and those with null components, take no part.

    Queries are sent to all tasks in blocks of at most about QUERY_LIMIT, one pass over the vectors each. Each task multiplies
    blocks of rows with blocks of queries and keeps k per query before anything is shuffled, whatever the number of vectors.
    Vectors whose length isn't finite are compared one by one, as they compare with all as NaN. The result is written to the
    shared folder.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    every = vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector")).withColumn("norm", norm(F.col("vector"))).where(F.col("norm").isNotNull())
    scratch = Scratch(spark)
    try:
        asked = scratch.write(queries.select(F.col(query_col).alias("query"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).withColumn("norm", norm(F.col("vector"))).where(F.col("norm").isNotNull()), "asked")
        # NaN is greater than infinity.
        fine, odd = (F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("norm") >= float("inf")
        n, n_odd = every.agg(F.count("*"), F.count_if(odd)).first()
        m, m_odd = asked.agg(F.count_if(fine), F.count_if(odd)).first()
        rows = every.where(fine).select("id", "vector").repartition(max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), "id").sortWithinPartitions("id")
        blocks = -(-m // QUERY_LIMIT)
        for block in range(blocks):
            part = asked.where(fine & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)).select("query", "vector").toArrow()
            if part.num_rows:
                scratch.write(_nearest(rows, part, asked.schema["query"], k, digits), f"found/block={block}")
        for name, one, other in (("vectors", every.where(odd), asked), ("queries", every.where(~odd), asked.where(odd))):
            if (n_odd and name == "vectors") or (m_odd and name == "queries"):
                pairs = one.select("id", "vector").join(F.broadcast(other.select("query", F.col("vector").alias("_q"))), F.lit(True), "inner")
                s = cosine(F.col("vector"), F.col("_q"))
                pairs = pairs.select("query", "id", (s if digits is None else F.round(s, digits)).alias("similarity")).where(F.col("similarity").isNotNull())
                scratch.write(_best(pairs, k).drop("rank"), f"found/block={name}")
        schema = T.StructType([asked.schema["query"], every.schema["id"], T.StructField("similarity", T.DoubleType())])
        found = spark.read.schema(schema).parquet(f"{scratch.path}/found") if exists(spark, f"{scratch.path}/found") else spark.createDataFrame([], schema)
        return scratch.write(_best(found, k).select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), "similarity"), "result")
    finally:
        scratch.close(keep="result")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    # A limit on row_number becomes a group limit that runs before the shuffle as well.
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inserted(table: DataFrame, rows: DataFrame, key: str, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """table with rows added, all or none: a key that is there twice or a wrong dimension fails the job that writes it."""
    checked = rows.withColumn(vector_col, F.when(F.size(vector_col) == dimension, F.col(vector_col)).otherwise(F.raise_error(F.lit("wrong vector dimension")).cast(rows.schema[vector_col].dataType)))
    both = table.unionByName(checked)
    twice = both.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return both.join(twice.select(key, F.lit(True).alias("_twice")), key, "left").withColumn(key, F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("key there twice: "), F.col(key).cast("string"))).cast(table.schema[key].dataType)).otherwise(F.col(key))).select(*table.columns)


def updated(table: DataFrame, changes: DataFrame, key: str, vector_col: str = "embedding", attributes_col: str = "attributes") -> DataFrame:
    """Vectors replaced and attributes merged by changes(key, vector, attributes), where these aren't null or empty."""
    new = changes.select(key, F.col(vector_col).alias("_v"), F.col(attributes_col).alias("_a"))
    merged = F.when(F.size("_a") > 0, merged_attributes(F.col(attributes_col), F.col("_a"))).otherwise(F.col(attributes_col))
    return table.join(new, key, "left").withColumn(vector_col, F.coalesce("_v", vector_col)).withColumn(attributes_col, merged).select(*table.columns)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)
