"""A stored index for cosine search: an inverted file of cells around trained centroids.

Vectors lie in files by cell, so a search reads only the cells near its query. Inserts add files to cells, deletions add ids to a
table; neither touches what is there. A search without a number of cells is exact: an angle bounds what a cell can hold."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine
from skein.operators.vector import clamped
from skein.session import Scratch, ensure_importable, exists, removed

#: Rows of a cell in one file, and cells at most: all tasks get the centroids.
FILE_ROWS, MOST_CELLS = 1 << 20, 4096
#: Queries that go to all tasks at once.
QUERY_BLOCK = 1000
#: Angles count as larger by so much, since they are rounded.
ROUNDING = 1e-6


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _usable(vector: Column) -> Column:
    """Vectors of finite components that aren't all zero."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(math.inf), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


class InvertedFile:
    """An index below a folder: centroids, vectors/cell=n/, cells (rows and widest angle by insert), gone (deleted ids).

    Each insert and each deletion has a number; a vector is there unless a later deletion names its id. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.root, self.id_col, self.vector_col = spark, root.rstrip("/"), id_col, vector_col

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = 100_000, seed: int = 4) -> InvertedFile:
        """Train centroids on about `sample` rows at most, chosen by a hash of the id, and insert all vectors. The number of cells
        is the root of that of rows unless given; vectors that are null or zero, or hold null or non-finite components, aren't
        indexed."""
        good = vectors.where(_usable(F.col(self.vector_col)))
        n = good.count()
        k = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS)
        part = good if n <= sample else good.where(F.pmod(F.xxhash64(F.lit(seed), self.id_col), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
        widest = F.array_max(F.transform(self.vector_col, lambda c: F.abs(c.cast("double"))))
        features = part.select(array_to_vector(F.transform(self.vector_col, lambda c: c.cast("double") / widest)).alias("features"))
        centres = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=12).fit(features).clusterCenters() if n else []
        rows = [(i, (c / np.linalg.norm(c)).tolist()) for i, c in enumerate(centres) if np.linalg.norm(c) > 0]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.root}/centroids")
        self.insert(good)
        return self

    def _centroids(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self._table("centroids").orderBy("cell").collect()
        return np.array([r.cell for r in rows]), np.array([r.centroid for r in rows])

    def _next(self) -> int:
        """The number of the next insert or deletion."""
        known = [self._table(t).agg(F.max("number")).first()[0] for t in ("cells", "gone") if exists(self.spark, f"{self.root}/{t}")]
        return max([0, *(k for k in known if k is not None)]) + 1

    def insert(self, vectors: DataFrame) -> None:
        """Add vectors to the files of their cells. Whether an id is there already isn't asked."""
        ensure_importable(self.spark)
        names, centroids = self._centroids()
        name, number = self.vector_col, self._next()
        if not len(names):
            return
        right = F.when(F.size(name) == centroids.shape[1], F.col(name)).otherwise(F.raise_error(F.lit("wrong vector dimension")).cast(vectors.schema[name].dataType))
        good = vectors.where(_usable(F.col(name))).withColumn(name, right)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(name)
                unit = _unit(np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)) if len(rows) else np.zeros((0, centroids.shape[1]))
                near = unit @ centroids.T
                best = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.int32()), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        scratch = Scratch(self.spark)
        assigned = scratch.write(good.mapInArrow(run, f"{schema}, cell int, angle double"), "assigned")
        cells = assigned.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).withColumn("number", F.lit(number))
        files = cells.select(F.col("cell").alias("cell_"), F.ceil(F.col("rows") / FILE_ROWS).alias("files"))
        # At most MOST_CELLS rows.
        dealt = assigned.join(F.broadcast(files), F.col("cell") == F.col("cell_")).withColumn("file", F.pmod(F.xxhash64(self.id_col), F.col("files")))
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt.repartition(n, "cell", "file").drop("cell_", "files", "file", "angle").withColumn("number", F.lit(number)).write.partitionBy("cell").mode("append").parquet(f"{self.root}/vectors")
        cells.coalesce(1).write.mode("append").parquet(f"{self.root}/cells")
        scratch.close()

    def delete(self, ids: DataFrame) -> None:
        """Vectors of these ids that are there now aren't any more."""
        ids.select(self.id_col).distinct().withColumn("number", F.lit(self._next())).write.mode("append").parquet(f"{self.root}/gone")

    def update(self, vectors: DataFrame) -> None:
        self.delete(vectors)
        self.insert(vectors)

    def drop(self) -> None:
        removed(self.spark, self.root)

    def live(self, cells: Sequence[int] | None = None) -> DataFrame:
        """Vectors that are there, of the cells named: other cells' files aren't read."""
        found = self._table("vectors")
        if cells is not None:
            found = found.where(F.col("cell").isin([int(c) for c in cells]))
        if not exists(self.spark, f"{self.root}/gone"):
            return found
        gone = self._table("gone").groupBy(F.col(self.id_col).alias("id_")).agg(F.max("number").alias("gone_"))
        return found.join(gone, (F.col(self.id_col) == F.col("id_")) & (F.col("number") < F.col("gone_")), "left_anti")

    def search(self, query: Sequence[float], k: int = 10, threshold: float = 0.0, cells: int | None = None) -> DataFrame:
        """As vector.top_k. With `cells`, only so many cells are read, those of the nearest centroids; else as many as may hold
        a nearer vector than those found in the first ones."""
        whole = np.asarray(query, float)
        if not exists(self.spark, f"{self.root}/vectors") or not np.isfinite(whole).all() or not whole.any():
            return self.spark.createDataFrame([], f"{self.id_col} long, similarity double")
        names, bound, order = self._ranked_all(_unit(whole[None]))
        names, bound = names[order[0]], bound[0][order[0]]
        first = max(1, round(math.sqrt(len(names)))) if cells is None else cells
        chosen = names[:first]
        if cells is None:
            best = self._nearest(self.live(chosen), whole, k, threshold).select("similarity").collect()
            least = best[-1][0] if len(best) == k else threshold
            chosen = names[(np.arange(len(names)) < first) | (bound >= least - ROUNDING)]
        found = self._nearest(self.live(chosen), whole, k, threshold)
        return found.withColumn("similarity", clamped(F.col("similarity")))

    def _nearest(self, vectors: DataFrame, query: np.ndarray, k: int, threshold: float) -> DataFrame:
        scored = vectors.withColumn("similarity", cosine(F.col(self.vector_col), F.lit(query.tolist()).cast("array<double>")))
        return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), self.id_col).limit(k).drop("cell", "number")

    def search_batch(self, queries: DataFrame, k: int, cells: int | None = None, query_col: str = "query_id") -> DataFrame:
        """(query_id, rank, id, similarity) of queries(query_id, vector), as vector.top_k_batch, in blocks of about QUERY_BLOCK.

        Each block goes to all tasks, with the cells that each query reads; a task keeps k rows for each query."""
        spark = self.spark
        kind = queries.schema[query_col].dataType.simpleString()
        id_kind = self.live().schema[self.id_col].dataType.simpleString()
        scratch = Scratch(spark)
        usable = queries.where(_usable(F.col("vector"))).select(query_col, F.transform("vector", lambda c: c.cast("double")).alias("vector"))
        usable = scratch.write(usable.withColumn("place", F.monotonically_increasing_id()), "queries")
        blocks = max(1, -(-usable.count() // QUERY_BLOCK))
        for block in range(blocks):
            part = usable.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block)
            asked = part.collect()
            names, bound, order = self._ranked_all(_unit(np.array([r.vector for r in asked]))) if asked else (np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0), dtype=int))
            first = max(1, round(math.sqrt(len(names)))) if cells is None else cells
            near = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(near, order[:, :first], True, axis=1)
            units = [_unit(np.array([r.vector]))[0] for r in asked]
            found = self._scored(units, names, near, k, id_kind)
            if cells is None:
                # What the first cells gave bounds what the others may give.
                found = scratch.write(found, f"near{block}")
                ends = found.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).where(F.col("n") >= k).collect()
                least = np.full(len(asked), -2.0)
                for r in ends:
                    least[r.query] = r.least
                found = self._best(found.unionByName(self._scored(units, names, (bound >= least[:, None] - ROUNDING) & ~near, k, id_kind)), k)
            asked_of = spark.createDataFrame([(i, r[query_col]) for i, r in enumerate(asked)], f"query int, {query_col} {kind}")
            named = found.join(F.broadcast(asked_of), "query").select(query_col, F.col("rank").cast("int").alias("rank"), self.id_col, "similarity")
            named.write.mode("append").parquet(f"{scratch.path}/result")
        scratch.close(keep="result")
        return spark.read.parquet(f"{scratch.path}/result")

    def _ranked_all(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells that have vectors, the largest cosine that one of each can have with each query, and cells nearest first."""
        names, centroids = self._centroids()
        widest = {r.cell: r.angle for r in self._table("cells").groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
        full = np.array([n in widest for n in names])
        names, near = names[full], np.clip(units @ centroids[full].T, -1, 1)
        bound = np.cos(np.maximum(np.arccos(near) - np.array([widest[n] for n in names]) - ROUNDING, 0))
        return names, bound, np.argsort(-near, axis=1, kind="stable")

    def _scored(self, units: list[np.ndarray], names: np.ndarray, wanted: np.ndarray, k: int, id_kind: str) -> DataFrame:
        """(query, rank, id, similarity) of the k nearest vectors for each query, from the cells that it wants."""
        sent = self.spark.sparkContext.broadcast((np.array(units), {int(n): np.flatnonzero(wanted[:, i]) for i, n in enumerate(names)}))
        id_col, vector_col = self.id_col, self.vector_col

        def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((ids, -score, query))
            query, ids, score = query[order], ids[order], score[order]
            kept = np.arange(len(query)) - np.searchsorted(query, query) < k
            return query[kept], ids[kept], score[kept]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, of_cell = sent.value
            held: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                cell, ids = np.asarray(batch.column("cell")), np.asarray(batch.column(id_col))
                for c in np.unique(cell):
                    at, queries = np.flatnonzero(cell == c), of_cell[int(c)]
                    if not len(queries):
                        continue
                    rows = batch.column(vector_col).take(pa.array(at))
                    score = asked[queries] @ _unit(np.asarray(rows.flatten(), dtype=np.float64).reshape(len(at), -1)).T
                    few = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(at) > k else np.broadcast_to(np.arange(len(at)), score.shape)
                    # Ties with the last of them may be smaller ids.
                    last = np.take_along_axis(score, few, axis=1).min(axis=1)
                    q, i = np.nonzero(score >= last[:, None])
                    held.append((queries[q], ids[at[i]], score[q, i]))
                if sum(len(h[0]) for h in held) > 8 * k * len(asked):
                    held = [best(*map(np.concatenate, zip(*held, strict=True)))]
            if held:
                query, found, score = best(*map(np.concatenate, zip(*held, strict=True)))
                yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int32()), id_col: pa.array(found), "similarity": pa.array(score)})

        cells = names[wanted.any(axis=0)] if len(names) else []
        vectors = self.live(cells).select(id_col, vector_col, "cell")
        return self._best(vectors.mapInArrow(run, f"query int, {id_col} {id_kind}, similarity double"), k)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), self.id_col)
        return found.select("query", self.id_col, "similarity").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
