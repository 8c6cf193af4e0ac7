"""The stored index against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import ivf, vector

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty vectors around each of the table's first 100."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                r = np.random.default_rng(i)
                rows = np.array(v) + r.normal(size=(20, len(v))) * 0.03
                yield pa.RecordBatch.from_arrays([pa.array(range(i * 20, i * 20 + 20)), pa.array(rows.tolist())], names=["vec_id", "embedding"])

    source = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 100").select("vec_id", "embedding")
    return source.mapInArrow(spread, "vec_id long, embedding array<double>").cache()


def index_of(spark, tmp_path, vectors, **options):
    return ivf.InvertedFile(spark, f"file://{tmp_path}/index").build(vectors, **options)


def rows(df):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]


def test_few_cells_find_what_exact_search_finds(spark, tmp_path, clustered):
    index = index_of(spark, tmp_path, clustered, cells=100)
    queries = clustered.where("vec_id % 20 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.vec_id) for r in vector.top_k_batch(clustered, queries, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in index.search_batch(queries, 10, cells=4).collect()}
    assert len(found & exact) >= 0.95 * len(exact)
    query = clustered.where("vec_id = 7").first().embedding
    files = len(index.live().inputFiles())
    read = index.search(query, 10, cells=4)
    plan = read._jdf.queryExecution().executedPlan().toString()
    chosen = [int(c) for c in re.search(r"PartitionFilters: \[cell#\d+ IN \(([\d,]+)\)", plan)[1].split(",")]
    assert len(chosen) == 4 and index.live(chosen).select(F.input_file_name()).distinct().count() < files / 10
    assert {r.vec_id for r in read.collect()} <= {v for q, v in exact if q == 7}


def test_exact_search_reads_few_cells(spark, tmp_path, clustered):
    index = index_of(spark, tmp_path, clustered, cells=100)
    query = clustered.where("vec_id = 47").first().embedding
    got = index.search(query, 10, 0.5)
    assert rows(got.select("vec_id", "similarity")) == rows(vector.top_k(clustered, query, 10, 0.5, "vec_id").select("vec_id", "similarity"))
    chosen = re.search(r"PartitionFilters: \[cell#\d+ IN \(([\d,]+)\)", got._jdf.queryExecution().executedPlan().toString())[1].split(",")
    assert len(chosen) <= 10
    queries = clustered.where("vec_id % 40 = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert sorted(rows(index.search_batch(queries, 5))) == sorted(rows(vector.top_k_batch(clustered, queries, 5)))


def test_inserts_deletes_and_updates_leave_files_alone(spark, tmp_path, clustered):
    index = index_of(spark, tmp_path, clustered.where("vec_id % 2 = 0"), cells=20)
    before = set(index.live().inputFiles())
    index.insert(clustered.where("vec_id % 2 = 1"))
    index.delete(clustered.where("vec_id % 20 = 5"))
    moved = clustered.where("vec_id % 20 = 6").withColumn("embedding", F.transform("embedding", lambda c: -c))
    index.update(moved)
    assert before < set(index._table("vectors").inputFiles())
    now = clustered.where("vec_id % 20 NOT IN (5, 6)").unionByName(moved).cache()
    assert index.live().count() == now.count() == 1900
    for query in (clustered.where("vec_id = 6").first().embedding, moved.where("vec_id = 26").first().embedding):
        assert rows(index.search(query, 10, 0.0).select("vec_id", "similarity")) == rows(vector.top_k(now, query, 10, 0.0, "vec_id").select("vec_id", "similarity"))
    index.insert(clustered.where("vec_id = 5"))
    assert index.live().where("vec_id = 5").count() == 1


def test_edges(spark, tmp_path):
    nan = float("nan")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1e200, 1e200]), (7, [1.0, 0.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    index = index_of(spark, tmp_path, some, cells=3)
    assert sorted(r.vec_id for r in index.live().collect()) == [1, 6, 7, 7]
    assert [r.vec_id for r in index.search([1.0, 0.0], 2).collect()] == [1, 7]
    assert index.search([0.0, 0.0], 2).collect() == [] and index.search([nan, 0.0], 2).collect() == []
    asked = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 2.0]), ("c", None)], "query_id string, vector array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in index.search_batch(asked, 1).collect()] == [("b", 1, 6)]
    with pytest.raises(Exception, match="wrong vector dimension"):
        index.insert(spark.createDataFrame([(9, [1.0])], "vec_id long, embedding array<double>"))
    index.drop()


def test_an_empty_index(spark, tmp_path):
    index = index_of(spark, tmp_path, spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert index.search([1.0], 3).collect() == []
