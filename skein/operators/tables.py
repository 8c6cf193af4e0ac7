"""Snapshots of mutable tables: a job writes a new folder, then a small pointer table names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schema import TABLES


class Snapshots:
    """Versions of one table below a root folder. One writer at a time; readers see the last published version."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.root = f"{root.rstrip('/')}/{name}"

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("version long, folder string, tag string").json(f"{self.root}/_versions")

    def versions(self) -> list[tuple[int, str]]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        return [(r[0], r[1]) for r in self._pointers().orderBy("version").collect()]

    def read(self) -> DataFrame:
        """The last version; an empty table of the registered schema if there is none."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], TABLES[self.name])
        return self.spark.read.parquet(f"{self.root}/{known[-1][1]}")

    def tagged(self, tag: str) -> int | None:
        """The version that was published under the tag, if any."""
        return self._pointers().where(F.col("tag") == tag).agg(F.max("version")).first()[0] if self.versions() else None

    def publish(self, df: DataFrame, tag: str | None = None) -> int:
        """Write df, which may read the last version, and make it the next version, under a tag if one is given."""
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        version = len(self.versions()) + 1
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(tag).cast("string").alias("tag")).coalesce(1).write.mode("append").json(f"{self.root}/_versions")
        return version

    def clear(self) -> int:
        """Publish an empty version; how many rows the last one had."""
        last = self.read()
        n = last.count()
        self.publish(self.spark.createDataFrame([], last.schema))
        return n


def rendered(rows: DataFrame, form: str = "table", most: int = 100) -> list[str]:
    """Up to most rows as lines of text: `json`, an object per line, or `table`, columns of equal width below their names."""
    if form == "json":
        return [r[0] for r in rows.select(F.to_json(F.struct("*"))).limit(most).collect()]
    if form != "table":
        raise ValueError(f"unknown form: {form}")
    lines = [rows.columns, *(["" if v is None else str(v) for v in r] for r in rows.limit(most).collect())]
    widths = [max(map(len, column)) for column in zip(*lines, strict=True)]
    return ["  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in lines]


def create_all(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(f"{database}.{name}")


def drop_all(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
