"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver's path is shared.

    On a cluster without a shared install, ship the package with --py-files.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


#: What a Python worker takes of a batch at once.
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch] | Iterator[pa.Array]) -> Iterator[pa.RecordBatch] | Iterator[pa.Array]:
    """Batches or columns in slices of about SLICE_BYTES: what Python makes of a text takes several times its bytes, and a batch
    has up to thousands of texts."""
    for batch in batches:
        step = max(1, len(batch) * SLICE_BYTES // max(batch.nbytes, 1))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master gets one of its own where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skein-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables that one job writes to a folder of its own below the shared folder and deletes itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = new_root(spark)
        self.tables: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again: the lineage ends here. Shuffle files of the writing job go at its end."""
        with _job_options(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def write_bucketed(self, df: DataFrame, buckets: int, key: str) -> DataFrame:
        """Write df dealt by key, so that joins and groups on key read it without another shuffle."""
        name = f"skein_{uuid.uuid4().hex}"
        self.tables.append(name)
        with _job_options(self.spark):
            df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def close(self, keep: str = "") -> None:
        """Delete all but the table named keep, which goes when the application ends or results_freed() says so."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, path = _file_system(self.spark, self.path)
        if not keep:
            fs.delete(path, True)
            return
        if fs.exists(path):
            for status in fs.listStatus(path):
                if status.getPath().getName() != keep:
                    fs.delete(status.getPath(), True)
            fs.deleteOnExit(path)
            if (left := _results.get()) is not None:
                left.append(self.path)

    def _delete(self, where: str) -> None:
        fs, path = _file_system(self.spark, where)
        fs.delete(path, True)


def new_root(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, for tables that a job keeps for itself."""
    return f"{shared_dir(spark).rstrip('/')}/skein-{uuid.uuid4().hex}"


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = _file_system(spark, where)
    return fs.exists(path)


def removed(spark: SparkSession, where: str) -> None:
    fs, path = _file_system(spark, where)
    fs.delete(path, True)


def read_text(spark: SparkSession, where: str) -> str | None:
    """A small file's text, None if it isn't there."""
    fs, path = _file_system(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename_new(spark: SparkSession, text: str, draft: str, where: str, replace: bool = False) -> bool:
    """Write text to draft and move it to where, in one step; False if a file is there already, unless it may be replaced."""
    jvm = spark.sparkContext._jvm
    fs, path = _file_system(spark, draft)
    stream = fs.create(path, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(where)
    if not replace and fs.getUri().getScheme() == "file":
        # Renaming replaces files here; a hard link doesn't.
        try:
            os.link(path.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(path, False)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path, target, options)
        return True
    except Py4JJavaError as e:
        fs.delete(path, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        if replace:
            return False  # two writers replace it at once; either will do
        raise


def checkpointed(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df written to the shared folder, its partitions and their order kept, and what deletes it there."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint()
    where = kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get()

    def release() -> None:
        fs, path = _file_system(df.sparkSession, where)
        fs.delete(path, True)

    return kept, release


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


#: Folders of results that jobs leave to their callers within a block of results_freed; none outside of one.
_results: ContextVar[list[str] | None] = ContextVar("results", default=None)


@contextmanager
def results_freed(spark: SparkSession):
    """Delete the results that jobs leave within the block, also after an error: for a caller that has written what it needs. What
    other threads leave meanwhile is theirs."""
    left: list[str] = []
    before = _results.set(left)
    try:
        yield
    finally:
        _results.reset(before)
        for path in left:
            removed(spark, path)


#: Set while a job writes its tables: shuffle files go at the end of a job, and a Python worker sees small batches.
_JOB_OPTIONS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
_lock = threading.Lock()
_jobs: dict[SparkSession, tuple[int, dict[str, str | None]]] = {}


@contextmanager
def _job_options(spark: SparkSession):
    """The options above; what the session had before comes back when its last concurrent job ends."""
    with _lock:
        running, before = _jobs.get(spark, (0, {}))
        if not running:
            before = {k: spark.conf.get(k, None) for k in _JOB_OPTIONS}
            for k, v in _JOB_OPTIONS.items():
                spark.conf.set(k, v)
        _jobs[spark] = running + 1, before
    try:
        yield
    finally:
        with _lock:
            running, before = _jobs.pop(spark)
            if running > 1:
                _jobs[spark] = running - 1, before
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)
