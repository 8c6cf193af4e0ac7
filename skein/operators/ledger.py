"""Tables that several writers change together: rows by key in a base and in deltas, and commits that name them.

A writer puts changed rows into new folders, then creates the next commit: one small file that names the folders of all tables. A
commit's number can be taken only once; who loses looks whether the others changed the same keys, and takes the next if not."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import exists, read_text, removed, rename_new

GONE = "_gone"
#: Up to so many rows of deltas are sent to all tasks; more are met by a shuffle, however small their files look.
SENT_ROWS = 100_000


class Conflict(Exception):
    """Another writer changed some of the same keys first."""


class Table(NamedTuple):
    """schema and key columns; buckets: parts by hash of the key, so that a look-up reads only those of its keys."""

    schema: str
    key: tuple[str, ...]
    buckets: int = 0


class Ledger:
    """Tables below a root folder that driver and executors share. Its file system must refuse a rename onto an existing file (HDFS
    does); on a local one, a hard link does as much."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    # Commits

    def _file(self, version: int) -> str:
        return f"{self.root}/_commits/{version:020d}.json"

    def last(self) -> dict:
        """The newest commit: looked for from the one last noted, which may be older."""
        version, noted = 0, read_text(self.spark, f"{self.root}/_commits/last")
        if noted and noted.isdigit():
            version = int(noted)
        while exists(self.spark, self._file(version + 1)):
            version += 1
        return self.at(version)

    def at(self, version: int) -> dict:
        if not version:
            return {"version": 0, "tag": None, "changed": {}, "tables": {n: {"base": None, "deltas": []} for n in self.tables}}
        return json.loads(read_text(self.spark, self._file(version)))

    def _take(self, commit: dict) -> bool:
        """Whether this commit got its number. It is whole or not there."""
        draft = f"{self.root}/_commits/draft-{uuid.uuid4().hex}"
        if not rename_new(self.spark, json.dumps(commit), draft, self._file(commit["version"])):
            return False
        rename_new(self.spark, str(commit["version"]), draft, f"{self.root}/_commits/last", replace=True)
        return True

    # Rows

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name].key), F.lit(self.tables[name].buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        if self.tables[name].buckets:
            n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows.withColumn("_bucket", self._bucket(name)).repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        else:
            rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def _folder(self, name: str, folder: str, buckets: Sequence[int] | None) -> DataFrame:
        t = self.tables[name]
        schema = f"{t.schema}, {GONE} boolean" + (", _bucket int" if t.buckets else "")
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        if t.buckets and buckets is not None:
            rows = rows.where(F.col("_bucket").isin(list(buckets)))
        return rows.drop("_bucket")

    def read(self, name: str, commit: dict | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table's rows as of a commit (the newest, unless given). The base isn't shuffled where the deltas have few rows."""
        known = (commit or self.last())["tables"][name]
        t = self.tables[name]
        empty = self.spark.createDataFrame([], t.schema)
        base = self._folder(name, known["base"], buckets).drop(GONE) if known["base"] else empty
        if not known["deltas"]:
            return base
        changes = None
        for place, folder in enumerate(known["deltas"]):
            part = self._folder(name, folder, buckets).withColumn("_place", F.lit(place))
            changes = part if changes is None else changes.unionByName(part)
        newest = changes.groupBy(*t.key).agg(F.max_by(F.struct(*empty.columns, GONE), "_place").alias("_row")).select("_row.*")
        if not known["base"]:
            return newest.where(~F.col(GONE)).drop(GONE)
        counts = [known.get("rows", {}).get(folder) for folder in known["deltas"]]
        few = None not in counts and sum(counts) <= SENT_ROWS
        kept = base.join(newest.select(*t.key).hint("broadcast" if few else "merge"), list(t.key), "left_anti").select(*empty.columns)
        return kept.unionByName(newest.where(~F.col(GONE)).drop(GONE))

    def looked_up(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a table with buckets that have one of these keys; only the keys' buckets are read."""
        asked = keys.select(*self.tables[name].key).distinct()
        buckets = [r[0] for r in asked.select(self._bucket(name).alias("b")).distinct().collect()]
        return self.read(name, buckets=buckets).join(asked, list(self.tables[name].key), "left_semi")

    # Changes

    def commit(self, changes: dict[str, DataFrame], since: dict | None = None, gone: dict[str, DataFrame] | None = None, tag: str | None = None) -> int:
        """Put rows (new ones, or in place of those of their keys) into tables and take out the keys of gone, all at once.

        since: the commit that the changes were made from; they fail with Conflict if a later one touched any of their keys. A
        tag that the newest commits already have (those since `since`) makes the call do nothing. Keys are unique in a change.
        What comes into an empty table is its base.
        """
        since = since or self.last()
        folders: dict[str, list[str]] = {}
        for name, rows in changes.items():
            columns = self.spark.createDataFrame([], self.tables[name].schema).columns
            folders.setdefault(name, []).append(self._write(name, rows.select(*columns).withColumn(GONE, F.lit(False))))
        for name, keys in (gone or {}).items():
            kinds = self.spark.createDataFrame([], self.tables[name].schema).schema
            rows = keys.select(*(F.col(f.name) if f.name in self.tables[name].key else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds)).withColumn(GONE, F.lit(True))
            folders.setdefault(name, []).append(self._write(name, rows))
        rows = {n: {f: self._folder(n, f, None).count() for f in known} for n, known in folders.items()}

        def added(name: str, t: dict) -> dict:
            if not t["base"] and not t["deltas"] and name not in (gone or {}):
                return dict(t, base=folders[name][0])
            return dict(t, deltas=[*t["deltas"], *folders[name]], rows=t.get("rows", {}) | rows[name])

        on = since
        while True:
            tables = {n: added(n, t) if n in folders else t for n, t in on["tables"].items()}
            if self._take({"version": on["version"] + 1, "tag": tag, "changed": folders, "tables": tables}):
                return on["version"] + 1
            newest = self.last()
            for version in range(on["version"] + 1, newest["version"] + 1):
                other = self.at(version)
                if tag is not None and other["tag"] == tag:
                    self._drop(folders)
                    return version
                for name in folders.keys() & other["changed"].keys():
                    if not self._keys(name, folders[name]).intersect(self._keys(name, other["changed"][name])).isEmpty():
                        self._drop(folders)
                        raise Conflict(f"{name}: commit {version} changed some of the same keys")
            on = newest

    def _keys(self, name: str, folders: list[str]) -> DataFrame:
        out = None
        for folder in folders:
            part = self._folder(name, folder, None).select(*self.tables[name].key)
            out = part if out is None else out.union(part)
        return out

    def _drop(self, folders: dict[str, list[str]]) -> None:
        for folder in (x for known in folders.values() for x in known):
            removed(self.spark, f"{self.root}/{folder}")

    def compact(self, name: str, keep: Column | None = None) -> int:
        """Make base and deltas one new base, of the rows to keep. What others commit meanwhile stays on top of it."""
        before = self.last()
        rows = self.read(name, before)
        folder = self._write(name, (rows if keep is None else rows.where(keep)).withColumn(GONE, F.lit(False)))
        on = before
        while True:
            known = on["tables"][name]
            if known["base"] != before["tables"][name]["base"]:
                self._drop({name: [folder]})
                return on["version"]  # another writer made a new base meanwhile
            later = known["deltas"][len(before["tables"][name]["deltas"]) :]
            counts = {f: n for f, n in known.get("rows", {}).items() if f in later}
            tables = dict(on["tables"], **{name: {"base": folder, "deltas": later, "rows": counts}})
            if self._take({"version": on["version"] + 1, "tag": None, "changed": {}, "tables": tables}):
                return on["version"] + 1
            on = self.last()

    def tried(self, change: Callable[[dict], tuple[dict[str, DataFrame], object]], times: int = 50) -> object:
        """change(commit) gives (changes, result); the result once they are committed. After a conflict it is asked again."""
        for attempt in range(times):
            since = self.last()
            changes, result = change(since)
            try:
                if changes:
                    self.commit(changes, since)
                return result
            except Conflict:
                time.sleep(min(0.01 * 2**attempt, 0.5) * (0.5 + os.urandom(1)[0] / 256))
        raise Conflict(f"no commit after {times} tries")
