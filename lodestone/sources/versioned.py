"""A table kept as Parquet files under one folder, in versions that readers see whole or not at all.

Rows are dealt into buckets by a hash of their key column. A change rewrites the buckets that it touches into a new
folder; a version is a list of the folder of every bucket, and becomes the live one when its pointer file, named by its
number, is created. That file is created without overwriting: of two changes that start from one version the second
fails to create it and is made again from the version that won. So the file system must refuse to create a file that is
there. A failed change leaves the old version, and the one before the live one is kept for running readers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times that a change is made again, and milliseconds after which an unfinished pointer counts as abandoned.
RETRIES, ABANDONED = 20, 60_000


class ConcurrentChange(RuntimeError):
    """Other changes kept coming first."""


@dataclass
class VersionedTable:
    """key: the column that deals rows into `buckets`; without one, each change rewrites the table."""

    spark: SparkSession
    path: str
    schema: str
    partition_by: tuple[str, ...] = ()
    key: str | None = None
    buckets: int = 8

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[tuple[int, int]]:
        """(number, time of creation) of all pointers, in order."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/pointer")):
            return []
        found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path(f"{self.path}/pointer"))]
        return sorted((int(name), at) for name, at in found if name.isdigit())

    def _manifest(self, number: int) -> dict | None:
        """What a pointer file says; None while it is being written or once it is gone."""
        fs, path = self._fs()
        try:
            stream = fs.open(path(f"{self.path}/pointer/{number:09d}"))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None

    def _latest(self) -> tuple[int, dict] | None:
        for number, _ in reversed(self._pointers()):
            if (found := self._manifest(number)) is not None:
                return number, found
        return None

    def _bucket(self, buckets: int, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(buckets)).cast("int") if self.key else F.lit(0)

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        schema = StructType.fromDDL(self.schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [f"{self.path}/{v}/bucket={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*parts).select(*schema.names)

    def exists(self) -> bool:
        return self._latest() is not None

    def create(self) -> None:
        """Make an empty version unless there is one."""
        if not self.exists():
            self.update(lambda old: old)

    def read(self) -> DataFrame:
        found = self._latest()
        if found is None:
            raise RuntimeError(f"no table at {self.path}")
        return self._rows(found[1]["folders"])

    def replace(self, df: DataFrame) -> None:
        """Make df the table, whatever it was."""
        self.update(lambda _: df)

    def update(self, change: Callable[[DataFrame], DataFrame], keys: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Replace rows by change(rows), from the newest version.

        keys: given the table, a column of the keys whose rows change; then change() sees and returns the rows of their
        buckets only, and the other buckets stay as they are. Both may be called several times.
        """
        for attempt in range(RETRIES):
            pointers, latest = self._pointers(), self._latest()
            number, manifest = latest or (-1, {"buckets": self.buckets if self.key else 1, "folders": {}})
            if pointers and pointers[-1][0] > number:  # unfinished: by another change, or by one that broke off
                if time.time() * 1000 - pointers[-1][1] < ABANDONED:
                    time.sleep(0.05 * (attempt + 1))
                    continue
                number = pointers[-1][0]
            if self._change(number + 1, manifest, change, keys):
                return
            time.sleep(0.02 * (attempt + 1))
        raise ConcurrentChange(f"{self.path}: {RETRIES} other changes came first")

    def _change(self, number: int, manifest: dict, change, keys) -> bool:
        fs, path = self._fs()
        folders, buckets, name = manifest["folders"], manifest["buckets"], f"version={uuid.uuid4().hex}"
        touched = {str(b) for b in range(buckets)}
        if keys is not None and self.key:
            asked = keys(self._rows(folders)).toDF("key").select(self._bucket(buckets, F.col("key")).alias("b")).distinct()
            touched = {str(r["b"]) for r in asked.collect()}  # at most `buckets`
            if not touched:
                return True
        new = change(self._rows({b: v for b, v in folders.items() if b in touched}))
        columns = StructType.fromDDL(self.schema).names
        new.select(*columns, self._bucket(buckets).alias("bucket")).repartition("bucket").write.partitionBy("bucket", *self.partition_by).parquet(f"{self.path}/{name}")
        written = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{name}"))]
        written = {w.removeprefix("bucket=") for w in written if w.startswith("bucket=")}
        if written - touched:
            fs.delete(path(f"{self.path}/{name}"), True)
            raise ValueError("a change returned rows of keys that it did not name")
        now = {b: v for b, v in folders.items() if b not in touched} | dict.fromkeys(written, name)
        try:
            out = fs.create(path(f"{self.path}/pointer/{number:09d}"), False)
        except Py4JJavaError as e:
            fs.delete(path(f"{self.path}/{name}"), True)
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps({"buckets": buckets, "folders": now}).encode()))
        out.close()
        self._clear(number, set(folders.values()) | set(now.values()))
        return True

    def _clear(self, number: int, kept: set[str]) -> None:
        """Delete versions before the last but one, and folders that only they name."""
        fs, path = self._fs()
        for old, _ in self._pointers():
            if old < number - 1:
                for folder in set(((self._manifest(old) or {}).get("folders") or {}).values()) - kept:
                    fs.delete(path(f"{self.path}/{folder}"), True)
                fs.delete(path(f"{self.path}/pointer/{old:09d}"), False)
