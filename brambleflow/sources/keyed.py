"""A table that keeps one row a key, changed by writing only the buckets that a change touches.

Rows lie in hash buckets; each change writes its buckets as new files and then
a manifest of the next version, which names the files of every bucket.  Readers
see one version as a whole.  Two writers that started from the same version
can't both write its successor: the one that comes second takes the newer
version and, if it touched other buckets, only lists its files there; else it
merges anew.  A change that is repeated gives the same rows.

A manifest is created without overwriting, which HDFS and object stores with
conditional writes do in one step; on a local disk two writers may collide
within the same instant, so one process should write there.  Files that no kept
version names are removed by ``vacuum``.

Defined cases: rows with a null key are left out; a store without versions reads as
an empty table; columns that rows lack are null, and null keeps what is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import _file_system

#: Buckets of a new store, and how often a writer begins anew before it gives up.
BUCKETS, TRIES = 64, 20


def merged(keys: list[str], columns: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """New values over old ones, null keeping what is there."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.alias("o").join(new.alias("n"), keys, "full_outer")
        return both.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns))

    return merge


class KeyedStore:
    """Rows of a schema with one row for each value of the key columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = T._parse_datatype_string(schema)
        self.columns = [f.name for f in self.schema.fields if f.name not in keys]
        self.buckets = buckets

    # Manifests.

    def _path(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        files, at = _file_system(self.spark, f"{self.folder}/manifests")
        if not files.exists(at):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"buckets": self.buckets, "files": {}}
        rows = self.spark.read.text(self._path(version), wholetext=True).collect()
        return json.loads(rows[0].value)

    def _commit(self, version: int, manifest: dict) -> bool:
        """Whether this writer made the version."""
        files, at = _file_system(self.spark, self._path(version))
        if files.exists(at):
            return False
        try:
            out = files.create(at, False)
        except Exception as e:  # py4j has no narrower type for an existing file
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(json.dumps(manifest).encode())
        out.close()
        return True

    # Rows.

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _of(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        paths = sorted({p for b, p in manifest["files"].items() if buckets is None or b in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in paths))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an older one that is kept."""
        return self._of(self._manifest(self.version() if version is None else version))

    def _own(self, rows: DataFrame) -> DataFrame:
        have = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        return have.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))

    def _change(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Apply a change to the buckets of some rows; gives the version that has it."""
        written: dict | None = None
        for _ in range(TRIES):
            version = self.version()
            manifest = self._manifest(version)
            n = manifest["buckets"]
            if written is None or any(manifest["files"].get(b) != p for b, p in written["seen"].items()):
                touched = [str(r[0]) for r in rows.select(self._bucket(n)).distinct().collect()]
                if not touched:
                    return version
                new = change(self._of(manifest, touched), rows).select(*self.keys, *self.columns)
                name = f"data/{uuid.uuid4().hex}"
                new.withColumn("bucket", self._bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
                files, at = _file_system(self.spark, f"{self.folder}/{name}")
                there = {s.getPath().getName() for s in files.listStatus(at)}
                written = {"seen": {b: manifest["files"].get(b) for b in touched}, "new": {b: f"{name}/bucket={b}" for b in touched if f"bucket={b}" in there}}
            # Only other buckets have changed since these were read.
            rest = {b: p for b, p in manifest["files"].items() if b not in written["seen"]}
            if self._commit(version + 1, {"buckets": n, "files": rest | written["new"]}):
                return version + 1
        raise OSError(f"{self.folder} is written too often")

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Insert rows, one a key, and merge them with those that are there; gives the new version.

        ``merge`` takes the touched buckets' old rows and the new ones; without it
        new values replace old ones, and nulls don't.
        """
        return self._change(self._own(rows), merge or merged(self.keys, self.columns))

    def delete(self, keys: DataFrame) -> int:
        own = keys.select(*self.keys).dropna().distinct()
        return self._change(self._own(own), lambda old, gone: old.join(gone.select(*self.keys), self.keys, "left_anti"))

    def vacuum(self, keep: int = 2) -> int:
        """Remove older versions than the newest ``keep``, and files that no kept one names; gives how many folders went.

        No writer may be at work meanwhile.
        """
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {p for v in kept for p in self._manifest(v)["files"].values()}
        files, data = _file_system(self.spark, f"{self.folder}/data")
        gone = 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for folder in files.listStatus(data) if files.exists(data) else []:
            for part in files.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    gone += bool(files.delete(part.getPath(), True))
            if not any(s.isDirectory() for s in files.listStatus(folder.getPath())):
                files.delete(folder.getPath(), True)
        for version in range(1, kept.start):
            files.delete(path(self._path(version)), False)
        return gone
