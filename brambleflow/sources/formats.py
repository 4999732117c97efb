"""Spark data sources for SQLite tables, vector files and resumable feature tables.

``register(spark)`` names them; then ``spark.read.format("sqlite")``,
``spark.read.format("npy_features")`` and ``df.write.format("features")`` work as
any other format does.  Files must lie where driver and executors can open them.

* ``sqlite``: path, table and partitions (8).  Column types follow the declared
  ones.  Partitions are ranges of rowid; comparisons, IN, null tests and prefixes
  are pushed into each partition's SQL.
* ``npy_features``: vectors (a 2-D .npy file), ids (a .npy file of strings or
  numbers) and partitions.  Each partition maps its rows of the files; no process
  reads a whole one.  Files with pickled objects are refused.
* ``features``: path and chunk (4,096).  Each task writes its rows (item_id, and any
  other columns) as files of so many and names each when it is whole, so what a
  broken job has encoded stays; ``missing_features`` tells what a rerun has still
  to do.  Rows reach the writer in Arrow batches, whose size bounds what is lost.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

#: Spark's types of SQLite's declared ones, by how these begin; others are strings.
SQLITE_TYPES = {"INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOL": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampType(), "BLOB": T.BinaryType()}
PARTITIONS, FETCH, CHUNK = 8, 4096, 4096
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    """Read-only, so that a wrong path isn't created."""
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class RowRange(ds.InputPartition):
    first: int
    last: int


class SqliteReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.n = int(options.get("partitions", PARTITIONS))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        kinds = {f.name: f.dataType for f in self.schema.fields}
        signs = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = isinstance(kinds.get(name), (T.LongType, T.DoubleType, T.StringType))
            if name and isinstance(f, ds.IsNotNull):
                self.where.append((f"{_quoted(name)} IS NOT NULL", []))
            elif name and isinstance(f, ds.IsNull):
                self.where.append((f"{_quoted(name)} IS NULL", []))
            elif plain and type(f) in signs:
                self.where.append((f"{_quoted(name)} {signs[type(f)]} ?", [f.value]))
            elif plain and isinstance(f, ds.In):
                self.where.append((f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif plain and isinstance(f, ds.StringStartsWith):
                self.where.append((f"substr({_quoted(name)}, 1, {len(f.value)}) = ?", [f.value]))
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        with _opened(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, -1)]
        bounds = np.linspace(low, high + 1, min(self.n, high - low + 1) + 1).astype(int).tolist()
        return [RowRange(a, b - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        parts, values = ["rowid BETWEEN ? AND ?", *(w for w, _ in self.where)], [partition.first, partition.last, *(v for _, own in self.where for v in own)]
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        turn = [_value(f.dataType) for f in self.schema.fields]
        with _opened(self.path) as c:
            rows = c.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {' AND '.join(parts)}", values)
            while some := rows.fetchmany(FETCH):
                for row in some:
                    yield tuple(None if x is None else t(x) for x, t in zip(row, turn, strict=True))


def _value(kind: T.DataType):
    """SQLite keeps any type in any column."""
    if isinstance(kind, T.TimestampType):
        return lambda x: datetime.fromtimestamp(x) if isinstance(x, (int, float)) else datetime.fromisoformat(x)
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, T.BinaryType):
        return lambda x: x.encode() if isinstance(x, str) else bytes(x)
    return {T.LongType: int, T.DoubleType: float}.get(type(kind), str)


class Sqlite(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _opened(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda said: next((t for name, t in SQLITE_TYPES.items() if said.upper().startswith(name)), T.StringType())
        return T.StructType([T.StructField(c[1], kind(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


class NpyReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.vectors, self.ids, self.n = options["vectors"], options["ids"], int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[RowRange]:
        x, ids = np.load(self.vectors, mmap_mode="r"), np.load(self.ids, mmap_mode="r")
        if x.ndim != 2 or len(x) != len(ids):
            raise ValueError("vectors must be a matrix with a row for each id")
        bounds = np.linspace(0, len(x), max(min(self.n, len(x)), 1) + 1).astype(int).tolist()
        return [RowRange(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        x, ids = np.load(self.vectors, mmap_mode="r"), np.load(self.ids, mmap_mode="r")
        for a in range(partition.first, partition.last, FETCH):
            b = min(a + FETCH, partition.last)
            rows = np.asarray(x[a:b], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids[a:b].tolist()], pa.string()), lists], names=["item_id", "v"])


class NpyFeatures(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_features"

    def schema(self) -> str:
        return "item_id string, v array<float>"

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(dict(self.options))


@dataclass
class Named(ds.WriterCommitMessage):
    files: list[str]


class FeatureWriter(ds.DataSourceArrowWriter):
    """Files become visible one by one, by renaming."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.chunk = options["path"].removeprefix("file://"), int(options.get("chunk", CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Named:
        os.makedirs(f"{self.path}/done", exist_ok=True)
        files: list[str] = []
        rest: list[pa.RecordBatch] = []

        def name_rest() -> None:
            table = pa.Table.from_batches(rest)
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(table, f"{self.path}/.{name}")
            os.replace(f"{self.path}/.{name}", f"{self.path}/done/{name}")
            files.append(name)
            rest.clear()

        for batch in iterator:
            for a in range(0, batch.num_rows, self.chunk):
                rest.append(batch.slice(a, self.chunk))
                if sum(x.num_rows for x in rest) >= self.chunk:
                    name_rest()
        if rest:
            name_rest()
        return Named(files)

    def commit(self, messages: list[Named | None]) -> None:
        """A mark that nothing is open."""
        os.makedirs(f"{self.path}/done", exist_ok=True)
        with open(f"{self.path}/_SUCCESS", "w"):
            pass

    def abort(self, messages: list[Named | None]) -> None:
        """What was named stays: a rerun needn't encode it again."""


class Features(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "features"

    def writer(self, schema: T.StructType, overwrite: bool) -> FeatureWriter:
        if overwrite:
            raise ValueError("features are added; take a new folder to begin anew")
        return FeatureWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (Sqlite, NpyFeatures, Features):
        spark.dataSource.register(source)
    spark.conf.set(PUSHDOWN, "true")


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first of each item's rows that were named; two tasks that tried the same rows may both have."""
    if not os.path.isdir(f"{path.removeprefix('file://')}/done"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/done").dropDuplicates(["item_id"])


def missing_features(items: DataFrame, path: str, key: str = "item_id") -> DataFrame:
    """Items without a row in a feature table."""
    return items.join(read_features(items.sparkSession, path, f"{key} string"), key, "left_anti")
