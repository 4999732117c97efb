"""Data sources: SQLite with pushed filters, mapped vector files, features that survive a broken job."""

from __future__ import annotations

import sqlite3
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambleflow.sources import formats


@pytest.fixture(scope="module")
def registered(spark):
    formats.register(spark)
    yield spark
    spark.conf.unset(formats.PUSHDOWN)


@pytest.fixture
def database(tmp_path):
    """The schema of the relational state."""
    path = str(tmp_path / "state.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE user_feedback (feedback_id INTEGER PRIMARY KEY, user_id TEXT, item_id TEXT, liked BOOLEAN DEFAULT FALSE, comment_text TEXT, rating INTEGER, shown_at TIMESTAMP)")
        c.executemany("INSERT INTO user_feedback VALUES (?, ?, ?, ?, ?, ?, ?)", [(i, f"u{i % 7}", f"i{i}", i % 3 == 0, None if i % 5 else f"c'{i}", i % 6 or None, f"2024-01-{1 + i % 28:02} 10:00:00") for i in range(1, 1001)])
        c.execute("CREATE TABLE user_preference_vectors (user_id TEXT PRIMARY KEY, preference_vector BLOB, vector_dim INT, weight FLOAT)")
        c.executemany("INSERT INTO user_preference_vectors VALUES (?, ?, ?, ?)", [("u", b"\x00\x01", 2, 0.5), ("v", None, None, 1)])
        c.execute('CREATE TABLE "odd ""name" (a TEXT)')
    return path


def test_sqlite_tables(registered, database):
    read = lambda t, **o: registered.read.format("sqlite").options(path=database, table=t, **o).load()
    df = read("user_feedback", partitions=5)
    assert df.dtypes == [("feedback_id", "bigint"), ("user_id", "string"), ("item_id", "string"), ("liked", "boolean"), ("comment_text", "string"), ("rating", "bigint"), ("shown_at", "timestamp")]
    assert df.rdd.getNumPartitions() == 5 and df.count() == 1000 and df.select("feedback_id").distinct().count() == 1000
    row = df.where("feedback_id = 15").first()
    assert tuple(row) == (15, "u1", "i15", True, "c'15", 3, datetime(2024, 1, 16, 10))
    assert [tuple(r) for r in read("user_preference_vectors").orderBy("user_id").collect()] == [("u", bytearray(b"\x00\x01"), 2, 0.5), ("v", None, None, 1.0)]
    assert read('odd "name').count() == 0
    with pytest.raises(Exception, match="no table"):
        read("nothing")


def test_filters_reach_sqlite(registered, database):
    df = registered.read.format("sqlite").options(path=database, table="user_feedback").load()
    for said in ("rating >= 4 AND user_id = 'u1'", "comment_text IS NULL AND feedback_id < 100", "comment_text LIKE 'c''1%'", "user_id IN ('u1', 'u2') AND liked", "rating IS NOT NULL AND rating <> 3", "shown_at > '2024-01-20'", "user_id = 'u1'' OR 1=1 --'"):
        got = df.where(said)
        want = registered.createDataFrame(df.collect(), df.schema).where(said)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), said
    reader = formats.SqliteReader({"path": database, "table": "user_feedback"}, df.schema)
    left = list(reader.pushFilters([formats.ds.GreaterThan(("rating",), 4), formats.ds.EqualTo(("liked",), True), formats.ds.In(("user_id",), ("u1", "u2")), formats.ds.IsNotNull(("rating",))]))
    assert left == [formats.ds.EqualTo(("liked",), True)]
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == df.where("rating > 4 AND user_id IN ('u1', 'u2')").count() < 1000
    plan = df.where("rating > 4")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # SQLite does it all


def test_vector_files_are_read_in_pieces(registered, tmp_path):
    x = np.arange(60, dtype=np.float64).reshape(20, 3)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "ids.npy", np.array([f"i{k}" for k in range(20)]))
    df = registered.read.format("npy_features").options(vectors=str(tmp_path / "x.npy"), ids=str(tmp_path / "ids.npy"), partitions=6).load()
    assert df.rdd.getNumPartitions() == 6
    assert {r.item_id: list(r.v) for r in df.collect()} == {f"i{k}": v.tolist() for k, v in enumerate(x)}
    np.save(tmp_path / "bad.npy", np.array([{"i": [1.0]}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="Python objects"):
        registered.read.format("npy_features").options(vectors=str(tmp_path / "bad.npy"), ids=str(tmp_path / "ids.npy")).load().count()
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    np.save(tmp_path / "no_ids.npy", np.zeros(0, dtype="<U1"))
    assert registered.read.format("npy_features").options(vectors=str(tmp_path / "none.npy"), ids=str(tmp_path / "no_ids.npy")).load().count() == 0


def test_a_broken_job_keeps_what_it_encoded(registered, tmp_path):
    path, log = str(tmp_path / "features"), tmp_path / "log"
    log.mkdir()
    items = registered.range(20_000).select(F.concat(F.lit("i"), "id").alias("item_id"))

    def encoded(breaks: bool, folder: str = str(log)):
        def run(batches):
            import os
            import uuid

            import pyarrow as pa

            for batch in batches:
                ids = batch.column("item_id").to_pylist()
                if breaks and "i19999" in ids:
                    raise RuntimeError("killed")
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                    out.write("\n".join(ids))
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([[float(len(i))] for i in ids], pa.list_(pa.float32()))], names=["item_id", "v"])

        return run

    write = lambda breaks: formats.missing_features(items, path).repartition(4, "item_id").sortWithinPartitions("item_id").mapInArrow(encoded(breaks), "item_id string, v array<float>").write.format("features").options(path=path, chunk=250).mode("append").save()
    registered.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    with pytest.raises(Exception, match="killed"):
        write(True)
    done = formats.read_features(registered, path, "item_id string, v array<float>")
    kept = {r.item_id for r in done.collect()}
    assert 0 < len(kept) < 20_000 and formats.missing_features(items, path).count() == 20_000 - len(kept)
    before = set(log.iterdir())
    write(False)
    again = [i for f in set(log.iterdir()) - before for i in f.read_text().split("\n")]
    assert not kept & set(again) and len(again) == len(set(again)) == 20_000 - len(kept)
    whole = formats.read_features(registered, path, "item_id string, v array<float>")
    assert whole.count() == 20_000 and whole.where("v[0] <> length(item_id)").count() == 0
    assert formats.missing_features(items, path).count() == 0
    registered.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
