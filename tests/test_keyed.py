"""The keyed store: partial rows, touched buckets, several writers, versions; and the stream of joined exposures."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from brambleflow.sources.keyed import KeyedStore
from brambleflow.sources.stores import VectorStore
from brambleflow.streaming.interest_stream import exposures_joined, exposures_joined_batch

SCHEMA = "k string, n long, t string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), SCHEMA, ["k"], buckets=16)


def test_null_keeps_what_is_there(spark, store):
    assert store.version() == 0 and store.read().count() == 0
    store.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 9, "no key")], SCHEMA))
    store.upsert(spark.createDataFrame([("a", None, "y"), ("c", 3, "z")], SCHEMA))
    store.upsert(spark.createDataFrame([("b", "text", 5)], "k string, t string, further int"))
    assert rows(store.read()) == [("a", 1, "y"), ("b", 2, "text"), ("c", 3, "z")]
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == 3
    store.delete(spark.createDataFrame([("a",), ("nobody",), (None,)], "k string"))
    assert rows(store.read()) == [("b", 2, "text"), ("c", 3, "z")] and rows(store.read(1)) == [("a", 1, "x"), ("b", 2, None)]


def test_written_bytes_follow_the_change(spark, store, tmp_path):
    many = spark.range(20_000).selectExpr("concat('k', id) AS k", "id AS n", "sha2(string(id), 256) AS t")
    store.upsert(many)
    before = size(tmp_path)
    store.upsert(spark.createDataFrame([("k17", 0, None)], SCHEMA))
    assert size(tmp_path) - before < before / 8
    got = store.read()
    assert got.count() == 20_000 and got.where("k = 'k17'").first().n == 0 and got.where("k = 'k17'").first().t is not None
    assert store.vacuum(1) == 1 and size(tmp_path) < 1.1 * before and store.read().count() == 20_000


def test_two_writers_lose_nothing(spark, store, monkeypatch):
    store.upsert(spark.createDataFrame([(f"k{i}", i, "0") for i in range(40)], SCHEMA))
    honest, others = KeyedStore._commit, []

    def overtaken(self, version, manifest):
        if len(others) < 2:
            # Another writer is first, the first time with the same key, then with another bucket's.
            others.append(None)
            monkeypatch.setattr(KeyedStore, "_commit", honest)
            KeyedStore(spark, self.folder, SCHEMA, ["k"], buckets=16).upsert(spark.createDataFrame([("k1" if len(others) == 1 else "k2", 100, None)], SCHEMA))
            monkeypatch.setattr(KeyedStore, "_commit", overtaken)
        return honest(self, version, manifest)

    monkeypatch.setattr(KeyedStore, "_commit", overtaken)
    assert store.upsert(spark.createDataFrame([("k1", None, "mine"), ("new", 1, "mine")], SCHEMA)) == 4
    got = {r.k: (r.n, r.t) for r in store.read().collect()}
    assert got["k1"] == (100, "mine") and got["k2"] == (100, "0") and got["new"] == (1, "mine") and len(got) == 41


def test_vector_store_keeps_the_untouched_side(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "vectors"))
    store.save(spark.createDataFrame([("u", [1.0, 2.0], [3.0], ["i", "j"])], "user_id string, v array<float>, short_term array<float>, history array<string>"))
    store.save(spark.createDataFrame([("u", [4.0], datetime(2024, 1, 2))], "user_id string, long_term array<float>, updated_at timestamp"))
    found = store.row("u")
    assert (list(found["v"]), list(found["short_term"]), list(found["long_term"]), list(found["history"]), found["updated_at"]) == ([1.0, 2.0], [3.0], [4.0], ["i", "j"], datetime(2024, 1, 2))
    assert store.row("nobody") is None and store.has("u")


def test_stream_of_exposures_equals_the_batch_join(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    shown = "user_id string, item_id string, ts timestamp, event_id long"
    told = "user_id string, item_id string, ts timestamp, liked boolean, rating int"
    exposures = [[("u", "a", at(0), 1), ("u", "b", at(1), 2), ("v", "a", at(2), 3), ("u", "a", at(3), 4)], [("w", "a", at(30), 5), ("u", "a", at(0.5), 6)], [("z", "z", at(200), 9)]]
    feedback = [[("u", "a", at(5), True, 5)], [("u", "b", at(26), True, 4), ("w", "a", at(31), False, 1), ("w", "a", at(32), None, 2)], [("z", "z", at(201), True, 3)]]
    streams = []
    for name, parts, schema in (("e", exposures, shown), ("f", feedback, told)):
        (tmp_path / name).mkdir()
        streams.append(spark.readStream.schema(schema).parquet(str(tmp_path / name)))
    query = exposures_joined(*streams, late="4 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    for step in range(3):
        for name, parts, schema in (("e", exposures, shown), ("f", feedback, told)):
            spark.createDataFrame(parts[step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = lambda parts, schema: spark.createDataFrame([r for p in parts for r in p], schema)
    want = exposures_joined_batch(whole(exposures, shown), whole(feedback, told)).where("event_id NOT IN (6, 9)")
    # Event 6 came when the watermark had passed it, 9 still waits for feedback.
    assert rows(got.where("event_id NOT IN (6, 9)")) == rows(want) and got.where("event_id = 9 AND has_feedback = 0").count() == 0
    assert {(r.event_id, r.has_feedback) for r in want.collect()} == {(1, 1), (2, 0), (3, 0), (4, 1), (5, 1)}
