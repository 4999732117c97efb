"""The stream of interest weights against the batch update, its decay by timers, and a restart."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from brambleflow.operators import feedback
from brambleflow.streaming.interest_stream import latest_weights, weights_stream

SCHEMA = "user_id string, item_id string, ts timestamp, event_id long, liked boolean, rating int, comment_text string"
START = datetime(2024, 1, 1)
TAGS = [("i1", "Ring"), ("i1", "Red"), ("i2", "Blue"), ("i3", "Hardware"), ("i2", "Ring")]
CATEGORIES = [("look", "Ring"), ("look", "Red"), ("look", "Blue"), ("kind", "Hardware")]


def weights(df):
    return {(r.user_id, r.tag): pytest.approx(r.weight) for r in df.collect()}


def test_batches_decay_and_restart(spark, tmp_path):
    tags, categories = spark.createDataFrame(TAGS, "item_id string, tag string"), spark.createDataFrame(CATEGORIES, "category string, tag string")
    at = lambda days: START + timedelta(days=days)
    steps = [
        [("u", "i1", at(0), 1, True, 5, "good"), ("u", "i2", at(0.1), 2, False, None, None), ("v", "i3", at(0.2), 3, None, 2, None)],
        [("u", "i1", at(1), 4, True, None, None), ("w", "i2", at(1), 5, True, 4, None), ("u", "i3", at(1), 6, None, 3, None)],
        [("w", "i3", at(5), 7, False, 1, "bad")],
    ]
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/n={number}")

    def started():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return weights_stream(stream, tags, categories, late="1 hour").writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").start()

    want = spark.createDataFrame([], "user_id string, tag string, weight double")
    query = started()
    for k, part in enumerate(steps):
        if k == 1:  # a restart between two batches
            query.stop()
            query = started()
        rows = spark.createDataFrame(part, SCHEMA).coalesce(1)
        rows.write.mode("append").parquet(source)
        query.processAllAvailable()
        want = spark.createDataFrame(feedback.updated_weights(want, rows, tags, categories).collect(), "user_id string, tag string, weight double")
    before = weights(want)
    assert weights(latest_weights(spark.read.parquet(sink))) == before and len(before) == 7
    assert {r.reason for r in spark.read.parquet(sink).collect()} == {"feedback"}
    # Day 8.5: u's and v's last feedback lies seven days back, w's not.
    spark.createDataFrame([("x", "i1", at(8.5), 8, True, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    spark.createDataFrame([("x", "i1", at(8.6), 9, True, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    updates = spark.read.parquet(sink)
    decayed = weights(feedback.decayed(want.where("user_id IN ('u', 'v')")))
    got = weights(updates.where("reason = 'decay'"))
    assert got == decayed and len(got) == 4
    after = weights(latest_weights(updates.where("user_id <> 'x'")))
    assert after == before | decayed
