"""What the fourth round's findings changed."""

from __future__ import annotations

import numpy as np

from brambleflow.operators import dense, ltr, rerank
from brambleflow.plans import recall


def test_matrix_without_bounds_has_all_groups(spark):
    lists = spark.createDataFrame([(u, i, 1.0 / r, r) for u in ("a", "b", "c") for r, i in enumerate(("x", "y", "z"), 1)], "user_id string, item_id string, score double, rank int")
    truth = spark.createDataFrame([("a", "x"), ("b", "q"), ("c", "z")], "user_id string, item_id string")
    got = ltr.training_matrix(lists, truth, None, None)
    assert sorted((r.user_id, r.item_id, r.label, r.group_size) for r in got.collect()) == sorted((u, i, float((u, i) in {("a", "x"), ("c", "z")}), 3) for u in "abc" for i in "xyz")
    assert ltr.training_matrix(lists, truth, 3, 2).count() == 4


def test_distinct_vectors_give_the_lists_of_all(spark, monkeypatch):
    base = np.random.default_rng(3).normal(size=(6, 4)).tolist()
    vectors = spark.createDataFrame([(str(n), v) for n, v in enumerate(base)] + [("none", None)], "key string, v array<double>")
    items = spark.createDataFrame([(str(n), str(n % 6)) for n in range(60)] + [("lost", "none")], "item_id string, key string").cache()
    queries = items.withColumnRenamed("item_id", "query_id")
    met = []
    inner = dense.cosine_top_k
    monkeypatch.setattr(dense, "cosine_top_k", lambda q, i, *a: (met.append((q.where("v IS NOT NULL").count(), i.count())), inner(q, i, *a))[1])
    listed = lambda df: sorted((r.query_id, r.rank, r.item_id, r.score) for r in df.collect())
    for k, same in ((13, True), (25, False)):
        every = inner(queries.join(vectors, "key"), items.join(vectors, "key"), k, same)
        assert listed(dense.keyed_top_k(queries, items, vectors, k, same)) == listed(every)
        assert met.pop() == (6, 6)


def test_attention_comes_from_products_in_batches(spark):
    pairs = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "none"), ("w", "a")], "user_id string, item_id string")
    history = spark.createDataFrame([("u", "h"), ("u", "g")], "user_id string, item_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, -1.0]), ("h", [3.0, 4.0]), ("g", [0.0, 2.0]), ("none", None)], "item_id string, v array<double>")
    out = rerank.attention_pooled(pairs, history, vectors, 2, mean=True)
    # a: the weights are 1 and 0; b: no product is positive, so both weigh a half.
    assert [(r.user_id, r.item_id, round(r.attention, 6), round(r.mean_similarity, 6)) for r in out.orderBy("user_id", "item_id").collect()] == [("u", "a", 0.6, 0.3), ("u", "b", -0.948683, -0.848528), ("u", "none", 0.0, 0.0), ("w", "a", 0.0, 0.0)]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_train_holds_the_asked_users_alone(spark, monkeypatch):
    history = spark.createDataFrame([(u, str(n), n) for u in ("u", "w", "short") for n in range(1, 3 if u == "short" else 6)], "user_id string, item_id string, ts long")
    monkeypatch.setattr(recall.V, "history", lambda spark, d: history)
    pairs = spark.createDataFrame([("u", "4"), ("u", "5"), ("short", "1")], "user_id string, item_id string")
    assert sorted((r.user_id, r.item_id, r.ts) for r in recall._train_of(spark, "", pairs).collect()) == [("u", "1", 1), ("u", "2", 2), ("u", "3", 3)]
