"""LambdaMART against a plain version, against pointwise trees, and over partitionings."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambleflow.operators import lambdamart as lm
from brambleflow.operators import ltr
from brambleflow.sources.config import shared_folder

FEATURES = ["a", "b", "c", "d"]
SCHEMA = "user_id string, item_id string, label double, a double, b double, c double, d double, score string, held string"


def groups(n, seed):
    """Relevance is a place within the group: what a group shares (a) says nothing, and b and c tell only in comparison."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        size = int(rng.integers(6, 30))
        x = rng.normal(size=(size, 4))
        level = rng.normal() * 4
        x[:, 0] = level + rng.normal(size=size) * 0.1
        worth = x[:, 1] + 0.7 * np.abs(x[:, 2]) + rng.normal(size=size) * 0.3
        x[:, 1] += level
        top = set(np.argsort(-worth)[:2].tolist())
        rows += [(f"u{g}", f"i{k:02}", float(k in top), *map(float, x[k]), "s", "h") for k in range(size)]
    return rows


def plain_lambdas(scores, labels):
    """Pair by pair."""
    n = len(scores)
    order = sorted(range(n), key=lambda i: -scores[i])
    disc = [1 / math.log2(r + 2) for r in range(n)]
    best = sum(y * d for y, d in zip(sorted(labels, reverse=True)[: lm.PLACES], disc, strict=False))
    g, h, total = [0.0] * n, [0.0] * n, 0.0
    if best <= 0 or len(set(labels)) == 1:
        return g, h
    spread = scores[order[0]] != scores[order[-1]]
    for r in range(min(lm.PLACES, n)):
        for q in range(r + 1, n):
            i, j = order[r], order[q]
            if labels[i] == labels[j]:
                continue
            high, low = (i, j) if labels[i] > labels[j] else (j, i)
            away = scores[high] - scores[low]
            change = abs(labels[i] - labels[j]) * abs(disc[r] - disc[q]) / best
            if spread:
                change /= 0.01 + abs(away)
            p = 1 / (1 + math.exp(away))
            g[high] -= change * p
            g[low] += change * p
            h[high] += change * p * (1 - p)
            h[low] += change * p * (1 - p)
            total += 2 * change * p
    scale = math.log2(1 + total) / total if total > 0 else 1.0
    return [x * scale for x in g], [x * scale for x in h]


def plain_tree(bins, g, h, leaves, step, least):
    """Leaf by leaf; returns leaf rows and values, and the splits made."""
    def best(rows):
        found = None
        for f in range(bins.shape[0]):
            for b in range(lm.BINS - 1):
                left = rows[bins[f][rows] <= b]
                right = rows[bins[f][rows] > b]
                if len(left) < least or len(right) < least or min(h[left].sum(), h[right].sum()) < lm.LEAST_HESSIAN:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                if gain > 1e-10 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, b, left, right)
        return found

    parts = [np.arange(bins.shape[1])]
    known, made = [best(parts[0])], []
    while len(parts) < leaves and any(known):
        at = max((k for k in range(len(parts)) if known[k]), key=lambda k: known[k][0])
        gain, f, b, left, right = known[at]
        made.append((f, b))
        parts[at : at + 1], known[at : at + 1] = [left, right], [best(left), best(right)]
    return parts, [-step * g[p].sum() / h[p].sum() for p in parts], made


def test_lambdas_equal_those_of_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 5, 40, 80):
        for scores in (np.zeros(n), rng.normal(size=n)):
            labels = rng.integers(0, 3, n).astype(float)
            g, h = lm.lambdas(scores, labels)
            want = plain_lambdas(scores.tolist(), labels.tolist())
            assert np.allclose(g, want[0], atol=1e-12) and np.allclose(h, want[1], atol=1e-12)
    assert not lm.lambdas(np.zeros(3), np.ones(3))[0].any() and not lm.lambdas(np.zeros(1), np.ones(1))[0].any()


def test_trees_equal_those_of_a_plain_version(spark):
    rows = groups(40, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    options = {"trees": 4, "leaves": 6, "feature_share": 1.0, "row_share": 1.0, "least_rows": 5, "patience": 50}
    model = lm.train_lambdamart(df, FEATURES, **options)
    held = {r[0] for r in df.where(lm.held_out_groups("user_id")).select("user_id").distinct().collect()}
    own = sorted(r for r in rows if r[0] not in held)
    x = np.array([r[3:7] for r in own])
    bins = model.binned(list(x.T))
    labels, names = np.array([r[2] for r in own]), np.array([r[0] for r in own])
    scores = np.zeros(len(own))
    # The plain version grows trees until the held-out groups stop rising, too: here it makes as many as were made.
    for tree in model.trees:
        g, h = np.zeros(len(own)), np.zeros(len(own))
        for name in set(names):
            at = np.flatnonzero(names == name)
            a, b = plain_lambdas(scores[at].tolist(), labels[at].tolist())
            g[at], h[at] = np.rint(np.array(a) * lm.UNIT) / lm.UNIT, np.rint(np.array(b) * lm.UNIT) / lm.UNIT
        parts, values, made = plain_tree(bins, g, h, 6, lm.STEP, 5)
        assert sorted(made) == sorted((f, b) for f, b in zip(tree.feature, tree.bin, strict=True) if f >= 0)
        for part, value in zip(parts, values, strict=True):
            scores[part] += value
            assert np.allclose(np.array(tree.value)[tree.leaf_of(bins[:, part])], value, atol=1e-9)
    assert model.trees and np.allclose(model.score(list(x.T)), scores)


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(groups(220, 3), SCHEMA)
    return df, lm.train_lambdamart(df, FEATURES, trees=25, leaves=12)


def test_the_same_model_from_other_partitions(spark, fitted):
    df, model = fitted
    again = lm.train_lambdamart(df.repartition(7).withColumn("d", F.col("d")), FEATURES, trees=25, leaves=12, block_rows=300)
    assert again.trees == model.trees and again.measured == model.measured


def test_it_ranks_new_groups_better_than_pointwise_trees(spark, fitted):
    from brambleflow.operators import evaluation

    df, model = fitted
    new = spark.createDataFrame([(f"n{r[0]}", *r[1:]) for r in groups(150, 4)], SCHEMA).drop("score")
    truth = new.where("label > 0").select("user_id", "item_id")
    plain = ltr.boosted_order(ltr.boosted_ranker(df, FEATURES), new, 10)
    ndcg = lambda order: evaluation.evaluate(order, truth, model="x").where("metric = 'ndcg' AND k = 10").first()["value"]
    assert ndcg(lm.lambdamart_order(model, new, 10)) > ndcg(plain)


def test_saved_model_and_importances(spark, fitted):
    df, model = fitted
    path = shared_folder(spark, "model")
    model.save(spark, path)
    loaded = lm.load_model(spark, path)
    assert loaded == model
    assert {f for f, _ in model.importances()} == set(FEATURES) and model.importances()[0][0] in "bc"
    rows = lm.lambdamart_scores(loaded, df.drop("d"))
    assert rows.columns == [c for c in df.columns if c not in ("d", "score")] + ["score"]
    x = rows.toPandas()
    assert np.allclose(x["score"], model.score([x["a"].to_numpy(), x["b"].to_numpy(), x["c"].to_numpy(), np.zeros(len(x))]))


def test_lambdamart_of_odd_rows(spark):
    none = lm.train_lambdamart(spark.createDataFrame([], SCHEMA), FEATURES)
    assert none.trees == [] and none.score([np.zeros(2)] * 4).tolist() == [0.0, 0.0]
    equal = spark.createDataFrame([("u1", f"i{k}", 1.0, 0.0, 0.0, 0.0, 0.0, "", "") for k in range(50)], SCHEMA)
    assert lm.train_lambdamart(equal, FEATURES).trees == []
    rows = [(*r[:2], None if k % 50 == 0 else r[2], float("nan") if k % 9 == 0 else r[3], *r[4:]) for k, r in enumerate(groups(60, 5))]
    odd = spark.createDataFrame([*rows, (None, "i", 1.0, 0.0, 0.0, 0.0, 0.0, "", ""), ("u", None, 1.0, 0.0, 0.0, 0.0, 0.0, "", ""), *rows[:40]], SCHEMA)
    model = lm.train_lambdamart(odd, FEATURES, trees=2, leaves=4)
    assert lm.lambdamart_scores(model, odd).where("score IS NULL OR isnan(score)").count() == 0


def test_a_group_beyond_the_bound_is_refused(spark, monkeypatch):
    rows = spark.range(lm.MOST_GROUP + 10).select(F.lit("u").alias("user_id"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 2).cast("double").alias("label"), F.rand(1).alias("a"))
    with pytest.raises(Exception, match="a group has more than"):
        lm.train_lambdamart(rows, ["a"], block_rows=1000)
