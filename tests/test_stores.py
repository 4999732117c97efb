"""Readers, writers, stores, encoders and models on small inputs."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambleflow.functions import text as T
from brambleflow.functions import vectors as V
from brambleflow.operators import encoders, evaluation, feedback, fusion, interests, ltr, preparation, profiles, ranking, rerank
from brambleflow.plans import behaviour
from brambleflow.sources import config, readers, schemas, stores


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_raw_lines_to_catalogue_and_log(spark, tmp_path):
    items = [
        {"parent_asin": "p1", "title": "Ring", "categories": '["A", "B"]', "images": '[{"large": "l.jpg"}]', "description": '["x", "y"]', "price": "3", "store": "S"},
        {"asin": "a2", "product_title": "Rod", "images": '["i.png"]', "image_url": "u.png"},
        {"asin": "", "title": "no id"},
        {"parent_asin": "p1", "title": "again"},
    ]
    with gzip.open(tmp_path / "items.jsonl.gz", "wt") as file:
        file.write("\n\n".join(json.dumps(x) for x in items))
    raw = readers.read_json_lines(spark, str(tmp_path / "items.jsonl.gz"), schemas.RAW_ITEMS, 2).withColumn("n", F.monotonically_increasing_id())
    got = {r.item_id: r for r in preparation.catalogue(raw.withColumn("n", F.when(F.col("title") == "again", 9).otherwise(0)), "n").collect()}
    assert set(got) == {"p1", "a2"} and (got["p1"].title, got["p1"].category, got["p1"].image_url, got["p1"].description) == ("Ring", "A > B", "l.jpg", "x y")
    assert (got["a2"].title, got["a2"].image_url, got["a2"].brand) == ("Rod", "i.png", "")
    log = [{"user_id": u, "asin": f"i{k}", "timestamp": 100 - k} for u in ("u", "v") for k in range(6)] + [{"user_id": "w", "asin": "i", "timestamp": 1}, {"user_id": "u", "asin": "late", "timestamp": 0, "unixReviewTime": 500}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, log)))
    out = preparation.interactions(readers.read_json_lines(spark, str(tmp_path / "log.jsonl"), schemas.RAW_REVIEWS), max_users=1, least=5, most=30)
    assert rows(out, "ts") == [("u", f"i{5 - k}", k + 1) for k in range(6)] + [("u", "late", 7)]


def test_csv_parquet_and_report_round_trips(spark, tmp_path):
    (tmp_path / "h.csv").write_text('user_id,item_id,ts,source\nu,"a ""b""\nc",1,x\n')
    history = readers.read_csv(spark, str(tmp_path / "h.csv"), schemas.HISTORY)
    assert rows(history, "ts") == [("u", 'a "b"\nc', 1, "x")]
    readers.write_table(history, str(tmp_path / "h.parquet"), "source")
    assert rows(readers.read_parquet(spark, str(tmp_path / "h.parquet"), ["user_id", "ts"]), "ts") == [("u", 1)]
    readers.write_report(spark.createDataFrame([("m", 0.5)], "metric string, value double"), str(tmp_path / "r"), k=5, model="bm25")
    said = spark.read.json(str(tmp_path / "r")).first()
    assert said.value == 0.5 and json.loads(said.run) == {"k": "5", "model": "bm25"}


def test_image_folder_takes_the_first_ending(spark, tmp_path):
    for name in ("a.png", "a.jpg", "b.webp", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    got = {r.item_id: r.path.rsplit(".", 1)[1] for r in readers.image_ids(spark, str(tmp_path)).collect()}
    assert got == {"a": "jpg", "b": "webp"}


def test_vector_store(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "store"))
    rows_of = lambda *x: spark.createDataFrame(list(x), "user_id string, v array<float>")
    assert store.stats() == (0, []) and not store.has("a")
    store.save(rows_of(("a", [1.0, 2.0]), ("b", [3.0, 4.0])))
    store.save(rows_of(("b", [5.0, 6.0]), ("c", [7.0, 8.0])))
    assert store.get("b") == [5.0, 6.0] and store.get("a") == [1.0, 2.0] and store.stats(2) == (3, ["a", "b"])
    store.delete(rows_of(("a", [0.0])))
    assert not store.has("a") and store.stats() == (2, ["b", "c"])


def test_model_save_and_feature_check(spark, tmp_path):
    data = spark.createDataFrame([(f"u{i % 7}", f"i{i}", float(i % 5), float(i % 3), float(i % 2)) for i in range(60)], "user_id string, item_id string, x double, y double, label double")
    model = ltr.trained_ranker(data, ["x", "y"])
    stores.save_model(model, str(tmp_path / "m"))
    back = stores.load_model(str(tmp_path / "m"), 2)
    assert rows(ltr.reranked(back, data, 3), "user_id", "rank") == rows(ltr.reranked(model, data, 3), "user_id", "rank")
    with pytest.raises(ValueError):
        stores.load_model(str(tmp_path / "m"), 15)
    boosted = ltr.boosted_ranker(data, ["x", "y"], trees=2, depth=2)
    assert ltr.boosted_order(boosted, data.drop("y"), 2).count() == 14  # what is missing counts 0
    assert [f for f, _ in sorted(ltr.importances(boosted, ["x", "y"]))] == ["x", "y"]


def test_features_from_a_file(spark, tmp_path):
    np.save(tmp_path / "f.npy", {f"i{k}": np.full(3, k, np.float32) for k in range(25)}, allow_pickle=True)
    stores.features_from_file(spark, str(tmp_path / "f.npy"), str(tmp_path / "f.parquet"), rows=10)
    got = {r.item_id: list(r.v) for r in spark.read.parquet(str(tmp_path / "f.parquet")).collect()}
    assert got == {f"i{k}": [float(k)] * 3 for k in range(25)}


def test_settings_and_sources(spark, tmp_path):
    assert config.fusion_settings(spark, str(tmp_path / "none.json")) == {"alpha": 1.0, "beta": 1.0, "normalize_final": True}
    (tmp_path / "f.json").write_text('{"text_weight": 0.6,\n "beta": 2, "normalize_final": false}')
    assert config.fusion_settings(spark, str(tmp_path / "none.json"), str(tmp_path / "f.json")) == {"alpha": 0.6, "beta": 2.0, "normalize_final": False}
    source = config.chosen([config.DataSource("sample", str(tmp_path)), config.DataSource("full", "/nowhere")], "sample")
    spark.range(1).write.parquet(source.path("items"))
    assert source.missing(spark) == ["history", "features"]
    with pytest.raises(ValueError):
        config.chosen([source], "other")
    assert evaluation.model_names(" BM25, learned_ranker,learned,,faiss") == ["bm25", "learned", "faiss"]
    with pytest.raises(ValueError):
        evaluation.model_names("bm25,magic")
    assert evaluation.cutoffs(10) == [5, 10] and evaluation.cutoffs(7) == [5, 7] and evaluation.cutoffs(3) == [3]


def test_encoders_and_multimodal_features(spark):
    items = spark.createDataFrame([("a", "red ring"), ("b", " "), ("c", "old rod")], "item_id string, text string")
    images = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"x")), ("c", bytearray())], "item_id string, content binary")
    out = encoders.multimodal_features(items, images, lambda: encoders.hashed_terms(8), lambda: encoders.hashed_bytes(4)).collect()
    assert [r.item_id for r in out] == ["a"] and len(out[0].v) == 12 and np.allclose(np.linalg.norm(out[0].image_vec), 1)
    told = encoders.answered(items, F.col("text"), lambda: lambda texts: [t.upper() if t.strip() else None for t in texts], F.lit("?"), "said")
    assert rows(told.select("item_id", "said"), "item_id") == [("a", "RED RING"), ("b", "?"), ("c", "OLD ROD")]
    native = items.select("item_id", T.hashed_vector(F.col("text"), 8).alias("v")).collect()
    assert np.allclose([r.v for r in native if r.item_id == "a"][0], encoders.hashed_terms(8)(["red ring"])[0], atol=1e-6) and native[1].v is None


def test_store_tables_and_demo_state(spark):
    one = lambda schema, *x: spark.createDataFrame(list(x), schema)
    for _ in range(2):  # seeding starts afresh
        stores.seed_demo(
            spark, "demo",
            one("user_id string, category string, tag string, weight double", ("u", "look", "Ring", 0.5)),
            one("user_id string, item_id string, liked boolean, rating int", ("u", "i", True, 5), ("u", "j", False, 1)),
            one("user_id string, item_id string", ("u", "i"), ("u", "k")),
            one("user_id string, nickname string", ("u", "name")),
        )
    readers.seed_tags(spark, "demo", [("look", "Ring", "r"), ("look", "Blue", "b")])
    readers.seed_tags(spark, "demo", [("look", "Ring", "r")])
    counts = {t: spark.table(f"demo.{t}").count() for t in ("users", "user_interests", "user_feedback", "exposure_history", "interest_tags")}
    assert counts == {"users": 1, "user_interests": 1, "user_feedback": 2, "exposure_history": 2, "interest_tags": 2}
    spark.sql("DROP DATABASE demo CASCADE")


def test_feedback_routing_and_upserts(spark):
    acts = spark.createDataFrame([("like", None), ("dislike", None), ("star", 4), ("star", 3), ("star", 2)], "action string, stars int")
    got = [tuple(r) for r in acts.select(*(c.alias(n) for n, c in feedback.routed(F.col("action"), F.col("stars")).items())).collect()]
    assert got == [(True, None, True), (False, 1, True), (True, 4, True), (False, 3, False), (False, 2, True)]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(feedback.upserted(old, new, "k"), "k") == [("a", 1), ("b", 3), ("c", 4)]
    shown = spark.createDataFrame([("u", ["i", "j"], None)], "user_id string, item_ids array<string>, shown_at timestamp")
    none = spark.createDataFrame([], "user_id string, item_id string, shown_at timestamp, interacted boolean")
    assert rows(feedback.recorded(none, shown).select("user_id", "item_id", "interacted"), "item_id") == [("u", "i", False), ("u", "j", False)]
    tags = spark.createDataFrame([("t", [1.0, 0.0]), ("s", [0.0, 2.0])], "tag string, v array<double>")
    weights = spark.createDataFrame([("u", "t", 0.75), ("u", "s", 0.25), ("w", "x", 1.0)], "user_id string, tag string, weight double")
    assert rows(feedback.preference_vectors(weights, tags, 2), "user_id") == [("u", [0.75, 0.5])]


def test_interest_sets_halves_and_near_copies(spark):
    features = spark.createDataFrame([(f"i{k}", [1.0 if j == k else 0.0 for j in range(5)]) for k in range(5)], "item_id string, v array<double>")
    history = spark.createDataFrame([("u", f"i{k}", k + 1) for k in range(5)] + [("one", "i0", 1)], "user_id string, item_id string, ts long")
    halves = {(r.item_id, r.half) for r in profiles.history_halves(history).collect()}
    assert halves == {("i4", 1), ("i3", 1), ("i2", 2), ("i1", 2), ("i0", 2)}
    got = {(r.user_id, r.number): r.v for r in profiles.interest_set(history, features, 5).collect()}
    assert set(got) == {("one", 1), *(("u", n) for n in range(1, 6))}
    assert np.allclose(got[("u", 4)], [0, 0, 0, 0.5**0.5, 0.5**0.5]) and np.allclose(got[("u", 5)], [3**-0.5] * 3 + [0, 0])


def test_learning_features_by_hand(spark):
    features = spark.createDataFrame([("c", [2.0, 0.0], [0.0, 1.0], [1.0, 0.0, 0.0, 1.0]), ("h", [1.0, 1.0], [3.0, 4.0], [0.0, 2.0, 0.0, 0.0]), ("g", [1.0, 0.0], [0.0, -1.0], [1.0, 0.0, 0.0, 0.0])], "item_id string, text_vec array<double>, image_vec array<double>, multi_vec array<double>")
    history = spark.createDataFrame([("u", "h", 1), ("u", "g", 2), ("u", "lost", 3)], "user_id string, item_id string, ts long")
    pairs = spark.createDataFrame([("u", "c", 0.5), ("v", "c", 0.0), ("u", "none", 0.0)], "user_id string, item_id string, recall_score double")
    got = {(r.user_id, r.item_id): r.asDict() for r in ltr.ltr_features(pairs, history, features, {"text": 2, "image": 2, "multi": 4}).collect()}
    f, r2 = got[("u", "c")], 0.5**0.5
    unit = np.array([1, 0, 0, 1]) * r2
    pooled = (r2 * np.array([1.0, 0, 0, 0]) + 0 * np.array([0.0, 1, 0, 0])) / r2
    mean = np.array([0.5, 0.5, 0, 0])
    want = {
        "history_length": 3, "has_text": 1, "has_image": 1, "has_multi": 1, "recall_score": 0.5,
        "text_max": 2.0, "text_mean": (2 + 2 * r2) / 2, "text_min": 2 * r2, "image_max": 0.8, "image_mean": -0.1, "image_min": -1.0,
        "image_attention": 0.8, "multi_max": r2, "multi_mean": r2 / 2, "multi_min": 0.0, "multi_std": r2 / 2, "multi_attention": float(pooled @ unit),
        "attention_std": 0.5, "attention_max": 1.0, "user_avg_sim": float(mean @ unit / np.linalg.norm(mean)),
        "mean_difference": (2 + 2 * r2) / 2 + 0.1, "combined": 0.3 * 0.5 + 0.4 * r2 + 0.3 * float(mean @ unit / np.linalg.norm(mean)),
    }
    assert {k: round(f[k], 5) for k in want} == {k: round(float(v), 5) for k, v in want.items()}
    assert all(v == 0 for k, v in got[("v", "c")].items() if k in ltr.LTR and not k.startswith("has"))
    lone = got[("u", "none")]
    assert (lone["has_text"], lone["text_max"], lone["multi_max"], lone["attention_max"]) == (0, 0, 0, 0.5)


def test_hard_negatives_and_matrix(spark):
    pairs = spark.createDataFrame([("u", "p")], "user_id string, item_id string")
    history = spark.createDataFrame([("u", "p", 1), ("u", "s", 2)], "user_id string, item_id string, ts long")
    lists = lambda *x: spark.createDataFrame(list(x), "user_id string, item_id string, score double, rank int")
    random = spark.createDataFrame([("u", "p", "r", 1), ("u", "p", "far", 3)], "user_id string, positive string, item_id string, place int")
    got = rows(ltr.mixed_negatives(pairs, random, lists(("u", "s", 90.0, 1), ("u", "a", 40.0, 2), ("u", "b", 5.0, 3)), lists(("u", "a", 0.25, 1)), history, (2, 2, 1)).select("item_id", "kind", "weight"), "kind", "item_id")
    assert got == [("a", "hard_bm25", 3.0), ("b", "hard_bm25", 1.5), ("a", "hard_faiss", 1.5), ("r", "random", 0.8)]
    assert ltr.mix(6) == (2, 1, 1) and ltr.mix(1) == (1, 1, 1) and ltr.mix(10) == (4, 3, 3)
    truth = spark.createDataFrame([("u", "a"), ("v", "x"), ("w", "y")], "user_id string, item_id string")
    found = ltr.training_matrix(lists(("u", "a", 0.9, 1), ("u", "b", 0.8, 2), ("v", "q", 0.7, 1), ("w", "y", 0.6, 1), ("z", "a", 1.0, 1)), truth, most_rows=3, each=2)
    assert rows(found.select("user_id", "item_id", "label", "group_size"), "user_id", "item_id") == [("u", "a", 1.0, 2), ("u", "b", 0.0, 2), ("v", "q", 0.0, 1)]


def test_small_expressions(spark):
    df = spark.createDataFrame([("https://x/a.PNG?b=.jpg", "  boots  ", "red", "work wear party", [1.0, 1.0], [1.0, 1.0 + 5e-6])], "u string, q string, color string, occ string, a array<double>, b array<double>")
    got = df.select(
        T.url_extension(F.col("u")).alias("ext"),
        T.search_string(F.lit(""), F.lit("shoe"), [F.col("color"), F.lit("")], F.col("occ")).alias("search"),
        T.enhanced_prompt(F.lit("x")).alias("prompt"),
        T.display_score(F.lit(0.5)).alias("shown"),
        V.close(F.col("a"), F.col("b")).alias("close"),
        V.normalized_soft(F.col("a")).alias("soft"),
        V.fused(F.col("a"), F.col("b"), unit=False).alias("plain"),
        T.item_text(F.lit("t"), F.lit(None).cast("string"), F.lit("c"), F.lit("")).alias("text"),
    ).first()
    assert (got.ext, got.search, got.shown, got.close, got.text) == (".png", "shoe red work wear", 0.75, True, "t c")
    assert got.prompt.startswith("a product photo of x") and len(got.plain) == 4 and abs(got.soft[0] - 0.5**0.5) < 1e-6
    intent = spark.range(1).select(*(c.alias(n) for n, c in T.intent_fields(F.lit('{"category": "shoe", "attributes": {"color": "red"}}'), F.lit("red shoe now")).items())).first()
    assert (intent.category, intent.color, intent.fit, intent.enhanced_query) == ("shoe", "red", "", "red shoe now")
    said = T.tag_display(F.col("t"), {"Casual": "casual style"}, {"A": ["x"], "B": ["x", "y"]})
    tags = spark.createDataFrame([("Casual",), ("X",), ("y",), ("other",)], "t string").select(said).collect()
    assert [r[0] for r in tags] == ["casual style", "B", "B", "other"]


def test_lists_and_appended_rows(spark):
    lists = lambda *x: spark.createDataFrame(list(x), "user_id string, item_id string, rank int")
    assert rows(preparation.first_seen(lists(("u", "b", 1), ("u", "a", 2)), lists(("u", "a", 1), ("u", "c", 2))), "place") == [("u", "b", 1), ("u", "a", 2), ("u", "c", 3)]
    history = spark.createDataFrame([("u", "a", 4), ("v", "b", 1)], "user_id string, item_id string, ts long")
    new = spark.createDataFrame([("u", "x", 1), ("u", "y", 2)], "user_id string, item_id string, place int")
    assert rows(preparation.appended(history, new, "more"), "user_id", "ts") == [("u", "a", 4, None), ("u", "x", 5, "more"), ("u", "y", 6, "more"), ("v", "b", 1, None)]
    assert rows(ranking.unseen(lists(("u", "a", 1), ("u", "z", 2)), history), "item_id") == [("u", "z", 2)]
    recs = spark.createDataFrame([("u", "a", 0.2, 0.5), ("u", "b", -0.4, 0.9)], "user_id string, item_id string, attention double, mean_similarity double")
    assert [r.item_id for r in rerank.user_attention(recs, 2).orderBy("rank").collect()] == ["b", "a"]
    metrics = lambda v: spark.createDataFrame([("m", 5, v)], "metric string, k int, value double")
    assert evaluation.improvement(metrics(0.3), metrics(0.2)).first().improvement == pytest.approx(0.5)
    assert feedback.without(spark.createDataFrame([(1,), (2,)], "feedback_id long"), spark.createDataFrame([(2,)], "feedback_id long")).count() == 1


def test_interests_registration_and_accounts(spark):
    asked = spark.createDataFrame([("u", " Ring "), ("u", "Ring"), ("u", " "), ("u", "Odd"), ("v", "Ring")], "user_id string, tag string")
    have = spark.createDataFrame([("u", "look", "Ring", 0.9), ("u", "look", "Blue", 0.4)], "user_id string, category string, tag string, weight double")
    categories = spark.createDataFrame([("look", "Ring")], "category string, tag string")
    assert rows(interests.registered(asked, have, categories), "user_id", "tag") == [("u", "look", "Blue", 0.4), ("u", "Custom", "Odd", 0.5), ("u", "look", "Ring", 0.9), ("v", "look", "Ring", 0.5)]
    assert rows(interests.registered(asked, have, categories, replace=True), "user_id", "tag") == [("u", "Custom", "Odd", 0.5), ("u", "look", "Ring", 0.5), ("v", "look", "Ring", 0.5)]
    users = spark.createDataFrame([("u", "n"), ("w", "m")], "user_id string, nickname string")
    assert rows(interests.accounts(users, have), "user_id") == [("u", "n", 2, ["Ring", "Blue"]), ("w", "m", 0, [])]


def test_fusion_by_strategy(spark):
    schema = "query_id string, item_id string, score double, rank int"
    a, b = spark.createDataFrame([("q", "a", 3.0, 1), ("r", "a", 3.0, 1)], schema), spark.createDataFrame([("q", "b", 0.5, 1), ("r", "c", 0.5, 1)], schema)
    searches = spark.createDataFrame([("q", "hybrid"), ("r", "dense")], "query_id string, strategy string")
    assert {(r.query_id, r.item_id) for r in fusion.by_strategy(searches, a, b, 5).collect()} == {("q", "a"), ("q", "b"), ("r", "c")}


def test_synthetic_histories_compare_only_the_pools_of_anchors(spark, monkeypatch):
    asked = []
    whole = behaviour.dense.cosine_top_k
    monkeypatch.setattr(behaviour.dense, "cosine_top_k", lambda q, *a, **b: asked.append(q.count()) or whole(q, *a, **b))
    behaviour.synthetic_histories(spark, "/root/testdata/sf0.001").count()
    assert asked == [80]


def test_clusters_of_all_starts_at_once_equal_those_of_one_after_another():
    rng = np.random.default_rng(3)
    for x in [rng.normal(size=(30, 8)), np.unique(rng.integers(0, 3, (40, 3)).astype(float), axis=0)]:
        k, draw, best = int(np.clip(np.ceil(np.sqrt(len(x) / 2)), 2, 5)), np.random.default_rng(42), np.inf
        for _ in range(profiles.STARTS):
            c = x[draw.choice(len(x), k, replace=False)]
            for _ in range(25):
                own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
            spread = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
            if spread < best - 1e-12:
                best, want = spread, c
        assert np.array_equal(profiles.clustered(x), want)
