"""Hand-computed fixtures for the formulas and their edges."""

from __future__ import annotations

import hashlib
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brambleflow.functions import text as T
from brambleflow.functions import vectors as V
from brambleflow.operators import bm25, dense, evaluation, feedback, fusion, interests, preparation, profiles, rerank
from brambleflow.operators.encoders import attention_forward, encoded, hashed_terms
from brambleflow.plans import behaviour, views


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bm25_counts_empty_documents_and_repeated_query_words(spark):
    docs = spark.createDataFrame([("a", "red red ring"), ("b", "blue ring"), ("c", None)], "item_id string, text string")
    queries = spark.createDataFrame([("q", "Red red zinc"), ("r", "zinc"), ("s", None)], "query_id string, text string")
    found = rows(bm25.search(bm25.build_index(docs), queries, 5), "query_id")
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3)))
    assert [(q, i, r) for q, i, _, r in found] == [("q", "a", 1)]
    assert found[0][2] == pytest.approx(want, abs=1e-6)


def lists(spark):
    schema = "query_id string, item_id string, score double, rank int"
    a = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 2.0, 2), ("q", "c", 1.0, 3), ("one", "x", 1.0, 1)], schema)
    b = spark.createDataFrame([("q", "c", 0.5, 1), ("q", "d", 0.5, 2)], schema)
    return a, b


def test_reciprocal_ranks(spark):
    found = {r.item_id: r for r in fusion.rrf(*lists(spark), 10).collect()}
    assert found["c"].final_score == pytest.approx(1 / 63 + 1 / 61, abs=1e-6)
    assert found["c"].recall_source == "hybrid" and found["c"]["rank"] == 1
    assert found["x"].recall_source == "bm25" and found["d"].bm25_rank is None


def test_adaptive_k_bounds_and_single_list(spark):
    found = {r.item_id: r for r in fusion.rrf_adaptive(*lists(spark), 10).collect()}
    assert found["x"].final_score == pytest.approx(0.6 / 31, abs=1e-6)
    assert found["a"].final_score == pytest.approx(0.6 / (15 + 1), abs=1e-6)
    assert found["d"].final_score == pytest.approx(0.4 / (44 + 2), abs=2e-4)


def test_hybrid_of_one_candidate_gives_whole_shares(spark):
    found = {r.item_id: r for r in fusion.hybrid(*lists(spark), 10).collect()}
    assert found["x"].final_score == pytest.approx(0.4 + 0.3, abs=1e-6)
    assert fusion.fuse("unknown", *lists(spark), 10).count() == 5


def test_metrics(spark):
    recs = spark.createDataFrame([("u", "a", 1), ("u", "x", 2), ("u", "y", 3), ("u", "b", 4), ("u", "a", 5)], "user_id string, item_id string, rank int")
    truth = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c")], "user_id string, item_id string")
    got = {r.user_id: r for r in evaluation.user_metrics(recs, truth, 4).collect()}
    assert (got["u"].precision, got["u"].recall, got["u"].hit_rate) == (0.5, 1.0, 1.0)
    assert got["u"].map == pytest.approx((1 + 2 / 4) / 2)
    assert got["u"].ndcg == pytest.approx((1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert tuple(got["v"])[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_split_drops_short_users(spark):
    h = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("b", "2", 2), ("b", "3", 3)], "user_id string, item_id string, ts long")
    train, truth = profiles.leave_last_n(h, 2)
    assert rows(train, "ts") == [("b", "1", 1)]
    assert rows(truth, "ts") == [("b", "2", 2), ("b", "3", 3)]


def test_prefix_expansion_has_the_whole_history(spark, tmp_path):
    spark.range(30).selectExpr("1L AS l_orderkey", "id AS l_linenumber", "id AS l_partkey", "0L AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1).selectExpr("1L AS o_orderkey", "7L AS o_custkey", "DATE'2020-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(behaviour.prefix_expansion(spark, str(tmp_path)), "ts")
    assert got == [("7", str(n), n + 1, " ".join(str(m) for m in reversed(range(n)))) for n in range(3, 30)]


def test_negatives_go_on_to_the_following_bins(spark):
    pair = "user_id string, item_id string"
    items = spark.createDataFrame([(f"i{n}",) for n in range(9)], "item_id string")
    history = spark.createDataFrame([("u", "i0"), ("u", "i1"), *[("v", f"i{n}") for n in range(7)]], pair)
    got = rows(profiles.hashed_negatives(spark.createDataFrame([("u", "i0"), ("u", "i1"), ("v", "i3")], pair), items, history, 4), "user_id", "positive", "place")
    assert [(u, p, n) for u, p, _, n in got] == [("u", p, n) for p in ("i0", "i1") for n in range(1, 5)] + [("v", "i3", 1), ("v", "i3", 2)]
    assert {i for u, _, i, _ in got if u == "v"} == {"i7", "i8"} and len({r[:3] for r in got}) == 10
    assert {i for u, _, i, _ in got if u == "u"} <= {f"i{n}" for n in range(2, 9)}

    def spread(*key):
        return int(hashlib.md5("#".join([*key, "42"]).encode()).hexdigest()[:8], 16) % profiles.BINS

    for p in ("i0", "i1"):
        order = sorted((f"i{n}" for n in range(2, 9)), key=lambda i: ((spread(i) - spread("u", p)) % profiles.BINS, hashlib.md5(f"u#{p}#{i}#42".encode()).hexdigest()))
        assert [i for _, q, i, _ in got if q == p] == order[:4]


def test_profile_renormalises_weights_of_missing_vectors(spark):
    h = spark.createDataFrame([("u", "a", 3), ("u", "gone", 2), ("u", "b", 1)], "user_id string, item_id string, ts long")
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_id string, v array<double>")
    (_, v), = rows(profiles.weighted_profile(h, f, 2, profiles.SHORT), "user_id")
    assert v == pytest.approx([0.55 / math.hypot(0.55, 0.15), 0.15 / math.hypot(0.55, 0.15)])


def test_interest_update(spark):
    schema = "user_id string, item_id string, liked boolean, rating int, comment_text string"
    tags = spark.createDataFrame([("i1", "Red"), ("i2", "Blue"), ("i3", "Nowhere")], "item_id string, tag string")
    cats = spark.createDataFrame([("look", "Red"), ("look", "Blue")], "category string, tag string")
    none = spark.createDataFrame([("u", "Old", 0.4)], "user_id string, tag string, weight double")
    seen = spark.createDataFrame([("u", "i1", True, None, None), ("u", "i2", False, 1, None), ("u", "i3", True, 5, "good")], schema)
    got = dict((t, w) for _, t, w in rows(feedback.updated_weights(none, seen, tags, cats), "tag"))
    assert got["Red"] == pytest.approx(0.72 * 0.35 + 0.38 * 0.5)
    assert got["Blue"] == pytest.approx(0.05)
    assert got["Old"] == 0.4 and set(got) == {"Red", "Blue", "Old"}


def test_folded_weights_are_clamped(spark):
    events = spark.createDataFrame([("u", "t", i, i, -1) for i in range(5)] + [("v", "t", 1, 1, 1)], "user_id string, tag string, ts long, event_id long, sign int")
    assert rows(feedback.folded_weights(events), "user_id") == [("u", "t", 0.05), ("v", "t", pytest.approx(0.442))]


def test_personalize_keeps_all_when_all_are_blocked(spark):
    pair = "user_id string, item_id string"
    base = spark.createDataFrame([("u", "a", 0.9), ("u", "b", 0.8)], f"{pair}, rank_score double")
    none = spark.createDataFrame([], f"{pair}, score double")
    blocked = spark.createDataFrame([("u", "a"), ("u", "b")], pair)
    out = interests.personalized(base, none, spark.createDataFrame([], pair), blocked, none, 8)
    assert [r.item_id for r in out.orderBy("rank").collect()] == ["a", "b"]
    half = interests.personalized(base, none, spark.createDataFrame([], pair), blocked.where("item_id = 'a'"), none, 8)
    assert [r.item_id for r in half.collect()] == ["b"]


def test_interest_ranks_all_items_by_similarity_and_tags(spark):
    tags = [t for _, t, _ in views.DICTIONARY]
    users = spark.createDataFrame([("u", [1.0, 0.0]), ("none", [0.0, 1.0])], "user_id string, v array<double>")
    turned = {f"i{n:03}": n / 200 for n in range(150)}
    features = spark.createDataFrame([(i, [math.cos(x), math.sin(x)]) for i, x in turned.items()], "item_id string, v array<double>")
    raw = {("i120", "Tool"): 6, ("i090", "Tool"): 3, ("i090", "Heat"): 6, ("i002", "Age"): 1}
    scores = spark.createDataFrame([(i, t, n) for (i, t), n in raw.items()], "item_id string, tag string, raw long")
    weights = spark.createDataFrame([("u", "Tool", 0.9), ("u", "Heat", 1.0)], "user_id string, tag string, weight double")
    weight = {"Tool": 0.9, "Heat": 1.0}
    got = rows(interests.interest_recommend(interests.interest_candidates(users, features, scores, weights, tags, 20), scores, weights, 20).where("user_id = 'u'"), "rank")
    score = {i: 0.7 * math.cos(x) + 0.3 * sum(n * weight.get(t, 0) for (j, t), n in raw.items() if j == i) / 12 for i, x in turned.items()}
    want = sorted(score, key=lambda i: (-round(score[i], 6), i))[:20]
    assert [i for _, i, _, _ in got] == want
    assert "i090" in want  # beyond the fifty nearest


def test_candidates_keep_the_first_of_equal_items(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    q = spark.createDataFrame([("q", [1.0, 0.0], [0.5])], "query_id string, v array<double>, w array<double>")
    i = spark.createDataFrame([(f"i{n:02}", [1.0, 0.0], [1.0]) for n in range(40)], "item_id string, v array<double>, w array<double>").coalesce(1)
    found = [r.item_id for r in dense.shared_candidates(q, i, 3, 1, (0.7, 0.3)).collect()]
    assert {"i00", "i01", "i02"} <= set(found) and len(found) <= 3 * 7


def test_attention_pool_is_zero_without_vectors(spark):
    pairs = spark.createDataFrame([("u", "a"), ("u", "none")], "user_id string, item_id string")
    history = spark.createDataFrame([("u", "b", 1)], "user_id string, item_id string, pos int")
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "item_id string, v array<double>")
    assert rows(rerank.attention_pooled(pairs, history, f, 2), "item_id") == [("u", "a", -1.0), ("u", "none", 0.0)]


def test_raw_catalogue(spark):
    from brambleflow.sources.schemas import RAW_ITEMS

    names = [c.split()[0] for c in RAW_ITEMS.split(", ")]
    make = lambda **kw: tuple(kw.get(n) for n in names)
    raw = [
        make(parent_asin="1", title="A", images='[{"hi_res": null, "large": "l.jpg"}]', categories='["x", "y"]', description="[]"),
        make(asin="1", title="again"),
        make(parent_asin="", asin="2", title="", product_title="B", images='["s.png"]', description='["p", "q"]'),
        make(asin="3", title="C", images='{"large": ["m.webp"]}'),
        make(asin="4", title="D", imageURL="flat.jpg"),
        make(asin="5"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], RAW_ITEMS + ", line int")
    got = {r.item_id: r for r in preparation.catalogue(df, "line").collect()}
    assert {k: v.image_url for k, v in got.items()} == {"1": "l.jpg", "2": "s.png", "3": "m.webp", "4": "flat.jpg"}
    assert (got["1"].title, got["1"].category, got["2"].title, got["2"].description) == ("A", "x > y", "B", "p q")


def test_text_functions(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": 2} ok',), ("nothing",), (None,)], "s string")
    assert [r[0] for r in df.select(F.get_json_object(T.salvaged_json(F.col("s")), "$.a")).collect()] == ["1", "2", None, None]
    df = spark.createDataFrame([("  one  two ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.first_words(F.col("s"), 1, "fashion")).collect()] == ["one", "fashion", "fashion"]
    df = spark.createDataFrame([("http://x/y.PNG?z=1",), ("http://x/y",)], "s string")
    assert [r[0] for r in df.select(T.url_extension(F.col("s"))).collect()] == [".png", ".jpg"]


def test_vector_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), (None, [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0]
    assert df.select(V.blended(F.col("a"), F.col("b"), 0.6)).collect()[1][0] == [1.0, 2.0]


def test_dense_blocks_break_ties_by_id_and_lsh_finds_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = [(str(i), [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [("dup", [1.0] * 8), ("dup2", [1.0] * 8)]
    items = spark.createDataFrame(v, "item_id string, v array<double>")
    queries = items.withColumnRenamed("item_id", "query_id")
    exact = {(r.query_id, r.item_id) for r in dense.cosine_top_k(queries, items, 5).collect()}
    assert len(exact) == 5 * 202
    top = [r.item_id for r in dense.cosine_top_k(queries.where("query_id = 'dup2'"), items, 2).orderBy("rank").collect()]
    assert top == ["dup", "dup2"]
    near = {(r.query_id, r.item_id) for r in dense.lsh_top_k(queries, items, 5).collect()}
    assert len(near & exact) / len(exact) >= 0.95


def test_encoder_and_attention():
    import numpy as np

    enc = hashed_terms(16)(["red ring", ""])
    assert np.linalg.norm(enc[0]) == pytest.approx(1) and not enc[1].any()
    w = attention_forward(np.ones(4), np.eye(4))
    assert w.sum() == pytest.approx(1) and (w == attention_forward(np.ones(4), np.eye(4))).all()


def test_encoded_column(spark):
    df = spark.createDataFrame([("red",), (" ",), (None,)], "t string")
    got = [r.v for r in encoded(df, "t", lambda: hashed_terms(8)).collect()]
    assert len(got[0]) == 8 and got[1] is None and got[2] is None


def test_stream_equals_fold(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from brambleflow.streaming.interest_stream import interest_stream, latest_weights

    schema = "user_id string, tag string, ts timestamp, event_id long, sign int"
    parts = [[("u", "t", 1, 1, 1), ("u", "s", 2, 2, -1)], [("u", "t", 3, 3, -1), ("v", "t", 4, 4, 1)]]
    frames = [spark.createDataFrame([(u, t, datetime(2024, 1, 1, 0, 0, ts), e, s) for u, t, ts, e, s in p], schema) for p in parts]
    source = tmp_path / "in"
    for p in frames:
        p.coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = interest_stream(stream).writeStream.format("memory").queryName("weights").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = rows(latest_weights(spark.table("weights")), "user_id", "tag")
    want = rows(feedback.folded_weights(frames[0].union(frames[1])), "user_id", "tag")
    assert [(u, t, pytest.approx(w)) for u, t, w in want] == got


def test_negatives_of_many_bins(spark, monkeypatch):
    monkeypatch.setattr(profiles, "BINS", 4)
    monkeypatch.setattr(profiles, "BIN_ITEMS", 3)
    names = [f"i{n}" for n in range(90)]
    items = spark.createDataFrame([(n,) for n in names], "item_id string")
    history = spark.createDataFrame([("u", n, k) for k, n in enumerate(names[:20])] + [("v", n, k) for k, n in enumerate(names[:88])], "user_id string, item_id string, ts long")
    positives = spark.createDataFrame([("u", n) for n in names[:12]] + [("v", names[3])], "user_id string, item_id string")
    md5 = lambda *key: hashlib.md5("#".join([*key, "42"]).encode()).hexdigest()
    hashed = lambda *key: int(md5(*key)[:8], 16) % 30
    seen = {"u": set(names[:20]), "v": set(names[:88])}
    want = []
    for user, positive in [("u", n) for n in names[:12]] + [("v", names[3])]:
        free = sorted(((hashed(n) - hashed(user, positive)) % 30, md5(user, positive, n), n) for n in names if n not in seen[user])
        want += [(user, positive, n, k + 1) for k, (*_, n) in enumerate(free[:4])]
    got = [tuple(r) for r in profiles.hashed_negatives(positives, items, history, 4).select("user_id", "positive", "item_id", "place").collect()]
    assert sorted(got) == sorted(want)


def test_positives_served_by_their_own_bin_meet_no_other(spark, monkeypatch):
    monkeypatch.setattr(profiles, "BINS", 2)
    monkeypatch.setattr(profiles, "REACH", None)
    names = [f"i{n}" for n in range(60)]
    items = spark.createDataFrame([(n,) for n in names], "item_id string")
    history = spark.createDataFrame([("u", n, k) for k, n in enumerate(names[:3])], "user_id string, item_id string, ts long")
    positives = spark.createDataFrame([("u", n) for n in names[:3]], "user_id string, item_id string")
    md5 = lambda *key: hashlib.md5("#".join([*key, "42"]).encode()).hexdigest()
    hashed = lambda *key: int(md5(*key)[:8], 16) % 2
    want = []
    for positive in names[:3]:
        free = sorted((md5("u", positive, n), n) for n in names[3:] if hashed(n) == hashed("u", positive))
        want += [("u", positive, n, k + 1) for k, (_, n) in enumerate(free[:4])]
    got = [tuple(r) for r in profiles.hashed_negatives(positives, items, history, 4).select("user_id", "positive", "item_id", "place").collect()]
    assert sorted(got) == sorted(want)


def test_item_matches_in_cells(spark, monkeypatch):
    monkeypatch.setattr(interests, "CELL_ITEMS", 3)
    monkeypatch.setattr(interests, "CELL_USERS", 5)
    raw = {(f"i{i}", t): 1 + (i * k) % 4 for i in range(10) for k, t in enumerate("abcde") if (i + k) % 3}
    own = {(f"u{u}", t): 0.01 + (u * (k + 2)) % 7 / 10 for u in range(12) for k, t in enumerate("abcdx") if (u + k) % 4}
    got = interests.item_matches(spark.createDataFrame([(*k, v) for k, v in raw.items()], "item_id string, tag string, raw long"), spark.createDataFrame([(*k, v) for k, v in own.items()] + [("u0", None, 1.0)], "user_id string, tag string, weight double"), 2)
    want = []
    for u in {u for u, _ in own}:
        for i in {i for i, _ in raw}:
            best = sorted((-round(raw[i, t] * own[u, t], 6), t) for t in "abcde" if (i, t) in raw and (u, t) in own and raw[i, t] * own[u, t] >= 0.05)
            want += [(u, i, t, -s, r + 1) for r, (s, t) in enumerate(best[:2])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Window" not in got._jdf.queryExecution().toString()


def test_merged_feedback_keeps_the_latest_known_values(spark, tmp_path):
    from brambleflow.streaming.interest_stream import feedback_of, feedback_store, merge_events, merged_feedback

    schema = "user_id string, item_id string, ts long, event_id long, liked boolean, rating int, comment_text string"
    first = [("u", "a", 1, 1, True, None, "good"), ("u", "b", 1, 2, False, 1, None)]
    second = [("u", "a", 2, 3, None, 4, None), ("v", "a", 2, 4, True, None, None)]
    for name, part in (("1", first), ("2", second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    whole = spark.createDataFrame(first + second, schema)
    source = tmp_path / "in"
    source.mkdir()
    for name in ("1", "2"):
        for file in (tmp_path / name).glob("*.parquet"):
            file.rename(source / f"{name}-{file.name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = merged_feedback(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    columns = ["user_id", "item_id", "liked", "rating", "comment_text"]
    want = rows(feedback.latest_feedback(whole).select(columns), "user_id", "item_id")
    store = feedback_store(spark, str(tmp_path / "out"), "bigint")
    assert rows(feedback_of(store).select(columns), "user_id", "item_id") == want
    # A new checkpoint reads all again; late and repeated events change nothing that is newer.
    query = merged_feedback(stream, str(tmp_path / "out"), str(tmp_path / "other"))
    query.processAllAvailable()
    query.stop()
    merge_events(store, spark.createDataFrame([("u", "a", 0, 9, False, 1, "late")], schema))
    assert rows(feedback_of(store).select(columns), "user_id", "item_id") == want


def test_top_k_in_cells_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dense, "SIDE_BYTES", 9000)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(1300, 6)), 1)
    v[5:60] = v[4]
    ids = [f"n{i}" for i in range(len(v))]
    items = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "item_id string, v array<double>").repartition(3)
    queries = items.withColumnRenamed("item_id", "query_id").where("query_id LIKE 'n1%' OR query_id IN ('n4', 'n5')")
    found = dense.top_k(queries, items, 7, skip_same=True)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # no side is copied to all tasks
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in found.collect()}
    asked = [i for i in ids if i.startswith("n1") or i in ("n4", "n5")]
    assert len(got) == 7 * len(asked)
    for q in asked:
        scores = np.round(v @ v[ids.index(q)], 6) + 0.0
        want = sorted((-s, i) for i, s in zip(ids, scores, strict=True) if i != q)[:7]
        assert [got[q, r + 1] for r in range(7)] == [(i, pytest.approx(-s, abs=1e-9)) for s, i in want]


def test_lsh_meets_pairs_of_a_bucket_without_a_join_of_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(f"n{i}", rng.normal(size=6).tolist()) for i in range(300)], "item_id string, v array<double>")
    found = dense.lsh_top_k(items.withColumnRenamed("item_id", "query_id"), items, 4, bucket=0.1, tables=3, most=0.8)
    assert "Join" not in found._jdf.queryExecution().toString()
    got = sorted((r.query_id, r.item_id, r.score, r["rank"]) for r in found.collect())

    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from brambleflow.operators.ranking import ranked

    unit = lambda key: items.select(F.col("item_id").alias(key), V.normalized(F.col("v")).alias("v")).withColumn("features", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.1, numHashTables=3, seed=42).fit(unit("item_id"))
    near = model.approxSimilarityJoin(unit("query_id"), unit("item_id"), 0.8, "distance").select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.item_id").alias("item_id"), V.dot(F.col("datasetA.v"), F.col("datasetB.v")).alias("score"))
    assert got == sorted((r.query_id, r.item_id, r.score, r["rank"]) for r in ranked(near, ["query_id"], 4).collect())


def test_scored_pairs_meet_only_their_items(spark):
    docs = spark.createDataFrame([(f"d{i}", f"red word{i}" if i % 2 else "red red blue") for i in range(50)], "item_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", "red blue word3") for i in range(40)], "query_id string, text string")
    pairs = spark.createDataFrame([("q1", "d3"), ("q1", "d4"), ("q2", "d4"), ("q2", "none")], "query_id string, item_id string")
    index = bm25.build_index(docs)
    want = {(r.query_id, r.item_id): r.score for r in bm25.scored(index, bm25.query_tokens(queries)).collect()}
    assert bm25.scored(index, bm25.query_tokens(queries), pairs).count() == 3
    got = rows(bm25.score_pairs(index, queries, pairs).select("query_id", "item_id", "score"), "query_id", "item_id")
    assert got == [(q, i, pytest.approx(want.get((q, i), 0.0))) for q, i in [("q1", "d3"), ("q1", "d4"), ("q2", "d4"), ("q2", "none")]]


def test_users_best_items_of_repeated_titles(spark):
    words = ["red", "blue", "ring", "bolt", "rod"]
    items = [(f"i{n:03}", f"{words[n % 5]} {words[n // 5 % 5]}") for n in range(150)]
    log = [(f"u{u}", f"i{(u * 37 + t * 11) % 150:03}", t) for u in range(12) for t in range(4)]
    history = spark.createDataFrame(log, "user_id string, item_id string, ts long")
    titled = spark.createDataFrame(items, "item_id string, title string")
    queries = bm25.user_queries(history, titled)
    seen = history.select(F.col("user_id").alias("query_id"), "item_id").distinct()
    index = bm25.build_index(titled, text="title")
    want = rows(bm25.search(index, queries, 8, seen).select("query_id", "item_id", "score", "rank"), "query_id", "rank")
    assert rows(bm25.recommend_users(history, titled, 8).select("user_id", "item_id", "score", "rank"), "user_id", "rank") == want


def test_tag_sums_of_pairs_and_largest_sums(spark):
    scores = spark.createDataFrame([(f"i{n}", t, 1 + n % 3) for n in range(30) for t in ("a", "b")] + [("top", "a", 9)], "item_id string, tag string, raw long")
    weights = spark.createDataFrame([("u", "a", 0.5), ("u", "b", 0.25), ("v", "b", 1.0)], "user_id string, tag string, weight double")
    pairs = spark.createDataFrame([("u", "i0"), ("u", "i1"), ("v", "i1"), ("v", "top"), ("w", "i1")], "user_id string, item_id string")
    assert rows(interests.tag_sums(pairs, scores, weights), "user_id", "item_id") == [("u", "i0", 0.75), ("u", "i1", 1.5), ("v", "i1", 2.0)]
    assert rows(interests.largest_sums(scores, weights), "user_id") == [("u", 4.5), ("v", 3.0)]
    base = pairs.withColumn("rank_score", F.lit(0.5))
    none = pairs.limit(0)
    every = pairs.select("user_id").distinct().crossJoin(scores.select("item_id").distinct())
    lists = [interests.personalized(base, none.withColumn("score", F.lit(0.0)), none, none, *own) for own in ((interests.tag_sums(every, scores, weights), 8), (interests.tag_sums(base, scores, weights), 8, interests.largest_sums(scores, weights)))]
    assert rows(lists[0], "user_id", "rank") == rows(lists[1], "user_id", "rank")


def test_first_groups_hold_all_users_that_a_matrix_takes(spark):
    from brambleflow.operators import ltr

    counts = spark.createDataFrame([("a", 0), ("b", 3), ("c", 0), ("d", 4), ("e", 5), ("f", 9)], "user_id string, rows long")
    users = lambda n: [r.user_id for r in ltr.first_groups(counts, n).orderBy("user_id").collect()]
    assert users(3) == ["a", "b"] and users(4) == ["a", "b", "c", "d"] and users(12) == list("abcde") and users(100) == list("abcdef")
    found = [(u, f"i{n}", 1.0, n + 1) for u, each in (("a", 1), ("b", 3), ("d", 6), ("e", 5), ("f", 9)) for n in range(each)]
    candidates = spark.createDataFrame(found, "user_id string, item_id string, score double, rank int")
    truth = spark.createDataFrame([(u, "i0") for u in "abcdef"], "user_id string, item_id string")
    for n in (3, 5, 9, 12, 40):
        own = candidates.join(ltr.first_groups(counts, n), "user_id", "left_semi")
        assert rows(ltr.training_matrix(own, truth, n), "user_id", "rank") == rows(ltr.training_matrix(candidates, truth, n), "user_id", "rank")


def test_text_recall_meets_each_distinct_text_once(spark, monkeypatch):
    from brambleflow.operators.ranking import last_n, ranked
    from brambleflow.plans import service

    folder, own, top, asked = "/root/testdata/sf0.001", views.items, dense.cosine_top_k, []
    twice = lambda s, d: own(s, d).unionByName(own(s, d).withColumn("item_id", F.concat(F.lit("1x"), "item_id")))
    monkeypatch.setattr(views, "items", twice)
    monkeypatch.setattr(dense, "cosine_top_k", lambda q, i, k, **more: (asked.append((q, i)), top(q, i, k, **more))[1])
    got = rows(service.bert_user_recommend(spark, folder).select("user_id", "item_id", "score", "rank"), "user_id", "rank")
    assert asked[0][1].count() * 2 <= twice(spark, folder).count()
    seen = last_n(views.history(spark, folder), 5).select(F.col("user_id").alias("query_id"), "item_id").distinct()
    every = top(asked[0][0], service._encoded(service._item_texts(spark, folder), "item_id"), 15).drop("rank").join(seen, ["query_id", "item_id"], "left_anti")
    assert got == rows(ranked(every, ["query_id"], 10).select("query_id", "item_id", "score", "rank"), "query_id", "rank")


def test_placed_history_is_placed_among_all_rows(spark):
    log = spark.createDataFrame([("u", f"i{t}", t) for t in range(1, 8)] + [("w", "i1", 1)], "user_id string, item_id string, ts long")
    f = spark.createDataFrame([("i1", [1.0, 0.0]), ("i5", [0.0, 1.0]), ("i6", [1.0, 1.0])], "item_id string, v array<double>")
    own = profiles.placed(log, f)
    assert [(r.user_id, r.item_id, r.pos, r["size"]) for r in own.orderBy("user_id", "pos").collect()] == [("u", "i6", 2, 7), ("u", "i5", 3, 7), ("u", "i1", 7, 7), ("w", "i1", 1, 1)]
    assert profiles.placed(own, f) is own
    assert rows(profiles.history_halves(own, 4).select("item_id", "pos", "half"), "pos") == rows(profiles.history_halves(log, 4).join(f, "item_id").select("item_id", "pos", "half"), "pos")
    assert rows(profiles.interest_set(own, f, 2), "user_id", "number") == rows(profiles.interest_set(log, f, 2), "user_id", "number")


def test_attention_gives_the_mean_similarity_of_a_pair_with_its_history(spark):
    history = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "user_id string, item_id string, pos int")
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 4.0])], "item_id string, v array<double>")
    pairs = spark.createDataFrame([("u", "c"), ("u", "none")], "user_id string, item_id string")
    found = rows(rerank.attention_pooled(pairs, history, f, 2, mean=True), "item_id")
    # Weights 3/11 and 8/11: the pooled vector is (3/11, 16/11).
    assert found[0][2:] == pytest.approx(((9 + 64) / math.hypot(3, 16) / 5, 0.7)) and found[1][2:] == (0.0, 0.0)


def test_user_ids_with_the_separator_of_query_ids(spark):
    interests = spark.createDataFrame([("a#1", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0])], "user_id string, number int, v array<double>")
    items = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "item_id string, v array<double>")
    none = spark.createDataFrame([], "user_id string, item_id string")
    assert [(r.user_id, r.item_id) for r in dense.proxy_recall(interests, items, none, 1).orderBy("user_id").collect()] == [("a", "y"), ("a#1", "x")]


def test_best_pairs_come_from_cells_of_bounded_size(spark, monkeypatch):
    words = [f"w{n}" for n in range(12)]
    docs = [(f"d{n:03d}", " ".join(words[(n * m) % 12] for m in range(1, 2 + n % 6))) for n in range(90)] + [(f"e{n}", "w1 w2 w3") for n in range(20)]
    docs = spark.createDataFrame(docs, "item_id string, text string")
    queries = bm25.query_tokens(spark.createDataFrame([("q", "w1 w2 w2"), ("r", "w3 w4 w5 zinc"), ("s", "zinc")], "query_id string, text string"))
    index = bm25.build_index(docs)
    all_pairs = bm25.scored(index, queries).where("score > 0").drop("items").collect()
    want = {q: sorted((-round(r.score, 6), r.item_id) for r in all_pairs if r.query_id == q)[:7] for q in "qr"}
    monkeypatch.setattr(bm25, "POSTINGS", 5)
    monkeypatch.setattr(bm25, "PAIRS", 7)
    found = bm25.best(index, queries, 7).collect()
    assert {q: sorted((-round(r.score, 6), r.item_id) for r in found if r.query_id == q)[:7] for q in "qr"} == want
    assert {r.query_id for r in found} == {"q", "r"} and all(r["items"] == 1 for r in found)
    whole = {(r.query_id, r.item_id) for r in bm25.best(index, queries, 7, ties=True).collect()}
    for q in "qr":
        least = -want[q][-1][0] - 1e-6
        assert {r.item_id for r in all_pairs if r.query_id == q and r.score > least} <= {i for p, i in whole if p == q}
    monkeypatch.setattr(bm25, "POSTINGS", 1 << 19)
    assert len([r for r in bm25.best(index, queries, 7).collect() if r.query_id == "q" and r.item_id[0] == "e"]) <= 7


def test_a_cell_has_a_bounded_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "CELL_QUERIES", 4)
    vecs = spark.createDataFrame([(f"v{n:03d}", [math.cos(n), math.sin(n)]) for n in range(64)], "item_id string, v array<double>").repartition(16)
    cells = dense._in_cells(vecs.withColumnRenamed("item_id", "query_id"), vecs, lambda q, a, i, b: (__import__("numpy").arange(len(q)), __import__("numpy").zeros(len(q), int), __import__("numpy").full(len(q), float(len(q)))))
    # Every query is in one cell of each group of items; 16 groups of blocks by a hash.
    held = cells.collect()
    assert len(held) == 64 and max(r.score for r in held) < 64


def test_items_pass_by_the_queries_of_a_task_and_leave_k_rows_a_query(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(1300, 4)), 1)
    v[30:70] = v[29]  # ties that chunks cut
    rows = [(f"n{i}", x.tolist()) for i, x in enumerate(v)]

    def want(n):
        scores = np.round(v @ v[n], 6) + 0.0
        best = sorted((-s, i) for (i, _), s in zip(rows, scores, strict=True) if i != rows[n][0])[:6]
        return [(i, pytest.approx(-s, abs=1e-9)) for s, i in best]

    items = spark.createDataFrame(rows, "item_id string, v array<double>").repartition(5)
    monkeypatch.setattr(dense, "SIDE_BYTES", 1000)
    merged, own = [], dense.ranked
    monkeypatch.setattr(dense, "ranked", lambda df, *more: (merged.append(df), own(df, *more))[1])
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in dense.top_k(items.withColumnRenamed("item_id", "query_id"), items, 6, skip_same=True).collect()}
    assert merged[0].count() == len(rows) * 6
    # Few queries: the items are dealt to several tasks.
    few = dense.top_k(items.where("item_id IN ('n3', 'n40')").withColumnRenamed("item_id", "query_id"), items, 6, skip_same=True)
    assert {(r.query_id, r["rank"]): (r.item_id, r.score) for r in few.collect()} == {at: x for at, x in got.items() if at[0] in ("n3", "n40")}
    assert merged[1].count() > 2 * 6
    # One task: queries, then items by id in small blocks, met a few at a time.
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    monkeypatch.setattr(dense, "PASSING", 40)
    block = lambda asks, at: pa.RecordBatch.from_pylist([{"asks": asks, "ids": [rows[i][0] for i in at], "vecs": v[at].tobytes()}])
    batches = [block(True, list(range(20, 80)))] + [block(False, order[at : at + 17]) for at in range(0, len(order), 17)]
    lists = {}
    for batch in dense._passed(6, True)(batches):
        for r in batch.to_pylist():
            lists.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    for n in range(20, 80):
        assert [got[rows[n][0], r + 1] for r in range(6)] == want(n) and lists[rows[n][0]] == want(n)
