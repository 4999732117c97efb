"""Queries of histories, evaluation, interests, feedback and preparation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import averaged, normalized
from ..operators import bm25, dense, evaluation, feedback, interests, preparation, profiles
from ..operators.neighbours import neighbour_graph
from ..operators.ranking import last_n, ranked
from ..sources.config import settled
from . import recall as R
from . import views as V
from .views import TEXT_SIZE, with_views

K, HELD_OUT = 10, 2


def dense_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return V.history(spark, d)


def leave_last_n_split(spark: SparkSession, d: str) -> DataFrame:
    train, truth = profiles.leave_last_n(V.history(spark, d))
    return train.withColumn("part", F.lit("train")).unionByName(truth.withColumn("part", F.lit("truth")))


def kcore_filter(spark: SparkSession, d: str) -> DataFrame:
    return profiles.activity_between(V.history(spark, d), 5, 30)


def first_n_users(spark: SparkSession, d: str) -> DataFrame:
    return profiles.first_users(V.history(spark, d), 50)


def prefix_expansion(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.prefixes(V.history(spark, d), 3)
    return out.select("user_id", "item_id", "ts", F.array_join("before", " ").alias("before"))


def negatives_md5(spark: SparkSession, d: str) -> DataFrame:
    history = V.history(spark, d)
    _, truth = profiles.leave_last_n(history)
    return profiles.hashed_negatives(truth.select("user_id", "item_id").distinct(), V.items(spark, d), history, 4).withColumn("place", F.col("place").cast("long"))


def cooc_pairs_leave_one(spark: SparkSession, d: str) -> DataFrame:
    return profiles.leave_one_pairs(V.history(spark, d))


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # BM25 asks by the latest titles before those held out; no earlier rows are needed.
    latest = last_n(V.history(spark, d), HELD_OUT + bm25.QUERY_TITLES).drop("pos")
    train, truth = profiles.leave_last_n(settled(latest, "latest"), HELD_OUT)
    return bm25.recommend_users(train, V.items(spark, d), K), truth


def metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(*_evaluated(spark, d), model="bm25")


def candidate_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.diagnostics(*_evaluated(spark, d))


def item_tag_scores(spark: SparkSession, d: str) -> DataFrame:
    return interests.tag_scores(V.items(spark, d), V.dictionary(spark))


def _signs(spark: SparkSession, d: str) -> DataFrame:
    tags = interests.title_tags(V.items(spark, d), V.dictionary(spark))
    return V.feedback_events(spark, d).join(tags, "item_id").select("user_id", "tag", "ts", "event_id", F.when(F.col("liked"), 1).otherwise(-1).alias("sign"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return feedback.folded_weights(_signs(spark, d))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


def interest_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_weights(spark, d), "weight")


def interest_decay(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feedback.decayed(_weights(spark, d)), "weight")


def interest_profile_top5(spark: SparkSession, d: str) -> DataFrame:
    return feedback.top_categories(_weights(spark, d), V.categories(spark))


def item_interest_matches(spark: SparkSession, d: str) -> DataFrame:
    scores = interests.tag_scores(V.items(spark, d), V.dictionary(spark))
    liked = V.feedback_events(spark, d).where("liked").select("item_id").distinct()
    return interests.item_matches(scores.join(liked, "item_id", "left_semi"), _weights(spark, d))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return feedback.latest_feedback(V.feedback_events(spark, d))


def feedback_latest_merge(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("user_id", "item_id", "liked", "rating", _shown("interacted_at"))


def _shown(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def exposure_join(spark: SparkSession, d: str) -> DataFrame:
    out = feedback.exposures_with_feedback(V.exposures(spark, d), _latest(spark, d))
    return out.select("event_id", "user_id", "item_id", F.coalesce(F.col("rating"), F.lit(0)).alias("rating"), "has_feedback")


def interaction_stats(spark: SparkSession, d: str) -> DataFrame:
    return feedback.interaction_stats(V.exposures(spark, d), _latest(spark, d))


def interest_update_batch(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "user_id string, tag string, weight double")
    tags = interests.title_tags(V.items(spark, d), V.dictionary(spark))
    return _rounded(feedback.updated_weights(none, _latest(spark, d), tags, V.categories(spark)), "weight")


def negative_profile(spark: SparkSession, d: str) -> DataFrame:
    disliked = _latest(spark, d).where(feedback.is_negative())
    out = interests.negative_profile(disliked, interests.tag_scores(V.items(spark, d), V.dictionary(spark)))
    return _rounded(out, "weight")


def _tastes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Users with the mean vector of what they liked, and all items with vectors."""
    f = V.features(spark, d).select("item_id", F.col("text_vec").alias("v"))
    liked = _latest(spark, d).where("liked").join(f, "item_id")
    return liked.groupBy("user_id").agg(averaged(F.col("v"), TEXT_SIZE).alias("v")), f


def _interest(spark: SparkSession, d: str, k: int) -> DataFrame:
    scores, weights = interests.tag_scores(V.items(spark, d), V.dictionary(spark)), _weights(spark, d)
    similar = interests.interest_candidates(*_tastes(spark, d), scores, weights, [t for _, t, _ in V.DICTIONARY], k)
    return interests.interest_recommend(similar, scores, weights, k)


def interest_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _interest(spark, d, 20)


def diverse_recommend(spark: SparkSession, d: str) -> DataFrame:
    return interests.diversified(_interest(spark, d, 20), V.features(spark, d).select("item_id", F.col("text_vec").alias("v")), K)


def _base(spark: SparkSession, d: str) -> DataFrame:
    """The fifty nearest items as a query's re-ranked list."""
    users, f = _tastes(spark, d)
    out = dense.cosine_top_k(users.withColumnRenamed("user_id", "query_id"), f, 50)
    return out.select(F.col("query_id").alias("user_id"), "item_id", F.col("score").alias("rank_score"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    latest = _latest(spark, d)
    scores = interests.tag_scores(V.items(spark, d), V.dictionary(spark))
    negative = interests.negative_profile(latest.where(feedback.is_negative()), scores)
    base = _base(spark, d)
    against, most = interests.tag_sums(base, scores, negative), interests.largest_sums(scores, negative)
    return interests.personalized(base, _interest(spark, d, 20), latest.where("liked"), latest.where(feedback.is_negative()), against, 8, most)


def personalize_topk(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d)


def rank_change_lab(spark: SparkSession, d: str) -> DataFrame:
    before = ranked(_base(spark, d), ["user_id"], 8, score="rank_score")
    return interests.rank_changes(before, _personal(spark, d), 8).withColumn("changed_items", F.col("changed_items").cast("long"))


def freq_ordered_items(spark: SparkSession, d: str) -> DataFrame:
    return preparation.item_frequency(V.items(spark, d).select("item_id"), V.history(spark, d), keep_unseen=True)


def anti_existing(spark: SparkSession, d: str) -> DataFrame:
    return V.items(spark, d).select("item_id", "title").join(V.features(spark, d).select("item_id"), "item_id", "left_anti")


def catalog_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return preparation.first_rows(V.items(spark, d).select("item_id", "title", "brand"), ["title"], "item_id")


def augment_similar_users(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d)
    history = profiles.placed(V.history(spark, d), f)
    users = settled(profiles.mean_profile(history, f.select("item_id", F.col("text_vec").alias("v")), TEXT_SIZE), "profiles")
    # Only users with few rows need neighbours.
    few = history.where("size < 20").select("user_id").distinct()
    asked = users.join(few, "user_id", "left_semi").withColumnRenamed("user_id", "query_id")
    near = dense.cosine_top_k(asked, users.withColumnRenamed("user_id", "item_id"), 5, skip_same=True)
    neighbours = near.select(F.col("query_id").alias("user_id"), F.col("item_id").alias("other"), "rank")
    return preparation.similar_user_additions(history, neighbours, least=20, most=3, items=f).withColumn("place", F.col("place").cast("long"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    vectors = V.features(spark, d).select("item_id", F.col("text_vec").alias("v"))
    return profiles.mean_profile(V.history(spark, d), vectors, TEXT_SIZE)


def similar_users_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every user's nearest other users, by cells of common pivots."""
    found = neighbour_graph(_profiles(spark, d).withColumnRenamed("user_id", "item_id"), 5)
    return found.select(F.col("item_id").alias("user_id"), "other", "score", "rank")


def similar_users_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the graph of users finds of the exact lists, and what share of all pairs it compares."""
    users, counted = _profiles(spark, d), []
    found = neighbour_graph(users.withColumnRenamed("user_id", "item_id"), 5, counted=counted).select(F.col("item_id").alias("query_id"), F.col("other").alias("item_id"), F.lit(1).alias("hit"))
    exact = dense.cosine_top_k(users.withColumnRenamed("user_id", "query_id"), users.withColumnRenamed("user_id", "item_id"), 5, skip_same=True)
    n = users.count()
    met = exact.join(found, ["query_id", "item_id"], "left")
    return met.agg(F.count("*").alias("exact"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"), F.round(F.lit(sum(counted) / max(n * (n - 1) / 2, 1)), 6).alias("compared_share"))


def augment_semantic(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).select("item_id", F.col("text_vec").alias("v"))
    near = dense.cosine_top_k(f.withColumnRenamed("item_id", "query_id"), f, 5, skip_same=True)
    near = near.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("other"), "rank")
    return preparation.semantic_additions(V.history(spark, d), near).withColumn("place", F.col("place").cast("long"))


def synthetic_histories(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).select("item_id", F.col("text_vec").alias("v"))
    # An item whose vector is a number throughout finds itself at least, so the anchors are known before any pair is compared.
    whole = f.where(F.forall(normalized(F.col("v")), lambda x: x.isNotNull() & ~F.isnan(x)))
    chosen = preparation.anchors(whole.select(F.col("item_id").alias("anchor"))).select(F.col("anchor").alias("query_id"))
    near = dense.cosine_top_k(f.withColumnRenamed("item_id", "query_id").join(chosen, "query_id", "left_semi"), f, 20)
    return preparation.synthetic_histories(near.select(F.col("query_id").alias("anchor"), "item_id", "rank"))


def intent_fallback_words(spark: SparkSession, d: str) -> DataFrame:
    return V.searches(spark, d).select("query_id", T.first_words(F.col("text"), 8, "fashion").alias("words"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    said = F.concat(F.lit("Sure, here it is: "), F.col("props"), F.lit(" - anything else?"))
    return e.select("event_id", F.get_json_object(T.salvaged_json(said), "$.k").alias("k"))


def anonymised_users(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("user_id"), F.sha2("c_name", 256).alias("name_hash"), T.valid_nickname(F.regexp_replace("c_name", "[^A-Za-z0-9_-]", "_")).alias("valid"))


def persona_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return ranked(_weights(spark, d), ["user_id"], 3, score="weight", item="tag")


def newest_liked(spark: SparkSession, d: str) -> DataFrame:
    liked = _latest(spark, d).where("liked").select("user_id", "item_id", "rating", "interacted_at")
    return feedback.newest(liked, 5, "interacted_at", "item_id").withColumn("interacted_at", _shown("interacted_at"))


def tag_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return V.categories(spark).groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


def store_violations(spark: SparkSession, d: str) -> DataFrame:
    users = V.history(spark, d).select("user_id").distinct()
    return preparation.violations(users, _weights(spark, d), _latest(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        dense_ordinal, leave_last_n_split, kcore_filter, first_n_users, prefix_expansion, negatives_md5, cooc_pairs_leave_one, metrics_at_k, candidate_diagnostics, item_tag_scores,
        interest_fold, interest_decay, interest_profile_top5, item_interest_matches, feedback_latest_merge, exposure_join, interaction_stats, interest_update_batch, negative_profile,
        interest_recommend, diverse_recommend, personalize_topk, rank_change_lab, freq_ordered_items, anti_existing, catalog_dedupe_first, augment_similar_users, similar_users_graph, similar_users_recall, augment_semantic,
        synthetic_histories, intent_fallback_words, json_salvage, anonymised_users, persona_snapshot, newest_liked, tag_catalogue, store_violations,
    )
}

# SQL.

_RECS = R.bm25_views("SELECT item_id, title AS text FROM items", R.USER_TEXT.format("recent")) | {
    "recent": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS pos FROM train",
    "recs": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id AS user_id, item_id, round(score, 6) AS score FROM scored s WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = s.query_id AND r.item_id = s.item_id AND pos <= 5)) QUALIFY rank <= 10",
    "wanted": "SELECT DISTINCT user_id, item_id FROM truth",
    "hits": "SELECT r.user_id, r.item_id, r.rank, (w.item_id IS NOT NULL)::INT AS hit FROM recs r LEFT JOIN wanted w USING (user_id, item_id)",
    "gt": "SELECT user_id, count(*) AS n FROM wanted GROUP BY user_id",
}
_RECS = {"recent": _RECS["recent"], **{k: v for k, v in _RECS.items() if k != "recent"}}


def _metrics(k: int) -> str:
    return f"""SELECT gt.user_id, coalesce(h / {k}.0::DOUBLE, 0) AS precision, coalesce(h / n, 0) AS recall, coalesce(g / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, {k}) + 1) t(i)), 0) AS ndcg,
  coalesce(a / least(n, {k}), 0) AS map, coalesce((h > 0)::INT::DOUBLE, 0) AS hit_rate
FROM gt LEFT JOIN (SELECT user_id, sum(hit) AS h, sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g, sum(CASE WHEN hit = 1 THEN f / rank ELSE 0 END) AS a
  FROM (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS f FROM hits WHERE rank <= {k}) GROUP BY user_id) m USING (user_id)"""


def _long(k: int) -> str:
    return " UNION ALL ".join(f"SELECT 'bm25' AS model, '{m}' AS metric, {k} AS k, round(avg({m}), 6) AS value FROM m{k}" for m in evaluation.METRICS)


_SIMILAR = {
    "liked": "SELECT user_id, item_id FROM feedback WHERE liked",
    "mean_v": "SELECT user_id, list(m ORDER BY j) AS v FROM (SELECT user_id, j, avg(x) AS m FROM (SELECT user_id, unnest(text_vec) AS x, generate_subscripts(text_vec, 1) AS j FROM liked JOIN features USING (item_id)) GROUP BY user_id, j) GROUP BY user_id",
    "every_near": "SELECT u.user_id, f.item_id, round(" + R.cos("u.v", "f.text_vec") + ", 6) + 0.0 AS similarity FROM mean_v u JOIN features f ON true",
    "nearby": "SELECT * FROM every_near QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) <= 50",
    "wtags": "SELECT user_id, item_id, sum(raw * weight) / (6.0::DOUBLE * any_value(n)) AS tags FROM tag_scores JOIN weights USING (tag) JOIN (SELECT user_id, count(*) AS n FROM weights GROUP BY user_id) USING (user_id) GROUP BY user_id, item_id",
    "interest": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT user_id, item_id, round(0.7::DOUBLE * similarity + 0.3::DOUBLE * coalesce(tags, 0), 6) + 0.0 AS score FROM every_near LEFT JOIN wtags USING (user_id, item_id)) QUALIFY rank <= 20",
}
_NEGATIVE = {
    "disliked": "SELECT user_id, item_id FROM feedback WHERE coalesce(NOT liked, false) OR coalesce(rating <= 2, false)",
    "top_tags": "SELECT item_id, tag, raw FROM tag_scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, tag) <= 3",
    "negative": "SELECT user_id, tag, s / max(s) OVER (PARTITION BY user_id) AS weight FROM (SELECT user_id, tag, sum(raw)::DOUBLE AS s FROM disliked JOIN top_tags USING (item_id) GROUP BY user_id, tag)",
}
_PERSONAL = _SIMILAR | _NEGATIVE | {
    "against": "SELECT user_id, item_id, s / max(s) OVER (PARTITION BY user_id) AS neg FROM (SELECT user_id, item_id, sum(raw * weight) AS s FROM tag_scores JOIN negative USING (tag) GROUP BY user_id, item_id)",
    "unit_i": "SELECT user_id, item_id, score / max(score) OVER (PARTITION BY user_id) AS i FROM interest",
    "own": "SELECT s.user_id, s.item_id, similarity AS s FROM nearby s LEFT JOIN disliked d USING (user_id, item_id) QUALIFY d.item_id IS NULL OR count(*) FILTER (WHERE d.item_id IS NULL) OVER (PARTITION BY s.user_id) = 0",
    "own_i": "SELECT o.user_id, o.item_id, s, coalesce(neg, 0) AS n, CASE WHEN l.item_id IS NOT NULL THEN CASE WHEN i IS NULL THEN 0.7::DOUBLE ELSE greatest(i, 0.8::DOUBLE) END ELSE coalesce(i, 0) END AS i FROM own o LEFT JOIN unit_i USING (user_id, item_id) LEFT JOIN against USING (user_id, item_id) LEFT JOIN liked l USING (user_id, item_id)",
    "kept": "SELECT user_id, item_id, CASE WHEN round(n, 6) > 0.3 THEN 0.30::DOUBLE * s + 0.50::DOUBLE * i - 0.35::DOUBLE * n WHEN round(i, 6) > 0.1 THEN 0.35::DOUBLE * s + 0.50::DOUBLE * i - 0.10::DOUBLE * n + 0.05::DOUBLE ELSE 0.45::DOUBLE * s + 0.35::DOUBLE * i - 0.10::DOUBLE * n END AS final_score, 'base' AS origin FROM own_i",
    "more": "SELECT user_id, item_id, 0.65::DOUBLE * i + 0.05::DOUBLE AS final_score, 'interest' AS origin FROM (SELECT u.user_id, u.item_id, round(u.i, 6) AS i FROM unit_i u ANTI JOIN nearby s ON s.user_id = u.user_id AND s.item_id = u.item_id) x ANTI JOIN disliked d ON d.user_id = x.user_id AND d.item_id = x.item_id QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC, item_id) <= 2",
    "personal": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, item_id)::INT AS rank FROM (SELECT user_id, item_id, round(final_score, 6) + 0.0 AS final_score, origin FROM (SELECT * FROM kept UNION ALL SELECT * FROM more)) QUALIFY rank <= 8",
}
ORACLES = {
    "dense_ordinal": with_views("SELECT user_id, item_id, ts FROM history"),
    "leave_last_n_split": with_views("SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'truth' FROM truth"),
    "kcore_filter": with_views("SELECT user_id, item_id, ts FROM sized WHERE n BETWEEN 5 AND 30"),
    "first_n_users": with_views("SELECT user_id, item_id, ts FROM history WHERE user_id IN (SELECT DISTINCT user_id FROM history ORDER BY user_id LIMIT 50)"),
    "prefix_expansion": with_views("SELECT user_id, item_id, ts, array_to_string(list_reverse(b), ' ') AS before FROM (SELECT *, list(item_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history) WHERE ts > 3"),
    "negatives_md5": with_views(
        "SELECT user_id, positive, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, positive ORDER BY ahead, md5(concat_ws('#', user_id, positive, item_id, '42')), item_id) AS place FROM met) WHERE place <= 4",
        nb="SELECT greatest(64, count(DISTINCT item_id) // 32) AS bins FROM items",
        asked=f"SELECT user_id, item_id AS positive, {R.HEX.format("concat_ws('#', user_id, item_id, '42')")} % bins AS bin FROM (SELECT DISTINCT user_id, item_id FROM truth), nb",
        slots=f"SELECT DISTINCT item_id, {R.HEX.format("concat_ws('#', item_id, '42')")} % bins AS bin FROM items, nb",
        seen_all="SELECT DISTINCT user_id, item_id FROM history",
        met="SELECT a.user_id, a.positive, s.item_id, (s.bin - a.bin + bins) % bins AS ahead FROM nb, asked a JOIN slots s ON s.item_id <> a.positive ANTI JOIN seen_all h ON h.user_id = a.user_id AND h.item_id = s.item_id",
    ),
    "cooc_pairs_leave_one": with_views("SELECT user_id, item_id, ts, string_agg(other, ' ' ORDER BY other_ts) AS others FROM (SELECT a.user_id, a.item_id, a.ts, b.item_id AS other, b.ts AS other_ts FROM history a JOIN history b ON a.user_id = b.user_id AND a.ts <> b.ts QUALIFY row_number() OVER (PARTITION BY a.user_id, a.ts ORDER BY b.ts) <= 5) GROUP BY user_id, item_id, ts"),
    "metrics_at_k": with_views(f"{_long(5)} UNION ALL {_long(10)}", **_RECS, m5=_metrics(5), m10=_metrics(10)),
    "candidate_diagnostics": with_views(
        "SELECT count(*) AS users, count(f) AS hit_users, round(count(s) / count(*), 6) AS non_empty_rate, round(count(f) / count(*), 6) AS hit_rate, round(avg(coalesce(s, 0)), 6) AS mean_size, round(avg(f), 6) AS mean_first_hit FROM gt LEFT JOIN (SELECT user_id, count(*) AS s, min(rank) FILTER (WHERE hit = 1) AS f FROM hits GROUP BY user_id) USING (user_id)", **_RECS
    ),
    "item_tag_scores": with_views("SELECT item_id, tag, raw FROM tag_scores"),
    "interest_fold": with_views("SELECT user_id, tag, round(weight, 6) AS weight FROM weights"),
    "interest_decay": with_views("SELECT user_id, tag, round(greatest(0.1::DOUBLE, 0.95::DOUBLE * weight), 6) AS weight FROM weights"),
    "interest_profile_top5": with_views("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category)::INT AS rank FROM (SELECT user_id, category, round(sum(weight), 6) AS total FROM weights JOIN categories USING (tag) GROUP BY user_id, category) QUALIFY rank <= 5"),
    "item_interest_matches": with_views("SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY score DESC, tag)::INT AS rank FROM (SELECT user_id, item_id, tag, round(raw * weight, 6) AS score FROM tag_scores JOIN weights USING (tag) WHERE raw * weight >= 0.05 AND item_id IN (SELECT item_id FROM feedback_events WHERE liked)) QUALIFY rank <= 3"),
    "feedback_latest_merge": with_views("SELECT user_id, item_id, liked, rating, strftime(interacted_at, '%Y-%m-%d %H:%M:%S') AS interacted_at FROM feedback"),
    "exposure_join": with_views("SELECT e.event_id, e.user_id, e.item_id, coalesce(rating, 0) AS rating, (f.item_id IS NOT NULL)::INT AS has_feedback FROM exposures e LEFT JOIN feedback f USING (user_id, item_id)"),
    "interaction_stats": with_views("SELECT e.user_id, count(*) AS total_exposures, count(f.item_id)::BIGINT AS total_interactions, count(*) FILTER (WHERE liked)::BIGINT AS total_likes, count(rating)::BIGINT AS total_ratings, round(coalesce(avg(rating), 0), 2) AS average_rating FROM exposures e LEFT JOIN feedback f USING (user_id, item_id) GROUP BY e.user_id"),
    "interest_update_batch": with_views(
        "SELECT user_id, tag, round(greatest(0.05::DOUBLE, least(1::DOUBLE, 0.72::DOUBLE * 0.35::DOUBLE + 0.38::DOUBLE * sum(p) - 0.52::DOUBLE * sum(n))), 6) AS weight FROM shares GROUP BY user_id, tag",
        marks="SELECT user_id, category, tag, sum(CASE WHEN liked OR rating >= 4 THEN 1 + 0.3::DOUBLE * (rating - 3) ELSE 0 END) AS pos, sum(CASE WHEN NOT (liked OR rating >= 4) AND (NOT liked OR rating <= 2) THEN 0.9::DOUBLE + 0.25::DOUBLE * greatest(3 - rating, 0) ELSE 0 END) AS neg FROM feedback JOIN title_tags USING (item_id) JOIN categories USING (tag) GROUP BY user_id, category, tag",
        shares="SELECT user_id, tag, CASE WHEN max(pos) OVER w > 0 THEN least(pos / (2 * max(pos) OVER w), 1) ELSE 0 END AS p, CASE WHEN max(neg) OVER w > 0 THEN least(neg / (2 * max(neg) OVER w), 1) ELSE 0 END AS n FROM marks WHERE pos > 0 OR neg > 0 WINDOW w AS (PARTITION BY user_id, category)",
    ),
    "negative_profile": with_views("SELECT user_id, tag, round(weight, 6) AS weight FROM negative", **_NEGATIVE),
    "interest_recommend": with_views("SELECT * FROM interest", **_SIMILAR),
    "diverse_recommend": with_views(
        "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT user_id, item_id, round(0.7::DOUBLE * CASE WHEN m > 0 THEN score / m ELSE 0 END + 0.3::DOUBLE * (1 - coalesce(least_cos, 0)), 6) + 0.0 AS score FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS m FROM interest JOIN features USING (item_id)) LEFT JOIN far USING (user_id, item_id)) QUALIFY rank <= 10",
        **_SIMILAR,
        far="SELECT a.user_id, a.item_id, min(" + R.cos("fa.text_vec", "fb.text_vec") + ") AS least_cos FROM interest a JOIN interest b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN features fa ON fa.item_id = a.item_id JOIN features fb ON fb.item_id = b.item_id GROUP BY a.user_id, a.item_id",
    ),
    "personalize_topk": with_views("SELECT * FROM personal", **_PERSONAL),
    "rank_change_lab": with_views(
        "SELECT user_id, (count(*) FILTER (WHERE a IS DISTINCT FROM b AND b IS NOT NULL))::BIGINT AS changed_items, (count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL))::BIGINT AS overlap_count, max((coalesce(a, 0) = 1 AND coalesce(b, 0) = 1)::INT) = 0 AS top1_changed FROM met GROUP BY user_id",
        **_PERSONAL,
        before_="SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) AS a FROM nearby QUALIFY a <= 8",
        met="SELECT user_id, item_id, a, p.rank AS b FROM before_ FULL JOIN personal p USING (user_id, item_id)",
    ),
    "freq_ordered_items": with_views("SELECT item_id, coalesce(freq, 0) AS freq FROM items LEFT JOIN (SELECT item_id, count(*) AS freq FROM history GROUP BY item_id) USING (item_id)"),
    "anti_existing": with_views("SELECT item_id, title FROM items ANTI JOIN features USING (item_id)"),
    "catalog_dedupe_first": with_views("SELECT item_id, title, brand FROM items QUALIFY row_number() OVER (PARTITION BY title ORDER BY item_id) = 1"),
    "augment_similar_users": with_views(
        "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY first_at, item_id) AS place FROM (SELECT n.user_id, h.item_id, min((-n.rank, h.ts)) AS first_at FROM near n JOIN few USING (user_id) JOIN history h ON h.user_id = n.other WHERE h.item_id IN (SELECT item_id FROM features) AND NOT EXISTS (SELECT 1 FROM history o WHERE o.user_id = n.user_id AND o.item_id = h.item_id) GROUP BY n.user_id, h.item_id) QUALIFY place <= 3",
        long_p=R.UNIT.format("long_vec", "SELECT user_id, list(m ORDER BY j) AS m FROM (SELECT user_id, j, avg(x) AS m FROM (SELECT user_id, unnest(text_vec) AS x, generate_subscripts(text_vec, 1) AS j FROM history JOIN features USING (item_id)) GROUP BY user_id, j) GROUP BY user_id"),
        near="SELECT user_id, other, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, other) AS rank FROM (SELECT a.user_id, b.user_id AS other, round(" + R.cos("a.long_vec", "b.long_vec") + ", 6) AS score FROM long_p a JOIN long_p b ON a.user_id <> b.user_id) QUALIFY rank <= 5",
        few="SELECT user_id FROM history GROUP BY user_id HAVING count(*) < 20",
    ),
    "augment_semantic": with_views(
        "SELECT user_id, other AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY first_at, other) AS place FROM (SELECT l.user_id, n.other, min((l.pos, -n.rank)) AS first_at FROM latest l JOIN near n ON n.item_id = l.item_id WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = l.user_id AND h.item_id = n.other) GROUP BY l.user_id, n.other) QUALIFY place <= 5",
        near="SELECT item_id, other, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other) AS rank FROM (SELECT a.item_id, b.item_id AS other, round(" + R.cos("a.text_vec", "b.text_vec") + ", 6) AS score FROM features a JOIN features b ON a.item_id <> b.item_id) QUALIFY rank <= 5",
    ),
    "synthetic_histories": with_views(
        "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank, item_id) AS ts FROM pools JOIN anchors USING (anchor) QUALIFY ts <= 8",
        pools="SELECT anchor, item_id, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, item_id) AS rank FROM (SELECT a.item_id AS anchor, b.item_id, round(" + R.cos("a.text_vec", "b.text_vec") + ", 6) + 0.0 AS score FROM features a JOIN features b ON true) QUALIFY rank <= 20",
        anchors="SELECT anchor, 'synthetic_' || md5(anchor) AS user_id FROM (SELECT DISTINCT anchor FROM pools) ORDER BY md5(concat_ws('#', anchor, '42')), anchor LIMIT 80",
    ),
    "intent_fallback_words": "SELECT item_id::VARCHAR AS query_id, CASE WHEN t = '' THEN 'fashion' ELSE array_to_string(string_split(t, ' ')[1:8], ' ') END AS words FROM (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM benchmark)",
    "json_salvage": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "anonymised_users": "SELECT c_custkey AS user_id, sha256(c_name) AS name_hash, length(trim(c_name)) >= 3 AND regexp_matches(c_name, '[A-Za-z0-9]') AS valid FROM customer",
    "persona_snapshot": with_views("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, tag)::INT AS rank FROM (SELECT user_id, tag, round(weight, 6) AS weight FROM weights) QUALIFY rank <= 3"),
    "newest_liked": with_views("SELECT user_id, item_id, rating, strftime(interacted_at, '%Y-%m-%d %H:%M:%S') AS interacted_at FROM feedback WHERE liked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY feedback.interacted_at DESC, item_id DESC) <= 5"),
    "tag_catalogue": with_views("SELECT category, string_agg(tag, ',' ORDER BY tag) AS tags FROM categories GROUP BY category"),
    "store_violations": with_views("SELECT 'interest_user' AS rule, (SELECT count(*) FROM weights WHERE user_id NOT IN (SELECT user_id FROM history)) AS n UNION ALL SELECT 'feedback_user', (SELECT count(*) FROM feedback WHERE user_id NOT IN (SELECT user_id FROM history)) UNION ALL SELECT 'interest_twice', 0 UNION ALL SELECT 'rating_range', (SELECT count(*) FROM feedback WHERE rating NOT BETWEEN 1 AND 5)"),
}
