"""Queries of accounts, interests, reports, text retrieval and comparisons of models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, rounded
from ..operators import bm25, dense, evaluation, feedback, fusion, interests, preparation, profiles, rerank
from ..operators.ranking import last_n, ranked
from ..sources.config import settled
from . import behaviour as B
from . import recall as R
from . import views as V
from .views import TEXT_SIZE, with_views

K, POOL, HASHED = 10, 50, R.HASHED


def _item_texts(spark: SparkSession, d: str) -> DataFrame:
    return V.items(spark, d).select("item_id", T.item_text(F.col("title"), F.col("brand"), F.col("category"), F.col("description")).alias("text"))


def _encoded(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, T.hashed_vector(F.col("text"), HASHED).alias("v")).where("v IS NOT NULL")


def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    return R.text_vectors(spark, d).select("item_id", rounded(F.col("v")).alias("v"))


def bert_search(spark: SparkSession, d: str) -> DataFrame:
    """Items by their texts' vectors for every search."""
    return dense.cosine_top_k(_encoded(V.searches(spark, d), "query_id"), _encoded(_item_texts(spark, d), "item_id"), K)


def _by_text(spark: SparkSession, d: str, history: DataFrame, k: int) -> DataFrame:
    """Items near the vector of a user's five latest texts, without these items.

    Texts repeat, so queries meet distinct texts under their first items' ids; a
    text's first items stand for it as long as fewer than are wanted score better.
    """
    items, most = _item_texts(spark, d), k + bm25.QUERY_TITLES
    queries = bm25.user_queries(history, items.withColumnRenamed("text", "title"))
    seen = last_n(history, bm25.QUERY_TITLES).select(F.col("user_id").alias("query_id"), "item_id").distinct()
    texts = items.groupBy("text").agg(F.min("item_id").alias("item_id"), F.least(F.count("*"), F.lit(most)).alias("items"))
    found = dense.cosine_top_k(_encoded(queries, "query_id"), _encoded(texts, "item_id"), most).drop("rank").join(texts, "item_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    count = lambda first: F.sum("items").over(order.rangeBetween(first, Window.currentRow))
    found = found.withColumn("better", count(Window.unboundedPreceding) - count(Window.currentRow)).where(F.col("better") < most).select("query_id", "text", "score")
    first = items.withColumn("place", F.row_number().over(Window.partitionBy("text").orderBy("item_id"))).where(F.col("place") <= most).drop("place")
    found = found.join(first, "text").join(seen, ["query_id", "item_id"], "left_anti").select("query_id", "item_id", "score")
    return ranked(found, ["query_id"], k).withColumnRenamed("query_id", "user_id")


def bert_user_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _by_text(spark, d, V.history(spark, d), K)


def text_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a search by the strategy that it asks for: hybrid fusion or the dense list alone, by turns."""
    index = bm25.build_index(_item_texts(spark, d))
    searches = V.searches(spark, d).withColumn("strategy", F.when(F.md5("query_id") < "8", "hybrid").otherwise("dense"))
    near = bert_search(spark, d)
    sparse = bm25.search(index, searches.where("strategy = 'hybrid'"), POOL)
    return fusion.by_strategy(searches, sparse, near, K).select(*R._SHOWN).fillna(0, ["bm25_rank", "faiss_rank"])


def _model_lists(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    train, truth = profiles.leave_last_n(V.history(spark, d))
    f = R._vectors(V.features(spark, d), "text_vec")
    sparse = settled(bm25.recommend_users(train, V.items(spark, d), K), "sparse")
    own = profiles.placed(train, f)
    near = settled(dense.proxy_recall(profiles.interest_set(own, f, TEXT_SIZE), f, own, K), "near")
    named = lambda df: df.withColumnRenamed("user_id", "query_id")
    both = fusion.rrf(named(sparse), named(near), K).select(F.col("query_id").alias("user_id"), "item_id", F.col("final_score").alias("score"), "rank")
    return {"bm25": sparse, "bert": _by_text(spark, d, train, K), "faiss": near, "hybrid": both}, truth


def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the named models over the same users."""
    lists, truth = _model_lists(spark, d)
    out = None
    for name in evaluation.model_names("bm25,bert,faiss,hybrid"):
        rows = evaluation.evaluate(lists[name], truth, evaluation.cutoffs(K), name)
        out = rows if out is None else out.unionByName(rows)
    return out


def _attentive(spark: SparkSession, d: str) -> DataFrame:
    """Recalled candidates re-ranked by attention to the train history and mean similarity with it."""
    f = R._vectors(V.features(spark, d), "text_vec")
    train = R.placed_train(spark, d)
    pairs = R.user_candidates(spark, d, train=train).where(F.col("rank") <= 20).select("user_id", "item_id")
    return rerank.user_attention(rerank.attention_pooled(pairs, last_n(train, K), f, TEXT_SIZE, mean=True), K)


def rerank_user_attention(spark: SparkSession, d: str) -> DataFrame:
    return _attentive(spark, d).select("user_id", "item_id", "score", "rank")


def compare_text_and_attention(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of text retrieval and of recall with attention."""
    train, truth = profiles.leave_last_n(V.history(spark, d))
    lists = {"bert": _by_text(spark, d, train, K), "attention": _attentive(spark, d)}
    both = [evaluation.evaluate(recs, truth, [K], name) for name, recs in lists.items()]
    return both[0].unionByName(both[1])


def model_deltas(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.deltas(compare_models(spark, d), "bm25")


def compare_fusion_modes(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every fusion mode over the same two lists a user."""
    lists, truth = _model_lists(spark, d)
    sparse, near = (lists[m].withColumnRenamed("user_id", "query_id") for m in ("bm25", "faiss"))
    out = None
    for mode in fusion.MODES:
        recs = fusion.fuse(mode, sparse, near, K).withColumnRenamed("query_id", "user_id")
        rows = evaluation.evaluate(recs, truth, [K], mode)
        out = rows if out is None else out.unionByName(rows)
    return out


def retrieval_dataset(spark: SparkSession, d: str) -> DataFrame:
    train, truth = profiles.leave_last_n(V.history(spark, d))
    out = evaluation.retrieval_dataset(train, truth, _item_texts(spark, d))
    return out.select("query_id", "text", F.array_join("relevant", " ").alias("relevant"))


def evaluated_items(spark: SparkSession, d: str) -> DataFrame:
    train, truth = profiles.leave_last_n(V.history(spark, d))
    return preparation.evaluated_items(V.items(spark, d).select("item_id", "title"), train, truth)


def _with_images(spark: SparkSession, d: str) -> DataFrame:
    """Items with an image address by their number: none, empty or of several endings."""
    n = F.col("item_id").cast("long") % 5
    address = F.concat(F.lit("https://img.example/"), "item_id")
    url = F.when(n == 1, F.lit("")).when(n == 2, F.concat(address, F.lit(".PNG?w=1"))).when(n == 3, F.concat(address, F.lit(".webp"))).when(n == 4, address)
    return V.items(spark, d).select("item_id", url.alias("image_url"))


def image_downloads(spark: SparkSession, d: str) -> DataFrame:
    return preparation.wanted_images(_with_images(spark, d), V.history(spark, d), 100)


def feature_progress(spark: SparkSession, d: str) -> DataFrame:
    return preparation.progress(V.features(spark, d), V.items(spark, d))


def complete_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Items of the catalogue whose text, image and whole vectors are all there."""
    f = V.features(spark, d).where("text_vec IS NOT NULL AND image_vec IS NOT NULL AND v IS NOT NULL")
    return V.items(spark, d).select("item_id").join(f, "item_id", "left_semi")


def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return V.history(spark, d).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count("*").alias("rows"))


def _keywords() -> dict[str, list[str]]:
    return {t: words.split() for _, t, words in V.DICTIONARY}


def _said(spark: SparkSession) -> DataFrame:
    said = sorted({t for _, t, _ in V.DICTIONARY} | {w.upper() for _, _, words in V.DICTIONARY for w in words.split()} | {"Unknown"})
    return spark.createDataFrame([(s,) for s in said], "tag string")


def tag_display(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark).select("tag", T.tag_display(F.col("tag"), {"Ring": "Rings"}, _keywords()).alias("shown"))


def tag_keywords(spark: SparkSession, d: str) -> DataFrame:
    return interests.keywords_of(_said(spark), V.dictionary(spark))


def _against(spark: SparkSession, d: str, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of a user's candidates by the user's interests and dislikes."""
    scores = interests.tag_scores(V.items(spark, d), V.dictionary(spark))
    disliked = feedback.latest_feedback(V.feedback_events(spark, d)).where(feedback.is_negative())
    return interests.tag_sums(base, scores, B._weights(spark, d)), interests.tag_sums(base, scores, interests.negative_profile(disliked, scores))


def report_personalised(spark: SparkSession, d: str) -> DataFrame:
    base = B._base(spark, d)
    out = interests.report_personalized(base, *_against(spark, d, base), 8)
    return B._rounded(out, "generic_score", "personalization_score", "negative_score")


def reason_pills(spark: SparkSession, d: str) -> DataFrame:
    """Why an item stands in a user's report."""
    scores = interests.tag_scores(V.items(spark, d), V.dictionary(spark))
    report = report_personalised(spark, d)
    met = report.select("user_id", "item_id").join(scores, "item_id").join(B._weights(spark, d), ["user_id", "tag"])
    best = ranked(met.select("user_id", "item_id", "tag", (F.col("raw") * F.col("weight")).alias("score")), ["user_id", "item_id"], 2, item="tag")
    listed = best.groupBy("user_id", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag", "score"))), lambda x: F.struct(x["tag"].alias("tag"), x["score"].alias("score"))).alias("tags"))
    pills = T.reason_pills(F.coalesce("tags", F.array().cast("array<struct<tag:string,score:double>>")), F.col("personalization_score"), F.col("negative_score"))
    return report.join(listed, ["user_id", "item_id"], "left").select("user_id", "item_id", F.array_join(pills, "; ").alias("pills"))


def chat_responses(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    found = F.col("p_size") % 3
    occasion = F.when(F.col("p_size") % 2 == 0, "general").otherwise(F.lower("p_brand"))
    return p.select(F.col("p_partkey").alias("item_id"), T.chat_response(F.col("p_type"), [F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_name"))], occasion, found).alias("response"))


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    """Each customer asks for a tag by its number, one with blanks around, a blank one and one of its own."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    tags = F.array(*(F.lit(t) for _, t, _ in V.DICTIONARY))
    n = F.col("c_custkey")
    return c.select(n.cast("string").alias("user_id"), F.explode(F.array(F.get(tags, (n % 7).cast("int")), F.concat(F.lit(" "), F.get(tags, (n % 5).cast("int")), F.lit(" ")), F.lit("  "), F.concat(F.lit("Own"), (n % 3).cast("string")))).alias("tag"))


def _interests(spark: SparkSession, d: str) -> DataFrame:
    return B._rounded(B._weights(spark, d), "weight").join(V.categories(spark), "tag")


def registered_interests(spark: SparkSession, d: str) -> DataFrame:
    return interests.registered(_registrations(spark, d), _interests(spark, d), V.categories(spark))


def replaced_interests(spark: SparkSession, d: str) -> DataFrame:
    asked = _registrations(spark, d).where(F.col("user_id").cast("long") % 2 == 0)
    return interests.registered(asked, _interests(spark, d), V.categories(spark), replace=True)


def account_info(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("nickname"))
    out = interests.accounts(users, _interests(spark, d))
    return out.withColumn("interests", F.array_join("interests", ","))


def recorded_exposures(spark: SparkSession, d: str) -> DataFrame:
    """Exposures with the eight items of each user's report appended."""
    old = V.exposures(spark, d).select("user_id", "item_id", F.col("ts").alias("shown_at"), F.lit(False).alias("interacted"))
    shown = B._base(spark, d).groupBy("user_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank_score")).alias("s"), "item_id"))), lambda x: x["item_id"]), 1, 8).alias("item_ids")).withColumn("shown_at", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return feedback.recorded(old, shown).select("user_id", "item_id", F.date_format("shown_at", "yyyy-MM-dd HH:mm:ss").alias("shown_at"))


def recalculated_weights(spark: SparkSession, d: str) -> DataFrame:
    latest = feedback.latest_feedback(V.feedback_events(spark, d))
    tags = interests.title_tags(V.items(spark, d), V.dictionary(spark))
    return B._rounded(feedback.recalculated(B._weights(spark, d), latest, tags, V.categories(spark)), "weight")


def _tag_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the items with the tags' numbers."""
    numbered = spark.createDataFrame([(t, str(i)) for i, (_, t, _) in enumerate(V.DICTIONARY)], "tag string, item_id string")
    return numbered.join(V.features(spark, d).select("item_id", F.col("text_vec").alias("v")), "item_id").select("tag", "v")


def preference_vectors(spark: SparkSession, d: str) -> DataFrame:
    out = feedback.preference_vectors(B._weights(spark, d), _tag_vectors(spark, d), TEXT_SIZE)
    return out.select("user_id", rounded(F.col("v")).alias("v"))


def rated_items(spark: SparkSession, d: str) -> DataFrame:
    latest = feedback.latest_feedback(V.feedback_events(spark, d))
    return feedback.rated(latest, 4, 100).select("user_id", "item_id", "rating")


def user_item_matrix(spark: SparkSession, d: str) -> DataFrame:
    return feedback.user_item_matrix(feedback.latest_feedback(V.feedback_events(spark, d)))


def report_weights(spark: SparkSession, d: str) -> DataFrame:
    """A report's rows: every account with its interests, their weights and their rank."""
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("nickname"))
    return users.join(ranked(_interests(spark, d), ["user_id"], score="weight", item="tag"), "user_id").select("nickname", "category", "tag", "weight", "rank")


def interest_queries(spark: SparkSession, d: str) -> DataFrame:
    return interests.interest_query(B._rounded(B._weights(spark, d), "weight"), V.dictionary(spark))


QUERIES = {
    f.__name__: f
    for f in (
        text_vectors, bert_search, bert_user_recommend, text_candidates, compare_models, model_deltas, compare_fusion_modes, rerank_user_attention, compare_text_and_attention, retrieval_dataset, evaluated_items, image_downloads, feature_progress,
        complete_candidates, distinct_users, tag_display, tag_keywords, report_personalised, reason_pills, chat_responses, registered_interests, replaced_interests, account_info, recorded_exposures,
        recalculated_weights, preference_vectors, rated_items, user_item_matrix, report_weights, interest_queries,
    )
}

# SQL.

ITEM_TEXT, _vectors_sql = R.ITEM_TEXT, R.hashed_vectors


_BERT = {"item_vec": _vectors_sql(ITEM_TEXT, "item_id")}


def _metric_rows(ks: list[int], recs: str) -> str:
    """Rows of metrics for ``recs`` (model, user_id, item_id, rank)."""
    one = lambda k: f"""SELECT model, count(*) AS users, avg(coalesce(h / {k}.0::DOUBLE, 0)) AS "precision", avg(coalesce(h / n, 0)) AS recall, avg(coalesce(g / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, {k}) + 1) t(i)), 0)) AS ndcg, avg(coalesce(a / least(n, {k}), 0)) AS map, avg(coalesce((h > 0)::INT::DOUBLE, 0)) AS hit_rate
  FROM (SELECT DISTINCT model FROM {recs}) CROSS JOIN (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, item_id FROM truth) GROUP BY user_id) gt
  LEFT JOIN (SELECT model, user_id, sum(hit) AS h, sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g, sum(CASE WHEN hit = 1 THEN f / rank ELSE 0 END) AS a
    FROM (SELECT *, sum(hit) OVER (PARTITION BY model, user_id ORDER BY rank) AS f FROM (SELECT r.*, (w.item_id IS NOT NULL)::INT AS hit FROM {recs} r LEFT JOIN (SELECT DISTINCT user_id, item_id FROM truth) w USING (user_id, item_id)) WHERE rank <= {k}) GROUP BY model, user_id) m USING (model, user_id) GROUP BY model"""  # noqa: E731
    names, values = ", ".join(f"'{m}'" for m in evaluation.METRICS), ", ".join(f'round("{m}", 6)' for m in evaluation.METRICS)
    return " UNION ALL ".join(f"SELECT model, unnest([{names}]) AS metric, {k} AS k, unnest([{values}]) AS value FROM ({one(k)})" for k in ks)


def _top_users(source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ({source}) QUALIFY rank <= {K}"


def _unseen(pos: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = s.user_id AND r.item_id = s.item_id{pos})"


_LISTS = R._TRAINED | R.bm25_views("SELECT item_id, title AS text FROM items", R.USER_TEXT.format("recent")) | R.profile_views("recent") | {
    "near_i": "SELECT *, row_number() OVER (PARTITION BY user_id, number ORDER BY score DESC, item_id) AS r FROM (SELECT user_id, number, f.item_id, round(" + R.cos("i.v", "f.text_vec") + ", 6) AS score FROM interests i JOIN features f ON true) QUALIFY r <= 30",
    "l_bm25": _top_users("SELECT user_id, item_id, score FROM (SELECT query_id AS user_id, item_id, round(score, 6) AS score FROM scored) s WHERE " + _unseen(" AND r.pos <= 5")),
    "l_faiss": _top_users("SELECT user_id, item_id, max(score) AS score FROM near_i s WHERE " + _unseen("") + " GROUP BY user_id, item_id"),
    "pairs_l": "SELECT user_id, item_id, score, rank, 'bm25' AS source FROM l_bm25 UNION ALL SELECT user_id, item_id, score, rank, 'faiss' FROM l_faiss",
}
_MODELS = _LISTS | _BERT | {
    "user_vec": _vectors_sql(f"SELECT user_id AS query_id, string_agg(text, ' ' ORDER BY pos) AS text FROM recent JOIN ({ITEM_TEXT}) USING (item_id) WHERE pos <= 5 GROUP BY user_id", "query_id"),
    "l_bert": _top_users("SELECT * FROM (SELECT u.query_id AS user_id, i.item_id, round(" + R.cos("u.v", "i.v") + ", 6) + 0.0 AS score FROM user_vec u JOIN item_vec i ON true) s WHERE " + _unseen(" AND r.pos <= 5")),
    "l_hybrid": _top_users("SELECT user_id, item_id, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score FROM pairs_l GROUP BY user_id, item_id"),
    "recs": " UNION ALL ".join(f"SELECT '{m}' AS model, user_id, item_id, rank FROM l_{m}" for m in ("bm25", "bert", "faiss", "hybrid")),
}
_FUSED = _LISTS | {
    "scaled": "SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0::DOUBLE / count(*) OVER w ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM pairs_l WINDOW w AS (PARTITION BY user_id, source)",
    "spread": "SELECT user_id, coalesce(var_pop(score) FILTER (WHERE source = 'bm25' AND rank <= 10), 0) AS vb, coalesce(var_pop(score) FILTER (WHERE source = 'faiss' AND rank <= 10), 0) AS vf, count(DISTINCT source) AS n FROM pairs_l GROUP BY user_id",
    "ks": f"SELECT user_id, CASE WHEN n < 2 THEN 30 ELSE {R._KS.format('vb')} END AS kb, CASE WHEN n < 2 THEN 30 ELSE {R._KS.format('vf')} END AS kf FROM spread",
    "rr": "SELECT user_id, item_id, sum(1 / (60.0::DOUBLE + rank)) AS r FROM pairs_l GROUP BY user_id, item_id",
    "rs": "SELECT user_id, item_id, CASE WHEN max(r) OVER w - min(r) OVER w < 1e-9 THEN 1.0::DOUBLE / count(*) OVER w ELSE (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END AS r FROM rr WINDOW w AS (PARTITION BY user_id)",
    "parts": "SELECT 'rrf' AS model, user_id, item_id, 1 / (60.0::DOUBLE + rank) AS part FROM pairs_l UNION ALL SELECT 'adaptive', user_id, item_id, CASE WHEN source = 'bm25' THEN 0.6::DOUBLE / (kb + rank) ELSE 0.4::DOUBLE / (kf + rank) END FROM pairs_l JOIN ks USING (user_id)"
    " UNION ALL SELECT 'weighted', user_id, item_id, 0.5::DOUBLE * s + 0.3::DOUBLE / (60 + rank) + 0.2::DOUBLE / rank FROM scaled UNION ALL SELECT 'hybrid', user_id, item_id, CASE WHEN source = 'bm25' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * s + 0.3::DOUBLE * r FROM scaled JOIN rs USING (user_id, item_id)",
    "recs": "SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT model, user_id, item_id, round(sum(part), 6) AS score FROM parts GROUP BY model, user_id, item_id) QUALIFY rank <= 10",
}
_ATTENTIVE = R._CANDIDATES | {
    "asked_a": "SELECT user_id, item_id FROM candidates WHERE rank <= 20",
    "met_a": "SELECT p.user_id, p.item_id, c.text_vec AS c, h.text_vec AS h, greatest(list_dot_product(h.text_vec, c.text_vec), 0) AS w0, " + R.cos("h.text_vec", "c.text_vec") + " AS s FROM asked_a p JOIN features c ON c.item_id = p.item_id JOIN recent r ON r.user_id = p.user_id AND r.pos <= 10 JOIN features h ON h.item_id = r.item_id",
    "wts_a": "SELECT *, CASE WHEN sum(w0) OVER u > 0 THEN w0 / sum(w0) OVER u ELSE 1.0::DOUBLE / count(*) OVER u END AS w FROM met_a WINDOW u AS (PARTITION BY user_id, item_id)",
    "pooled_a": "SELECT user_id, item_id, list(x ORDER BY j) AS p, any_value(c) AS c FROM (SELECT user_id, item_id, j, sum(x * w) AS x, any_value(c) AS c FROM (SELECT user_id, item_id, w, c, unnest(h) AS x, generate_subscripts(h, 1) AS j FROM wts_a) GROUP BY user_id, item_id, j) GROUP BY user_id, item_id",
    "mean_a": "SELECT user_id, item_id, avg(s) AS s FROM met_a GROUP BY user_id, item_id",
    "l_attention": _top_users("SELECT user_id, item_id, round(0.6::DOUBLE * greatest(coalesce(" + R.cos("o.p", "o.c") + ", 0), 0) + 0.4::DOUBLE * coalesce(s, 0), 6) + 0.0 AS score FROM asked_a LEFT JOIN pooled_a o USING (user_id, item_id) LEFT JOIN mean_a USING (user_id, item_id)"),
}
_REPORT = B._SIMILAR | B._NEGATIVE | {
    "i_raw": "SELECT user_id, item_id, sum(raw * weight) AS i FROM tag_scores JOIN weights USING (tag) GROUP BY user_id, item_id",
    "n_raw": "SELECT user_id, item_id, sum(raw * weight) AS n FROM tag_scores JOIN negative USING (tag) GROUP BY user_id, item_id",
    "shares": "SELECT user_id, item_id, similarity AS g, coalesce(i / nullif(max(i) OVER w, 0), 0) AS i, coalesce(n / nullif(max(n) OVER w, 0), 0) AS n FROM nearby LEFT JOIN i_raw USING (user_id, item_id) LEFT JOIN n_raw USING (user_id, item_id) WINDOW w AS (PARTITION BY user_id)",
    "report": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, item_id)::INT AS rank FROM (SELECT user_id, item_id, round(g, 6) AS generic_score, round(i, 6) AS personalization_score, round(n, 6) AS negative_score, round(0.64::DOUBLE * g + 0.31::DOUBLE * i - 0.17::DOUBLE * n, 6) + 0.0 AS final_score FROM shares) QUALIFY rank <= 8",
}
_TAGS = "[" + ", ".join(f"'{t}'" for _, t, _ in V.DICTIONARY) + "]"
_REGISTERED = {
    "asked": f"SELECT DISTINCT user_id, trim(tag) AS tag FROM (SELECT c_custkey::VARCHAR AS user_id, unnest([{_TAGS}[c_custkey % 7 + 1], ' ' || {_TAGS}[c_custkey % 5 + 1] || ' ', '  ', 'Own' || (c_custkey % 3)]) AS tag FROM customer) WHERE trim(tag) <> ''",
    "own_i": "SELECT user_id, category, tag, round(weight, 6) AS weight FROM weights JOIN categories USING (tag)",
}
_SAID = sorted({t for _, t, _ in V.DICTIONARY} | {w.upper() for _, _, words in V.DICTIONARY for w in words.split()} | {"Unknown"})
_SAID_SQL = "SELECT unnest([" + ", ".join(f"'{s}'" for s in _SAID) + "]) AS tag"
_NEW = "SELECT a.user_id, coalesce(c.category, 'Custom') AS category, a.tag, 0.5::DOUBLE AS weight FROM asked a LEFT JOIN categories c USING (tag)"

_HUNDREDTHS = "printf('%d.%02d', floor({0} * 100 + 0.5::DOUBLE)::INT // 100, floor({0} * 100 + 0.5::DOUBLE)::INT % 100)"
ORACLES = {
    "text_vectors": with_views(f"SELECT item_id, {R.R6.format('v')} AS v FROM item_vec", **_BERT),
    "bert_search": with_views(R.top("(SELECT q.query_id, i.item_id, " + R.cos("q.v", "i.v") + " AS score FROM query_vec q JOIN item_vec i ON true)", "query_id", K), **_BERT, query_vec=_vectors_sql(R.SEARCHES, "query_id")),
    "bert_user_recommend": with_views("SELECT user_id, item_id, score, rank::INT AS rank FROM l_bert", **{k: v.replace("FROM train", "FROM history") if k == "recent" else v for k, v in _MODELS.items() if k in ("recent", "item_vec", "user_vec", "l_bert")}),
    "text_candidates": with_views(
        R._RECORDS, **_BERT, **R.bm25_views(ITEM_TEXT, R.SEARCHES),
        query_vec=_vectors_sql(R.SEARCHES, "query_id"),
        near=R.top("(SELECT q.query_id, i.item_id, " + R.cos("q.v", "i.v") + " AS score FROM query_vec q JOIN item_vec i ON true)", "query_id", K),
        sparse=R.top("scored", "query_id", POOL),
        parts="SELECT query_id, item_id, rank, 'faiss' AS source, 1 / (60.0::DOUBLE + rank) AS part FROM near UNION ALL SELECT query_id, item_id, rank, 'bm25', 1 / (60.0::DOUBLE + rank) FROM sparse WHERE md5(query_id) < '8'",
    ),
    "rerank_user_attention": with_views("SELECT user_id, item_id, score, rank::INT AS rank FROM l_attention", **_ATTENTIVE),
    "compare_text_and_attention": with_views(_metric_rows([10], "recs"), **{**_ATTENTIVE, **{k: v for k, v in _MODELS.items() if k in ("item_vec", "user_vec", "l_bert")}}, recs="SELECT 'bert' AS model, user_id, item_id, rank FROM l_bert UNION ALL SELECT 'attention', user_id, item_id, rank FROM l_attention"),
    "compare_models": with_views(_metric_rows([5, 10], "recs"), **_MODELS),
    "model_deltas": with_views("SELECT m.model, m.metric, m.k, m.value, round(m.value - o.value, 6) + 0.0 AS difference, round((m.value - o.value) / greatest(o.value, 1e-6), 6) + 0.0 AS improvement FROM metrics m JOIN metrics o ON o.model = 'bm25' AND o.metric = m.metric AND o.k = m.k WHERE m.model <> 'bm25'", **_MODELS, metrics=_metric_rows([5, 10], "recs")),
    "compare_fusion_modes": with_views(_metric_rows([10], "recs"), **_FUSED),
    "retrieval_dataset": with_views(
        "SELECT 'user_' || q.user_id AS query_id, text, coalesce(relevant, '') AS relevant FROM q LEFT JOIN w USING (user_id)",
        q=f"SELECT user_id, trim(string_agg(text, ' ' ORDER BY ts)) AS text FROM (SELECT user_id, text, ts FROM train JOIN ({ITEM_TEXT}) USING (item_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) <= 5) GROUP BY user_id",
        w="SELECT user_id, string_agg(item_id, ' ' ORDER BY item_id) AS relevant FROM (SELECT DISTINCT user_id, item_id FROM truth WHERE item_id IN (SELECT item_id FROM items)) GROUP BY user_id",
    ),
    "evaluated_items": with_views("SELECT item_id, title FROM items WHERE item_id IN (SELECT item_id FROM train UNION SELECT item_id FROM truth)"),
    "image_downloads": with_views(
        "SELECT item_id, url AS image_url, CASE item_id::BIGINT % 5 WHEN 2 THEN '.png' WHEN 3 THEN '.webp' ELSE '.jpg' END AS extension, freq FROM images JOIN (SELECT item_id, count(*) AS freq FROM history GROUP BY item_id) USING (item_id) WHERE url <> '' ORDER BY freq DESC, item_id LIMIT 100",
        images="SELECT item_id, CASE item_id::BIGINT % 5 WHEN 1 THEN '' WHEN 2 THEN 'https://img.example/' || item_id || '.PNG?w=1' WHEN 3 THEN 'https://img.example/' || item_id || '.webp' WHEN 4 THEN 'https://img.example/' || item_id END AS url FROM items",
    ),
    "feature_progress": with_views("SELECT count(f.item_id) AS done, count(*) AS total, round(100.0::DOUBLE * count(f.item_id) / count(*), 1) AS percent FROM items LEFT JOIN features f USING (item_id)"),
    "complete_candidates": with_views("SELECT item_id FROM items WHERE item_id IN (SELECT item_id FROM features WHERE text_vec IS NOT NULL AND image_vec IS NOT NULL)"),
    "distinct_users": with_views("SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS rows FROM history"),
    "tag_display": with_views(f"SELECT s.tag, CASE WHEN s.tag = 'Ring' THEN 'Rings' ELSE coalesce((SELECT max(d.tag) FROM dictionary d WHERE d.keyword = lower(s.tag)), s.tag) END AS shown FROM ({_SAID_SQL}) s"),
    "tag_keywords": with_views(f"SELECT s.tag, coalesce(d.keyword, lower(s.tag)) AS keyword FROM ({_SAID_SQL}) s LEFT JOIN dictionary d USING (tag)"),
    "report_personalised": with_views("SELECT * FROM report", **_REPORT),
    "reason_pills": with_views(
        f"SELECT user_id, item_id, concat_ws('; ', CASE WHEN t IS NOT NULL THEN 'matches ' || t END, CASE WHEN personalization_score > 0.12 THEN 'personalised +' || {_HUNDREDTHS.format('personalization_score')} END, CASE WHEN negative_score > 0.18 THEN 'dislikes -' || {_HUNDREDTHS.format('negative_score')} END) AS pills FROM report LEFT JOIN best USING (user_id, item_id)", **_REPORT,
        best="SELECT user_id, item_id, string_agg(tag, ' / ' ORDER BY rank) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY score DESC, tag) AS rank FROM (SELECT user_id, item_id, tag, round(raw * weight, 6) AS score FROM report JOIN tag_scores USING (item_id) JOIN weights USING (user_id, tag)) QUALIFY rank <= 2) WHERE score >= 0.08 GROUP BY user_id, item_id",
    ),
    "chat_responses": "SELECT p_partkey AS item_id, 'You are looking for ' || concat_ws(' ', concat_ws(', ', p_brand, CASE WHEN p_size > 25 THEN p_name END), p_type) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' for ' || lower(p_brand) END || '.' || CASE WHEN p_size % 3 > 0 THEN ' Found ' || (p_size % 3) || ' matching items.' ELSE ' Nothing matches; try other words or fewer conditions.' END AS response FROM part",
    "registered_interests": with_views(f"SELECT * FROM own_i UNION ALL SELECT n.* FROM ({_NEW}) n ANTI JOIN own_i o ON o.user_id = n.user_id AND o.tag = n.tag", **_REGISTERED),
    "replaced_interests": with_views(f"SELECT * FROM own_i WHERE user_id NOT IN (SELECT user_id FROM asked WHERE user_id::BIGINT % 2 = 0) UNION ALL SELECT * FROM ({_NEW}) WHERE user_id::BIGINT % 2 = 0", **_REGISTERED),
    "account_info": with_views("SELECT c_custkey::VARCHAR AS user_id, c_name AS nickname, count(tag) AS n_interests, coalesce(string_agg(tag, ',' ORDER BY weight DESC, tag), '') AS interests FROM customer LEFT JOIN (SELECT user_id, tag, round(weight, 6) AS weight FROM weights) w ON w.user_id = c_custkey::VARCHAR GROUP BY c_custkey, c_name"),
    "recorded_exposures": with_views("SELECT user_id, item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown_at FROM exposures UNION ALL SELECT user_id, item_id, '2030-01-01 00:00:00' FROM (SELECT user_id, item_id FROM nearby QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) <= 8)", **B._SIMILAR),
    "recalculated_weights": with_views(
        "SELECT user_id, tag, round(CASE WHEN p IS NULL THEN weight ELSE greatest(0.05::DOUBLE, least(1::DOUBLE, 0.72::DOUBLE * coalesce(weight, 0.35::DOUBLE) + 0.38::DOUBLE * p - 0.52::DOUBLE * n)) END, 6) AS weight FROM weights FULL JOIN moves USING (user_id, tag)",
        recent_f="SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY interacted_at DESC, item_id DESC) <= 100",
        marks="SELECT user_id, category, tag, sum(CASE WHEN liked OR rating >= 4 THEN 1 + 0.3::DOUBLE * greatest(rating - 3, 0) ELSE 0 END) AS pos, sum(CASE WHEN NOT (liked OR rating >= 4) AND (NOT liked OR rating <= 2) THEN 0.9::DOUBLE + 0.25::DOUBLE * greatest(3 - rating, 0) ELSE 0 END) AS neg FROM recent_f JOIN title_tags USING (item_id) JOIN categories USING (tag) GROUP BY user_id, category, tag",
        shares="SELECT user_id, tag, coalesce(least(pos / nullif(2 * max(pos) OVER w, 0), 1), 0) AS p, coalesce(least(neg / nullif(2 * max(neg) OVER w, 0), 1), 0) AS n FROM marks WHERE pos > 0 OR neg > 0 WINDOW w AS (PARTITION BY user_id, category)",
        moves="SELECT user_id, tag, sum(p) AS p, sum(n) AS n FROM shares GROUP BY user_id, tag",
    ),
    "preference_vectors": with_views(
        f"SELECT user_id, {R.R6.format('list(m ORDER BY j)')} AS v FROM (SELECT user_id, j, sum(x * weight) / sum(weight) AS m FROM (SELECT user_id, weight, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM weights JOIN tag_vec USING (tag)) GROUP BY user_id, j) GROUP BY user_id",
        tag_vec="SELECT tag, text_vec AS v FROM (VALUES " + ", ".join(f"('{t}', '{i}')" for i, (_, t, _) in enumerate(V.DICTIONARY)) + ") n(tag, item_id) JOIN features USING (item_id)",
    ),
    "rated_items": with_views("SELECT user_id, item_id, rating FROM feedback WHERE rating >= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY interacted_at DESC, item_id DESC) <= 100"),
    "user_item_matrix": with_views("SELECT user_id, item_id, rating FROM feedback WHERE rating >= 1"),
    "report_weights": with_views("SELECT c_name AS nickname, category, tag, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, tag)::INT AS rank FROM own_i JOIN customer ON c_custkey::VARCHAR = user_id", own_i=_REGISTERED["own_i"]),
    "interest_queries": with_views(
        "SELECT user_id, array_to_string((list(keyword ORDER BY weight DESC, tag, keyword, i))[1:50], ' ') AS text FROM (SELECT user_id, tag, keyword, weight, unnest(range(floor(weight * 3)::BIGINT)) AS i FROM (SELECT user_id, tag, round(weight, 6) AS weight FROM weights) JOIN dictionary USING (tag)) GROUP BY user_id",
    ),
}
