"""Queries of search, recall, fusion and re-ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hashed_vector, item_text
from ..functions.vectors import cosine, fused, rounded, text_query_fused
from ..operators import bm25, bm25_index, dense, fusion, hnsw, lambdamart, ltr, profiles, rerank
from ..operators.ranking import last_n, unseen
from ..sources.config import settled, shared_folder
from . import views as V
from .views import TEXT_SIZE, with_views

K, POOL, HASHED = 10, 50, 64
SIZES = {"text": TEXT_SIZE, "image": TEXT_SIZE, "multi": 2 * TEXT_SIZE}


def _vectors(features: DataFrame, column: str, key: str = "item_id") -> DataFrame:
    return features.select(F.col("item_id").alias(key), F.col(column).alias("v"))


def bm25_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(bm25.build_index(V.corpus(spark, d)), V.searches(spark, d), K)


def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same search by a saved index of postings by impact, with an exact early end."""
    path = shared_folder(spark, "bm25-index")
    bm25_index.save_index(V.corpus(spark, d), path)
    return bm25_index.search(bm25_index.open_index(spark, path), V.searches(spark, d), K)


def bm25_index_reads(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the searches' tokens, those that the early end reads, items that match and those that get exact scores."""
    path, counted = shared_folder(spark, "bm25-index"), {}
    bm25_index.save_index(V.corpus(spark, d), path)
    bm25_index.search(bm25_index.open_index(spark, path), V.searches(spark, d), K, counted)
    return spark.createDataFrame([tuple(int(counted[c]) for c in ("postings", "read", "matches", "scored"))], "postings long, read long, matches long, scored long")


def bm25_user_recommend(spark: SparkSession, d: str) -> DataFrame:
    return bm25.recommend_users(V.history(spark, d), V.items(spark, d), K)


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build_index(V.corpus(spark, d)).frequencies


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    history, items = V.history(spark, d), V.items(spark, d)
    _, truth = profiles.leave_last_n(history)
    users = bm25.user_queries(history, items).withColumnRenamed("query_id", "user_id")
    out = ltr.token_overlap(truth.select("user_id", "item_id").distinct(), users, items)
    return out.select("user_id", "item_id", F.round("overlap", 6).alias("overlap"))


def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d)
    return dense.cosine_top_k(_vectors(f, "v", "query_id"), _vectors(f, "v"), K, skip_same=True)


def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d)
    return dense.lsh_top_k(_vectors(f, "v", "query_id"), _vectors(f, "v"), K)


def hnsw_topk(spark: SparkSession, d: str) -> DataFrame:
    """By a neighbour graph that is saved and opened again."""
    f = V.features(spark, d)
    path = shared_folder(spark, "hnsw")
    hnsw.save_index(_vectors(f, "v"), path)
    return hnsw.search_index(hnsw.open_index(spark, path), _vectors(f, "v", "query_id"), K, skip_same=True)


def hnsw_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the graph's walks find of the exact lists, and what share of all pairs they score."""
    f = V.features(spark, d)
    path = shared_folder(spark, "hnsw")
    hnsw.save_index(_vectors(f, "v"), path)
    walked = hnsw.found_by_walks(hnsw.open_index(spark, path), _vectors(f, "v", "query_id"), K + 1)
    walked.write.parquet(f"{path}-found")
    walked = spark.read.parquet(f"{path}-found")
    exact = dense_topk_cosine(spark, d)
    met = exact.join(walked.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    n = f.count()
    return met.agg(F.count("*").alias("exact"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall")).crossJoin(walked.agg(F.round(F.sum("scored") / F.lit(max(n * n, 1)), 6).alias("scored_share")))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The best documents of every search, by words and by the vectors of the same numbers."""
    f = V.features(spark, d)
    own = _vectors(f, "v", "query_id").join(V.searches(spark, d).select("query_id"), "query_id", "left_semi")
    return bm25.search(bm25.build_index(V.corpus(spark, d)), V.searches(spark, d), POOL), dense.cosine_top_k(own, _vectors(f, "v"), POOL)


_SHOWN = ["query_id", "item_id", "final_score", "bm25_rank", "faiss_rank", "recall_source", "rank"]


def _fused(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = fusion.fuse(mode, *_lists(spark, d), K).select(*_SHOWN)
        return out.fillna(0, ["bm25_rank", "faiss_rank"])

    return query


def fusion_concat_norm(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d)
    return f.select("item_id", rounded(fused(F.col("text_vec"), F.col("image_vec"), 0.6, 0.4)).alias("fused_vec"), rounded(text_query_fused(F.col("text_vec"), TEXT_SIZE)).alias("query_vec"))


def vector_mean_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.weighted_profile(V.history(spark, d), _vectors(V.features(spark, d), "text_vec"), TEXT_SIZE)
    return out.select("user_id", rounded(F.col("v")).alias("v"))


def short_long_hybrid_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.interest_profiles(V.history(spark, d), _vectors(V.features(spark, d), "text_vec"), TEXT_SIZE)
    return out.select("user_id", *(rounded(F.col(c)).alias(c) for c in ("short_vec", "long_vec", "hybrid_vec")))


def kmeans_interests(spark: SparkSession, d: str) -> DataFrame:
    return profiles.kmeans_interests(_placed(spark, d), _vectors(V.features(spark, d), "text_vec"))


def _interests(spark: SparkSession, d: str) -> DataFrame:
    """Short, long, hybrid and half profiles as interests."""
    return profiles.interest_set(V.history(spark, d), _vectors(V.features(spark, d), "text_vec"), TEXT_SIZE)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The history's rows of items with vectors, placed once for all profiles."""
    return profiles.placed(V.history(spark, d), V.features(spark, d))


def _two_towers(history: DataFrame, interests: DataFrame, f: DataFrame, k: int = 20) -> DataFrame:
    images = profiles.image_profile(history, _vectors(f, "image_vec"), TEXT_SIZE)
    return dense.user_recall(interests, images, _vectors(f, "text_vec"), _vectors(f, "image_vec"), k)


def two_tower_user_recall(spark: SparkSession, d: str) -> DataFrame:
    history, f = _placed(spark, d), V.features(spark, d)
    return _two_towers(history, profiles.interest_set(history, _vectors(f, "text_vec"), TEXT_SIZE), f)


def two_tower_clustered_recall(spark: SparkSession, d: str) -> DataFrame:
    """By clustered interests, as the user model gives them."""
    history, f = _placed(spark, d), V.features(spark, d)
    return _two_towers(history, profiles.kmeans_interests(history, _vectors(f, "text_vec")), f)


def user_candidates(spark: SparkSession, d: str, k: int = POOL, users: DataFrame | None = None, train: DataFrame | None = None) -> DataFrame:
    """Recall for all users, or those given, from their train history, without what that holds."""
    f = V.features(spark, d)
    train = placed_train(spark, d, users) if train is None else train
    # Who has a train history has held-out items; what is found has a vector.
    return unseen(_two_towers(train, profiles.interest_set(train, _vectors(f, "text_vec"), TEXT_SIZE), f, k), train)


def placed_train(spark: SparkSession, d: str, users: DataFrame | None = None) -> DataFrame:
    """Rows of items with vectors of the train history of all users, or those given, with their places in it."""
    train, _ = profiles.leave_last_n(V.history(spark, d))
    train = train if users is None else train.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return profiles.placed(train, V.features(spark, d))


def training_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of BM25 and proxy recall over a user's ten latest train items, without these."""
    sparse, dense_ = _training_lists(spark, d)
    return fusion.rrf(sparse, dense_, 20).select(F.col("query_id").alias("user_id"), "item_id", "final_score", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("faiss_rank", F.lit(0)).alias("faiss_rank"), "recall_source", "rank")


def _training_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, items = V.features(spark, d), V.items(spark, d)
    train, _ = profiles.leave_last_n(V.history(spark, d))
    recent = last_n(train, profiles.LONG)
    sparse = bm25.recommend_users(train, items, K, profiles.LONG).withColumnRenamed("user_id", "query_id")
    interests = profiles.interest_set(train, _vectors(f, "text_vec"), TEXT_SIZE)
    near = dense.proxy_recall(interests, _vectors(f, "text_vec"), recent, K).withColumnRenamed("user_id", "query_id")
    return sparse, near


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """For each held-out item: negatives by hash, by BM25 and by nearness to the interests, with their weights."""
    f, items = V.features(spark, d), V.items(spark, d)
    pairs = settled(_pairs(spark, d), "pairs")
    history = V.history(spark, d).join(pairs.select("user_id").distinct(), "user_id", "left_semi")
    train = _train_of(spark, d, pairs)
    sparse = bm25.recommend_users(train, items, 50, profiles.LONG)
    interests = profiles.interest_set(train, _vectors(f, "text_vec"), TEXT_SIZE)
    near = dense.proxy_recall(interests, _vectors(f, "text_vec"), train, K)
    counts = ltr.mix()
    random = profiles.hashed_negatives(pairs, f.select("item_id"), history, counts[0])
    return ltr.mixed_negatives(pairs, random, sparse, near, history, counts)


def proxy_recall_maxmerge(spark: SparkSession, d: str) -> DataFrame:
    return dense.proxy_recall(_interests(spark, d), _vectors(V.features(spark, d), "text_vec"), V.history(spark, d), K)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each item's 50 nearest by text as candidates, with text, image and whole similarity."""
    f = V.features(spark, d)
    pool = dense.cosine_top_k(_vectors(f, "text_vec", "query_id"), _vectors(f, "text_vec"), POOL, skip_same=True)
    q, i = f.select(F.col("item_id").alias("query_id"), F.col("image_vec").alias("qi"), F.col("v").alias("qv")), f.select("item_id", "image_vec", "v")
    met = pool.drop("rank").withColumnRenamed("score", "text_score").join(q, "query_id").join(i, "item_id")
    return met.select("query_id", "item_id", "text_score", cosine(F.col("qi"), F.col("image_vec")).alias("clip_score"), cosine(F.col("qv"), F.col("v")).alias("fusion_score"), F.col("text_score").alias("recall_score"))


def rerank_two_signal(spark: SparkSession, d: str) -> DataFrame:
    return rerank.two_signals(_candidates(spark, d), 8).select("query_id", "item_id", "rank_score", "display_score", "rank")


def item_texts(spark: SparkSession, d: str) -> DataFrame:
    return V.items(spark, d).select("item_id", item_text(F.col("title"), F.col("brand"), F.col("category"), F.col("description")).alias("text"))


def text_vectors(spark: SparkSession, d: str, key: str = "item_id") -> DataFrame:
    """Vectors of the items' texts by the native encoder."""
    return item_texts(spark, d).select(F.col("item_id").alias(key), hashed_vector(F.col("text"), HASHED).alias("v")).where("v IS NOT NULL")


def _with_text_scores(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    """With bert_score: the similarity of texts where it is among the query's 50 best, else 0.

    The candidates are read twice, so they are settled; texts repeat, so distinct ones meet.
    """
    candidates, items = settled(candidates, "candidates"), item_texts(spark, d).withColumnRenamed("text", "key")
    vectors = settled(items.select("key").distinct().select("key", hashed_vector(F.col("key"), HASHED).alias("v")), "vectors")
    asked = items.withColumnRenamed("item_id", "query_id").join(candidates.select("query_id").distinct(), "query_id", "left_semi")
    near = dense.keyed_top_k(asked, items, vectors, POOL, skip_same=True).select("query_id", "item_id", F.col("score").alias("bert_score"))
    return candidates.join(near, ["query_id", "item_id"], "left").withColumn("bert_score", F.coalesce("bert_score", F.lit(0.0)))


def rerank_attention4(spark: SparkSession, d: str) -> DataFrame:
    out = rerank.by_attention(_with_text_scores(spark, d, _candidates(spark, d)), ["text_score", "clip_score", "fusion_score", "bert_score"], rerank.FOUR, 8)
    return out.select("query_id", "item_id", "rank_score", "attention_w", "rank")


def rerank_attention3_clipped(spark: SparkSession, d: str) -> DataFrame:
    out = rerank.by_attention(_candidates(spark, d), ["fusion_score", "text_score", "clip_score"], rerank.THREE, K, clip=True)
    return out.select("query_id", "item_id", "rank_score", "attention_w", "rank")


def rerank_text_attention(spark: SparkSession, d: str) -> DataFrame:
    return rerank.text_attention(_candidates(spark, d), 8).select("query_id", "item_id", "rank_score", "rank")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every user with the items held out, as far as these have vectors."""
    _, truth = profiles.leave_last_n(V.history(spark, d))
    return truth.select("user_id", "item_id").distinct().join(V.features(spark, d).select("item_id"), "item_id", "left_semi")


def _train_of(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """The train history of the pairs' users alone, settled."""
    train, _ = profiles.leave_last_n(V.history(spark, d))
    return settled(train.join(pairs.select("user_id").distinct(), "user_id", "left_semi"), "train")


def attention_pool_score(spark: SparkSession, d: str) -> DataFrame:
    train, _ = profiles.leave_last_n(V.history(spark, d))
    out = rerank.attention_pooled(_pairs(spark, d), last_n(train, K), _vectors(V.features(spark, d), "text_vec"), TEXT_SIZE)
    return out.select("user_id", "item_id", F.round("attention", 6).alias("attention"))


def rerank_user_cosine(spark: SparkSession, d: str) -> DataFrame:
    f = _vectors(V.features(spark, d), "text_vec")
    train, _ = profiles.leave_last_n(V.history(spark, d))
    users = profiles.interest_profiles(train, f, TEXT_SIZE).select("user_id", F.col("hybrid_vec").alias("v")).where("v IS NOT NULL")
    return rerank.by_user_vector(users, _pairs(spark, d), f, 8)


def _ltr_rows(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).withColumnRenamed("v", "multi_vec")
    pairs = settled(_pairs(spark, d), "pairs")
    train = _train_of(spark, d, pairs)
    recalled = user_candidates(spark, d, train=profiles.placed(train, V.features(spark, d))).select("user_id", "item_id", F.col("score").alias("recall_score"))
    pairs = pairs.join(recalled, ["user_id", "item_id"], "left").withColumn("recall_score", F.coalesce("recall_score", F.lit(0.0)))
    pairs = settled(pairs, "recalled")
    return ltr.ltr_features(pairs, train, f, SIZES)


def ltr24_features(spark: SparkSession, d: str) -> DataFrame:
    return _ltr_rows(spark, d)


def ltr_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of labelled candidates: the rows of a training matrix."""
    train, truth = profiles.leave_last_n(V.history(spark, d))
    return ltr.training_matrix(user_candidates(spark, d, ltr.USER_CANDIDATES, ltr.first_groups(_least_candidates(spark, d, train, ltr.USER_CANDIDATES))), truth)


def _least_candidates(spark: SparkSession, d: str, train: DataFrame, k: int) -> DataFrame:
    """(user_id, rows): how many candidates a user gets at least.

    One whose latest items have a vector gets k, or as many as there are vectors,
    without those of the train history.
    """
    f = V.features(spark, d).where("text_vec IS NOT NULL").select("item_id")
    known = last_n(train, profiles.LONG).join(f, "item_id", "left_semi").select("user_id").distinct().withColumn("known", F.lit(1))
    own = train.groupBy("user_id").agg(F.countDistinct("item_id").alias("held")).join(known, "user_id", "left")
    most = F.broadcast(f.agg(F.least(F.count("*"), F.lit(k)).alias("most")))
    return own.crossJoin(most).select("user_id", F.when(F.col("known") == 1, F.greatest(F.col("most") - F.col("held"), F.lit(0))).otherwise(0).alias("rows"))


def ltr_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Groups of labelled candidates with their features."""
    return _with_ltr_features(spark, d, ltr_groups(spark, d))


def _whole_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The groups of all users with their features, settled; recall's depth is the only bound of a group."""
    _, truth = profiles.leave_last_n(V.history(spark, d))
    rows = settled(ltr.training_matrix(user_candidates(spark, d, ltr.USER_CANDIDATES), truth, None, None), "groups")
    return settled(_with_ltr_features(spark, d, rows), "matrix")


def _with_ltr_features(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    f = V.features(spark, d).withColumnRenamed("v", "multi_vec")
    train, _ = profiles.leave_last_n(V.history(spark, d))
    return rows.select("user_id", "item_id", "label", "group_size").join(ltr.ltr_features(rows.select("user_id", "item_id", "recall_score"), train, f, SIZES), ["user_id", "item_id"])


def pairwise15_features(spark: SparkSession, d: str) -> DataFrame:
    return _pairwise(spark, d, settled(_pairs(spark, d), "pairs"))


def _pairwise(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    f, items = V.features(spark, d), V.items(spark, d)
    train = _train_of(spark, d, pairs)
    text, image = _vectors(f, "text_vec"), _vectors(f, "image_vec")
    recent = last_n(train, profiles.LONG)
    queries = bm25.user_queries(train, items, profiles.LONG)
    index = bm25.build_index(items, text="title")
    scores = bm25.score_pairs(index, queries, pairs.withColumnRenamed("user_id", "query_id")).withColumnRenamed("query_id", "user_id").withColumnRenamed("score", "bm25")
    p = profiles.interest_profiles(train, text, TEXT_SIZE)
    interests = profiles.interest_set(train, text, TEXT_SIZE).groupBy("user_id").agg(F.collect_list("v").alias("interests"))
    mean_text = profiles.mean_of_units(recent, text, TEXT_SIZE).withColumnRenamed("v", "mt")
    mean_image = profiles.mean_of_units(recent, image, TEXT_SIZE).withColumnRenamed("v", "mi")
    seen = recent.select("user_id", F.col("item_id").alias("seen")).join(text.withColumnRenamed("item_id", "seen").withColumnRenamed("v", "h"), "seen")
    near = pairs.join(text, "item_id").join(seen, "user_id").groupBy("user_id", "item_id").agg(F.max(cosine(F.col("h"), F.col("v"))).alias("hmax"), F.avg(cosine(F.col("h"), F.col("v"))).alias("hmean"))
    overlap = ltr.token_overlap(pairs, queries.withColumnRenamed("query_id", "user_id"), items)
    n_tokens = bm25.query_tokens(items.select(F.col("item_id").alias("query_id"), F.col("title").alias("text"))).groupBy("query_id").agg(F.sum("qf").alias("n")).withColumnRenamed("query_id", "item_id")
    out = pairs.join(scores, ["user_id", "item_id"], "left").join(p, "user_id", "left").join(interests, "user_id", "left").join(mean_text, "user_id", "left").join(mean_image, "user_id", "left")
    out = out.join(near, ["user_id", "item_id"], "left").join(overlap, ["user_id", "item_id"], "left").join(n_tokens, "item_id", "left").join(f.select("item_id", "text_vec", "image_vec"), "item_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    short, long, both = (cosine(F.col(c), F.col("text_vec")) for c in ("short_vec", "long_vec", "hybrid_vec"))
    found = F.coalesce(F.col("bm25"), F.lit(0.0)) > 0
    near_interest = zero(F.array_max(F.transform("interests", lambda v: cosine(v, F.col("text_vec")))))
    by_vector = F.round(near_interest, 6) > 0
    values = [F.log1p(zero(F.col("bm25"))), near_interest, cosine(F.col("mt"), F.col("text_vec")), cosine(F.col("mi"), F.col("image_vec")), F.lit(0.0), found.cast("double"), by_vector.cast("double"), (found & by_vector).cast("double"), both, short, long, zero(F.col("hmax")), zero(F.col("hmean")), zero(F.col("overlap")), zero(F.col("n").cast("double")) / 20]
    return out.select("user_id", "item_id", *(F.round(v, 6).alias(n) for v, n in zip(values, ltr.PAIRWISE, strict=True)))


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items as positives and hashed negatives, with the pairwise features."""
    f, pairs = V.features(spark, d), settled(_pairs(spark, d), "pairs")
    history = V.history(spark, d).join(pairs.select("user_id").distinct(), "user_id", "left_semi")
    negatives = profiles.hashed_negatives(pairs, f.select("item_id"), history, 4).select("user_id", "item_id").distinct()
    labelled = settled(pairs.withColumn("label", F.lit(1.0)).unionByName(negatives.withColumn("label", F.lit(0.0))), "labelled")
    return settled(_pairwise(spark, d, labelled.select("user_id", "item_id")).join(labelled, ["user_id", "item_id"]), "rows")


def lr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the users of four of five hash parts, applied to those of the fifth."""
    rows = _training(spark, d)
    return ltr.reranked(_fitted(rows, lambda x: ltr.trained_ranker(x, ltr.PAIRWISE)), rows.where(ltr.held_out()), K)


def _fitted(rows: DataFrame, fit):
    """A model of the rows that aren't held out, which stay cached while it is made."""
    own = rows.where(~ltr.held_out()).persist()
    try:
        return fit(own)
    finally:
        own.unpersist()


def lr_weighted_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fitted with hard negatives and their weights."""
    negatives = hard_negatives(spark, d)
    labelled = _pairs(spark, d).select("user_id", "item_id", F.lit(1.0).alias("label"), F.lit(1.0).alias("weight"))
    # Both are read many times, so they are made once.
    labelled = settled(labelled.unionByName(negatives.groupBy("user_id", "item_id").agg(F.lit(0.0).alias("label"), F.max("weight").alias("weight"))), "labelled")
    rows = settled(_pairwise(spark, d, labelled.select("user_id", "item_id")).join(labelled, ["user_id", "item_id"]), "rows")
    return ltr.reranked(_fitted(rows, lambda x: ltr.trained_ranker(x, ltr.PAIRWISE, weight="weight")), rows.where(ltr.held_out()), K)


def _boosted(rows: DataFrame) -> DataFrame:
    return ltr.boosted_order(ltr.boosted_ranker(rows.where(~ltr.held_out()), ltr.LTR), rows.where(ltr.held_out()), K)


def gbt_ltr(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the groups of candidates of four of five hash parts of all users, applied to those of the fifth."""
    return _boosted(_whole_matrix(spark, d))


def lambdamart_ltr(spark: SparkSession, d: str) -> DataFrame:
    """LambdaMART fitted on the same groups, applied to the same held-out users."""
    rows = _whole_matrix(spark, d)
    return lambdamart.lambdamart_order(lambdamart.train_lambdamart(rows.where(~ltr.held_out()), ltr.LTR), rows.where(ltr.held_out()), K)


def gbt_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the boosted order and of the recall order over the held-out users' groups."""
    from ..operators import evaluation
    from ..operators.ranking import ranked

    _, truth = profiles.leave_last_n(V.history(spark, d))
    rows = _whole_matrix(spark, d)
    held = rows.where(ltr.held_out())
    recall = ranked(held.select("user_id", "item_id", F.col("recall_score").alias("score")), ["user_id"], K)
    own = truth.join(held.select("user_id").distinct(), "user_id", "left_semi")
    return evaluation.evaluate(_boosted(rows), own, model="boosted").unionByName(evaluation.evaluate(recall, own, model="recall"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search_topk, bm25_index_topk, bm25_index_reads, bm25_user_recommend, doc_freq, token_overlap, dense_topk_cosine, lsh_topk, hnsw_topk, hnsw_recall, fusion_concat_norm, vector_mean_profile, short_long_hybrid_profile, kmeans_interests,
        two_tower_user_recall, two_tower_clustered_recall, user_candidates, training_candidates, hard_negatives, proxy_recall_maxmerge, rerank_two_signal, rerank_attention4, rerank_attention3_clipped, rerank_text_attention, attention_pool_score, rerank_user_cosine,
        ltr24_features, ltr_groups, ltr_matrix, lambdamart_ltr, pairwise15_features, lr_rerank, lr_weighted_rerank, gbt_ltr, gbt_ndcg,
    )
} | {f"fusion_{m}": _fused(m) for m in fusion.MODES}

# SQL.

HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def bm25_views(docs: str, queries: str) -> dict[str, str]:
    """Views up to ``scored`` (query_id, item_id, score); docs has item_id, text, queries query_id, text."""
    return {
        "toks": f"SELECT item_id, {TOKENS.format('text')} AS t FROM ({docs})",
        "dl": "SELECT item_id, len(t) AS dl FROM toks",
        "post": "SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(t) AS token FROM toks) GROUP BY ALL",
        "freq": "SELECT token, count(*) AS df FROM post GROUP BY token",
        "corp": "SELECT greatest(count(*), 1) AS n, greatest(avg(dl), 1e-6) AS mean FROM dl",
        "qtok": f"SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS token FROM ({queries})) GROUP BY ALL",
        "scored": "SELECT query_id, item_id, sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score FROM qtok JOIN freq USING (token) JOIN post USING (token) JOIN dl USING (item_id) CROSS JOIN corp GROUP BY query_id, item_id",
    }


def top(source: str, by: str, k: int, score: str = "score", columns: str | None = None) -> str:
    cols = columns or f"{by}, item_id, {score}"
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, item_id)::INT AS rank FROM (SELECT {cols.replace(score, f'round({score}, 6) AS {score}', 1) if columns is None else cols} FROM {source}) QUALIFY rank <= {k}"


def cos(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


ITEM_TEXT = "SELECT item_id, trim(concat_ws(' ', title, brand, category, description)) AS text FROM items"


def hashed_vectors(source: str, key: str) -> str:
    """Counts of hashed tokens, of length one."""
    counted = f"SELECT {key}, bucket, count(*)::DOUBLE AS c FROM (SELECT {key}, {HEX.format('token')} % {HASHED} AS bucket FROM (SELECT {key}, unnest({TOKENS.format('text')}) AS token FROM ({source}))) GROUP BY ALL"
    listed = f"SELECT k.{key}, list(coalesce(c, 0) ORDER BY b) AS m FROM (SELECT DISTINCT {key}, b FROM ({counted}), range({HASHED}) r(b)) k LEFT JOIN ({counted}) x ON x.{key} = k.{key} AND x.bucket = k.b GROUP BY k.{key}"
    return f"SELECT {key}, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM ({listed})"


DOCS, SEARCHES = "SELECT doc_id::VARCHAR AS item_id, text FROM documents", "SELECT item_id::VARCHAR AS query_id, text FROM benchmark"
USER_TEXT = "SELECT user_id AS query_id, string_agg(title, ' ' ORDER BY pos) AS text FROM {} JOIN items USING (item_id) WHERE pos <= 5 GROUP BY user_id"
_LISTS = bm25_views(DOCS, SEARCHES) | {
    "sparse": top("scored", "query_id", POOL),
    "dense": top(f"(SELECT q.item_id AS query_id, i.item_id, {cos('q.v', 'i.v')} AS score FROM features q JOIN features i ON true WHERE q.item_id IN (SELECT item_id::VARCHAR FROM benchmark))", "query_id", POOL),
    "lists": "SELECT query_id, item_id, score, rank, 'bm25' AS source FROM sparse UNION ALL SELECT query_id, item_id, score, rank, 'faiss' FROM dense",
    "scaled": "SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0::DOUBLE / count(*) OVER w ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lists WINDOW w AS (PARTITION BY query_id, source)",
}
_RECORDS = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, item_id)::INT AS rank FROM (SELECT query_id, item_id, round(sum(part), 6) AS final_score, coalesce(max(rank) FILTER (WHERE source = 'bm25'), 0) AS bm25_rank, coalesce(max(rank) FILTER (WHERE source = 'faiss'), 0) AS faiss_rank, CASE WHEN count(DISTINCT source) = 2 THEN 'hybrid' ELSE max(source) END AS recall_source FROM parts GROUP BY query_id, item_id) QUALIFY rank <= 10"


def mean_profile(source: str, vec: str, weight: str, n: int) -> str:
    return (
        f"SELECT user_id, list(m ORDER BY j) AS m FROM (SELECT user_id, j, sum(x * w) / sum(w) AS m FROM (SELECT user_id, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS j, {weight} AS w FROM {source} JOIN features USING (item_id) WHERE pos <= {n}) GROUP BY user_id, j) GROUP BY user_id"
    )


UNIT = "SELECT user_id, CASE WHEN list_dot_product(m, m) > 0 THEN list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) ELSE m END AS {} FROM ({})"
SHORT_W = "CASE pos WHEN 1 THEN 0.55::DOUBLE WHEN 2 THEN 0.30::DOUBLE ELSE 0.15::DOUBLE END"


def profile_views(source: str) -> dict[str, str]:
    return {
        "short_p": UNIT.format("short_vec", mean_profile(source, "text_vec", SHORT_W, 3)),
        "long_p": UNIT.format("long_vec", mean_profile(source, "text_vec", "1.0::DOUBLE", 10)),
        "profiles": UNIT.replace("SELECT user_id,", "SELECT user_id, short_vec, long_vec,").format("hybrid_vec", "SELECT user_id, short_vec, long_vec, CASE WHEN short_vec IS NULL THEN long_vec WHEN long_vec IS NULL THEN short_vec ELSE list_transform(list_zip(short_vec, long_vec), lambda p: 0.65::DOUBLE * p[1] + (1 - 0.65::DOUBLE) * p[2]) END AS m FROM short_p FULL JOIN long_p USING (user_id)"),
        "half": f"SELECT *, CASE WHEN pos <= n // 2 THEN 4 ELSE 5 END AS number FROM (SELECT user_id, item_id, pos, count(*) OVER (PARTITION BY user_id) AS n FROM {source} WHERE pos <= 10) WHERE n >= 4",
        "half_p": UNIT.replace("SELECT user_id,", "SELECT user_id, number,").format("v", "SELECT user_id, number, list(m ORDER BY j) AS m FROM (SELECT user_id, number, j, avg(x) AS m FROM (SELECT user_id, number, unnest(text_vec) AS x, generate_subscripts(text_vec, 1) AS j FROM half JOIN features USING (item_id)) GROUP BY user_id, number, j) GROUP BY user_id, number"),
        "every_i": "SELECT user_id, 1 AS number, short_vec AS v FROM profiles WHERE short_vec IS NOT NULL UNION ALL SELECT user_id, 2, long_vec FROM profiles WHERE long_vec IS NOT NULL UNION ALL SELECT user_id, 3, hybrid_vec FROM profiles WHERE hybrid_vec IS NOT NULL UNION ALL SELECT user_id, number, v FROM half_p",
        "interests": "SELECT * FROM every_i a WHERE NOT EXISTS (SELECT 1 FROM every_i b WHERE b.user_id = a.user_id AND b.number < a.number AND len(list_filter(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]) > 1e-8 + 1e-5 * abs(p[2]))) = 0)",
    }


R6 = "list_transform({}, lambda x: round(x, 6) + 0.0)"
_POOL = {
    "pool": top(f"(SELECT q.item_id AS query_id, i.item_id, {cos('q.text_vec', 'i.text_vec')} AS score FROM features q JOIN features i ON q.item_id <> i.item_id)", "query_id", POOL),
    "cands": f"SELECT p.query_id, p.item_id, p.score AS text_score, {cos('q.image_vec', 'i.image_vec')} AS clip_score, {cos('q.v', 'i.v')} AS fusion_score FROM pool p JOIN features q ON q.item_id = p.query_id JOIN features i ON i.item_id = p.item_id",
}


def _attention(signals: list[str], base: tuple[float, ...], k: int, clip: bool) -> str:
    s = [f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))" if clip else x for x in signals]
    raw = [f"{b}::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * {x})" for b, x in zip(base, s, strict=True)]
    total = " + ".join(raw)
    w = [f"({r}) / ({total})" for r in raw]
    score = " + ".join(f"{a} * {x}" for a, x in zip(w, s, strict=True))
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, item_id)::INT AS rank FROM (SELECT query_id, item_id, round({score}, 6) + 0.0 AS rank_score, {R6.format('[' + ', '.join(w) + ']')} AS attention_w FROM cands) QUALIFY rank <= {k}"


_TRAINED = {"recent": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS pos FROM train", "pairs": "SELECT DISTINCT user_id, item_id FROM truth WHERE item_id IN (SELECT item_id FROM features)"}
_ATTENTION = _TRAINED | {
    "met": "SELECT p.user_id, p.item_id, c.text_vec AS c, h.text_vec AS h, greatest(list_dot_product(h.text_vec, c.text_vec), 0) AS w0 FROM pairs p JOIN features c ON c.item_id = p.item_id JOIN recent r ON r.user_id = p.user_id AND r.pos <= 10 JOIN features h ON h.item_id = r.item_id",
    "wts": "SELECT *, CASE WHEN sum(w0) OVER u > 0 THEN w0 / sum(w0) OVER u ELSE 1.0::DOUBLE / count(*) OVER u END AS w FROM met WINDOW u AS (PARTITION BY user_id, item_id)",
    "pooled": "SELECT user_id, item_id, list(x ORDER BY j) AS p, any_value(c) AS c FROM (SELECT user_id, item_id, j, sum(x * w) AS x, any_value(c) AS c FROM (SELECT user_id, item_id, w, c, unnest(h) AS x, generate_subscripts(h, 1) AS j FROM wts) GROUP BY user_id, item_id, j) GROUP BY user_id, item_id",
}


def _pooled(m: str, column: str) -> str:
    """The candidate's cosine with the history pooled by w_<m>, or by its mean."""
    return f"SELECT user_id, item_id, {cos('p', 'c')} AS {m}_attention, {cos('a', 'c')} AS {m}_average FROM (SELECT user_id, item_id, any_value(c) AS c, list(m ORDER BY j) AS a, list(CASE WHEN t > 0 THEN p ELSE m END ORDER BY j) AS p FROM (SELECT user_id, item_id, j, any_value(c) AS c, sum(x * w) AS p, avg(x) AS m, sum(w) AS t FROM (SELECT user_id, item_id, w_{m} AS w, c_{m} AS c, unnest(h_{m}) AS x, generate_subscripts(h_{m}, 1) AS j FROM met) GROUP BY user_id, item_id, j) GROUP BY user_id, item_id)"


def _ltr_views(pairs: str) -> dict[str, str]:
    """Views up to ``ltr`` for pairs with recall_score."""
    m = {"text": "text_vec", "image": "image_vec", "multi": "v"}
    unit = lambda c: f"list_transform({c}, lambda x: x / sqrt(list_dot_product({c}, {c})))"
    z = lambda c: f"coalesce({c}, 0)"
    agg = ", ".join(f"max(s_{k}) AS {k}_max, avg(s_{k}) AS {k}_mean, min(s_{k}) AS {k}_min, stddev_pop(s_{k}) AS {k}_std" for k in m)
    sims = ", ".join(f"list_dot_product(h_{k}, {'c_multi' if k == 'multi' else 'r_' + k}) AS s_{k}, greatest(list_dot_product(h_{k}, c_{k}), 0) AS w_{k}" for k in m)
    special = {"history_length": z("n"), "has_text": "1", "has_image": "1", "has_multi": "1", "user_avg_sim": z("multi_average"), "mean_difference": f"{z('text_mean')} - {z('image_mean')}", "mean_ratio": f"{z('text_mean')} / ({z('image_mean')} + 1e-6)", "combined": f"0.3::DOUBLE * recall_score + 0.4::DOUBLE * {z('multi_attention')} + 0.3::DOUBLE * {z('multi_average')}"}
    cols = ", ".join(f"round(({special.get(f, z(f))})::DOUBLE, 6) + 0.0 AS {f}" for f in ltr.LTR)
    return {
        "asked": pairs,
        "units": "SELECT item_id, " + ", ".join(f"{unit(c)} AS u_{k}, {c} AS r_{k}" for k, c in m.items()) + " FROM features",
        "both_v": "SELECT p.user_id, p.item_id, " + ", ".join(f"c.u_{k} AS c_{k}, c.r_{k} AS r_{k}, h.u_{k} AS h_{k}" for k in m) + " FROM asked p JOIN units c ON c.item_id = p.item_id JOIN recent r ON r.user_id = p.user_id AND r.pos <= 50 JOIN units h ON h.item_id = r.item_id",
        "met": f"SELECT *, {sims} FROM both_v",
        "aggs": f"SELECT user_id, item_id, {agg}, CASE WHEN sum(w_multi) > 0 THEN stddev_pop(w_multi) / sum(w_multi) ELSE 0 END AS attention_std, CASE WHEN sum(w_multi) > 0 THEN max(w_multi) / sum(w_multi) ELSE 1.0::DOUBLE / count(*) END AS attention_max FROM met GROUP BY user_id, item_id",
        **{f"pool_{k}": _pooled(k, c) for k, c in m.items()},
        "lengths": "SELECT user_id, least(count(*), 50) AS n FROM train GROUP BY user_id",
        "ltr": f"SELECT user_id, item_id, {cols} FROM asked LEFT JOIN aggs USING (user_id, item_id) LEFT JOIN lengths USING (user_id) " + " ".join(f"LEFT JOIN pool_{k} USING (user_id, item_id)" for k in m),
    }


def two_tower_views(source: str, k: int) -> dict[str, str]:
    """Views up to ``towers``: the k best of both towers' lists."""
    return profile_views(source) | {
        "image_p": UNIT.format("v", mean_profile(source, "image_vec", "1.0::DOUBLE", 20)),
        "texts": "SELECT *, row_number() OVER (PARTITION BY user_id, number ORDER BY score DESC, item_id) AS r FROM (SELECT user_id, number, f.item_id, round(" + cos("i.v", "f.text_vec") + f", 6) AS score FROM interests i JOIN features f ON true) QUALIFY r <= {k}",
        "text_list": f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, round(sum(1 / (60.0::DOUBLE + (number - 1) * {k} + r)), 6) AS score FROM texts GROUP BY user_id, item_id)",
        "image_list": "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, f.item_id, round(" + cos("i.v", "f.image_vec") + f", 6) AS score FROM image_p i JOIN features f ON true) QUALIFY rank <= {k}",
        "both_lists": "SELECT * FROM text_list UNION ALL SELECT * FROM image_list",
        "towers": top("(SELECT user_id, item_id, sum(1 / (60.0::DOUBLE + rank)) AS score FROM both_lists GROUP BY user_id, item_id)", "user_id", k),
    }


def _candidates_sql(k: int) -> dict[str, str]:
    """Views up to ``candidates``, those of users that have a truth, without their train items."""
    return _TRAINED | two_tower_views("recent", k) | {"candidates": "SELECT c.* FROM towers c ANTI JOIN (SELECT DISTINCT user_id, item_id FROM train) t USING (user_id, item_id) SEMI JOIN (SELECT DISTINCT user_id FROM truth) u USING (user_id)"}


_CANDIDATES = _candidates_sql(POOL)
_GROUPS = _candidates_sql(ltr.USER_CANDIDATES) | {
    "grouped": "SELECT user_id, count(*) AS group_size FROM candidates GROUP BY user_id",
    "taken": f"SELECT user_id, group_size FROM grouped QUALIFY coalesce(sum(group_size) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {ltr.MATRIX_ROWS}",
    "wanted": "SELECT DISTINCT user_id, item_id FROM truth",
    "rows_": "SELECT c.user_id, c.item_id, c.score AS recall_score, c.rank, (w.item_id IS NOT NULL)::INT::DOUBLE AS label, group_size FROM candidates c JOIN taken USING (user_id) LEFT JOIN wanted w ON w.user_id = c.user_id AND w.item_id = c.item_id",
}
_RECALLED = "SELECT p.user_id, p.item_id, coalesce(score, 0) AS recall_score FROM pairs p LEFT JOIN candidates c ON c.user_id = p.user_id AND c.item_id = p.item_id"
_TRAIN_LISTS = _TRAINED | bm25_views("SELECT item_id, title AS text FROM items", USER_TEXT.replace("pos <= 5", "pos <= 10").format("recent")) | profile_views("recent") | {
    "near_i": "SELECT *, row_number() OVER (PARTITION BY user_id, number ORDER BY score DESC, item_id) AS r FROM (SELECT user_id, number, f.item_id, round(" + cos("i.v", "f.text_vec") + ", 6) AS score FROM interests i JOIN features f ON true) QUALIFY r <= 30",
}


def _pairwise_sql() -> str:
    unit = lambda c: f"list_transform({c}, lambda x: x / sqrt(list_dot_product({c}, {c})))"
    mean = lambda c, name: UNIT.format(name, f"SELECT user_id, list(m ORDER BY j) AS m FROM (SELECT user_id, j, avg(x) AS m FROM (SELECT user_id, unnest({unit(c)}) AS x, generate_subscripts({c}, 1) AS j FROM recent JOIN features USING (item_id) WHERE pos <= 10) GROUP BY user_id, j) GROUP BY user_id")
    more = bm25_views("SELECT item_id, title AS text FROM items", USER_TEXT.replace("pos <= 5", "pos <= 10").format("recent")) | profile_views("recent") | {
        "nearest_i": f"SELECT p.user_id, p.item_id, max({cos('i.v', 'c.text_vec')}) AS imax FROM pairs p JOIN features c ON c.item_id = p.item_id JOIN interests i ON i.user_id = p.user_id GROUP BY p.user_id, p.item_id",
        "mt": mean("text_vec", "mt"),
        "mi": mean("image_vec", "mi"),
        "near": f"SELECT p.user_id, p.item_id, max({cos('h.text_vec', 'c.text_vec')}) AS hmax, avg({cos('h.text_vec', 'c.text_vec')}) AS hmean FROM pairs p JOIN features c ON c.item_id = p.item_id JOIN recent r ON r.user_id = p.user_id AND r.pos <= 10 JOIN features h ON h.item_id = r.item_id GROUP BY p.user_id, p.item_id",
        "shared": "SELECT p.user_id, p.item_id, sum(least(q.qf, t.tf)) AS shared FROM pairs p JOIN qtok q ON q.query_id = p.user_id JOIN post t ON t.item_id = p.item_id AND t.token = q.token GROUP BY p.user_id, p.item_id",
        "qsize": "SELECT query_id AS user_id, sum(qf) AS size FROM qtok GROUP BY query_id",
    }
    c = lambda a, b="f.text_vec": cos(a, b)
    values = ["ln(1 + coalesce(s.score, 0))", "coalesce(imax, 0)", c("mt"), c("mi", "f.image_vec"), "0", "(coalesce(s.score, 0) > 0)::INT", "(round(coalesce(imax, 0), 6) > 0)::INT", "(coalesce(s.score, 0) > 0 AND round(coalesce(imax, 0), 6) > 0)::INT", c("hybrid_vec"), c("short_vec"), c("long_vec"), "coalesce(hmax, 0)", "coalesce(hmean, 0)", "coalesce(shared / size, 0)", "coalesce(dl, 0) / 20.0::DOUBLE"]
    cols = ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {n}" for v, n in zip(values, ltr.PAIRWISE, strict=True))
    return with_views(f"SELECT p.user_id, p.item_id, {cols} FROM pairs p LEFT JOIN scored s ON s.query_id = p.user_id AND s.item_id = p.item_id LEFT JOIN profiles USING (user_id) LEFT JOIN nearest_i x ON x.user_id = p.user_id AND x.item_id = p.item_id LEFT JOIN mt USING (user_id) LEFT JOIN mi USING (user_id) LEFT JOIN near n ON n.user_id = p.user_id AND n.item_id = p.item_id LEFT JOIN shared h ON h.user_id = p.user_id AND h.item_id = p.item_id LEFT JOIN qsize z ON z.user_id = p.user_id LEFT JOIN dl ON dl.item_id = p.item_id LEFT JOIN features f ON f.item_id = p.item_id", **_TRAINED, **more)


_KS = "greatest(15, least(60, trunc(30 * (1.5::DOUBLE - {} / (vb + vf + 1e-9)))::INT))"
ORACLES = {
    "bm25_search_topk": with_views(top("scored", "query_id", K), **bm25_views(DOCS, SEARCHES)),
    "bm25_index_topk": with_views(top("scored", "query_id", K), **bm25_views(DOCS, SEARCHES)),
    "bm25_user_recommend": with_views(
        top("(SELECT query_id AS user_id, item_id, score FROM scored s WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = s.query_id AND l.item_id = s.item_id AND pos <= 5))", "user_id", K),
        **bm25_views("SELECT item_id, title AS text FROM items", USER_TEXT.format("latest")),
    ),
    "doc_freq": with_views("SELECT token, df FROM freq", **{k: v for k, v in bm25_views(DOCS, SEARCHES).items() if k in ("toks", "post", "freq")}),
    "token_overlap": with_views(
        "SELECT user_id, item_id, round(coalesce(shared / size, 0), 6) AS overlap FROM (SELECT DISTINCT user_id, item_id FROM truth) p LEFT JOIN shared USING (user_id, item_id) LEFT JOIN size USING (user_id)",
        **{k: v for k, v in bm25_views("SELECT item_id, title AS text FROM items", USER_TEXT.format("latest")).items() if k in ("toks", "post", "qtok")},
        shared="SELECT query_id AS user_id, p.item_id, sum(least(qf, tf)) AS shared FROM (SELECT DISTINCT user_id, item_id FROM truth) p JOIN qtok ON query_id = p.user_id JOIN post ON post.item_id = p.item_id AND post.token = qtok.token GROUP BY ALL",
        size="SELECT query_id AS user_id, sum(qf) AS size FROM qtok GROUP BY ALL",
    ),
    "dense_topk_cosine": with_views(top(f"(SELECT q.item_id AS query_id, i.item_id, {cos('q.v', 'i.v')} AS score FROM features q JOIN features i ON q.item_id <> i.item_id)", "query_id", K)),
    "fusion_rrf": with_views(_RECORDS, **_LISTS, parts="SELECT *, 1 / (60.0::DOUBLE + rank) AS part FROM lists"),
    "fusion_adaptive": with_views(
        _RECORDS, **_LISTS,
        spread="SELECT query_id, coalesce(var_pop(score) FILTER (WHERE source = 'bm25' AND rank <= 10), 0) AS vb, coalesce(var_pop(score) FILTER (WHERE source = 'faiss' AND rank <= 10), 0) AS vf, count(DISTINCT source) AS n FROM lists GROUP BY query_id",
        ks=f"SELECT query_id, CASE WHEN n < 2 THEN 30 ELSE {_KS.format('vb')} END AS kb, CASE WHEN n < 2 THEN 30 ELSE {_KS.format('vf')} END AS kf FROM spread",
        parts="SELECT l.*, CASE WHEN source = 'bm25' THEN 0.6::DOUBLE / (kb + rank) ELSE 0.4::DOUBLE / (kf + rank) END AS part FROM lists l JOIN ks USING (query_id)",
    ),
    "fusion_weighted": with_views(_RECORDS, **_LISTS, parts="SELECT *, 0.5::DOUBLE * s + 0.3::DOUBLE / (60 + rank) + 0.2::DOUBLE / rank AS part FROM scaled"),
    "fusion_hybrid": with_views(
        _RECORDS, **_LISTS,
        rr="SELECT query_id, item_id, sum(1 / (60.0::DOUBLE + rank)) AS r FROM lists GROUP BY query_id, item_id",
        rs="SELECT query_id, item_id, CASE WHEN max(r) OVER w - min(r) OVER w < 1e-9 THEN 1.0::DOUBLE / count(*) OVER w ELSE (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END AS r FROM rr WINDOW w AS (PARTITION BY query_id)",
        parts="SELECT c.*, CASE WHEN source = 'bm25' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * s + 0.3::DOUBLE * r AS part FROM scaled c JOIN rs USING (query_id, item_id)",
    ),
    "fusion_concat_norm": with_views(
        f"SELECT item_id, {R6.format('list_transform(f, lambda x: x / sqrt(list_dot_product(f, f)))')} AS fused_vec, {R6.format('list_concat(t, list_transform(t, lambda x: 0.0::DOUBLE))')} AS query_vec FROM fv",
        fv="SELECT item_id, t, list_concat(list_transform(t, lambda x: 0.6::DOUBLE * x), list_transform(i, lambda x: 0.4::DOUBLE * x)) AS f FROM (SELECT item_id, list_transform(text_vec, lambda x: x / sqrt(list_dot_product(text_vec, text_vec))) AS t, list_transform(image_vec, lambda x: x / sqrt(list_dot_product(image_vec, image_vec))) AS i FROM features)",
    ),
    "vector_mean_profile": with_views(f"SELECT user_id, {R6.format('long_vec')} AS v FROM long_p", long_p=profile_views("latest")["long_p"]),
    "short_long_hybrid_profile": with_views(f"SELECT user_id, {R6.format('short_vec')} AS short_vec, {R6.format('long_vec')} AS long_vec, {R6.format('hybrid_vec')} AS hybrid_vec FROM profiles", **profile_views("latest")),
    "two_tower_user_recall": with_views("SELECT * FROM towers", **two_tower_views("latest", 20)),
    "user_candidates": with_views("SELECT * FROM candidates", **_CANDIDATES),
    "training_candidates": with_views(
        _RECORDS.replace("rank <= 10", "rank <= 20").replace("SELECT *, row_number", "SELECT query_id AS user_id, item_id, final_score, bm25_rank, faiss_rank, recall_source, row_number"), **_TRAIN_LISTS,
        sparse="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, item_id, round(score, 6) AS score FROM scored s WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = s.query_id AND r.item_id = s.item_id AND pos <= 10)) QUALIFY rank <= 10",
        dense="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id AS query_id, item_id, max(score) AS score FROM near_i n WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = n.user_id AND r.item_id = n.item_id AND pos <= 10) GROUP BY user_id, item_id) QUALIFY rank <= 10",
        parts="SELECT query_id, item_id, rank, 'bm25' AS source, 1 / (60.0::DOUBLE + rank) AS part FROM sparse UNION ALL SELECT query_id, item_id, rank, 'faiss', 1 / (60.0::DOUBLE + rank) FROM dense",
    ),
    "hard_negatives": with_views(
        f"SELECT user_id, positive, item_id, 'random' AS kind, 0.8::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id, positive ORDER BY ahead, md5(concat_ws('#', user_id, positive, item_id, '42')), item_id) AS place FROM drawn) WHERE place <= {ltr.mix()[0]} UNION ALL SELECT user_id, positive, item_id, kind, round(1 + least(score / unit, 2.0::DOUBLE), 6) AS weight FROM (SELECT p.user_id, p.item_id AS positive, h.item_id, kind, unit, score FROM pairs p JOIN hard h ON h.user_id = p.user_id AND h.item_id <> p.item_id QUALIFY row_number() OVER (PARTITION BY p.user_id, p.item_id, kind ORDER BY score DESC, h.item_id) <= {ltr.mix()[1]})",
        **_TRAIN_LISTS,
        nb="SELECT greatest(64, count(DISTINCT item_id) // 32) AS bins FROM features",
        asked=f"SELECT user_id, item_id AS positive, {HEX.format("concat_ws('#', user_id, item_id, '42')")} % bins AS bin FROM pairs, nb",
        slots=f"SELECT item_id, {HEX.format("concat_ws('#', item_id, '42')")} % bins AS bin FROM features, nb",
        seen_all="SELECT DISTINCT user_id, item_id FROM history",
        drawn="SELECT a.user_id, a.positive, s.item_id, (s.bin - a.bin + bins) % bins AS ahead FROM nb, asked a JOIN slots s ON s.item_id <> a.positive ANTI JOIN seen_all h ON h.user_id = a.user_id AND h.item_id = s.item_id",
        sparse="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id AS user_id, item_id, round(score, 6) AS score FROM scored s WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = s.query_id AND r.item_id = s.item_id AND pos <= 10)) QUALIFY rank <= 50",
        dense="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, max(score) AS score FROM near_i n WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = n.user_id AND r.item_id = n.item_id) GROUP BY user_id, item_id) QUALIFY rank <= 10",
        hard="SELECT x.* FROM (SELECT user_id, item_id, score, 'hard_bm25' AS kind, 10.0::DOUBLE AS unit FROM sparse UNION ALL SELECT user_id, item_id, score, 'hard_faiss', 0.5::DOUBLE FROM dense) x ANTI JOIN seen_all h ON h.user_id = x.user_id AND h.item_id = x.item_id",
    ),
    "proxy_recall_maxmerge": with_views(
        top("(SELECT user_id, item_id, max(score) AS score FROM texts t WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = t.user_id AND h.item_id = t.item_id) GROUP BY user_id, item_id)", "user_id", K),
        **profile_views("latest"),
        texts="SELECT *, row_number() OVER (PARTITION BY user_id, number ORDER BY score DESC, item_id) AS r FROM (SELECT user_id, number, f.item_id, round(" + cos("i.v", "f.text_vec") + ", 6) AS score FROM interests i JOIN features f ON true) QUALIFY r <= 30",
    ),
    "rerank_two_signal": with_views("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, item_id)::INT AS rank FROM (SELECT query_id, item_id, round(0.6::DOUBLE * text_score + 0.4::DOUBLE * clip_score, 6) + 0.0 AS rank_score, round(0.5::DOUBLE * text_score + 0.3::DOUBLE * clip_score + 0.2::DOUBLE * text_score, 6) AS display_score FROM cands) QUALIFY rank <= 8", **_POOL),
    "rerank_attention4": with_views(
        _attention(["text_score", "clip_score", "fusion_score", "coalesce(bert, 0)"], rerank.FOUR, 8, False).replace("FROM cands", "FROM cands LEFT JOIN berts USING (query_id, item_id)"), **_POOL,
        item_vec=hashed_vectors(ITEM_TEXT, "item_id"),
        berts="SELECT q.item_id AS query_id, i.item_id, round(" + cos("q.v", "i.v") + ", 6) + 0.0 AS bert FROM item_vec q JOIN item_vec i ON q.item_id <> i.item_id WHERE q.item_id IN (SELECT query_id FROM cands) QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY bert DESC, i.item_id) <= 50",
    ),
    "rerank_attention3_clipped": with_views(_attention(["fusion_score", "text_score", "clip_score"], rerank.THREE, K, True), **_POOL),
    "rerank_text_attention": with_views("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, item_id)::INT AS rank FROM (SELECT query_id, item_id, round(0.35::DOUBLE * text_score + 0.2::DOUBLE * clip_score + 0.25::DOUBLE * (text_score <> 0)::INT + 0.2::DOUBLE * text_score, 6) + 0.0 AS rank_score FROM cands) QUALIFY rank <= 8", **_POOL),
    "attention_pool_score": with_views(f"SELECT user_id, item_id, round(coalesce({cos('o.p', 'o.c')}, 0), 6) AS attention FROM pairs LEFT JOIN pooled o USING (user_id, item_id)", **_ATTENTION),
    "rerank_user_cosine": with_views(top(f"(SELECT p.user_id, p.item_id, {cos('u.hybrid_vec', 'f.text_vec')} AS score FROM pairs p JOIN profiles u USING (user_id) JOIN features f ON f.item_id = p.item_id WHERE u.hybrid_vec IS NOT NULL)", "user_id", 8), **_TRAINED, **profile_views("recent")),
    "ltr24_features": with_views("SELECT * FROM ltr", **_CANDIDATES, **_ltr_views(_RECALLED)),
    "ltr_groups": with_views("SELECT * FROM rows_", **_GROUPS),
    "pairwise15_features": _pairwise_sql(),
}

#: SQL that takes minutes on larger tables: the tests compare it on the smallest ones.
SLOW_ORACLES = {"ltr_matrix": with_views("SELECT l.*, label, group_size FROM ltr l JOIN rows_ USING (user_id, item_id)", **_GROUPS, **_ltr_views("SELECT user_id, item_id, recall_score FROM rows_"))}
