"""Fusion of two ranked lists a query into candidate records.

A list has query_id, item_id, score, rank.  All modes return query_id, item_id,
final_score, bm25_raw, faiss_raw, bm25_rank, faiss_rank, recall_source and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

RRF_K = 60
#: Fixed values of the adaptive mode: base and range of k, source weights.
BASE_K, LEAST_K, MOST_K = 30, 15, 60
SPARSE_SHARE, DENSE_SHARE = 0.6, 0.4
#: Shares of scaled score, reciprocal of k + rank, and reciprocal rank.
WEIGHTED = (0.5, 0.3, 0.2)
#: Shares of scaled sparse score, scaled dense score and scaled reciprocal ranks.
HYBRID = (0.4, 0.3, 0.3)
TOP_VARIANCE = 10


def both_lists(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    columns = ["query_id", "item_id", "score", "rank"]
    return sparse.select(*columns, F.lit("bm25").alias("source")).unionByName(dense.select(*columns, F.lit("faiss").alias("source")))


def minmax(score: Column, *by: str) -> Column:
    """Scaled to 0..1 within a list; of a constant list each gets its share."""
    own = Window.partitionBy(*by)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high - low < 1e-9, 1 / F.count(F.lit(1)).over(own)).otherwise((score - low) / (high - low))


def _records(rows: DataFrame, part: Column, k: int) -> DataFrame:
    """Records from rows with a part of the final score each."""
    pick = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    out = rows.withColumn("part", part).groupBy("query_id", "item_id").agg(
        F.sum("part").alias("final_score"), pick("bm25", "score").alias("bm25_raw"), pick("faiss", "score").alias("faiss_raw"), pick("bm25", "rank").alias("bm25_rank"), pick("faiss", "rank").alias("faiss_rank")
    )
    source = F.when(F.col("bm25_rank").isNotNull() & F.col("faiss_rank").isNotNull(), "hybrid").when(F.col("bm25_rank").isNotNull(), "bm25").otherwise("faiss")
    return ranked(out.withColumn("recall_source", source), ["query_id"], k, score="final_score")


def rrf(sparse: DataFrame, dense: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    return _records(both_lists(sparse, dense), 1 / (rrf_k + F.col("rank")), k)


def rrf_adaptive(sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """A list's k falls with its share of the variance of the best ten scores."""
    rows = both_lists(sparse, dense)
    own = Window.partitionBy("query_id", "source")
    spread = rows.withColumn("n", F.count("*").over(own)).groupBy("query_id").agg(
        *(F.coalesce(F.var_pop(F.when((F.col("source") == s) & (F.col("rank") <= TOP_VARIANCE), F.col("score"))), F.lit(0.0)).alias(f"var_{s}") for s in ("bm25", "faiss")),
        *(F.max((F.col("source") == s).cast("int")).alias(f"has_{s}") for s in ("bm25", "faiss")),
    )
    total = F.col("var_bm25") + F.col("var_faiss") + 1e-9
    bounded = lambda s: F.when(F.col("has_bm25") + F.col("has_faiss") < 2, F.lit(BASE_K)).otherwise(F.greatest(F.lit(LEAST_K), F.least(F.lit(MOST_K), (BASE_K * (1.5 - F.col(f"var_{s}") / total)).cast("int"))))
    ks = spread.select("query_id", bounded("bm25").alias("k_bm25"), bounded("faiss").alias("k_faiss"))
    sparse_row = F.col("source") == "bm25"
    part = F.when(sparse_row, SPARSE_SHARE / (F.col("k_bm25") + F.col("rank"))).otherwise(DENSE_SHARE / (F.col("k_faiss") + F.col("rank")))
    return _records(rows.join(ks, "query_id"), part, k)


def weighted(sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    rows = both_lists(sparse, dense).withColumn("scaled", minmax(F.col("score"), "query_id", "source"))
    return _records(rows, WEIGHTED[0] * F.col("scaled") + WEIGHTED[1] / (RRF_K + F.col("rank")) + WEIGHTED[2] / F.col("rank"), k)


def hybrid(sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """The scaled reciprocal ranks count once for each list that has the item."""
    rows = both_lists(sparse, dense).withColumn("scaled", minmax(F.col("score"), "query_id", "source"))
    ranks = rows.groupBy("query_id", "item_id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf")).withColumn("rrf", minmax(F.col("rrf"), "query_id"))
    share = F.when(F.col("source") == "bm25", HYBRID[0]).otherwise(HYBRID[1])
    return _records(rows.join(ranks, ["query_id", "item_id"]), share * F.col("scaled") + HYBRID[2] * F.col("rrf"), k)


def by_strategy(searches: DataFrame, sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Records of searches (query_id, strategy): hybrid ones from both lists, the others from the dense one alone."""
    wants = lambda s: searches.where((F.col("strategy") == "hybrid") == F.lit(s)).select("query_id")
    both = rrf(sparse.join(wants(True), "query_id", "left_semi"), dense.join(wants(True), "query_id", "left_semi"), k)
    alone = rrf(sparse.limit(0), dense.join(wants(False), "query_id", "left_semi"), k)
    return both.unionByName(alone)


MODES = {"rrf": rrf, "adaptive": rrf_adaptive, "weighted": weighted, "hybrid": hybrid}


def fuse(mode: str, sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """An unknown mode is plain reciprocal rank fusion; ``faiss_only`` takes the dense list alone."""
    if mode == "faiss_only":
        return rrf(sparse.limit(0), dense, k)
    return MODES.get(mode, rrf)(sparse, dense, k)
