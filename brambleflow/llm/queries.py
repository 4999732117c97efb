"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .byte_pairs import encode_bytes_bpe
from .common import table
from .importance import importance_resample
from .kdtree import exact_top_k
from .licenses import scan_licenses
from .line_dedup import line_dedup
from .media import media_digests
from .minhash import near_duplicates
from .packing import WINDOW, retrieval_packing
from .pieces import encode_pieces
from .quality import score_quality, train_quality
from .suffix_dedup import suffix_dedup
from .tiers import ranked_search
from .wrappers import extract_main_text


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup(table(spark, folder, "documents"), min_chars=10, digest=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def op2_media(spark: SparkSession, folder: str) -> DataFrame:
    return media_digests(table(spark, folder, "documents"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).drop("row")


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(table(spark, folder, "documents"), shingle_words=5, percent=75)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_packing(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), WINDOW, with_ids=False)


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup(table(spark, folder, "documents"), length=50, digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, train_quality(docs, table(spark, folder, "labels")))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    out = encode_pieces(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    out = importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=5, least_words=20, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = encode_bytes_bpe(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_media": op2_media,
        "op3_main_text": op3_main_text,
        "op4_license_scan": op4_license_scan,
        "op5_top_k": op5_top_k,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_packing": op7_packing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_quality": op9_quality,
        "op10_pieces": op10_pieces,
        "op11_importance": op11_importance,
        "op12_ranked_search": op12_ranked_search,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
