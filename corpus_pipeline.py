"""A cleaning pipeline over ``documents``: quality, lines, near copies, repeated bytes, packing.

Counts as part of the subpackage ``brambleflow.llm``.  Each stage takes what its
predecessor kept, as a DataFrame with the columns of documents, and the folder
of the tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambleflow.llm.common import NULL_ID, shared_dir, table
from brambleflow.llm.line_dedup import line_dedup
from brambleflow.llm.minhash import near_duplicates
from brambleflow.llm.packing import WINDOW, retrieval_packing
from brambleflow.llm.quality import score_quality, train_quality
from brambleflow.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with a key of each row's doc_id and text."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    return out.withColumn("_id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("_row", F.xxhash64(F.coalesce("text", F.lit(""))))


def _with(docs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Documents with a column of an operator's rows for the same doc_id and text."""
    own = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("row").alias("_row"), F.col(column).alias("_found")).dropDuplicates(["_id", "_row"])
    return _documents(docs).join(own.hint("merge"), ["_id", "_row"])


def _new_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    return _with(docs, found, "kept").select("doc_id", F.col("_found").alias("text"), "lang", "source", F.length("_found").cast("long").alias("n_chars"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels' rows of these documents."""
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return scored.where("predicted = 1").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds."""
    return _new_texts(docs, line_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _with(docs, near_duplicates(docs), "kept").where("_found").select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what 50-byte strings of earlier ones cover (whole characters)."""
    return _new_texts(docs, suffix_dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of WINDOW tokens, with their ids."""
    return retrieval_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), WINDOW)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/brambleflow/{uuid.uuid4().hex}-pipeline"
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
