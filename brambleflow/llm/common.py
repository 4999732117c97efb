"""What the operators share: table access, row identity and settled intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark remove a job's shuffle files at its end, as its result is settled.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null id where numbers are compared; null ids sort after all others.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine for which none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='brambleflow-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again.

    A lost executor then costs the tasks it was running, never what stands
    before them.  Spark removes the folder when its session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brambleflow/{uuid.uuid4().hex}-{label}"
    cleanup = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if cleanup is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, cleanup)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Remove a settled table that no later step reads."""
    spark = df.sparkSession
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of large values, one at a time: a batch is never copied as a whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def text_of(column: str = "text") -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): rows that share doc_id and text share everything derived from them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("row", F.xxhash64("text"))
