"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import EXTENSIONS, STORE


def read_json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not; a malformed line is an error.

    Gzip files can't be split, so rows may be dealt to more partitions.
    """
    out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return out.repartition(partitions) if partitions else out


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def image_ids(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(item_id, path, length) of images named by their item; of several, the first by extension."""
    pattern = rf"([^/]+)\.({'|'.join(extensions)})$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    found = files.select(F.regexp_extract("path", pattern, 1).alias("item_id"), F.regexp_extract("path", pattern, 2).alias("extension"), "path", "length").where("item_id <> ''")
    order = F.array_position(F.array(*map(F.lit, extensions)), F.col("extension"))
    return found.groupBy("item_id").agg(F.min_by(F.struct("path", "length"), order).alias("x")).select("item_id", "x.path", "x.length")


def create_store(spark: SparkSession, database: str, drop: bool = False) -> None:
    """Tables of the feedback store, where they aren't there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in STORE.items():
        if drop:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def seed_tags(spark: SparkSession, database: str, rows: list[tuple[str, str, str]]) -> None:
    """Inserts tags that aren't there."""
    have = spark.table(f"{database}.interest_tags").select("category", "tag")
    spark.createDataFrame(rows, "category string, tag string, description string").join(have, ["category", "tag"], "left_anti").write.insertInto(f"{database}.interest_tags")


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    out = df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_report(metrics: DataFrame, path: str, **run: str | int | float) -> None:
    """Metrics as JSON lines, each with the run's settings."""
    metrics.withColumn("run", F.to_json(F.create_map(*(F.lit(str(x)) for kv in run.items() for x in kv)))).write.mode("overwrite").json(path)
