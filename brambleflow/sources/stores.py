"""Stores that keep one row a key: user vectors, models, feature dictionaries and the demonstration state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import exists
from .keyed import KeyedStore


class VectorStore:
    """User vectors: v, short_term, long_term, history (newest first) and updated_at of each user_id.

    Saved rows may lack columns: what they lack stays as it is.
    """

    SCHEMA = "user_id string, v array<float>, short_term array<float>, long_term array<float>, history array<string>, updated_at timestamp"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.table = spark, KeyedStore(spark, folder, self.SCHEMA, ["user_id"])

    def read(self) -> DataFrame:
        return self.table.read()

    def save(self, rows: DataFrame) -> None:
        """Inserts users and replaces what is given of those that are there; rows without updated_at are of now."""
        own = rows if "updated_at" in rows.columns else rows.withColumn("updated_at", F.current_timestamp())
        self.table.upsert(own)

    def delete(self, users: DataFrame) -> None:
        self.table.delete(users)

    def row(self, user: str) -> dict | None:
        """All that is known of a user."""
        found = self.read().where(F.col("user_id") == user).first()
        return found.asDict() if found else None

    def get(self, user: str) -> list[float] | None:
        found = self.row(user)
        return list(found["v"]) if found and found["v"] is not None else None

    def has(self, user: str) -> bool:
        return self.row(user) is not None

    def stats(self, n: int = 5) -> tuple[int, list[str]]:
        """How many users there are, and the first few."""
        return self.read().count(), [r.user_id for r in self.read().select("user_id").orderBy("user_id").limit(n).collect()]


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, features: int):
    """A ranker; one for another number of features is an error."""
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(path)
    have = len(model.stages[0].getInputCols())
    if have != features:
        raise ValueError(f"the model takes {have} features, not {features}")
    return model


def features_from_file(spark: SparkSession, file: str, path: str, rows: int = 10_000) -> None:
    """A dictionary of vectors, saved as a NumPy object file on the driver, as a Parquet table (item_id, v), part by part.

    The file is unpickled: only files of one's own may be read so.
    """
    import numpy as np

    found = list(np.load(file, allow_pickle=True).item().items())
    for start in range(0, max(len(found), 1), rows):
        part = [(str(k), [float(x) for x in v]) for k, v in found[start : start + rows]]
        spark.createDataFrame(part, "item_id string, v array<float>").write.mode("overwrite" if start == 0 else "append").parquet(path)


def seed_demo(spark: SparkSession, database: str, interests: DataFrame, feedback: DataFrame, exposures: DataFrame, users: DataFrame) -> None:
    """The demonstration state: the store's tables emptied and filled with given rows."""
    from .readers import create_store
    from .schemas import STORE

    create_store(spark, database, drop=True)
    for name, rows in (("users", users), ("user_interests", interests), ("user_feedback", feedback), ("exposure_history", exposures)):
        columns = [c.split()[0] for c in STORE[name].split(", ")]
        schema = spark.table(f"{database}.{name}").schema
        full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns))
        full.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.insertInto(f"{database}.{name}")


__all__ = ["VectorStore", "exists", "features_from_file", "load_model", "save_model", "seed_demo"]
