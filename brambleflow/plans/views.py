"""Views of the star schema as catalogue, log, features and feedback, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators.profiles import dense_ordinal

TEXT_SIZE = 32
#: Fixed value: tags over the words of part names, as (category, tag, keywords).
DICTIONARY = [
    ("object", "Hardware", "bolt rod plate"),
    ("object", "Tool", "anvil gear gizmo widget"),
    ("object", "Ring", "ring"),
    ("look", "Color", "red blue"),
    ("look", "Size", "large small"),
    ("state", "Heat", "hot cold"),
    ("state", "Age", "new old"),
]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    p = _read(spark, folder, "part")
    return p.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"), F.col("p_retailprice").alias("price"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    met = _read(spark, folder, "lineitem").join(_read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    own = met.select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id"), *order)
    return dense_ordinal(own, *order).select("user_id", "item_id", "ts")


def features(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, v (whole), text_vec, image_vec."""
    e = _read(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), doubles(F.col("embedding")).alias("v"))
    return e.select("item_id", "v", F.slice("v", 1, TEXT_SIZE).alias("text_vec"), F.slice("v", TEXT_SIZE + 1, TEXT_SIZE).alias("image_vec"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")


def searches(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def _event_items(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type", F.get_json_object("props", "$.k").alias("item_id"))


def feedback_events(spark: SparkSession, folder: str) -> DataFrame:
    e = _event_items(spark, folder).where(F.col("event_type").isin("click", "purchase", "error"))
    rating = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "click", 4).otherwise(1)
    return e.select("event_id", "ts", "user_id", "item_id", F.col("event_type").isin("click", "purchase").alias("liked"), rating.alias("rating"), F.lit(None).cast("string").alias("comment_text"))


def exposures(spark: SparkSession, folder: str) -> DataFrame:
    return _event_items(spark, folder).where(F.col("event_type") == "view").select("event_id", "ts", "user_id", "item_id")


def dictionary(spark: SparkSession) -> DataFrame:
    rows = [(c, t, w) for c, t, words in DICTIONARY for w in words.split()]
    return spark.createDataFrame(rows, "category string, tag string, keyword string")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, t, _ in DICTIONARY], "category string, tag string")


_VALUES = ", ".join(f"('{c}', '{t}', '{w}')" for c, t, words in DICTIONARY for w in words.split())
#: The same views for DuckDB, and what several queries' SQL shares; a later one may use earlier ones.
SQL_VIEWS = {
    "items": "SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_brand AS brand, p_type AS category, concat_ws(' ', p_name, p_brand, p_type) AS description, p_retailprice AS price FROM part",
    "history": "SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "features": "SELECT vec_id::VARCHAR AS item_id, embedding::DOUBLE[] AS v, embedding[1:32]::DOUBLE[] AS text_vec, embedding[33:64]::DOUBLE[] AS image_vec FROM embeddings",
    "latest": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS pos FROM history",
    "sized": "SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM latest",
    "train": "SELECT user_id, item_id, ts FROM sized WHERE n > 2 AND pos > 2",
    "truth": "SELECT user_id, item_id, ts FROM sized WHERE n > 2 AND pos <= 2",
    "dictionary": f"SELECT * FROM (VALUES {_VALUES}) AS t(category, tag, keyword)",
    "categories": "SELECT DISTINCT category, tag FROM dictionary",
    "title_tags": "SELECT DISTINCT item_id, tag FROM items JOIN dictionary ON contains(lower(title), keyword)",
    "tag_scores": "SELECT item_id, tag, sum(2 * contains(lower(title), keyword)::INT + contains(lower(description), keyword)::INT)::BIGINT AS raw FROM items JOIN dictionary ON contains(lower(title), keyword) OR contains(lower(description), keyword) GROUP BY item_id, tag",
    "event_items": "SELECT event_id, ts, user_id::VARCHAR AS user_id, event_type, json_extract_string(props, '$.k') AS item_id FROM events",
    "feedback_events": "SELECT event_id, ts, user_id, item_id, event_type IN ('click', 'purchase') AS liked, CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 4 ELSE 1 END AS rating FROM event_items WHERE event_type IN ('click', 'purchase', 'error')",
    "exposures": "SELECT event_id, ts, user_id, item_id FROM event_items WHERE event_type = 'view'",
    "feedback": "SELECT user_id, item_id, arg_max(liked, (ts, event_id)) AS liked, arg_max(rating, (ts, event_id)) AS rating, max(ts) AS interacted_at FROM feedback_events GROUP BY user_id, item_id",
    "signs": "SELECT user_id, tag, ts, event_id, CASE WHEN liked THEN 1 ELSE -1 END AS sign FROM feedback_events JOIN title_tags USING (item_id)",
    "listed": "SELECT user_id, tag, list(sign ORDER BY ts, event_id) AS signs FROM signs GROUP BY user_id, tag",
    "weights": "SELECT user_id, tag, list_reduce(list_prepend(0.35::DOUBLE, signs::DOUBLE[]), lambda w, s: greatest(0.05::DOUBLE, least(1::DOUBLE, 0.72::DOUBLE * w + CASE WHEN s > 0 THEN 0.19::DOUBLE ELSE -0.26::DOUBLE END))) AS weight FROM listed",
}


def with_views(body: str, *names: str, **more: str) -> str:
    """SQL with the named views, and those that these use, before it."""
    import re

    needed: list[str] = []

    def need(name: str, text: str) -> None:
        for other in SQL_VIEWS:
            if other != name and other not in needed and re.search(rf"\b{other}\b", text):
                need(other, SQL_VIEWS[other])
        if name in SQL_VIEWS and name not in needed:
            needed.append(name)

    need("", " ".join([body, *more.values(), *names]))
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in needed] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}"
