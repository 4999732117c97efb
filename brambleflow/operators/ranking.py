"""Ranked lists: rounding, ranks and cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def ranked(df: DataFrame, by: Sequence[str], k: int | None = None, score: str = "score", item: str = "item_id", rank: str = "rank") -> DataFrame:
    """Scores rounded, then ranked within ``by`` by score and item; at most k rows each.

    Rounding comes first, so that the order of a sum cannot turn a tie.
    """
    out = df.withColumn(score, F.round(score, DIGITS) + F.lit(0.0))
    out = out.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(item))))
    return out.where(F.col(rank) <= k) if k else out


def last_n(history: DataFrame, n: int, user: str = "user_id", order: str = "ts") -> DataFrame:
    """Each user's n latest rows, with ``pos`` 1 for the newest; of a history with places (``profiles.placed``) those that it holds."""
    if {"pos", "size"} <= set(history.columns):
        return history.where(F.col("pos") <= n)
    own = Window.partitionBy(user).orderBy(F.desc(order))
    return history.withColumn("pos", F.row_number().over(own)).where(F.col("pos") <= n)


def unseen(recommended: DataFrame, history: DataFrame, exclude_last: int | None = None) -> DataFrame:
    """Without the items of a user's (latest) history."""
    seen = history if exclude_last is None else last_n(history, exclude_last)
    return recommended.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
