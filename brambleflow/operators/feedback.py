"""Feedback and exposures: merging, statistics and interest weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the weight update: what stays, gain, loss, first weight, bounds.
STAYS, GAIN, LOSS, FIRST, LEAST, MOST = 0.72, 0.38, 0.52, 0.35, 0.05, 1.0
#: Decay of short-term interest and its floor.
DECAY, DECAY_FLOOR = 0.95, 0.1


def is_positive() -> Column:
    return F.coalesce(F.col("liked") | (F.col("rating") >= 4), F.col("liked"), F.col("rating") >= 4, F.lit(False))


def is_negative() -> Column:
    """As the ranking takes it: disliked, or rated 2 or less; an unknown like is neither."""
    return F.coalesce(F.col("liked") == F.lit(False), F.lit(False)) | F.coalesce(F.col("rating") <= 2, F.lit(False))


def routed(action: Column, stars: Column) -> dict[str, Column]:
    """liked, rating and whether weights change, of a like, a dislike or a star."""
    return {
        "liked": F.when(action == "like", True).when(action == "dislike", False).otherwise(stars >= 4),
        "rating": F.when(action == "dislike", 1).when(action == "star", stars),
        "updates": (action != "star") | (stars >= 4) | (stars <= 2),
    }


def latest_feedback(events: DataFrame) -> DataFrame:
    """One row per user and item: the latest non-null liked, rating and comment, in order of ts and event_id."""
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c)
    return events.groupBy("user_id", "item_id").agg(latest("liked"), latest("rating"), latest("comment_text"), F.max("ts").alias("interacted_at"))


def without(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    return feedback.join(ids.select("feedback_id"), "feedback_id", "left_anti")


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Each user's n newest rows."""
    own = Window.partitionBy("user_id").orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_place", F.row_number().over(own)).where(F.col("_place") <= n).drop("_place")


def exposures_with_feedback(exposures: DataFrame, feedback: DataFrame) -> DataFrame:
    """Exposures with liked, rating and whether the user reacted at all."""
    seen = feedback.select("user_id", "item_id", "liked", "rating", F.lit(1).alias("_found"))
    return exposures.join(seen, ["user_id", "item_id"], "left").withColumn("has_feedback", F.coalesce("_found", F.lit(0))).drop("_found")


def interaction_stats(exposures: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per user: exposures, reactions, likes, ratings and the mean rating; each exposure counts its feedback."""
    met = exposures_with_feedback(exposures, feedback)
    return met.groupBy("user_id").agg(
        F.count("*").alias("total_exposures"),
        F.sum("has_feedback").alias("total_interactions"),
        F.sum(F.when(F.col("liked"), 1).otherwise(0)).alias("total_likes"),
        F.sum(F.when(F.col("rating").isNotNull(), 1).otherwise(0)).alias("total_ratings"),
        F.round(F.coalesce(F.avg(F.col("rating").cast("double")), F.lit(0.0)), 2).alias("average_rating"),
    )


def feedback_scores(feedback: DataFrame) -> DataFrame:
    """Feedback with ``pos`` and ``neg``: what it counts for and against its tags."""
    rated = F.coalesce("rating", F.lit(3))
    up = 1 + 0.3 * (rated - 3) + F.when(F.length("comment_text") > 0, 0.5).otherwise(0.0)
    down = 0.9 + 0.25 * F.greatest(3 - rated, F.lit(0))
    return feedback.withColumn("pos", F.when(is_positive(), up).otherwise(0.0)).withColumn("neg", F.when(~is_positive() & is_negative(), down).otherwise(0.0))


def updated_weights(weights: DataFrame, feedback: DataFrame, item_tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Weights (user_id, tag, weight) after a batch of feedback.

    A tag's share of the feedback is its sum against twice the largest of its
    category, for and against apart.
    """
    own = feedback_scores(feedback).join(item_tags, "item_id").join(categories.select("tag", "category"), "tag")
    sums = own.groupBy("user_id", "category", "tag").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0 OR neg > 0")
    most = Window.partitionBy("user_id", "category")
    # A category without any feedback of a kind gives none of it (least() would skip the null).
    share = lambda c: F.when(F.max(c).over(most) > 0, F.least(F.col(c) / (2 * F.max(c).over(most)), F.lit(1.0))).otherwise(0.0)
    moves = sums.withColumn("p", share("pos")).withColumn("n", share("neg")).groupBy("user_id", "tag").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    both = weights.join(moves, ["user_id", "tag"], "full_outer")
    new = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), STAYS * F.coalesce("weight", F.lit(FIRST)) + GAIN * F.col("p") - LOSS * F.col("n")))
    return both.select("user_id", "tag", F.when(F.col("p").isNull(), F.col("weight")).otherwise(new).alias("weight"))


def recalculated(weights: DataFrame, feedback: DataFrame, item_tags: DataFrame, categories: DataFrame, n: int = 100) -> DataFrame:
    """Weights after a batch of each user's n latest feedback rows."""
    return updated_weights(weights, newest(feedback, n, "interacted_at", "item_id"), item_tags, categories)


def recorded(exposures: DataFrame, shown: DataFrame) -> DataFrame:
    """Exposures (user_id, item_id, shown_at, interacted) with shown lists (user_id, item_ids, shown_at) appended."""
    new = shown.select("user_id", F.explode("item_ids").alias("item_id"), "shown_at", F.lit(False).alias("interacted"))
    return exposures.select("user_id", "item_id", "shown_at", "interacted").unionByName(new)


def rated(feedback: DataFrame, least: int, n: int = 100) -> DataFrame:
    """Each user's n newest items rated ``least`` or more."""
    return newest(feedback.where(F.col("rating") >= least), n, "interacted_at", "item_id")


def user_item_matrix(feedback: DataFrame, least: int = 1) -> DataFrame:
    """(user_id, item_id, rating) of ratings of ``least`` or more."""
    return feedback.where(F.col("rating") >= least).select("user_id", "item_id", "rating")


def stepped(weight: Column, sign: Column) -> Column:
    """A weight after one event: with a single event a tag's share is one half."""
    moved = STAYS * weight + F.when(sign > 0, F.lit(GAIN / 2)).otherwise(F.lit(-LOSS / 2))
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), moved))


def folded_weights(events: DataFrame) -> DataFrame:
    """(user_id, tag, weight) after events (user_id, tag, ts, event_id, sign), one after another.

    A user's events of one tag are one array.
    """
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "sign")))
    return events.groupBy("user_id", "tag").agg(F.aggregate(listed, F.lit(FIRST), lambda w, e: stepped(w, e["sign"])).alias("weight"))


def decayed(weights: DataFrame, factor: float = DECAY, floor: float = DECAY_FLOOR) -> DataFrame:
    return weights.withColumn("weight", F.greatest(F.lit(floor), F.col("weight") * factor))


def top_categories(weights: DataFrame, categories: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, category, total, rank): a user's strongest categories."""
    from .ranking import ranked

    sums = weights.join(categories, "tag").groupBy("user_id", "category").agg(F.sum("weight").alias("total"))
    return ranked(sums, ["user_id"], n, score="total", item="category")


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The old rows whose keys the new ones lack, and the new ones."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def preference_vectors(weights: DataFrame, embeddings: DataFrame, size: int) -> DataFrame:
    """(user_id, v): mean of the tags' embeddings by weight (0.5 where none is known)."""
    from ..functions.vectors import summed

    met = weights.withColumn("w", F.coalesce("weight", F.lit(0.5))).join(embeddings.select("tag", "v"), "tag")
    out = met.groupBy("user_id").agg(summed(F.col("v"), size, F.col("w")).alias("v"), F.sum("w").alias("total"))
    return out.where("total > 0").select("user_id", F.transform("v", lambda x: x / F.col("total")).alias("v"))
