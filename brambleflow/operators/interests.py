"""Interest tags: item scores, cold start and personalisation.

A dictionary has tag, keyword; weights have user_id, tag, weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.config import settled
from .dense import shared_candidates
from .keywords import contained
from .ranking import DIGITS, ranked

#: Score of a keyword in the title and in the description; shares of similarity and tags; the most a tag counts.
IN_TITLE, IN_DESCRIPTION, SHARES, TAG_UNIT = 2, 1, (0.7, 0.3), 6.0
DIVERSITY = 0.3
#: Items and users of a cell at most, about.
CELL_ITEMS, CELL_USERS = 256, 4096


def _tags_of(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text, tag, n): how many of a tag's keywords a text contains; each distinct text is read once."""
    words = dictionary.select("tag", F.lower("keyword").alias("keyword")).distinct()
    found = contained(texts.select("text").distinct(), words)
    return found.join(words, "keyword").groupBy("text", "tag").agg(F.count("*").alias("n"))


def tag_scores(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(item_id, tag, raw) with raw > 0: keywords found in lower-cased title and description."""
    own = lambda c, weight: items.select("item_id", F.lower(F.coalesce(c, F.lit(""))).alias("text"), F.lit(weight).alias("weight"))
    both = own("title", IN_TITLE).unionByName(own("description", IN_DESCRIPTION))
    met = both.join(_tags_of(both, dictionary), "text")
    return met.groupBy("item_id", "tag").agg(F.sum(F.col("weight") * F.col("n")).alias("raw"))


def title_tags(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(item_id, tag) of keywords in the title."""
    own = items.select("item_id", F.lower(F.coalesce("title", F.lit(""))).alias("text"))
    return own.join(_tags_of(own, dictionary), "text").select("item_id", "tag")


def item_matches(scores: DataFrame, weights: DataFrame, n: int = 3, least: float = 0.05) -> DataFrame:
    """(user_id, item_id, tag, score, rank): the n best tags of an item for a user.

    A user and an item are one row each, with their tags, of which the dictionary
    has few; a user has a tag once.  Users and items are dealt to cells of bounded size that together hold
    every pair, so a frequent tag's rows aren't one task's, and pairs aren't shuffled.
    """
    own = settled(weights.where("tag IS NOT NULL").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "weight"))).alias("weights")), "weights")
    held = settled(scores.groupBy("item_id").agg(F.collect_list(F.struct("tag", "raw")).alias("tags")), "tags")
    over, down = (max(1, -(-side.count() // most)) for side, most in ((held, CELL_ITEMS), (own, CELL_USERS)))
    group = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cell = F.col("down") * over + F.col("over")
    tasks = min(2000, over * down)
    users = own.select("user_id", "weights", group("user_id", down).alias("down"), each(over).alias("over")).select(cell.alias("cell"), "user_id", "weights").repartition(tasks, "cell")
    items = held.select("item_id", "tags", group("item_id", over).alias("over"), each(down).alias("down")).select(cell.alias("cell"), "item_id", "tags").repartition(tasks, "cell")
    # As in a ranked list: rounded, largest first, then by tag.
    scored = F.transform("tags", lambda x: F.struct(x["tag"].alias("tag"), (x["raw"] * F.element_at("weights", x["tag"])).alias("exact")))
    kept = F.transform(F.filter(scored, lambda x: x["exact"] >= least), lambda x: F.struct((-(F.round(x["exact"], DIGITS) + F.lit(0.0))).alias("minus"), x["tag"].alias("tag")))
    best = F.slice(F.array_sort(kept), 1, n)
    met = users.hint("merge").join(items, "cell").select("user_id", "item_id", F.posexplode(best).alias("at", "x"))
    return met.select("user_id", "item_id", "x.tag", (-F.col("x.minus") + F.lit(0.0)).alias("score"), (F.col("at") + 1).alias("rank"))


def interest_query(weights: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(user_id, text): each keyword of a tag as often as three times its weight says, the first 50."""
    words = weights.join(dictionary, "tag").withColumn("times", F.floor(F.col("weight") * 3).cast("int")).where("times > 0")
    listed = F.array_sort(F.collect_list(F.struct(-F.col("weight"), "tag", "keyword", "times")))
    flat = F.flatten(F.transform(listed, lambda x: F.array_repeat(x["keyword"], x["times"])))
    return words.groupBy("user_id").agg(F.array_join(F.slice(flat, 1, 50), " ").alias("text"))


def tag_sums(pairs: DataFrame, scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, item_id, score): of given pairs with a common tag, the item's scores by the user's weights.

    Items meet their tags first, so rows grow with the pairs, not with users times items.
    """
    met = pairs.select("user_id", "item_id").distinct().join(scores, "item_id").join(weights, ["user_id", "tag"])
    return met.groupBy("user_id", "item_id").agg(F.sum(F.col("raw") * F.col("weight")).alias("score"))


def largest_sums(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, most): a user's largest sum of tags over all items; items of equal tag scores count once."""
    own = scores.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("tag", "raw"))).alias("tags")).select("tags").distinct()
    met = own.select("tags", F.explode("tags").alias("x")).select("tags", "x.tag", "x.raw").join(weights, "tag")
    sums = met.groupBy("user_id", "tags").agg(F.sum(F.col("raw") * F.col("weight")).alias("sum"))
    return sums.groupBy("user_id").agg(F.max("sum").alias("most"))


def weighted_tags(pairs: DataFrame, scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, item_id, tags): scores of an item's tags by the user's weights, over the most they could count."""
    tags = weights.groupBy("user_id").agg(F.count("*").alias("n"))
    met = tag_sums(pairs, scores, weights).withColumnRenamed("score", "sum")
    return met.join(tags, "user_id").select("user_id", "item_id", (F.col("sum") / (TAG_UNIT * F.col("n"))).alias("tags"))


def interest_candidates(users: DataFrame, features: DataFrame, scores: DataFrame, weights: DataFrame, tags: Sequence[str], k: int) -> DataFrame:
    """(user_id, item_id, similarity): of all items with a vector, those that can be a user's k best by similarity and tags.

    ``users`` has user_id, v; ``features`` item_id, v; ``tags`` are the dictionary's.
    """

    def listed(rows: DataFrame, key: str, value: Column) -> DataFrame:
        return rows.groupBy(key).agg(F.array(*(F.sum(F.when(F.col("tag") == t, value).otherwise(0.0)) for t in tags)).alias("w"), F.count("*").alias("n"))

    zeros = F.array(*[F.lit(0.0)] * len(tags))
    own = listed(weights, "user_id", F.col("weight")).select("user_id", F.transform("w", lambda x: x / (TAG_UNIT * F.col("n"))).alias("w"))
    q = users.join(own, "user_id", "left").select(F.col("user_id").alias("query_id"), "v", F.coalesce("w", zeros).alias("w"))
    i = features.join(listed(scores, "item_id", F.col("raw").cast("double")), "item_id", "left").select("item_id", "v", F.coalesce("w", zeros).alias("w"))
    return shared_candidates(q, i, k, len(tags), SHARES).select(F.col("query_id").alias("user_id"), "item_id", F.col("score").alias("similarity"))


def interest_recommend(similar: DataFrame, scores: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """By similarity to the user's interest query (user_id, item_id, similarity) and by tags."""
    met = similar.join(weighted_tags(similar, scores, weights), ["user_id", "item_id"], "left")
    out = met.withColumn("score", SHARES[0] * F.col("similarity") + SHARES[1] * F.coalesce("tags", F.lit(0.0)))
    return ranked(out.select("user_id", "item_id", "score"), ["user_id"], k)


def diversified(pool: DataFrame, features: DataFrame, k: int, weight: float = DIVERSITY) -> DataFrame:
    """The k best of a user's 2k: score against the best, and distance to the farthest other."""
    pool = pool.where(F.col("rank") <= 2 * k).select("user_id", "item_id", "score").join(features.select("item_id", "v"), "item_id")
    a, b = pool.alias("a"), pool.alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.item_id") != F.col("b.item_id")))
    far = met.groupBy(F.col("a.user_id").alias("user_id"), F.col("a.item_id").alias("item_id")).agg(F.min(cosine(F.col("a.v"), F.col("b.v"))).alias("least"))
    best = F.max("score").over(Window.partitionBy("user_id"))
    out = pool.join(far, ["user_id", "item_id"], "left").withColumn("diversity", 1 - F.coalesce("least", F.lit(0.0)))
    out = out.withColumn("score", (1 - weight) * F.when(best > 0, F.col("score") / best).otherwise(0.0) + weight * F.col("diversity"))
    return ranked(out.select("user_id", "item_id", "score"), ["user_id"], k)


def negative_profile(disliked: DataFrame, scores: DataFrame) -> DataFrame:
    """(user_id, tag, weight): the three strongest tags of disliked items, summed, against the largest sum."""
    top = ranked(scores.select("item_id", "tag", F.col("raw").cast("double").alias("score")), ["item_id"], 3, item="tag")
    sums = disliked.select("user_id", "item_id").distinct().join(top, "item_id").groupBy("user_id", "tag").agg(F.sum("score").alias("sum"))
    return sums.withColumn("weight", F.col("sum") / F.max("sum").over(Window.partitionBy("user_id"))).select("user_id", "tag", "weight")


def personalized(base: DataFrame, interest: DataFrame, liked: DataFrame, blocked: DataFrame, negative: DataFrame, k: int, most: DataFrame | None = None) -> DataFrame:
    """A user's candidates (user_id, item_id, rank_score) by interest, likes and dislikes.

    ``interest`` and ``negative`` have user_id, item_id, score, each taken against
    the user's largest, which ``most`` (user_id, most) gives for ``negative`` where
    its rows are the candidates' alone.  Blocked items go
    unless that leaves nothing.  Interest items that aren't candidates, max(2,
    k // 3) of them, are put in.  Returns user_id, item_id, final_score, origin, rank.
    """
    unit = lambda df, name: df.select("user_id", "item_id", (F.col("score") / F.max("score").over(Window.partitionBy("user_id"))).alias(name))
    dislike = unit(negative, "negative") if most is None else negative.join(most, "user_id").select("user_id", "item_id", (F.col("score") / F.col("most")).alias("negative"))
    own = base.join(blocked.select("user_id", "item_id").distinct().withColumn("bad", F.lit(1)), ["user_id", "item_id"], "left")
    left = F.sum(F.when(F.col("bad").isNull(), 1).otherwise(0)).over(Window.partitionBy("user_id"))
    own = own.withColumn("left", left).where("bad IS NULL OR left = 0").drop("bad", "left")
    interest_unit = unit(interest, "interest")
    likes = liked.select("user_id", "item_id").distinct().withColumn("liked", F.lit(1))
    met = own.join(interest_unit, ["user_id", "item_id"], "left").join(dislike, ["user_id", "item_id"], "left").join(likes, ["user_id", "item_id"], "left")
    i = F.when(F.col("liked") == 1, F.greatest(F.coalesce("interest", F.lit(0.7)), F.when(F.col("interest").isNotNull(), F.lit(0.8)).otherwise(F.lit(0.7)))).otherwise(F.coalesce("interest", F.lit(0.0)))
    n, s = F.coalesce("negative", F.lit(0.0)), F.col("rank_score")
    # Rounded, so that the order of a sum cannot carry a value over a threshold.
    final = F.when(F.round(n, DIGITS) > 0.3, 0.30 * s + 0.50 * i - 0.35 * n).when(F.round(i, DIGITS) > 0.1, 0.35 * s + 0.50 * i - 0.10 * n + 0.05).otherwise(0.45 * s + 0.35 * i - 0.10 * n)
    kept = met.select("user_id", "item_id", final.alias("final_score"), F.lit("base").alias("origin"))
    more = ranked(interest_unit.join(base.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").join(base.select("user_id").distinct(), "user_id", "left_semi").join(blocked.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti"), ["user_id"], max(2, k // 3), score="interest")
    more = more.select("user_id", "item_id", (0.65 * F.col("interest") + 0.05).alias("final_score"), F.lit("interest").alias("origin"))
    return ranked(kept.unionByName(more), ["user_id"], k, score="final_score")


#: Shares of base score, interest and dislike in the report's order.
REPORT = (0.64, 0.31, 0.17)


def report_personalized(base: DataFrame, interest: DataFrame, negative: DataFrame, k: int) -> DataFrame:
    """A user's candidates (user_id, item_id, rank_score) in the report's order.

    ``interest`` and ``negative`` have user_id, item_id, score, each taken against
    the largest among the candidates.  Returns user_id, item_id, generic_score,
    personalization_score, negative_score, final_score, rank.
    """
    met = base.join(interest.withColumnRenamed("score", "i"), ["user_id", "item_id"], "left").join(negative.withColumnRenamed("score", "n"), ["user_id", "item_id"], "left")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(Window.partitionBy("user_id")), F.lit(0.0)), F.lit(0.0))
    out = met.select("user_id", "item_id", F.col("rank_score").alias("generic_score"), share("i").alias("personalization_score"), share("n").alias("negative_score"))
    a, b, c = REPORT
    out = out.withColumn("final_score", a * F.col("generic_score") + b * F.col("personalization_score") - c * F.col("negative_score"))
    return ranked(out, ["user_id"], k, score="final_score")


def keywords_of(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tag, keyword) of tags; one that the dictionary lacks is its own keyword in lower case."""
    return tags.select("tag").distinct().join(dictionary.select("tag", "keyword"), "tag", "left").select("tag", F.coalesce("keyword", F.lower("tag")).alias("keyword"))


def registered(asked: DataFrame, have: DataFrame, categories: DataFrame, weight: float = 0.5, replace: bool = False) -> DataFrame:
    """Interests (user_id, category, tag, weight) with those asked for (user_id, tag) that a user lacks.

    Tags are trimmed, blank ones skipped, unknown ones of category Custom.  With
    ``replace``, the users' former interests go.
    """
    new = asked.select("user_id", F.trim("tag").alias("tag")).where("tag <> ''").distinct()
    named = new.join(categories.groupBy("tag").agg(F.min("category").alias("category")), "tag", "left")
    new = named.select("user_id", F.coalesce("category", F.lit("Custom")).alias("category"), "tag", F.lit(weight).alias("weight"))
    own = have.select("user_id", "category", "tag", "weight")
    if replace:
        own = own.join(asked.select("user_id").distinct(), "user_id", "left_anti")
    return own.unionByName(new.join(own.select("user_id", "tag"), ["user_id", "tag"], "left_anti"))


def accounts(users: DataFrame, interests: DataFrame) -> DataFrame:
    """(user_id, nickname, n_interests, interests): a user's tags by weight; login compares the hash of the password."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "tag")))
    own = interests.groupBy("user_id").agg(F.transform(listed, lambda x: x["tag"]).alias("interests"))
    out = users.join(own, "user_id", "left").withColumn("interests", F.coalesce("interests", F.array().cast("array<string>")))
    return out.select("user_id", "nickname", F.size("interests").cast("long").alias("n_interests"), "interests")


def rank_changes(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(user_id, changed_items, overlap_count, top1_changed) of two ranked lists."""
    a = before.where(F.col("rank") <= k).select("user_id", "item_id", F.col("rank").alias("a"))
    b = after.where(F.col("rank") <= k).select("user_id", "item_id", F.col("rank").alias("b"))
    met = a.join(b, ["user_id", "item_id"], "full_outer")
    return met.groupBy("user_id").agg(
        F.sum((~F.col("a").eqNullSafe(F.col("b")) & F.col("b").isNotNull()).cast("int")).alias("changed_items"),
        F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")).alias("overlap_count"),
        (F.max(F.when((F.col("a") == 1) & (F.col("b") == 1), 1).otherwise(0)) == 0).alias("top1_changed"),
    )
