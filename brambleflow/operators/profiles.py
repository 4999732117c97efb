"""Histories, splits and user profiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import averaged, blended, close, doubles, normalized, summed
from ..sources.config import settled
from .ranking import last_n

#: Weights of the three latest items, length of the long history, share of the short profile.
SHORT, LONG, SHORT_SHARE = (0.55, 0.30, 0.15), 10, 0.65
IMAGES, CLUSTER_HISTORY, MOST_CLUSTERS, STARTS = 20, 50, 5, 10
#: The fewest bins to which items are dealt for negatives, the items of a bin of large catalogues, the bins that are tried at once, positives of a task.
BINS, BIN_ITEMS, REACH, TASK_POSITIVES = 64, 32, 4, 1 << 16


def dense_ordinal(log: DataFrame, *order: str | Column, user: str = "user_id") -> DataFrame:
    """The log with ``ts`` 1, 2, ... within a user."""
    return log.withColumn("ts", F.row_number().over(Window.partitionBy(user).orderBy(*order)).cast("long"))


def leave_last_n(history: DataFrame, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """(train, truth): users with more than n rows; their last n are the truth."""
    own = Window.partitionBy("user_id")
    marked = history.withColumn("size", F.count("*").over(own)).withColumn("from_end", F.row_number().over(own.orderBy(F.desc("ts"))))
    marked = marked.where(F.col("size") > n)
    return marked.where(F.col("from_end") > n).select(history.columns), marked.where(F.col("from_end") <= n).select(history.columns)


def placed(history: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of items (item_id) with ``pos`` (1 for the newest) and ``size`` among all rows of the user, settled.

    What needs the latest rows with vectors reads this table instead of placing the whole history again.
    """
    if {"pos", "size"} <= set(history.columns):
        return history
    own = Window.partitionBy("user_id")
    marked = history.withColumn("pos", F.row_number().over(own.orderBy(F.desc("ts")))).withColumn("size", F.count("*").over(own))
    return settled(marked.join(items.select("item_id").distinct(), "item_id", "left_semi"), "placed")


def activity_between(history: DataFrame, least: int, most: int) -> DataFrame:
    """Rows of users with so many rows."""
    kept = history.groupBy("user_id").count().where(F.col("count").between(least, most))
    return history.join(kept.select("user_id"), "user_id", "left_semi")


def first_users(history: DataFrame, n: int) -> DataFrame:
    """Rows of the first n users by id."""
    return history.join(history.select("user_id").distinct().orderBy("user_id").limit(n), "user_id", "left_semi")


def weighted_profile(history: DataFrame, features: DataFrame, size: int, weights: Sequence[float] | None = None, n: int = LONG) -> DataFrame:
    """(user_id, v): mean vector of the n latest items, weighted by place, of length one.

    Items without a vector drop out with their weights.
    """
    own = last_n(history, len(weights) if weights else n)
    weight = F.lit(1.0) if weights is None else F.element_at(F.array(*map(F.lit, weights)), F.col("pos").cast("int"))
    met = own.withColumn("weight", weight).join(features.select("item_id", "v"), "item_id")
    mean = met.groupBy("user_id").agg(summed(F.col("v"), size, F.col("weight")).alias("v"), F.sum("weight").alias("total"))
    return mean.select("user_id", normalized(F.when(F.col("total") > 0, F.transform("v", lambda x: x / F.col("total"))).otherwise(F.col("v"))).alias("v"))


def interest_profiles(history: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(user_id, short_vec, long_vec, hybrid_vec)."""
    short = weighted_profile(history, features, size, SHORT).withColumnRenamed("v", "short_vec")
    long = weighted_profile(history, features, size, None, LONG).withColumnRenamed("v", "long_vec")
    both = short.join(long, "user_id", "full_outer")
    return both.withColumn("hybrid_vec", normalized(blended(F.col("short_vec"), F.col("long_vec"), SHORT_SHARE)))


def image_profile(history: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Mean image vector of the latest items; users without one have no row."""
    return weighted_profile(history, images, size, None, IMAGES)


def mean_of_units(history: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """Vectors brought to length one, averaged, brought to length one."""
    met = history.join(features.select("item_id", normalized(F.col("v")).alias("v")), "item_id")
    return met.groupBy("user_id").agg(averaged(F.col("v"), size).alias("v")).withColumn("v", normalized(F.col("v")))


def history_halves(history: DataFrame, n: int = LONG) -> DataFrame:
    """The n latest items with ``half`` 1 (newer) or 2, for users with four or more."""
    own = last_n(history, n)
    own = own.withColumn("size", F.least("size", F.lit(n)) if "size" in own.columns else F.count("*").over(Window.partitionBy("user_id")))
    return own.where("size >= 4").withColumn("half", F.when(F.col("pos") <= F.floor(F.col("size") / 2), 1).otherwise(2))


def interest_set(history: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(user_id, number, v): short, long and hybrid profile and those of both halves of the history as interests 1 to 5.

    One that is nearly an earlier one is left out.
    """
    history = placed(history, features)
    profiles = interest_profiles(history, features, size)
    halves = history_halves(history).join(features.select("item_id", "v"), "item_id").groupBy("user_id", "half").agg(normalized(averaged(F.col("v"), size)).alias("v"))
    # A user's vectors are five at most.
    halves = halves.groupBy("user_id").agg(*(F.first(F.when(F.col("half") == h, F.col("v")), ignorenulls=True).alias(f"half{h}") for h in (1, 2)))
    every = F.array("short_vec", "long_vec", "hybrid_vec", "half1", "half2")
    numbered = F.filter(F.transform(every, lambda v, i: F.struct((i + 1).alias("number"), v.alias("v"))), lambda x: x["v"].isNotNull())
    none = F.filter(numbered, lambda x: F.lit(False))
    kept = F.aggregate(numbered, none, lambda held, x: F.when(F.exists(held, lambda y: close(x["v"], y["v"])), held).otherwise(F.concat(held, F.array(x))))
    return profiles.join(halves, "user_id", "left").select("user_id", F.explode(kept).alias("x")).select("user_id", "x.number", "x.v")


def mean_profile(history: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(user_id, v): mean vector of the whole history, of length one."""
    met = history.join(features.select("item_id", "v"), "item_id")
    return met.groupBy("user_id").agg(normalized(averaged(F.col("v"), size)).alias("v"))


def kmeans_interests(history: DataFrame, features: DataFrame, seed: int = 42, rounds: int = 25) -> DataFrame:
    """(user_id, number, v): centres of a user's latest item vectors.

    Up to five distinct vectors stand for themselves; more are clustered into
    ceil(sqrt(n / 2)) groups, two to five: the best of STARTS runs from random
    vectors.  A user's latest items are few, so a group is small whatever the
    corpus.
    """
    rows = last_n(history, CLUSTER_HISTORY).join(features.select("item_id", doubles(F.col("v")).alias("v")), "item_id").where("v IS NOT NULL")
    own = rows.groupBy("user_id").agg(F.collect_list(F.struct("v")).alias("vs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            users, numbers, found = [], [], []
            for user, held in zip(batch.column("user_id").to_pylist(), batch.column("vs"), strict=True):
                vecs = held.values.field("v")
                x = np.unique(np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), float).reshape(len(vecs), -1), axis=0)
                c = clustered(x, seed, rounds) if len(x) > MOST_CLUSTERS else x
                users += [user] * len(c)
                numbers += range(1, len(c) + 1)
                found += list(c)
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.string()), pa.array(numbers, pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["user_id", "number", "v"])

    return own.mapInArrow(run, "user_id string, number int, v array<double>")


def clustered(x: np.ndarray, seed: int = 42, rounds: int = 25) -> np.ndarray:
    """Centres of the best of STARTS runs of k-means over distinct rows; the runs go together, round by round."""
    n = len(x)
    k = int(np.clip(np.ceil(np.sqrt(n / 2)), 2, min(MOST_CLUSTERS, n - 1)))
    rng = np.random.default_rng(seed)
    c = x[np.stack([rng.choice(n, k, replace=False) for _ in range(STARTS)])]
    own, live, exact = np.full((STARTS, n), -1), np.arange(STARTS), (x * x).sum() * 1e-12
    for _round in range(rounds):
        some = c[live]
        d = (some * some).sum(axis=2)[:, None] - 2 * (x @ some.transpose(0, 2, 1))
        least = np.partition(d, 1, axis=2)
        if not (least[:, :, 1] - least[:, :, 0]).min() > exact:  # a tie or nearly one: by the differences themselves
            d = ((x[None, :, None] - some[:, None]) ** 2).sum(axis=3)
        near = d.argmin(axis=2)
        moved = (near != own[live]).any(axis=1)
        live, near = live[moved], near[moved]
        if not len(live):
            break
        own[live] = near
        held = (near[:, None] == np.arange(k)[None, :, None]).astype(float)
        counts = held.sum(axis=2)[:, :, None]
        c[live] = np.where(counts > 0, held @ x / np.maximum(counts, 1), c[live])
    spread = ((x[None, :, None] - c[:, None]) ** 2).sum(axis=3).min(axis=2).sum(axis=1)
    best = 0
    for start in range(1, STARTS):
        if spread[start] < spread[best] - 1e-12:
            best = start
    return np.array([x[own[best] == j].mean(axis=0) if (own[best] == j).any() else c[best, j] for j in range(k)])


def prefixes(history: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """Each row after ``least`` others as a positive with the items before it, newest first: user_id, item_id, ts, before."""
    own = Window.partitionBy("user_id").orderBy("ts")
    frame = own.rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    out = history.withColumn("place", F.row_number().over(own)).withColumn("before", F.reverse(F.collect_list("item_id").over(frame)))
    return out.where(F.col("place") > least).select("user_id", "item_id", "ts", "before")


def hashed_negatives(positives: DataFrame, items: DataFrame, history: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """For each user's positive, n items outside the user's history, in the order of a hash.

    Items are dealt to hash bins, the more items the more bins; a positive draws
    from the bin of its own hash and, where that has too few, from the following
    ones until n are found or all bins are used.  It meets its own bin as one array,
    of which the first 2n items go on; where a user's history leaves too few of
    these, it meets the items of REACH bins, and only where these hold little but
    a user's history all.
    """
    hashed = lambda *key: F.conv(F.substring(F.md5(F.concat_ws("#", *key, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    each = items.select("item_id").distinct()
    bins = F.broadcast(each.agg(F.greatest(F.lit(BINS), F.floor(F.count("*") / BIN_ITEMS)).cast("long").alias("bins")))
    dealt = each.crossJoin(bins).select("item_id", (hashed("item_id") % F.col("bins")).alias("bin"))
    asked = positives.select("user_id", F.col("item_id").alias("positive"), hashed("user_id", "item_id").alias("own")).distinct().crossJoin(bins)
    asked = settled(asked.select("user_id", "positive", "bins", (F.col("own") % F.col("bins")).alias("start")), "asked")
    seen = history.select("user_id", "item_id")
    by_hash = F.md5(F.concat_ws("#", "user_id", "positive", "item_id", F.lit(str(seed))))

    def picked(met: DataFrame, *order: str | Column) -> DataFrame:
        met = met.where(F.col("item_id") != F.col("positive")).join(seen, ["user_id", "item_id"], "left_anti")
        pick = Window.partitionBy("user_id", "positive").orderBy(*order)
        return met.withColumn("place", F.row_number().over(pick)).where(F.col("place") <= n).select("user_id", "positive", "item_id", "place")

    def rest(asked: DataFrame, found: DataFrame) -> DataFrame:
        return settled(asked.join(found.where(F.col("place") == n), ["user_id", "positive"], "left_anti"), "short")

    # A bin holds about BIN_ITEMS items.  Sorting it for each positive takes time, not bytes, so the tasks are told.
    tasks = max(2 * asked.sparkSession.sparkContext.defaultParallelism, asked.count() // TASK_POSITIVES)
    shelves = dealt.repartition(tasks, "bin").groupBy(F.col("bin").alias("start")).agg(F.collect_list("item_id").alias("held"))
    keyed = lambda x: F.struct(F.md5(F.concat_ws("#", "user_id", "positive", x, F.lit(str(seed)))).alias("key"), x.alias("item"))
    ordered = F.array_sort(F.transform(F.filter("held", lambda x: x != F.col("positive")), keyed))
    met = asked.repartition(tasks, "start").hint("merge").join(shelves, "start")
    first = met.select("user_id", "positive", F.posexplode(F.transform(F.slice(ordered, 1, 2 * n), lambda x: x["item"])).alias("at", "item_id"))
    own = settled(picked(first, "at"), "picked")
    short = rest(asked, own)
    if short.isEmpty():
        return own
    reach = short.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(REACH - 1)))).withColumn("bin", F.pmod(F.col("start") + F.col("ahead"), F.col("bins")))
    near = settled(picked(reach.join(dealt, "bin"), "ahead", by_hash, "item_id"), "picked")
    last = rest(short, near)
    more = picked(last.crossJoin(dealt).withColumn("ahead", F.pmod(F.col("bin") - F.col("start"), F.col("bins"))), "ahead", by_hash, "item_id")
    served = lambda found: found.join(found.where(F.col("place") == n).select("user_id", "positive"), ["user_id", "positive"], "left_semi")
    return served(own).unionByName(served(near)).unionByName(more)


def leave_one_pairs(history: DataFrame, n: int = 5) -> DataFrame:
    """Each item of a user with the user's first n other items: user_id, item_id, ts, others (in order of time)."""
    a = history.select("user_id", "item_id", "ts").alias("a")
    early = history.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).where(F.col("place") <= n + 1)
    b = early.select("user_id", F.col("item_id").alias("other"), F.col("ts").alias("other_ts")).alias("b")
    met = a.join(b, "user_id").where(F.col("ts") != F.col("other_ts"))
    own = Window.partitionBy("user_id", "ts").orderBy("other_ts")
    met = met.withColumn("place", F.row_number().over(own)).where(F.col("place") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("other_ts", "other"))), lambda x: x["other"])
    return met.groupBy("user_id", "item_id", "ts").agg(F.array_join(listed, " ").alias("others"))

