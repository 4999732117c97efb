"""Interest weights kept by a stream of feedback events.

Events (user_id, tag, ts, event_id, sign) update one weight per user and tag, one
after another; ``operators.feedback.folded_weights`` is the batch twin.  A
user's events of a micro-batch are applied in the order of ts and event_id.
Events that come after later ones of an earlier micro-batch are applied when
they come; those behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import functions as F

from ..operators.feedback import FIRST, GAIN, LEAST, LOSS, MOST, STAYS
from ..sources.keyed import BUCKETS, KeyedStore

OUTPUT = "user_id string, tag string, weight double, version long"
STATE = "weight double, version long"


def stepped(weight: float, sign: int) -> float:
    """A weight after one event."""
    return max(LEAST, min(MOST, STAYS * weight + (GAIN / 2 if sign > 0 else -LOSS / 2)))


class InterestWeights(StatefulProcessor):
    """State per user: a map of tag to weight and number of events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weights = handle.getMapState("weights", "tag string", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        touched: dict[str, tuple[float, int]] = {}
        for tag, sign in zip(events["tag"], events["sign"], strict=True):
            if tag not in touched:
                touched[tag] = self.weights.getValue((tag,)) if self.weights.containsKey((tag,)) else (FIRST, 0)
            weight, version = touched[tag]
            touched[tag] = (stepped(weight, sign), version + 1)
        for tag, value in touched.items():
            self.weights.updateValue((tag,), value)
        yield pd.DataFrame([(key[0], t, w, v) for t, (w, v) in touched.items()], columns=["user_id", "tag", "weight", "version"])

    def close(self) -> None:
        pass


def interest_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Updates (user_id, tag, weight, version) of a streaming DataFrame of events."""
    own = events.withWatermark("ts", late)
    return own.groupBy("user_id").transformWithStateInPandas(InterestWeights(), OUTPUT, "Update", "None")


def latest_weights(updates: DataFrame) -> DataFrame:
    """The last version of each weight in a sink of updates."""
    return updates.groupBy("user_id", "tag").agg(F.max_by("weight", "version").alias("weight"))


#: Each value with the event it came from: ts and event_id.
_VALUES = {"liked": "boolean", "rating": "int", "comment_text": "string"}


def feedback_store(spark: SparkSession, path: str, ts: str = "timestamp", buckets: int = BUCKETS) -> KeyedStore:
    """The table of merged feedback: one row a user and item, each value with its event; ``ts`` is the type of the events' ts."""
    values = ", ".join(f"{c} struct<ts: {ts}, event_id: bigint, value: {kind}>" for c, kind in _VALUES.items())
    return KeyedStore(spark, path, f"user_id string, item_id string, {values}, interacted_at {ts}", ["user_id", "item_id"], buckets)


def merge_events(store: KeyedStore, events: DataFrame) -> int:
    """The latest known value of each column wins, however late or often an event comes."""
    stamped = events.select("user_id", "item_id", *(F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", F.col(c).alias("value"))).alias(c) for c in _VALUES), F.col("ts").alias("interacted_at"))

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id", "item_id").agg(*(F.max(c).alias(c) for c in [*_VALUES, "interacted_at"]))

    return store.upsert(latest(stamped), lambda old, new: latest(old.unionByName(new)))


def feedback_of(store: KeyedStore) -> DataFrame:
    """user_id, item_id, liked, rating, comment_text, interacted_at."""
    return store.read().select("user_id", "item_id", *(F.col(f"{c}.value").alias(c) for c in _VALUES), "interacted_at")


def merged_feedback(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps one row per user and item in a keyed store; a micro-batch writes the buckets it touches.

    A repeated micro-batch, or one of a new checkpoint, changes nothing that is newer.
    """
    kind = dict(events.dtypes)["ts"]

    def merge(batch: DataFrame, _number: int) -> None:
        merge_events(feedback_store(batch.sparkSession, path, kind), batch)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").start()


def exposures_joined(exposures: DataFrame, feedback: DataFrame, late: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Streams of exposures and feedback joined: each exposure with the feedback that follows ``within`` it, or with none.

    ``exposures`` has user_id, item_id, ts, event_id, ``feedback`` user_id, item_id, ts,
    liked, rating.  An exposure waits until the watermark, ``late`` behind the slower
    stream, has passed the interval; then it comes out with nulls if nothing was
    found.  Rows behind the watermark are dropped.  The state holds the rows of
    an interval and of the lateness, whatever the length of the streams.
    """
    shown = exposures.select("user_id", "item_id", F.col("ts").alias("shown_at"), "event_id").withWatermark("shown_at", late).alias("e")
    told = feedback.select(F.col("user_id").alias("f_user"), F.col("item_id").alias("f_item"), F.col("ts").alias("interacted_at"), "liked", "rating").withWatermark("interacted_at", late).alias("f")
    after = F.expr(f"interacted_at >= shown_at AND interacted_at <= shown_at + INTERVAL {within}")
    met = shown.join(told, (F.col("user_id") == F.col("f_user")) & (F.col("item_id") == F.col("f_item")) & after, "left_outer")
    return met.select("user_id", "item_id", "shown_at", "event_id", "liked", "rating", "interacted_at", F.col("f_user").isNotNull().cast("int").alias("has_feedback"))


def exposures_joined_batch(exposures: DataFrame, feedback: DataFrame, within: str = "1 day") -> DataFrame:
    """The same of whole tables."""
    shown = exposures.select("user_id", "item_id", F.col("ts").alias("shown_at"), "event_id")
    told = feedback.select(F.col("user_id").alias("f_user"), F.col("item_id").alias("f_item"), F.col("ts").alias("interacted_at"), "liked", "rating")
    after = F.expr(f"interacted_at >= shown_at AND interacted_at <= shown_at + INTERVAL {within}")
    met = shown.join(told, (F.col("user_id") == F.col("f_user")) & (F.col("item_id") == F.col("f_item")) & after, "left_outer")
    return met.select("user_id", "item_id", "shown_at", "event_id", "liked", "rating", "interacted_at", F.col("f_user").isNotNull().cast("int").alias("has_feedback"))


#: How long a user's weights stand before they decay.
DECAY_AFTER = "7 days"
_KEPT = "tags array<string>, weights array<double>, version bigint, due timestamp"


def _moved(held: dict[str, float], rows: pd.DataFrame) -> dict[str, float]:
    """Weights that a batch of feedback changes: a tag's share is its sum against twice the largest of its category."""
    sums = rows.groupby(["category", "tag"], sort=True)[["pos", "neg"]].sum()
    sums = sums[(sums["pos"] > 0) | (sums["neg"] > 0)].reset_index()
    most = 2 * sums.groupby("category")[["pos", "neg"]].transform("max")
    shares = (sums[["pos", "neg"]] / most.where(most > 0)).clip(upper=1.0).fillna(0.0)
    moves = shares.groupby(sums["tag"], sort=True).sum()
    return {t: max(LEAST, min(MOST, STAYS * held.get(t, FIRST) + GAIN * p - LOSS * n)) for t, p, n in zip(moves.index, moves["pos"], moves["neg"], strict=True)}


def weights_stream(feedback: DataFrame, item_tags: DataFrame, categories: DataFrame, late: str = "1 day", after: str = DECAY_AFTER) -> DataFrame:
    """Updates (user_id, tag, weight, version, reason) of users' weights by a stream of feedback, with decay.

    ``feedback`` has user_id, item_id, ts, liked, rating, comment_text; the tables of
    tags are joined as they stand.  Each micro-batch of a user's feedback moves
    the weights as ``operators.feedback.updated_weights`` does.  When event time has
    passed ``after`` a user's last feedback, the weights decay once, and again
    after each further interval, until all stand at the floor; a user whose weights
    all stand there waits for feedback without a timer.  The state of a user is
    the weights of the tags that were touched.
    """
    from ..operators.feedback import DECAY, DECAY_FLOOR, feedback_scores

    step = pd.Timedelta(after)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tags, weights, version, due = state.get if state.exists else ([], [], 0, None)
        held = dict(zip(tags, weights, strict=True))
        if state.hasTimedOut:
            changed = {t: max(DECAY_FLOOR, w * DECAY) for t, w in held.items() if w != DECAY_FLOOR}
            reason, due = "decay", pd.Timestamp(due) + step
        else:
            rows = pd.concat(list(batches))
            changed, reason = _moved(held, rows), "feedback"
            newest = rows["ts"].max() + step
            due = newest if due is None else max(pd.Timestamp(due), newest)
        held |= changed
        version += 1
        state.update((list(held), [float(w) for w in held.values()], version, due.to_pydatetime()))
        if any(w != DECAY_FLOOR for w in held.values()):
            # A timer must lie ahead of the watermark.
            state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], t, w, version, reason) for t, w in changed.items()], columns=["user_id", "tag", "weight", "version", "reason"])

    own = feedback_scores(feedback.withWatermark("ts", late)).join(item_tags, "item_id").join(categories.select("tag", "category"), "tag").select("user_id", "ts", "category", "tag", "pos", "neg")
    return own.groupBy("user_id").applyInPandasWithState(update, f"{OUTPUT}, reason string", _KEPT, "update", "EventTimeTimeout")
