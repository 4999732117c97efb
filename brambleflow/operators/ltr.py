"""Features and models of learning to rank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import doubles
from .ranking import last_n, ranked

HISTORY = 50
LTR = [
    "history_length", "has_text", "has_image", "has_multi", "recall_score",
    "text_max", "text_mean", "text_min", "text_attention", "image_max", "image_mean", "image_min", "image_attention",
    "multi_max", "multi_mean", "multi_min", "multi_std", "multi_attention", "attention_std", "attention_max",
    "user_avg_sim", "mean_difference", "mean_ratio", "combined",
]
PAIRWISE = [
    "bm25_score", "interest_max", "text_cosine", "image_cosine", "recall_score", "from_bm25", "from_faiss", "from_both",
    "hybrid_cosine", "short_cosine", "long_cosine", "history_max", "history_mean", "token_overlap", "title_tokens",
]
#: Shares of recall score, attention and similarity to the user's mean in the combined score.
COMBINED = (0.3, 0.4, 0.3)
#: Rows of a training matrix at which no further user is added, candidates a user.
MATRIX_ROWS, USER_CANDIDATES = 70_000, 100


def token_overlap(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, overlap): shared tokens, as often as both have them, over the user's tokens.

    ``users`` has user_id, text; ``items`` item_id, title.
    """
    count = lambda df, key, text, n: df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    own, title = count(users, "user_id", "text", "x"), count(items, "item_id", "title", "y")
    sizes = own.groupBy("user_id").agg(F.sum("x").alias("size"))
    met = pairs.join(own, "user_id").join(title, ["item_id", "token"]).groupBy("user_id", "item_id").agg(F.sum(F.least("x", "y")).alias("shared"))
    out = pairs.join(met, ["user_id", "item_id"], "left").join(sizes, "user_id", "left")
    return out.withColumn("overlap", F.coalesce(F.col("shared") / F.col("size"), F.lit(0.0))).drop("shared", "size")


#: Candidates of a user that are scored together.
_TOGETHER = 512


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as rows of a matrix (zeros for null), and which are there."""
    there = np.asarray(column.is_valid())
    out = np.zeros((len(column), size))
    if there.any():
        out[there] = np.asarray(column.drop_null().flatten(), np.float64).reshape(-1, size)
    return out, there


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 0 where a row is zero."""
    n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.divide((a * b).sum(1), n, out=np.zeros(len(n)), where=n > 0)


def _against_history(sizes: dict[str, int], names: list[str]):
    """Figures of each user's candidates, by matrix products with the vectors of the history."""

    def figures(row: dict, own: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        n = len(next(iter(own.values()))[0])
        for m, (raw, unit, there) in own.items():
            seen = row[m]
            none = np.full(n, np.nan)
            if not len(seen):
                out |= {f"{m}_{x}": none for x in ("max", "mean", "min", "std")} | {f"{m}_attention": np.zeros(n)}
                if m == "multi":
                    out |= {"attention_std": none, "attention_max": none, "user_avg_sim": np.zeros(n)}
                continue
            s = (unit if m == "multi" else raw) @ seen.T
            w = np.maximum(unit @ seen.T, 0)
            total, mean = w.sum(1), seen.mean(0)
            for x, value in (("max", s.max(1)), ("mean", s.mean(1)), ("min", s.min(1)), ("std", s.std(1))):
                out[f"{m}_{x}"] = value if m == "multi" else np.where(there, value, np.nan)
            out[f"{m}_attention"] = _cosines(np.where(total[:, None] > 0, w @ seen, mean), unit)
            if m == "multi":
                some = np.where(total > 0, total, 1.0)
                out |= {"attention_std": np.where(total > 0, w.std(1) / some, 0.0), "attention_max": np.where(total > 0, w.max(1) / some, 1 / len(seen)), "user_avg_sim": _cosines(np.broadcast_to(mean, unit.shape), unit)}
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cands = batch.column("cands")[i].values
                own = {}
                for m, size in sizes.items():
                    raw, there = matrix(cands.field(f"raw_{m}"), size)
                    length = np.sqrt((raw * raw).sum(1))
                    own[m] = raw, raw / np.where(length > 0, length, 1)[:, None], there
                seen = {}
                for m, size in sizes.items():
                    raw, _ = matrix(batch.column(f"h_{m}")[i].values, size)
                    length = np.sqrt((raw * raw).sum(1))
                    seen[m] = raw / np.where(length > 0, length, 1)[:, None]
                found = figures(seen, own)
                user = pa.array([batch.column("user_id")[i].as_py()] * len(cands), pa.string())
                yield pa.RecordBatch.from_arrays([user, cands.field("item_id"), *(pa.array(found[x], pa.float64(), from_pandas=True) for x in names)], names=["user_id", "item_id", *names])

    return run


def in_parts(asked: DataFrame) -> DataFrame:
    """Pairs (user_id, item_id) with ``part``, which about _TOGETHER of a user's pairs share."""
    parts = asked.groupBy("user_id").agg(F.ceil(F.count("*") / _TOGETHER).alias("parts"))
    return asked.join(parts, "user_id").withColumn("part", F.pmod(F.xxhash64("item_id"), "parts"))


def history_similarities(pairs: DataFrame, history: DataFrame, features: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Per pair and modality: max, mean, min, deviation of the similarities to the latest items, and attention figures.

    ``features`` has item_id, text_vec, image_vec, multi_vec (null where an item
    lacks one), ``sizes`` their lengths.  The history's vectors have length one;
    the candidate's text and image vectors are taken as they are, elsewhere it
    has length one, too.  Attention is the cosine of the candidate with the
    history pooled by the positive parts of the products.

    A user's latest vectors (HISTORY at most) meet their candidates in parts of
    about _TOGETHER, so no vector is copied for each pair.
    """
    own = last_n(history, HISTORY).select("user_id", F.col("item_id").alias("seen")).join(features.select(F.col("item_id").alias("seen"), *(doubles(F.col(f"{m}_vec")).alias(f"h_{m}") for m in sizes)), "seen")
    seen = own.groupBy("user_id").agg(*(F.collect_list(f"h_{m}").alias(f"h_{m}") for m in sizes))
    asked = pairs.select("user_id", "item_id").distinct()
    dealt = in_parts(asked)
    candidates = features.select("item_id", *(doubles(F.col(f"{m}_vec")).alias(f"raw_{m}") for m in sizes))
    # A candidate without a whole vector counts as a zero vector there.
    met = dealt.join(candidates, "item_id", "left").groupBy("user_id", "part").agg(F.collect_list(F.struct("item_id", *(f"raw_{m}" for m in sizes))).alias("cands")).join(seen, "user_id")
    names = [f"{m}_{x}" for m in sizes for x in ("max", "mean", "min", "std", "attention")] + ["attention_std", "attention_max", "user_avg_sim"]
    return met.mapInArrow(_against_history(sizes, names), ", ".join(["user_id string, item_id string", *(f"{x} double" for x in names)]))


def ltr_features(pairs: DataFrame, history: DataFrame, features: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(user_id, item_id, 24 features) of pairs with recall_score; what has no vector counts 0."""
    lengths = last_n(history, HISTORY).groupBy("user_id").agg(F.count("*").alias("n"))
    have = features.select("item_id", *(F.col(f"{m}_vec").isNotNull().cast("double").alias(f"has_{m}") for m in sizes))
    out = pairs.join(lengths, "user_id", "left").join(have, "item_id", "left").join(history_similarities(pairs, history, features, sizes), ["user_id", "item_id"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    own = {
        "history_length": zero("n"),
        "mean_difference": zero("text_mean") - zero("image_mean"),
        "mean_ratio": zero("text_mean") / (zero("image_mean") + 1e-6),
        "combined": COMBINED[0] * zero("recall_score") + COMBINED[1] * zero("multi_attention") + COMBINED[2] * zero("user_avg_sim"),
    }
    return out.select("user_id", "item_id", *(F.round(own.get(f, zero(f)), 6).alias(f) for f in LTR))


def first_groups(counts: DataFrame, most_rows: int = MATRIX_ROWS) -> DataFrame:
    """(user_id) of users, in order, among whom are all that ``training_matrix`` takes.

    ``counts`` (user_id, rows) tells how many candidates a user has at least.
    Where these are enough, no later user is taken, so its candidates needn't be found.
    """
    # A user counts for a row at least, so the running sum is over most_rows users at most.
    upto = F.sum("rows").over(Window.orderBy("user_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = counts.where("rows > 0").orderBy("user_id").limit(most_rows).withColumn("upto", upto).where(F.col("upto") >= most_rows).agg(F.min("user_id").alias("last"))
    return counts.crossJoin(F.broadcast(last)).where("last IS NULL OR user_id <= last").select("user_id")


def training_matrix(candidates: DataFrame, truth: DataFrame, most_rows: int | None = MATRIX_ROWS, each: int | None = USER_CANDIDATES) -> DataFrame:
    """(user_id, item_id, recall_score, rank, label, group_size): a group of labelled candidates for each user of the truth.

    ``candidates`` has user_id, item_id, score, rank.  Users are taken in order
    until the rows are enough, the last one whole; without ``most_rows`` all are,
    without ``each`` with all their candidates.
    """
    wanted = truth.select("user_id", "item_id").distinct().withColumn("label", F.lit(1.0))
    rows = (candidates if each is None else candidates.where(F.col("rank") <= each)).join(truth.select("user_id").distinct(), "user_id", "left_semi").join(wanted, ["user_id", "item_id"], "left")
    taken = rows.groupBy("user_id").agg(F.count("*").alias("group_size"))
    if most_rows is not None:
        # Each user adds a row at least, so the running sum is over most_rows users at most.
        before = F.coalesce(F.sum("group_size").over(Window.orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        taken = taken.orderBy("user_id").limit(most_rows).withColumn("before", before).where(F.col("before") < most_rows).drop("before")
    return rows.join(taken, "user_id").select("user_id", "item_id", F.col("score").alias("recall_score"), "rank", F.coalesce("label", F.lit(0.0)).alias("label"), "group_size")


#: Weights of random negatives, and unit and most of what nearness adds to hard ones.
EASY, BM25_UNIT, DENSE_UNIT, MOST_HARD = 0.8, 10.0, 0.5, 2.0


#: Negatives of a positive, and the shares of random ones, of BM25's and of near ones.
NEGATIVES, MIX = 6, (0.4, 0.3, 0.3)


def mix(negatives: int = NEGATIVES) -> tuple[int, int, int]:
    """How many negatives of each kind a positive gets, one at least."""
    return tuple(max(1, int(negatives * share)) for share in MIX)


def mixed_negatives(pairs: DataFrame, random: DataFrame, sparse: DataFrame, near: DataFrame, history: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """(user_id, positive, item_id, kind, weight): of each kind so many negatives a positive, none of the user's history.

    ``random`` has user_id, positive, item_id, place; ``sparse`` and ``near`` are users'
    ranked lists.  Hard negatives weigh the more, the better their score.
    """
    seen = history.select("user_id", "item_id").distinct()
    own = pairs.select("user_id", F.col("item_id").alias("positive"))

    def hard(found: DataFrame, kind: str, weight: Column, each: int) -> DataFrame:
        first = ranked(found.join(seen, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", "score"), ["user_id"], each + 1)
        met = own.join(first, "user_id").where(F.col("item_id") != F.col("positive"))
        place = F.row_number().over(Window.partitionBy("user_id", "positive").orderBy("rank"))
        return met.withColumn("place", place).where(F.col("place") <= each).select("user_id", "positive", "item_id", F.lit(kind).alias("kind"), F.round(1 + F.least(weight, F.lit(MOST_HARD)), 6).alias("weight"))

    easy = random.where(F.col("place") <= counts[0]).select("user_id", "positive", "item_id", F.lit("random").alias("kind"), F.lit(EASY).alias("weight"))
    return easy.unionByName(hard(sparse, "hard_bm25", F.col("score") / BM25_UNIT, counts[1])).unionByName(hard(near, "hard_faiss", F.col("score") / DENSE_UNIT, counts[2]))


def held_out(user: str = "user_id") -> Column:
    """The fifth of users on which no ranker is fitted, by a hash."""
    return F.pmod(F.crc32(F.col(user)), F.lit(5)) == 0


def trained_ranker(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None):
    """A logistic regression without scaling, its penalty over the rows as a whole."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml import Pipeline

    total = rows.agg(F.sum(F.col(weight)) if weight else F.count("*")).first()[0]
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=1000, standardization=False, regParam=1 / max(float(total or 1), 1), **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(rows)


def reranked(model, rows: DataFrame, k: int) -> DataFrame:
    """Candidates by a model's probability of label 1: user_id, item_id, score, rank."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return ranked(out.select("user_id", "item_id", "score"), ["user_id"], k)


def boosted_ranker(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees, row by row: stands for a listwise ranker, which Spark lacks."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml import Pipeline

    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(rows)


def boosted_order(model, rows: DataFrame, k: int) -> DataFrame:
    """By a model's prediction; a feature that the rows lack counts 0."""
    missing = [c for c in model.stages[0].getInputCols() if c not in rows.columns]
    out = model.transform(rows.select("*", *(F.lit(0.0).alias(c) for c in missing))).withColumn("score", F.col("prediction"))
    return ranked(out.select("user_id", "item_id", "score"), ["user_id"], k)


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, largest first."""
    found = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, found, strict=True), key=lambda x: (-x[1], x[0]))
