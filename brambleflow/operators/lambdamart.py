"""LambdaMART: boosted trees whose gradients come from swaps within query groups.

Rows are packed into blocks of whole groups, features as numbers of bins.  For
each tree, every block adds the last tree to its scores and computes what each
pair of a group would change in NDCG (lambdas).  A tree grows leaf by leaf, the
best split first: blocks sum gradients by leaf, feature and bin, Spark adds these
histograms up, and the driver, which sees no row, picks splits from at most
leaves x features x bins sums.  Children of all leaves that might be split next
are summed in one pass, so a tree costs about as many passes as it is deep.

Gradients are whole numbers of a small unit, so sums don't depend on the order
in which blocks are added: the same rows give the same model, however they are
partitioned.  A share of the groups, by a hash, is not fitted; training ends when
their NDCG no longer rises.

Defined cases: rows without a group or item are left out, a null label counts 0 and
a null or non-finite feature 0; groups with only one kind of label give no
gradients; without any group of two labels the model has no trees and scores all
rows 0.  A group is the candidates of one query and must not exceed MOST_GROUP rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import shared_folder
from .ranking import ranked

#: Leaves of a tree, step, most trees, trees without a rise that end training, shares of features a tree and of rows in five trees, least rows of a leaf.
LEAVES, STEP, TREES, PATIENCE, FEATURE_SHARE, ROW_SHARE, ROW_ROUNDS, LEAST_ROWS = 31, 0.05, 200, 20, 0.8, 0.8, 5, 20
#: The best places whose pairs count, and the places at which held-out groups are measured.
PLACES, MEASURED = 30, (5, 10)
LEAST_HESSIAN = 1e-3
BINS = 64
#: Gradients are whole multiples of 1 / UNIT.
UNIT = float(1 << 24)
#: Rows of a block, about, and of a group at most.
BLOCK_ROWS, MOST_GROUP = 1 << 16, 1 << 17
#: After so many trees the blocks' state is written, which cuts its lineage.
SETTLE_EVERY = 10
_STATE = "block long, keys binary, bounds binary, held binary, labels binary, bins binary, scores binary, gradients binary, hessians binary"


@dataclass
class Tree:
    """Nodes in arrays: feature (-1: leaf), bin up to which a row goes left, children, value of a leaf, gain of a split."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, bin_, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for name, empty in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0), ("gain", 0.0)):
                getattr(self, name).append(empty)
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; ``bins`` has a row for each feature."""
        feature, bin_, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, columns = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            goes = bins[feature[node], columns] <= bin_[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)


@dataclass
class Model:
    """Trees over binned features, with the bins' upper edges."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    #: NDCG of the held-out groups after each tree, at each measured place.
    measured: list[list[float]]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0), side="left") for e, c in zip(self.edges, columns, strict=True)]).astype(np.uint8)

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = self.binned(columns)
        out = np.zeros(bins.shape[1])
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaf_of(bins)]
        return out

    def importances(self) -> list[tuple[str, float]]:
        """Features by the gain of their splits, largest first."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += g
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a node, and one for the bins."""
        nodes = [(t, n, *map(json.dumps, (tree.feature[n], tree.bin[n], tree.left[n], tree.right[n], tree.value[n], tree.gain[n]))) for t, tree in enumerate(self.trees) for n in range(len(tree.feature))]
        rows = [(-1, 0, json.dumps(self.features), json.dumps(self.edges), json.dumps(self.measured), "", "", ""), *nodes]
        spark.createDataFrame(rows, "tree int, node int, a string, b string, c string, d string, e string, f string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r["tree"], r["node"]))
    features, edges, measured = (json.loads(rows[0][c]) for c in "abc")
    trees: list[Tree] = []
    for r in rows[1:]:
        if r["node"] == 0:
            trees.append(Tree([], [], [], [], [], []))
        for name, c in zip(("feature", "bin", "left", "right", "value", "gain"), "abcdef", strict=True):
            getattr(trees[-1], name).append(json.loads(r[c]))
    return Model(features, edges, trees, measured)


# Blocks of groups.


def held_out_groups(group: str) -> Column:
    """A fifth of the groups, by a hash, on which training is measured."""
    return F.pmod(F.crc32(F.concat(F.lit("held:"), F.col(group))), F.lit(5)) == 0


def _cleaned(features: list[str]) -> list[Column]:
    c = [F.col(f).cast("double") for f in features]
    return [F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x).alias(f) for x, f in zip(c, features, strict=True)]


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of at most ``bins`` bins a feature, of about equal numbers of rows."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.select(*_cleaned(features)).agg(*(F.percentile_approx(f, shares, F.lit(20_000)).alias(f) for f in features)).first()
    return [sorted(set(found[f] or [])) for f in features]


def _pack(model: Model, block_rows: int):
    features = model.features

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rest = TaskContext.get().partitionId() << 32, None

        def packed(table: pa.Table) -> pa.RecordBatch:
            groups = np.array(table.column("group").to_pylist(), object)
            bounds = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(groups))
            if int(np.diff(bounds).max()) > MOST_GROUP:
                raise ValueError(f"a group has more than {MOST_GROUP} rows")
            bins = model.binned([table.column(f).to_numpy() for f in features])
            zeros = np.zeros(len(groups))
            parts = table.column("key").to_numpy(), bounds.astype(np.int64), table.column("held").to_numpy()[bounds[:-1]].astype(np.uint8), table.column("label").to_numpy().astype(np.float64), bins, zeros, zeros.astype(np.int64), zeros.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["block", "keys", "bounds", "held", "labels", "bins", "scores", "gradients", "hessians"])

        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows > block_rows:
                # The last group may go on.
                groups = rest.column("group").to_pylist()
                cut = len(groups) - 1
                while cut and groups[cut - 1] == groups[-1]:
                    cut -= 1
                if cut:
                    yield packed(rest.slice(0, cut))
                    number, rest = number + 1, rest.slice(cut)
                elif rest.num_rows > MOST_GROUP:
                    raise ValueError(f"a group has more than {MOST_GROUP} rows")
        if rest is not None and rest.num_rows:
            yield packed(rest)

    return run


class _Block:
    def __init__(self, row: dict, n_features: int) -> None:
        self.row = row
        self.bounds, self.held = np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)
        self.labels, self.scores = np.frombuffer(row["labels"]), np.frombuffer(row["scores"])
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(n_features, -1)

    def fitted(self) -> np.ndarray:
        """Rows of groups that are fitted."""
        return ~np.repeat(self.held, np.diff(self.bounds))


def _discounts(n: int) -> np.ndarray:
    return 1 / np.log2(np.arange(n) + 2.0)


def lambdas(scores: np.ndarray, labels: np.ndarray, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of a group's scores, of pairs with one row among the best ``places``."""
    n = len(scores)
    gradient, hessian = np.zeros(n), np.zeros(n)
    order = np.argsort(-scores, kind="stable")
    s, y, discount = scores[order], labels[order], _discounts(n)
    top = min(places, n)
    best = float((np.sort(y)[::-1][:top] * discount[:top]).sum())
    if best <= 0 or (y == y[0]).all():
        return gradient, hessian
    i, j = np.arange(top)[:, None], np.arange(n)[None, :]
    sign = np.where(j > i, np.sign(y[:top, None] - y[None, :]), 0.0)
    away = (s[:top, None] - s[None, :]) * sign
    change = np.abs(y[:top, None] - y[None, :]) * np.abs(discount[:top, None] - discount[None, :]) / best
    if s[0] != s[-1]:
        change = change / (0.01 + np.abs(away))
    p = 1 / (1 + np.exp(away))
    pull, curve = change * p * (sign != 0), change * p * (1 - p) * (sign != 0)
    total = 2 * float(pull.sum())
    scale = np.log2(1 + total) / total if total > 0 else 1.0
    own = np.zeros(n), np.zeros(n)
    own[0][:top] -= (pull * sign).sum(1)
    own[0][:] += (pull * sign).sum(0)
    own[1][:top] += curve.sum(1)
    own[1][:] += curve.sum(0)
    gradient[order], hessian[order] = own[0] * scale, own[1] * scale
    return gradient, hessian


def _ndcg(scores: np.ndarray, labels: np.ndarray, k: int) -> float | None:
    if not (labels > 0).any():
        return None
    discount = _discounts(min(k, len(labels)))
    own = labels[np.argsort(-scores, kind="stable")][:k]
    return float((own * discount).sum() / (np.sort(labels)[::-1][:k] * discount).sum())


def _advance(tree: Tree | None, n_features: int):
    """Add a tree to the scores, and compute the gradients anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, n_features)
                scores = block.scores if tree is None else block.scores + np.array(tree.value)[tree.leaf_of(block.bins)]
                gradient, hessian = np.zeros(len(scores), np.int64), np.zeros(len(scores), np.int64)
                for g, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
                    if not block.held[g]:
                        x, y = lambdas(scores[a:b], block.labels[a:b])
                        gradient[a:b], hessian[a:b] = np.rint(x * UNIT), np.rint(y * UNIT)
                row |= {"scores": scores.tobytes(), "gradients": gradient.tobytes(), "hessians": hessian.tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], pa.int64() if c == "block" else pa.binary()) for c in row], names=list(row))

    return run


def sampled_rows(keys: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Which rows take part in a tree, by hashes of them; the same for ROW_ROUNDS trees."""
    if share >= 1:
        return np.ones(len(keys), bool)
    h = keys.view(np.uint64) ^ np.uint64((round_ // ROW_ROUNDS + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return (h >> np.uint64(11)) * 2.0**-53 < share


def _histograms(tree: Tree, wanted: list[int], used: list[int], round_: int, row_share: float, n_features: int):
    """Sums of gradients, hessians and rows by wanted leaf, feature and bin; NDCG of held-out groups as a leaf of its own (-1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(wanted), len(used), BINS))
        place = np.full(len(tree.feature), -1)
        place[wanted] = np.arange(len(wanted))
        measured, groups = [0.0] * len(MEASURED), 0
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, n_features)
                if len(tree.feature) == 1:
                    for a, b in zip(block.bounds[:-1][block.held].tolist(), block.bounds[1:][block.held].tolist(), strict=True):
                        own = [_ndcg(block.scores[a:b], block.labels[a:b], k) for k in MEASURED]
                        if own[0] is not None:
                            measured, groups = [x + y for x, y in zip(measured, own, strict=True)], groups + 1
                leaf = place[tree.leaf_of(block.bins)]
                some = np.flatnonzero((leaf >= 0) & block.fitted() & sampled_rows(np.frombuffer(row["keys"], np.int64), round_, row_share))
                gradient, hessian = np.frombuffer(row["gradients"], np.int64), np.frombuffer(row["hessians"], np.int64)
                for f, feature in enumerate(used):
                    cell = (leaf[some] * len(used) + f) * BINS + block.bins[feature][some]
                    for t, weight in enumerate((gradient[some], hessian[some], None)):
                        total[t] += np.bincount(cell, weight, total[t].size).reshape(total[t].shape)
        at = np.nonzero(total[2])
        node, feature = np.array(wanted)[at[0]], np.array(used)[at[1]]
        cols = [node, feature, at[2], *(total[t][at].astype(np.int64) for t in range(3))]
        if groups:  # fixed-point sums, too
            more = [[-1, k, 0, round(m * UNIT), 0, groups] for k, m in zip(MEASURED, measured, strict=True)]
            cols = [np.concatenate([c, np.array(x)]) for c, x in zip(cols, zip(*more, strict=True), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["node", "feature", "bin", "g", "h", "n"])

    return run


# Growth.


def best_split(hist: np.ndarray, least_rows: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a leaf's histogram (gradient, hessian, rows by feature and bin); ties go to the first feature and bin."""
    g, h, n = hist[0] / UNIT, hist[1] / UNIT, hist[2]
    left = [np.cumsum(x, 1)[:, :-1] for x in (g, h, n)]
    whole = [x.sum(1)[:, None] for x in (g, h, n)]
    right = [w - x for w, x in zip(whole, left, strict=True)]
    fits = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
    gain = np.where(fits, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-10 else None


def grow(sums, leaves: int, step: float, least_rows: int) -> Tree:
    """A tree, the leaf of largest gain split first.

    ``sums(tree, nodes)`` gives the nodes' histograms (3, features, bins).  The
    tree that it gets may hold more splits than are made in the end: those of all
    leaves that may come next.
    """
    trial, hists, splits, children = Tree(), {}, {}, {}

    def learn(nodes: list[int]) -> None:
        for node, hist in sums(trial, nodes).items():
            hists[node], splits[node] = hist, best_split(hist, least_rows)

    learn([0])
    while True:
        # Best first, as far as the sums reach.
        own, made = [0], []
        while len(own) < leaves:
            known = [n for n in own if splits[n]]
            if not known:
                break
            node = max(known, key=lambda n: (splits[n][0], -n))
            if node not in children:
                break
            own.remove(node)
            own += children[node]
            made.append(node)
        node = max((n for n in own if splits[n]), key=lambda n: (splits[n][0], -n), default=None)
        if len(own) >= leaves or node is None:
            break
        likely = sorted((n for n in own if splits[n] and n not in children), key=lambda n: (-splits[n][0], n))[: leaves - len(own)]
        new: list[int] = []
        for n in likely:
            gain, f, b = splits[n]
            children[n] = trial.split(n, f, b, gain)
            new += children[n]
        learn(new)
    # The same splits again, without the others.
    tree, place = Tree(), {0: 0}
    for n in made:
        gain, f, b = splits[n]
        for child, at in zip(children[n], tree.split(place[n], f, b, gain), strict=True):
            place[child] = at
    for n in own:
        rows = hists[n].sum(2)
        g, h = rows[:2, int(rows[2].argmax())] / UNIT  # of a feature that takes part
        tree.value[place[n]] = float(-step * g / h) if h > 0 else 0.0
    return tree


def train_lambdamart(
    rows: DataFrame, features: list[str], group: str = "user_id", item: str = "item_id", label: str = "label", trees: int = TREES, leaves: int = LEAVES, step: float = STEP,
    patience: int = PATIENCE, feature_share: float = FEATURE_SHARE, row_share: float = ROW_SHARE, least_rows: int = LEAST_ROWS, seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> Model:
    """Trees fitted on groups of labelled rows (label: relevance, 0 or more)."""
    spark = rows.sparkSession
    model = Model(features, [], [], [])
    own = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(item).cast("string").alias("item"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"), *_cleaned(features))
    path = shared_folder(spark, "lambdamart")
    # The rows are read twice (edges, blocks), their features may be costly.
    own.withColumns({"held": held_out_groups("group"), "key": F.xxhash64("group", "item")}).write.parquet(f"{path}/rows")
    own = spark.read.parquet(f"{path}/rows")
    model.edges = bin_edges(own, features)
    dealt = own.repartition("group").sortWithinPartitions("group", "item")
    dealt.mapInArrow(_pack(model, block_rows), _STATE).write.parquet(f"{path}/0")
    blocks, kept = spark.read.parquet(f"{path}/0"), None
    best, since = [(-1.0, 0)] * len(MEASURED), 0
    generator = np.random.default_rng(seed)
    tree: Tree | None = None
    for round_ in range(trees + 1):
        blocks = blocks.mapInArrow(_advance(tree, len(features)), _STATE)
        if round_ and round_ % SETTLE_EVERY == 0:
            blocks.write.parquet(f"{path}/{round_}")
            blocks = spark.read.parquet(f"{path}/{round_}")
        blocks = blocks.persist()
        used = sorted(generator.permutation(len(features))[: max(1, round(feature_share * len(features)))].tolist())
        seen: dict[int, tuple[int, int]] = {}

        def sums(trial: Tree, nodes: list[int], blocks: DataFrame = blocks, used: list[int] = used, round_: int = round_, seen: dict = seen) -> dict[int, np.ndarray]:
            part = blocks.mapInArrow(_histograms(trial, nodes, used, round_, row_share, len(features)), "node long, feature long, bin long, g long, h long, n long")
            out = {n: np.zeros((3, len(features), BINS)) for n in nodes}
            for r in part.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
                if r[0] < 0:
                    seen[r[1]] = (r[3], r[5])
                else:
                    out[r[0]][:, r[1], r[2]] = r[3:]
            return out

        found = grow(sums, leaves if round_ < trees else 1, step, least_rows)
        if kept is not None:
            kept.unpersist()
        kept = blocks
        if seen and round_:
            model.measured.append([seen[k][0] / UNIT / seen[k][1] for k in MEASURED])
            best = [max(b, (m, -round_)) for b, m in zip(best, model.measured[-1], strict=True)]
            if any(round_ + at >= patience for _, at in best):
                break
        tree = found
        if round_ < trees and len(tree.feature) > 1:
            model.trees.append(tree)
        else:
            break
    if kept is not None:
        kept.unpersist()
    if model.measured:
        # The measure that stopped rising first tells how many trees stay.
        model.trees = model.trees[: min(-at for _, at in best)]
    return model


def lambdamart_scores(model: Model, rows: DataFrame) -> DataFrame:
    """The rows with ``score``; a feature that the rows lack counts 0."""
    have = [f for f in model.features if f in rows.columns]
    fields = [f for f in rows.schema.fields if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) if f in have else np.zeros(batch.num_rows) for f in model.features]
            score = model.score(columns) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return rows.select(*(f.name for f in fields)).mapInArrow(run, f"{schema}, score double")


def lambdamart_order(model: Model, rows: DataFrame, k: int) -> DataFrame:
    """Candidates by a model's score: user_id, item_id, score, rank."""
    return ranked(lambdamart_scores(model, rows).select("user_id", "item_id", "score"), ["user_id"], k)
