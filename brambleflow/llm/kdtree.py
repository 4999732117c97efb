"""Exact top-k inner products by KD-trees over shards.

Vectors stream into shards of bounded size, where they stand; each shard has a
KD-tree of median splits along the widest side, with tight bounding boxes.  A
query first searches its own shard.  Its k-th score there goes with it to the
shards whose whole box allows that score: boxes and queries meet in bundles and
blocks of bounded size.  In a shard the search goes through the tree's boxes in
the order of their bounds (the most that a box allows), and ends where the bound
falls below the k-th score.

Scores are integers (components are floors of scaled values) and exact, by whole
numbers where doubles don't suffice; a score beyond a long counts as the long
nearest to it.  Vectors of different lengths are not compared.

Defined cases: vectors that are null or hold null or non-finite components (or
such as aren't finite when scaled), and rows without vec_id, take no part; every
row is a candidate of all others, those with its vec_id and vector too, and each
row that asks has a list of its own; equal scores go to the smaller vec_id; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SHARD_VECTORS = 8192
LEAF_VECTORS = 64
BLOCK_QUERIES = 256
#: Shards whose boxes meet a block of queries at once, and such blocks that meet the same boxes.
BUNDLE_SHARDS, SLICE_BLOCKS = 512, 64
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def upper_bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """What inner products in the boxes can't exceed, rounding included: a row for each query."""
    with np.errstate(all="ignore"):
        most = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * ((low.shape[1] + 4) * 2.0**-52)
        return np.maximum(np.nan_to_num(most + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf), float(LEAST))


class Tree:
    """A KD-tree over the rows of ``points`` (float64 holding integers)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        low, high, spans, child = [], [], [], []
        todo = [(np.arange(len(ids)), -1)]
        order: list[np.ndarray] = []
        at = 0
        while todo:
            rows, parent = todo.pop()
            node = len(low)
            if parent >= 0:
                child[parent].append(node)
            low.append(points[rows].min(axis=0))
            high.append(points[rows].max(axis=0))
            child.append([])
            with np.errstate(over="ignore"):
                wide = high[-1] - low[-1]
            if len(rows) <= LEAF_VECTORS or not len(wide) or wide.max() <= 0:
                rows = rows[np.argsort(ids[rows], kind="stable")]
                order.append(rows)
                spans.append((at, at + len(rows)))
                at += len(rows)
                continue
            spans.append((0, 0))
            half = len(rows) // 2
            part = rows[np.argpartition(points[rows, int(wide.argmax())], half)]
            todo += [(part[half:], node), (part[:half], node)]
        self.low, self.high = np.array(low), np.array(high)
        self.spans, self.child = spans, child
        self.rows = np.concatenate(order)
        self.ids, self.points = ids[self.rows], points[self.rows]
        self.most = float(np.abs(points).max(initial=0))

    def _scores(self, a: int, b: int, query: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.points[a:b] @ query).astype(np.int64)
        own = [int(x) for x in query.tolist()]
        return np.array([min(MOST, max(LEAST, sum(int(x) * y for x, y in zip(p, own, strict=True)))) for p in self.points[a:b].tolist()], np.int64)

    def search(self, query: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """The best k (score, id) of at least ``least``, by score and then smaller id, without the row ``own``."""
        exact = self.most * float(np.abs(query).max(initial=0)) * max(len(query), 1) < EXACT
        bounds = upper_bounds(self.low, self.high, query[None])[0].tolist()
        heap = [(-bounds[0], 0)]
        best: list[tuple[int, int]] = []
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if self.child[node]:
                for x in self.child[node]:
                    if bounds[x] >= least:
                        heapq.heappush(heap, (-bounds[x], x))
                continue
            a, b = self.spans[node]
            scores = self._scores(a, b, query, exact)
            near = np.flatnonzero((scores >= least) & (self.rows[a:b] != own))
            if len(near):
                near = near[np.lexsort((self.ids[a:b][near], ~scores[near]))[:k]]
                best += zip(scores[near].tolist(), self.ids[a:b][near].tolist(), strict=True)
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


_PACKED = pa.schema([("kind", pa.int32()), ("dim", pa.int32()), ("shard", pa.int64()), ("asks", pa.binary()), ("ids", pa.binary()), ("vecs", pa.binary()), ("least", pa.binary())])
PACKED = "kind int, dim int, shard long, asks binary, ids binary, vecs binary, least binary"
#: A shard (ids, vecs; its box in least), queries (asks names the row, least the k-th score at home), what these found (vecs holds the others' ids, least the scores).
SHARD, QUERIES, FOUND = 0, 1, 2


def _row(kind: int, dim: int, shard: int, asks, ids, vecs, least) -> dict:
    return {"kind": kind, "dim": dim, "shard": shard, "asks": asks.tobytes(), "ids": ids.tobytes(), "vecs": vecs.tobytes(), "least": least.tobytes()}


def _found_row(dim: int, shard: int, rows: list[tuple[int, int, int, int]]) -> dict:
    return _row(FOUND, dim, shard, *(np.array(x, np.int64) for x in zip(*rows, strict=True)))


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    asks, ids, least = (np.frombuffer(row[c], np.int64) for c in ("asks", "ids", "least"))
    return asks, ids, np.frombuffer(row["vecs"], np.float64).reshape(len(ids), row["dim"]), least


def _index(k: int):
    """Shards, their queries with the k-th scores at home, and what these found at home."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}
        none = np.zeros(0, np.int64)

        def closed(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal shard
            ids, asked, vecs = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            tree = Tree(ids, vecs)
            rows = [_row(SHARD, dim, shard, none, ids, vecs, np.stack([vecs.min(axis=0), vecs.max(axis=0)]))]
            at = np.flatnonzero(asked)
            for start in range(0, len(at), BLOCK_QUERIES):
                own = at[start : start + BLOCK_QUERIES]
                asks, least, found = (shard << 16) + own, np.full(len(own), LEAST), []
                for n, i in enumerate(own.tolist()):
                    best = tree.search(vecs[i], i, k, LEAST)
                    if len(best) == k:
                        least[n] = best[-1][0]
                    found += [(int(asks[n]), int(ids[i]), other, score) for score, other in best]
                rows.append(_row(QUERIES, dim, shard, asks, ids[own], vecs[own], least))
                if found:
                    rows.append(_found_row(dim, shard, found))
            shard += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)

        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            ids, asked = batch.column("vec_id").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                vecs = flat[(ends[mine] - dim)[:, None] + np.arange(dim)].astype(np.float64)
                for start in range(0, len(mine), SHARD_VECTORS):
                    part = slice(start, start + SHARD_VECTORS)
                    held.setdefault(dim, []).append((ids[mine[part]], asked[mine[part]], vecs[part]))
                    if sum(len(x[0]) for x in held[dim]) >= SHARD_VECTORS:
                        yield from closed(dim)
        for dim in list(held):
            yield from closed(dim)

    return run


def _sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by length, bundle and slice, boxes first: each shard's queries whose k-th score its box allows."""
    key, shards, boxes, packed = None, [], [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["dim"], row["bundle"], row["slice"]) != key:
                key, shards, boxes, packed = (row["dim"], row["bundle"], row["slice"]), [], [], None
            if row["kind"] == SHARD:
                shards.append(row["shard"])
                boxes.append(np.frombuffer(row["least"], np.float64).reshape(2, row["dim"]))
                continue
            if not shards:
                continue
            if packed is None:
                packed = np.stack(boxes)
            asks, ids, vecs, least = _queries(row)
            allowed = upper_bounds(packed[:, 0], packed[:, 1], vecs) >= least[:, None].astype(np.float64)
            out = []
            for i in np.flatnonzero(allowed.any(axis=0)).tolist():
                if shards[i] != row["shard"]:
                    own = np.flatnonzero(allowed[:, i])
                    out.append(_row(QUERIES, row["dim"], shards[i], asks[own], ids[own], vecs[own], least[own]))
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, schema=_PACKED)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PACKED)


def _search(k: int):
    """Over rows sorted by shard, the shard's own row first: what the query blocks find there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, current = None, None
        for batch in batches:
            for row in batch.to_pylist():
                asks, ids, vecs, least = _queries(row | {"least": b""} if row["kind"] == SHARD else row)
                if row["kind"] == SHARD:
                    tree, current = Tree(ids, vecs), row["shard"]
                elif row["shard"] == current:
                    found: list[tuple[int, int, int, int]] = []
                    for ask, i, v, own in zip(asks.tolist(), ids.tolist(), vecs, least.tolist(), strict=True):
                        found += [(ask, i, other, score) for score, other in tree.search(v, -1, k, own)]
                    if found:
                        yield pa.RecordBatch.from_pylist([_found_row(row["dim"], row["shard"], found)], schema=_PACKED)

    return run


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("asks", "ids", "vecs", "least")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in row], names=["ask", "query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, asked: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best inner products of every row that ``asked`` marks with all rows but itself.

    ``vectors`` has vec_id and embedding; components are floor(scale * x).
    Returns query_id, rank (from 1), vec_id, score.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & asked.isNotNull())
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), asked.cast("boolean").alias("asked"), F.col("embedding").cast("array<double>").alias("embedding"))
    scaled = F.transform("embedding", lambda x: x * F.lit(float(scale)))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # From 2 ** 53 on, a double is a whole number.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x))
    index = settle(usable.where(finite).select("vec_id", "asked", whole.alias("v")).mapInArrow(_index(k), PACKED), "index")

    shards, blocks = index.where(F.col("kind") == SHARD), index.where(F.col("kind") == QUERIES)
    bundles, slices = -(-shards.count() // BUNDLE_SHARDS) or 1, -(-blocks.count() // SLICE_BLOCKS) or 1
    deal = lambda n, salt: F.pmod(F.xxhash64("shard", "asks", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    boxes = shards.select("kind", "dim", "shard", *(F.lit(None).cast("binary").alias(c) for c in ("asks", "ids", "vecs")), "least").withColumn("bundle", deal(bundles, 1)).withColumn("slice", every(slices))
    asking = blocks.withColumn("slice", deal(slices, 2)).withColumn("bundle", every(bundles))
    meeting = boxes.unionByName(asking).repartition("dim", "bundle", "slice").sortWithinPartitions("dim", "bundle", "slice", "kind")
    sent = meeting.mapInArrow(_sent, PACKED)
    met = shards.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "kind")
    away = met.mapInArrow(_search(k), PACKED)
    found = index.where(F.col("kind") == FOUND).unionByName(away).mapInArrow(_unpacked, "ask long, query_id long, vec_id long, score long")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
