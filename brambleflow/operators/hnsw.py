"""A saved vector index: a layered neighbour graph (HNSW) for each shard of vectors.

Vectors of length one are dealt to shards of bounded size.  A shard's graph is
built by one task: nodes enter in batches that double with the graph, a batch
searches the graph built so far all at once, and each node is linked with those
of its candidates that are nearer to it than to one another.  The index is a
table with a row a shard (ids, vectors, links by layer); it is saved, opened
again and searched without being rebuilt.

A search lets blocks of queries walk every shard's graph in step: each query
expands its best unexpanded node until its EF best are all expanded.  Scores are
exact cosines, the set of found items is approximate: recall is measured, not
promised.

Defined cases: null, empty and zero vectors and null ids are left out; items that
repeat an id are nodes of their own; an empty table gives an index without rows and
searches without results; fewer than k items give as many rows as there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, norm
from ..sources.config import shared_folder
from .dense import CELL_QUERIES, _blocks, _each, dealt, figures
from .ranking import DIGITS, ranked

#: Links of a node above the lowest layer (twice as many there), and how many candidates building and searching keep.
LINKS, EF_BUILD, EF_SEARCH = 32, 40, 64
#: Vectors of a shard, about; nodes that enter together; queries that walk together.
SHARD_ITEMS, BATCH, WALK = 1 << 15, 256, 256
_INDEX = "shard long, ids array<string>, size int, vectors binary, layers array<binary>, entry int"


class Graph:
    """A layered neighbour graph over vectors of length one."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.vectors, self.layers, self.entry = vectors, layers, entry
        #: Vectors that searches have compared with a query.
        self.scored = 0

    def walk(self, queries: np.ndarray, starts: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes of a layer that each query finds from its starts, best first (-1: none), and their products."""
        links = self.layers[layer]
        n, rows = len(queries), np.arange(len(queries))
        ids, sims = np.full((n, ef), -1), np.full((n, ef), -np.inf, np.float32)
        done = np.ones((n, ef), bool)
        seen = np.zeros((n, len(self.vectors)), bool)
        width = min(starts.shape[1], ef)
        first = starts[:, :width]
        ids[:, :width] = first
        there = first >= 0
        sims[:, :width] = np.where(there, np.einsum("qd,qkd->qk", queries, self.vectors[first]), -np.inf)
        done[:, :width] = ~there
        seen[np.repeat(rows, width)[there.ravel()], first[there]] = True
        self.scored += int(there.sum())
        while True:
            place = np.where(done, -np.inf, sims).argmax(1)
            open_ = np.flatnonzero(~done[rows, place])
            if not len(open_):
                return ids, sims
            done[open_, place[open_]] = True
            near = links[ids[open_, place[open_]]]
            new = (near >= 0) & ~seen[open_[:, None], near]
            seen[np.repeat(open_, new.sum(1)), near[new]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            which = np.nonzero(new)
            found[which] = np.einsum("kd,kd->k", queries[open_[which[0]]], self.vectors[near[which]])
            self.scored += len(which[0])
            # Rows whose list nothing new enters stay as they are.
            better = found.max(1) > sims[open_, -1]
            if not better.any():
                continue
            open_, near, found, new = open_[better], near[better], found[better], new[better]
            both = np.concatenate([sims[open_], found], 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :ef]
            sims[open_] = np.take_along_axis(both, best, 1)
            ids[open_] = np.take_along_axis(np.concatenate([ids[open_], near], 1), best, 1)
            done[open_] = np.take_along_axis(np.concatenate([done[open_], ~new], 1), best, 1)

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.walk(queries, at, layer, 1)[0]
        ids, sims = self.walk(queries, at, 0, max(ef, k))
        return ids[:, :k], sims[:, :k]


def _chosen(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (best first, -1: none) those nearer to it than to one chosen before; at most ``most``, padded with -1."""
    n, width = candidates.shape
    out, count = np.full((n, most), -1), np.zeros(n, np.int64)
    between = np.einsum("nid,njd->nij", vectors[candidates], vectors[candidates])
    taken, rows = np.zeros((n, width), bool), np.arange(n)
    for j in range(width):
        clear = ~(taken[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1)
        fits = (candidates[:, j] >= 0) & (candidates[:, j] != own) & clear & (count < most)
        taken[:, j] = fits
        out[rows[fits], count[fits]] = candidates[fits, j]
        count[fits] += 1
    # Places that stay free go to the nearest of the others.
    for j in range(width):
        fits = (candidates[:, j] >= 0) & (candidates[:, j] != own) & ~taken[:, j] & (count < most)
        out[rows[fits], count[fits]] = candidates[fits, j]
        count[fits] += 1
    return out


def _ordered(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidates by product with their node, best first."""
    candidates = -np.sort(-candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    sims = np.where(candidates >= 0, np.einsum("nd,nkd->nk", vectors[own], vectors[candidates]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)


def node_layers(ids: list[str], links: int = LINKS) -> np.ndarray:
    """The highest layer of each node, by a hash of its id: each has a share of 1 / links of the one below."""
    u = (np.array([zlib.crc32(i.encode()) for i in ids]) + 0.5) / 2.0**32
    return np.floor(-np.log(u) / np.log(links)).astype(np.int64)


def build_graph(vectors: np.ndarray, tops: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """The graph of nodes that reach up to the layers ``tops``."""
    n = len(vectors)
    layers = [np.full((n, 2 * links if layer == 0 else links), -1) for layer in range(int(tops.max()) + 1)]
    graph = Graph(vectors, layers, int(tops.argmax()))
    # The entry comes first, so that every layer has a start.
    order = np.append(graph.entry, np.delete(np.arange(n), graph.entry))
    ready = 1
    while ready < n:
        batch = order[ready : ready + min(BATCH, ready)]
        at = np.full((len(batch), 1), graph.entry)
        for layer in range(len(layers) - 1, -1, -1):
            joins = tops[batch] >= layer
            if (~joins).any():
                found = graph.walk(vectors[batch[~joins]], at[~joins][:, :1], layer, 1)[0]
                at[~joins, :1] = found
            if not joins.any():
                continue
            own = batch[joins]
            found = graph.walk(vectors[own], at[joins], layer, ef)[0]
            if at.shape[1] < ef:
                at = np.concatenate([at, np.full((len(at), ef - at.shape[1]), -1)], 1)
            at[joins] = found
            most = layers[layer].shape[1]
            # Nodes that enter together are candidates for one another, too.
            sims = vectors[own] @ vectors[own].T
            np.fill_diagonal(sims, -np.inf)
            beside = np.argsort(-sims, axis=1, kind="stable")[:, : min(ef, len(own) - 1)]
            candidates, sims = _ordered(vectors, own, np.concatenate([found, own[beside]], 1))
            chosen = _chosen(vectors, own, candidates, sims, links)
            layers[layer][own] = _padded(chosen, most)
            _link_back(vectors, layers[layer], own, chosen)
        ready += len(batch)
    return graph


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([rows, np.full((len(rows), width - rows.shape[1]), -1)], 1)


def _link_back(vectors: np.ndarray, links: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
    """The links' other ends point back; a node with too many chooses anew."""
    which = np.nonzero(chosen >= 0)
    to, back = chosen[which], own[which[0]]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, begins, counts = np.unique(to, return_index=True, return_counts=True)
    new = np.full((len(nodes), int(counts.max(initial=0))), -1)
    new[np.repeat(np.arange(len(nodes)), counts), np.arange(len(to)) - np.repeat(begins, counts)] = back
    for a in range(0, len(nodes), BATCH):
        rows = nodes[a : a + BATCH]
        candidates, sims = _ordered(vectors, rows, np.concatenate([links[rows], new[a : a + BATCH]], 1))
        width = int((candidates >= 0).sum(1).max())
        candidates, sims = candidates[:, :width], sims[:, :width]
        most = links.shape[1]
        if width <= most:
            links[rows] = _padded(candidates, most)
        else:
            links[rows] = _chosen(vectors, rows, candidates, sims, most)


# Tables.


def _build(links: int, ef: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids: list[str] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column("item_id").to_pylist()
            parts.append(np.asarray(batch.column("v").flatten(), np.float32).reshape(batch.num_rows, -1))
        if not ids:
            return
        order = np.argsort(np.array(ids, str), kind="stable")  # the same graph however rows arrive
        vectors = np.concatenate(parts)[order]
        ids = [ids[i] for i in order]
        graph = build_graph(vectors, node_layers(ids, links), links, ef)
        row = {"shard": TaskContext.get().partitionId(), "ids": ids, "size": vectors.shape[1], "vectors": vectors.tobytes(), "layers": [x.astype(np.int32).tobytes() for x in graph.layers], "entry": graph.entry}
        kinds = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.string())), ("size", pa.int32()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("entry", pa.int32())])
        yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return run


def _units(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (norm(F.col("v")) > 0)).select(F.col(key).cast("string").alias(key), F.transform(doubles(F.col("v")), lambda x: x).alias("w"), norm(F.col("v")).alias("n")).select(key, F.transform("w", lambda x: x / F.col("n")).alias("v"))


def save_index(items: DataFrame, path: str, shard_items: int = SHARD_ITEMS, links: int = LINKS, ef: int = EF_BUILD) -> None:
    """Build the shards' graphs of items (item_id, v) and write them."""
    own = _units(items, "item_id")
    shards = 1 + own.count() // shard_items
    own.repartition(shards, F.xxhash64("item_id")).mapInArrow(_build(links, ef), _INDEX).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(path)


def _graph(row: dict) -> Graph:
    n = len(row["ids"])
    return Graph(np.frombuffer(row["vectors"], np.float32).reshape(n, row["size"]), [np.frombuffer(x, np.int32).reshape(n, -1) for x in row["layers"]], row["entry"])


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best scores and of those within two roundings of the k-th."""
    order = np.lexsort((-scores, rows))
    r, s = rows[order], scores[order]
    last = s[np.minimum(np.searchsorted(r, r) + k, np.searchsorted(r, r, "right")) - 1]
    return order[s >= last - 2 * 10.0**-DIGITS]


def _search(k: int, ef: int):
    """Blocks of queries first, then shards: what the queries' walks find in all of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids: list[str] = []
        parts: list[np.ndarray] = []
        queries, found, scored = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["asks"]:
                    q_ids += row["ids"]
                    parts.append(np.frombuffer(row["vectors"]).reshape(len(row["ids"]), -1))
                    continue
                if not parts:
                    return
                queries = np.concatenate(parts) if queries is None else queries
                graph, ids = _graph(row), np.array(row["ids"], object)
                for a in range(0, len(queries), WALK):
                    own, before = queries[a : a + WALK], graph.scored
                    near, _ = graph.search(own.astype(np.float32), k, ef)
                    some = np.nonzero(near >= 0)
                    # Scores in doubles, as the exact search has them.
                    score = np.round(np.einsum("kd,kd->k", own[some[0]], graph.vectors[near[some]].astype(np.float64)), DIGITS) + 0.0
                    new = some[0] + a, ids[near[some]], score
                    both = tuple(np.concatenate(z) for z in zip(found[a], new, strict=True)) if a in found else new
                    kept = _best(both[0], both[2], k)
                    found[a], scored[a] = tuple(z[kept] for z in both), scored.get(a, 0) + graph.scored - before
        for a, (rows, items, score) in found.items():
            compared = np.zeros(len(rows), np.int64)
            compared[:1] = scored[a]
            asked = np.array(q_ids, object)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(items, pa.string()), pa.array(score), pa.array(compared)], names=["query_id", "item_id", "score", "scored"])

    return run


def found_by_walks(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """The k best items of every query, at least: query_id, item_id, score, scored (compared vectors, once for each block of queries).

    A task has a group of queries of bounded size, by which the shards pass one
    after another (few queries: some of the shards).
    """
    spark = index.sparkSession
    q = _blocks(_units(queries, "query_id"), "query_id", shared_folder(spark, "walks"))
    (blocks, asked, _, parts), shards = figures(q), index.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    down = max(1, -(-asked // CELL_QUERIES), min(blocks, tasks))
    over = max(1, min(shards, -(-tasks // down)))
    q = q.select(F.lit(True).alias("asks"), F.col("block").alias("number"), "ids", F.col("vecs").alias("vectors"), dealt(down, blocks, parts).alias("down"), _each(over).alias("over"))
    held = index.select(F.lit(False).alias("asks"), F.col("shard").alias("number"), "ids", "vectors", "size", "layers", "entry", F.pmod("shard", F.lit(over)).alias("over"), _each(down).alias("down"))
    met = q.unionByName(held, allowMissingColumns=True).repartitionById(down * over, (F.col("down") * over + F.col("over")).cast("int")).sortWithinPartitions(F.desc("asks"), "number")
    return met.select("asks", "ids", "vectors", "size", "layers", "entry").mapInArrow(_search(k, ef), "query_id string, item_id string, score double, scored long")


def search_index(index: DataFrame, queries: DataFrame, k: int, skip_same: bool = False, ef: int = EF_SEARCH) -> DataFrame:
    """The k items of largest cosine that the walks find: query_id, item_id, score, rank."""
    found = found_by_walks(index, queries, k + skip_same, ef).select("query_id", "item_id", "score")
    return ranked(found.where("query_id <> item_id") if skip_same else found, ["query_id"], k)
