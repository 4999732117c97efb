"""Dense recall: exact top-k in cells of matrix products, and LSH."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, normalized
from ..sources.config import settled, shared_folder
from .ranking import DIGITS, ranked

#: Rows of a block of vectors; bytes of the vectors that a cell has of a side, and queries of a cell (their lists take more than their vectors); queries and items of one product; items that a stream meets at once.
BLOCK, SIDE_BYTES, CELL_QUERIES, QUERIES, ITEMS, PASSING = 512, 24 << 20, 1 << 14, 512, 8192, 1 << 14
#: Pairs that are scored in doubles at once.
_EXACT = 1 << 17
_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.string())), ("vecs", pa.binary())])
_FOUND = "query_id string, item_id string, score double"


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vecs = np.asarray(part.column("v").flatten().to_numpy(zero_copy_only=False), np.float64)
            if len(vecs) % part.num_rows:
                raise ValueError("vectors of different lengths")
            ids = pa.array([part.column("id").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.num_rows]), ids, pa.array([vecs.tobytes()], pa.binary())], schema=_BLOCKS)
            number += 1


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A cell's blocks of one side as ids and a matrix."""
    ids = np.array(table.column("ids").combine_chunks().flatten().to_pylist(), object)
    return ids, np.frombuffer(b"".join(table.column("vecs").to_pylist())).reshape(len(ids), -1)


def _kept(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Places of each row's k best by score and column, in this order; with a margin also those so near the k-th, of equal scores k."""
    order = np.lexsort((cols, -scores, rows))
    r, s, place = rows[order], scores[order], np.arange(len(order))
    start = np.searchsorted(r, r)
    if not margin:
        return order[place - start < k]
    last = s[np.minimum(start + k, np.searchsorted(r, r, "right")) - 1]
    new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])] if len(r) else np.empty(0, bool)
    return order[(s >= last - margin) & (place - np.maximum.accumulate(np.where(new, place, 0)) < k)]


_Found = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE: _Found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)


def _nearest(a: np.ndarray, b: np.ndarray, k: int, scored, margin: float = 0.0, own: np.ndarray | None = None, allowed=None, before: _Found = _NONE, base: int = 0) -> _Found:
    """(rows of a, rows of b, scores): each row's k best; of equal scores those of smaller place in b.

    Products in single precision tell which pairs may be among them, with their
    largest error as a margin; ``scored(i, j)`` gives the scores of these pairs.
    ``own`` has the places from and to which b is the row itself, ``allowed``
    tells which pairs of two ranges count.  ``before`` is what was returned for
    rows that precede those of b, whose first has the place ``base``.
    """
    lengths = [np.sqrt((z * z).sum(1)) for z in (a, b)]
    narrow = all(np.isfinite(z).all() and z.max() < 1e15 for z in lengths)
    length, most = (np.where(np.isfinite(z), z, 0) for z in lengths)
    kind, unit = (np.float32, 1.2e-7) if narrow else (np.float64, 2.3e-16)
    error = length * most.max() * (a.shape[1] + 8) * unit + margin + 10.0**-DIGITS
    x, y = a.astype(kind), b.astype(kind)
    more = k if own is None else k + int((own[:, 1] - own[:, 0]).max())
    space, out = np.empty(min(QUERIES, len(a)) * min(ITEMS, len(b)), kind), []

    def raised(least: np.ndarray, best: _Found, err: np.ndarray) -> np.ndarray:
        """What a pair must score to be among the best, where a list is full."""
        first, last = (np.searchsorted(best[0], np.arange(len(least)), side) for side in ("left", "right"))
        full = np.flatnonzero(last - first >= k)
        least[full] = np.maximum(least[full], best[2][first[full] + k - 1] - err[full])
        return least

    for q in range(0, len(a), QUERIES):
        n = min(QUERIES, len(a) - q)
        err = error[q : q + n]
        held = slice(*np.searchsorted(before[0], [q, q + n]))
        best = before[0][held] - q, before[1][held], before[2][held]
        least = raised(np.full(n, -np.inf), best, err)
        for i in range(0, len(b), ITEMS):
            m = min(ITEMS, len(b) - i)
            s = np.matmul(x[q : q + n], y[i : i + m].T, out=space[: n * m].reshape(n, m))
            counts = None if narrow else ~np.isnan(s)
            if allowed is not None:
                counts = allowed(q, q + n, i, i + ITEMS) if counts is None else counts & allowed(q, q + n, i, i + ITEMS)
            if counts is not None:
                s[~counts] = -np.inf
            if i == 0 and m > more and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, m - more, axis=1)[:, m - more] - 2 * err)
            hit = s >= least.astype(kind)[:, None]
            seen = np.flatnonzero(hit if counts is None else hit & counts)
            for at in range(0, len(seen), _EXACT):
                rows, cols = np.divmod(seen[at : at + _EXACT], m)
                cols += i
                if own is not None:
                    other = (cols < own[q + rows, 0]) | (cols >= own[q + rows, 1])
                    rows, cols = rows[other], cols[other]
                found = tuple(np.concatenate(z) for z in zip(best, (rows, base + cols, scored(q + rows, cols)), strict=True))
                keep = _kept(*found, k, margin)
                best = tuple(z[keep] for z in found)
            if len(seen):
                least = raised(least, best, err)
        out.append((best[0] + q, best[1], best[2]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _blocks(side: DataFrame, key: str, folder: str, ordered: bool = False) -> DataFrame:
    """Ids and vectors as settled blocks; with ``ordered`` their numbers rise with the ids."""
    rows = side.where(F.col("v").isNotNull()).select(F.col(key).alias("id"), doubles(F.col("v")).alias("v"))
    if ordered:
        rows = rows.orderBy(F.coalesce("id", F.lit("None")))
    rows.mapInArrow(_packed, "block long, n long, ids array<string>, vecs binary").write.parquet(f"{folder}/{key}")
    return side.sparkSession.read.parquet(f"{folder}/{key}")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def figures(blocks: DataFrame) -> tuple[int, int, int, int]:
    """Blocks, vectors, their bytes, and parts that wrote blocks."""
    sums = F.sum("n"), F.sum(F.octet_length("vecs")), F.max(F.shiftright("block", 32)) + 1
    return tuple(blocks.agg(F.count("*"), *(F.coalesce(x, F.lit(0)) for x in sums)).first())


def dealt(n: int, blocks: int, parts: int) -> Column:
    """A block's group of n; a part's blocks follow one another, so groups get about the same number of them."""
    return F.pmod(F.shiftright("block", 32) * -(-blocks // max(parts, 1)) + F.col("block").bitwiseAND(F.lit(2**32 - 1)), F.lit(n))


def _in_cells(queries: DataFrame, items: DataFrame, nearest) -> DataFrame:
    """(query_id, item_id, score) by ``nearest(q_ids, a, i_ids, b)`` over cells that together hold every pair.

    Both sides are packed into blocks, which are settled; blocks are dealt to
    groups of bounded size, a cell is a group of queries and one of items, and
    tasks get cells.  So nothing is broadcast, a task's memory is bounded, and a
    side crosses the network once for each group of the other.
    """
    spark, folder = queries.sparkSession, shared_folder(queries.sparkSession, "blocks")
    q, i = _blocks(queries, "query_id", folder), _blocks(items, "item_id", folder)
    (_, asked, asked_bytes, _), (_, _, held_bytes, _) = figures(q), figures(i)
    over = max(1, -(-held_bytes // SIDE_BYTES))
    down = max(1, -(-asked_bytes // SIDE_BYTES), -(-asked // CELL_QUERIES), min(-(-asked // BLOCK), -(-4 * spark.sparkContext.defaultParallelism // over)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    q = q.select(F.lit(True).alias("asks"), "ids", "vecs", group(down).alias("down"), _each(over).alias("over"))
    i = i.select(F.lit(False).alias("asks"), "ids", "vecs", group(over).alias("over"), _each(down).alias("down"))
    cells = q.unionByName(i).select("asks", "ids", "vecs", (F.col("down") * over + F.col("over")).alias("cell"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        ours, theirs = table.filter(asks), table.filter(pc.invert(asks))
        if not (ours.num_rows and theirs.num_rows):
            return pa.table({"query_id": pa.array([], pa.string()), "item_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        (q_ids, a), (i_ids, b) = _side(ours), _side(theirs)
        order = np.argsort(i_ids.astype(str), kind="stable")  # ties stay in the order of ids
        i_ids, b = i_ids[order], b[order]
        rows, cols, scores = nearest(q_ids, a, i_ids, b)
        taken = lambda ids, at: pa.array(ids, pa.string()).take(pa.array(at))
        return pa.table({"query_id": taken(q_ids, rows), "item_id": taken(i_ids, cols), "score": pa.array(scores)})

    return cells.repartition(min(2 * down * over, 2000), "cell").groupBy("cell").applyInArrow(run, _FOUND)


def _dots(a: np.ndarray, b: np.ndarray, digits: int):
    return lambda i, j: np.round(np.einsum("ij,ij->i", a[i], b[j]), digits) + 0.0


def _passed(k: int, skip_same: bool):
    """Blocks of queries first, then items in the order of their ids: each query's k best of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, passing, waiting = [], [], 0
        q_ids = a = said = None
        best, base, known, names = _NONE, 0, np.empty(0, np.int64), np.empty(0, object)

        def joined(blocks: list) -> tuple[np.ndarray, np.ndarray]:
            ids = np.concatenate([x for x, _ in blocks])
            return ids, np.concatenate([x for _, x in blocks]).reshape(len(ids), -1)

        def meet() -> None:
            nonlocal q_ids, a, said, best, base, known, names, passing, waiting
            if a is None:
                q_ids, a = joined(asked)
                said = q_ids.astype(str)
            ids, b = joined(passing)
            own = None
            if skip_same:
                held = ids.astype(str)
                own = np.stack([np.searchsorted(held, said), np.searchsorted(held, said, "right")], 1)
            best = _nearest(a, b, k, _dots(a, b, DIGITS), own=own, before=best, base=base)
            # Only the ids of items that are in a list stay.
            cols = np.unique(best[1])
            old = np.searchsorted(cols, base)
            names = np.concatenate([names[np.searchsorted(known, cols[:old])], ids[cols[old:] - base]])
            known, base, passing, waiting = cols, base + len(ids), [], 0

        for batch in batches:
            for asks, ids, vecs in zip(batch.column("asks").to_pylist(), batch.column("ids"), batch.column("vecs"), strict=True):
                block = np.array(ids.as_py(), object), np.frombuffer(vecs.as_buffer()).copy()
                if asks:
                    asked.append(block)
                else:
                    passing.append(block)
                    waiting += len(block[0])
                    if waiting >= PASSING and asked:
                        meet()
        if passing and asked:
            meet()
        for at in range(0, len(best[0]), _EXACT):
            rows, cols, scores = (z[at : at + _EXACT] for z in best)
            found = pa.array(q_ids[rows], pa.string()), pa.array(names[np.searchsorted(known, cols)], pa.string()), pa.array(scores)
            yield pa.RecordBatch.from_arrays(list(found), names=["query_id", "item_id", "score"])

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """The k largest inner products of every query: query_id, item_id, score, rank.

    ``queries`` has query_id and v, ``items`` item_id and v (both ids strings).
    Every pair is multiplied.  A task has a group of queries of bounded size, by
    which all items pass in blocks (few queries: a group of the items), so what a
    query's list holds already tells which pairs need exact scores, a task keeps
    no items, and it gives k rows a query.
    """
    spark, folder = queries.sparkSession, shared_folder(queries.sparkSession, "blocks")
    q, i = _blocks(queries, "query_id", folder), _blocks(items, "item_id", folder, ordered=True)
    (q_blocks, asked, asked_bytes, q_parts), (i_blocks, _, held_bytes, i_parts) = figures(q), figures(i)
    tasks = 4 * spark.sparkContext.defaultParallelism
    down = max(1, -(-asked_bytes // SIDE_BYTES), -(-asked // CELL_QUERIES), min(q_blocks, tasks))
    over = max(1, min(-(-held_bytes // SIDE_BYTES), -(-tasks // down)))
    q = q.select(F.lit(True).alias("asks"), "block", "ids", "vecs", dealt(down, q_blocks, q_parts).alias("down"), _each(over).alias("over"))
    i = i.select(F.lit(False).alias("asks"), "block", "ids", "vecs", dealt(over, i_blocks, i_parts).alias("over"), _each(down).alias("down"))
    met = q.unionByName(i).repartitionById(down * over, (F.col("down") * over + F.col("over")).cast("int"))
    met = met.sortWithinPartitions(F.desc("asks"), "block").select("asks", "ids", "vecs")
    return ranked(met.mapInArrow(_passed(k, skip_same), _FOUND), ["query_id"], k)


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    unit = lambda df: df.withColumn("v", normalized(F.col("v")))
    return top_k(unit(queries), unit(items), k, skip_same)


def keyed_top_k(queries: DataFrame, items: DataFrame, vectors: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """The rows of ``cosine_top_k`` where vectors repeat: ``queries`` has query_id, key, ``items`` item_id, key, ``vectors`` key (once) and v.

    Keys meet, not rows.  Of the keys that score best, those stay that fewer
    items than are wanted precede, and of each its first items.
    """
    most = k + 1 if skip_same else k
    held = settled(items.groupBy("key").agg(F.min("item_id").alias("item_id"), F.least(F.count("*"), F.lit(most)).alias("items")).join(vectors, "key").where("v IS NOT NULL"), "keys")
    asked = queries.select("key").distinct().join(vectors, "key").select(F.col("key").alias("query_id"), "v")
    found = cosine_top_k(asked, held.select("item_id", "v"), most).drop("rank").join(held.select("item_id", "key", "items"), "item_id").drop("item_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    count = lambda first: F.sum("items").over(order.rangeBetween(first, Window.currentRow))
    found = found.withColumn("better", count(Window.unboundedPreceding) - count(Window.currentRow)).where(F.col("better") < most)
    first = items.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("item_id"))).where(F.col("place") <= most).select("key", "item_id")
    listed = ranked(found.join(first, "key").select(F.col("query_id").alias("key"), "item_id", "score"), ["key"], most).drop("rank")
    out = queries.select("query_id", "key").join(listed, "key")
    out = out.where(F.col("query_id") != F.col("item_id")) if skip_same else out
    return ranked(out.select("query_id", "item_id", "score"), ["query_id"], k)


#: More than two roundings can move a score.
_MARGIN = 2e-6


def shared_candidates(queries: DataFrame, items: DataFrame, k: int, size: int, shares: tuple[float, float]) -> DataFrame:
    """Items among which are the k best of a query by shares of cosine and of a second inner product: query_id, item_id, score (the cosine).

    Both sides have v and w, and w has ``size`` numbers.  All items are scored,
    in cells; those within a rounding of a cell's k-th score stay, too.
    """
    both = lambda df: df.withColumn("v", F.concat(normalized(F.col("v")), doubles(F.col("w"))))

    def nearest(q_ids: np.ndarray, a: np.ndarray, i_ids: np.ndarray, b: np.ndarray):
        cosines, tags = _dots(a[:, :-size], b[:, :-size], DIGITS), _dots(a[:, -size:], b[:, -size:], 12)
        weighted = np.concatenate([a[:, :-size] * shares[0], a[:, -size:] * shares[1]], 1)
        rows, cols, _ = _nearest(weighted, b, k, lambda i, j: shares[0] * cosines(i, j) + shares[1] * tags(i, j), _MARGIN)
        return rows, cols, cosines(rows, cols)

    return _in_cells(both(queries), both(items), nearest)


def lsh_top_k(queries: DataFrame, items: DataFrame, k: int, bucket: float = 0.7, tables: int = 8, most: float = 1.5, seed: int = 42) -> DataFrame:
    """Approximate cosine top-k: random projections of unit vectors give candidates, scores are exact.

    A pair that shares a bucket in any table and is nearer than ``most`` is a
    candidate.  Buckets of unit vectors are few and large, so pairs are told by
    their codes in cells rather than joined and listed.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = lambda df, key: df.where(F.col("v").isNotNull()).select(F.col(key), normalized(F.col("v")).alias("v")).withColumn("features", array_to_vector("v"))
    q, i = unit(queries, "query_id"), unit(items, "item_id")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(i)
    coded = lambda df, key: model.transform(df).select(key, F.concat("v", *(vector_to_array(F.col("hashes")[t]) for t in range(tables))).alias("v"))

    def nearest(q_ids: np.ndarray, a: np.ndarray, i_ids: np.ndarray, b: np.ndarray):
        (a, own), (b, held) = (np.split(x, [x.shape[1] - tables], axis=1) for x in (a, b))
        own, held = (np.ascontiguousarray(x.T).astype(np.int32) for x in (own, held))

        def met(q: int, q_end: int, i: int, i_end: int) -> np.ndarray:
            out = own[0, q:q_end, None] == held[0, None, i:i_end]
            for t in range(1, tables):
                out |= own[t, q:q_end, None] == held[t, None, i:i_end]
            return out

        rows, cols, scores = _nearest(a, b, k, _dots(a, b, DIGITS), allowed=met)
        near = ((a[rows] - b[cols]) ** 2).sum(1) < most * most
        return rows[near], cols[near], scores[near]

    return ranked(_in_cells(coded(q, "query_id"), coded(i, "item_id"), nearest), ["query_id"], k)


def _numbered(interests: DataFrame) -> DataFrame:
    return interests.withColumn("query_id", F.concat_ws("#", "user_id", "number"))


def _by_user(found: DataFrame) -> DataFrame:
    """With user_id and number, which the query ids of numbered interests end with."""
    number = F.substring_index("query_id", "#", -1)
    user = F.when(F.contains("query_id", F.lit("#")), F.substring(F.col("query_id"), F.lit(1), F.length("query_id") - F.length(number) - 1))
    return found.withColumn("user_id", user).withColumn("number", number.cast("int"))


def user_recall(interests: DataFrame, images: DataFrame, text_items: DataFrame, image_items: DataFrame, k: int = 20, rrf_k: int = 60) -> DataFrame:
    """Recall by several interest vectors (user_id, number, v) and one image vector (user_id, v) a user.

    The interests' lists follow one another as one list; both lists are fused
    by reciprocal ranks: user_id, item_id, score, rank.
    """
    found = _by_user(cosine_top_k(_numbered(interests), text_items, k))
    text = found.groupBy("user_id", "item_id").agg(F.sum(1 / (rrf_k + (F.col("number") - 1) * k + F.col("rank"))).alias("score"))
    text = ranked(text, ["user_id"]).select("user_id", "item_id", "rank")
    image = cosine_top_k(images.withColumnRenamed("user_id", "query_id"), image_items, k).select(F.col("query_id").alias("user_id"), "item_id", "rank")
    both = text.unionByName(image).groupBy("user_id", "item_id").agg(F.sum(1 / (rrf_k + F.col("rank"))).alias("score"))
    return ranked(both, ["user_id"], k)


def proxy_recall(interests: DataFrame, items: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """The best score over a user's interest vectors for each of their 3k nearest items, without the history."""
    found = _by_user(cosine_top_k(_numbered(interests), items, 3 * k))
    found = found.join(history.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return ranked(found.groupBy("user_id", "item_id").agg(F.max("score").alias("score")), ["user_id"], k)


__all__ = ["top_k", "cosine_top_k", "lsh_top_k", "user_recall", "proxy_recall"]
