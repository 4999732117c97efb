"""Ranked lexical search over a tiered index.

The documents are indexed in shards, one row a shard: the hashes of its terms, in
how many of its documents each stands, and the postings by falling impact, cut
into tiers.  A term's best sixteenth (sixteen postings at least) makes the first
tier, the rest of its best quarter the second, all others the third.  Beside each
of the first two stands what a posting below it can add at most.

A search reads the first tier of every shard for all items.  Postings give each
document a lower bound of its score, the terms' residual bounds an upper one.
The k-th best lower bound over all shards is an item's threshold; the item is
proven if every document that could still reach it has equal bounds.  Items
without that proof fall through to the second tier, and then to the third, where
all bounds are equal.  What a score needs of the whole corpus (documents, their
words, documents of a term) is counted over all of it.

A document's place in the tables is its identity.  Terms are told apart by 64-bit
hashes: among 10^7 terms two share one with probability 3e-6.

Defined cases: a null or empty text has no terms, counts for nothing and is never
found; an item without terms, or whose terms no document holds, finds nothing;
rows that repeat a doc_id are documents of their own, and rows that repeat an
item_id items of their own; null ids come last of equal scores; empty tables give
an empty result; further columns are ignored.  Long texts are read in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, drop_settled, rows_of, settle, text_of
from .textblocks import BLOCK_BYTES, blocks, ragged, word_bounds, word_hashes, word_slices

#: Bytes and documents of a shard, about; a document is never cut.
SHARD_BYTES, SHARD_DOCS = 1 << 23, 1 << 16
#: The shares of a term's postings that stand in the first tier, and in the first two, as divisors, and the least number of the first.
SHARES, LEAST = (16, 4), 16
TIERS = len(SHARES) + 1
#: Impact is SCALE * tf div (1000 * tf + 8 * m), m is 25 + 75 * n * N div L.
SCALE, TF_UNIT, M_UNIT, M_BASE, M_PART = 1_000_000_000, 1000, 8, 25, 75
#: Items, and distinct terms, of a block that meets a shard.
ITEM_BLOCK, TERM_BLOCK = 256, 1 << 16
_SHARD = ["shard", "doc_ids", "terms", "df"]
_INDEX = "shard long, doc_ids binary, terms binary, df binary, " + ", ".join(f"docs_{t} binary, impacts_{t} binary, rest_{t} binary" for t in range(TIERS))


def tier_ends(df: np.ndarray) -> list[np.ndarray]:
    """How many of a term's postings stand in each tier or above."""
    return [np.minimum(df, np.maximum(LEAST, df // share)) for share in SHARES] + [df]


def _term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and count of each term of each text of a block, by hash and then row, and the words of each row."""
    first, last, bounds = word_bounds(data, offsets, "alnum")
    words = np.diff(bounds)
    hashes, rows = word_hashes(data, first, last), np.repeat(np.arange(len(words)), words)
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    return *_runs(hashes, rows, np.ones(len(rows), np.int64)), words


def _runs(hashes: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by hash and row: counts of the same hash and row added."""
    if not len(hashes):
        return hashes, rows, n
    begins = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])))
    return hashes[begins], rows[begins], np.add.reduceat(n, begins)


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for _, data, offsets in blocks(batches):
        words = np.zeros(len(offsets) - 1, np.int64)
        for part, own in word_slices(data, offsets):
            words += np.diff(word_bounds(part, own, "alnum")[2])
        n += int((words > 0).sum())
        total += int(words.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "words"])


def impacts(tf: np.ndarray, words: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting adds for a unit of its term's weight; ``words`` are those of its document."""
    sizes, at = np.unique(words, return_inverse=True)
    m = np.array([M_BASE + M_PART * w * n // total for w in sizes.tolist()], np.int64)[at]
    return SCALE * tf // (TF_UNIT * tf + M_UNIT * m)


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _shard_row(number: int, ids: list, entries: list, words: np.ndarray, n: int, total: int) -> pa.RecordBatch:
    """One shard's index of its documents (entries: hash, place and count of their terms)."""
    hashes, place, tf = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(hashes, kind="stable")  # places rise within a hash, as blocks come in order
    hashes, place, tf = _runs(hashes[order], place[order], tf[order])
    impact = impacts(tf, words[place], n, total) if len(tf) else np.zeros(0, np.int64)
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    df = np.diff(np.append(begins, len(hashes)))
    order = np.lexsort((-impact, np.repeat(np.arange(len(df)), df)))
    place, impact = place[order].astype(np.uint16), impact[order].astype(np.uint32)
    columns = [pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array([NULL_ID if i is None else i for i in ids], np.int64), hashes[begins], df.astype(np.uint32)))]
    names, above = list(_SHARD), np.zeros(len(df), np.int64)
    for tier, ends in enumerate(tier_ends(df)):
        own = ragged(begins + above, ends - above)
        longer = np.flatnonzero(ends < df)
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (place[own], impact[own], impact[(begins + ends)[longer]])]
        names += [f"docs_{tier}", f"impacts_{tier}", f"rest_{tier}"]
        above = ends
    return pa.RecordBatch.from_arrays(columns, names=names)


def _shards(n: int, total: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list = []
        entries, words, size = [], [], 0
        for rows, data, offsets in blocks(batches, limit=min(BLOCK_BYTES, most)):
            if ids and (size + len(data) > most or len(ids) + rows.num_rows > SHARD_DOCS):
                yield _shard_row(number, ids, entries, np.concatenate(words), n, total)
                number, ids, entries, words, size = number + 1, [], [], [], 0
            for a in range(0, rows.num_rows, SHARD_DOCS):  # a block of very short texts
                some = offsets[a : a + SHARD_DOCS + 1]
                if a:
                    yield _shard_row(number, ids, entries, np.concatenate(words), n, total)
                    number, ids, entries, words, size = number + 1, [], [], [], 0
                own = np.zeros(len(some) - 1, np.int64)
                for part, within in word_slices(data[some[0] : some[-1]], some - some[0]):
                    hashes, row, tf, n_words = _term_counts(part, within)
                    entries.append((hashes, row + len(ids), tf))
                    own += n_words
                words.append(own)
                ids += rows.column("doc_id").slice(a, SHARD_DOCS).to_pylist()
            size += len(data)
        if ids:
            yield _shard_row(number, ids, entries, np.concatenate(words), n, total)

    return run, _INDEX


@dataclass
class TieredIndex:
    """Shards of postings in tiers, the number of documents with terms, and that of their words."""

    shards: DataFrame
    n: int
    words: int

    def save(self, path: str) -> None:
        spark = self.shards.sparkSession
        self.shards.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/shards")
        spark.createDataFrame([(self.n, self.words)], "n long, words long").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")


def open_index(spark: SparkSession, path: str) -> TieredIndex:
    """An index that was saved."""
    corpus = spark.read.parquet(f"{path}/corpus").first()
    return TieredIndex(spark.read.parquet(f"{path}/shards"), corpus["n"], corpus["words"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> TieredIndex:
    """The index of documents (doc_id, text), settled in the shared folder."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    whole = own.mapInArrow(_sizes, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n, words = int(whole[0]), int(whole[1])
    return TieredIndex(settle(own.mapInArrow(*_shards(n, max(words, 1), shard_bytes)), "tiers", "zstd"), n, words)


# Search.


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        hashes, row, n, _ = _term_counts(data, offsets)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([rows.column("item").take(at), rows.column("item_id").take(at), pa.array(hashes.view(np.int64)), pa.array(n)], names=["item", "item_id", "h", "qf"])


def _term_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, TERM_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column("h")[a : a + TERM_BLOCK]).tobytes()], pa.binary())], names=["asked"])


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of these shards the asked terms stand."""
    found: dict[int, int] = {}
    for row in rows_of(batches):
        terms, df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["df"], np.uint32)
        asked = np.frombuffer(row["asked"], np.uint64)
        at = np.minimum(np.searchsorted(terms, asked), max(len(terms) - 1, 0))
        there = terms[at] == asked if len(terms) else np.zeros(len(asked), bool)
        for h, n in zip(asked[there].view(np.int64).tolist(), df[at[there]].tolist(), strict=True):
            found[h] = found.get(h, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["h", "n"])


def _item_blocks(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("items", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("terms", pa.binary()), ("weights", pa.binary())])
        rows: list[dict] = []

        def packed() -> pa.RecordBatch:
            terms = [t for r in rows for t in r["terms"]]
            weights = np.array([t["qf"] * term_weight(n, t["df"]) for t in terms], np.int64)
            starts = np.cumsum([0, *(len(r["terms"]) for r in rows)]).tolist()
            own = {"items": [r["item"] for r in rows], "least": [r["least"] for r in rows], "starts": starts, "terms": np.array([t["h"] for t in terms], np.int64).tobytes(), "weights": weights.tobytes()}
            return pa.RecordBatch.from_pylist([own], schema=kind)

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                if len(rows) == ITEM_BLOCK:
                    yield packed()
                    rows = []
        if rows:
            yield packed()

    return run, "items array<long>, least array<long>, starts array<long>, terms binary, weights binary"


class _Shard:
    """A shard's first tiers, as arrays."""

    def __init__(self, row: dict, level: int) -> None:
        self.number, self.ids = row["shard"], np.frombuffer(row["doc_ids"], np.int64)
        self.terms, self.df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["df"], np.uint32).astype(np.int64)
        ends, above = tier_ends(self.df), np.zeros(len(self.df), np.int64)
        self.tiers = []
        for tier in range(level + 1):
            size = ends[tier] - above
            self.tiers.append((np.cumsum(size) - size, size, np.frombuffer(row[f"docs_{tier}"], np.uint16), np.frombuffer(row[f"impacts_{tier}"], np.uint32)))
            above = ends[tier]
        #: What a posting below adds at most.
        self.rest = np.zeros(len(self.df), np.int64)
        self.rest[np.flatnonzero(ends[level] < self.df)] = np.frombuffer(row[f"rest_{level}"], np.uint32)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each document's lower and upper bound for a query's terms, and how many postings were read."""
        lower, known, read = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64), 0
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        there = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[there], weights[there]
        rest = weights * self.rest[at]
        for start, size, docs, impact in self.tiers:
            own, n = ragged(start[at], size[at]), size[at]
            np.add.at(lower, docs[own], np.repeat(weights, n) * impact[own])
            if rest.any():
                np.add.at(known, docs[own], np.repeat(rest, n))
            read += len(own)
        return lower, lower + (int(rest.sum()) - known), read


def _scan(k: int, level: int):
    """For each item the k best lower bounds over the task's shards, and the largest upper bound that no lower one reaches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        ready: dict[int, int] = {}
        read: dict[int, int] = {}
        shard = None
        for row in rows_of(batches):
            if shard is None or shard.number != row["shard"]:
                shard = _Shard(row, level)
            terms, weights = np.frombuffer(row["terms_"], np.int64).view(np.uint64), np.frombuffer(row["weights"], np.int64)
            for i, item in enumerate(row["items"]):
                own = slice(row["starts"][i], row["starts"][i + 1])
                lower, upper, n = shard.bounds(terms[own], weights[own])
                have = best.get(item)
                least = max(row["least"][i], int(have[-1, 0]) if have is not None and len(have) == k else 1)
                could = upper[(upper > lower) & (upper >= least)]
                if len(could):
                    ready[item] = max(ready.get(item, 0), int(could.max()))
                read[item] = read.get(item, 0) + n
                found = np.flatnonzero(lower >= least)
                if len(found):
                    rows = np.column_stack([lower[found], shard.ids[found], np.full(len(found), shard.number), found])
                    rows = rows if have is None else np.concatenate([have, rows])
                    best[item] = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]
        for item, n in read.items():
            rows = best.get(item, np.zeros((0, 4), np.int64))
            m = len(rows)
            # The last row has what the task leaves open, and what it read.
            cols = [np.full(m + 1, item), *(np.append(rows[:, c], x) for c, x in ((2, -1), (3, 0), (1, n), (0, ready.get(item, 0))))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["item", "shard", "place", "doc_id", "score"])

    return run, "item long, shard long, place long, doc_id long, score long"


def search(index: TieredIndex, items: DataFrame, k: int, counted: list | None = None) -> DataFrame:
    """The k best documents of every item (item_id, text): item_id, rank, doc_id, score.

    ``counted`` gets for each tier that was read the number of items and of postings.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).withColumn("item", F.monotonically_increasing_id())
    terms = settle(asked.select("item", "item_id", "text").mapInArrow(_item_terms, "item long, item_id long, h long, qf long"), "items")
    # Terms and items meet the shards in blocks of bounded size, each made by one task.
    distinct = settle(terms.select("h").distinct(), "distinct")
    asked_terms = settle(distinct.coalesce(1 + distinct.count() // TERM_BLOCK).mapInArrow(_term_blocks, "asked binary"), "asked")
    met = index.shards.select("terms", "df").crossJoin(asked_terms).mapInArrow(_frequencies, "h long, n long")
    df = met.groupBy("h").agg(F.sum("n").alias("df"))
    weighed = settle(terms.join(df, "h").groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("h", "qf", "df"))).alias("terms")), "weighed")
    found, left, least, n_items = [], weighed, None, weighed.count()
    for level in range(TIERS):
        known = left.withColumn("least", F.lit(1).cast("long")) if least is None else left.join(least, "item")
        packed = settle(known.select("item", "least", "terms").coalesce(1 + n_items // ITEM_BLOCK).mapInArrow(*_item_blocks(index.n)), "blocks").withColumnRenamed("terms", "terms_")
        columns = [*_SHARD, *(f"{c}_{t}" for t in range(level + 1) for c in ("docs", "impacts")), f"rest_{level}"]
        part = settle(index.shards.select(*columns).crossJoin(packed).mapInArrow(*_scan(k, level)), "scan")
        found.append(part.where("shard >= 0"))
        lowers = found[0]
        for other in found[1:]:
            lowers = lowers.unionByName(other)
        lowers = lowers.groupBy("item", "shard", "place", "doc_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "shard", "place")
        best = lowers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        threshold = best.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        rest = part.where("shard < 0").groupBy("item").agg(F.max("score").alias("open"), F.sum("doc_id").alias("read"))
        state = settle(rest.join(threshold, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))), "state")
        if counted is not None:
            counted.append(tuple(state.agg(F.count("*"), F.coalesce(F.sum("read"), F.lit(0))).first()))
        least = state.where(F.col("open") >= F.col("least")).select("item", "least")
        drop_settled(packed)
        if least.isEmpty():
            break
    return settle(best.join(weighed.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score"), "found")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, counted: list | None = None) -> DataFrame:
    """The k best documents (doc_id, text) of every item (item_id, text), by a tiered index of all documents."""
    index = build_index(docs)
    out = search(index, items, k, counted)
    drop_settled(index.shards)
    return out
