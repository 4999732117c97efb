"""Importance resampling towards a target's distribution of hashed n-grams.

The features of a text are its runs of 1 to ``MOST_WORDS`` words; a feature's
bucket is its CRC-32 modulo the number of buckets.  Each block of texts becomes a
sparse document-by-bucket matrix of counts, in compressed rows (begin of each
row, bucket and count of each entry), which is written as a table.  Column sums
of the corpus' and the target's matrices give the two distributions, their
logarithmic ratio a gain for each bucket, and a product of each block with the
vector of gains the weights.  Documents are then drawn without replacement by
weight and a Gumbel number that a hash of the document's id fixes.

Ranks come from a range partitioning by score: a place within its partition, and
the sizes of the partitions before.

Defined cases: a null or empty text has no features and weight 0; a document of
fewer words than asked is never drawn; rows that repeat a doc_id are documents of
their own (equal ones get consecutive ranks); a null doc_id counts as the empty
string in the hash and comes last of equal scores; an empty target gives every
bucket the same count of one half of nothing, so gains follow the corpus alone;
an empty corpus gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, drop_settled, rows_of, settle, text_of
from .textblocks import BLOCK_BYTES, LOWER, blocks, word_bounds, word_slices

BUCKETS, MOST_WORDS = 10_000, 3
#: The least words of a document that may be drawn, and the share that is drawn, in percent.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of a word that are hashed step by step for all words together.
STEPS = 32
#: Bytes of text that are read together, and rows and entries of a block of the matrix, about: its arrays stay small objects for the JVM.
TEXT_BYTES, BLOCK_ROWS, BLOCK_ENTRIES = 1 << 17, 1 << 9, 1 << 15
_CSR = "block long, doc_ids array<long>, n_words array<int>, starts binary, buckets binary, counts binary"


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, before its final complement, by the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def crc_of_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, begun: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of spans of bytes, going on from those of what stands before them."""
    crc = ~(np.zeros(len(first), np.uint32) if begun is None else begun)
    size = np.minimum(last - first, STEPS)
    order = np.argsort(-size, kind="stable")
    state, at, sizes = crc[order], first[order], -size[order]
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(sizes, -k))  # spans longer than k come first
        own = state[:n]
        state[:n] = _CRC[(own ^ data[at[:n] + k]) & 0xFF] ^ own >> 8
    crc[order] = state
    crc = ~crc
    for i in np.flatnonzero(last - first > STEPS).tolist():
        crc[i] = zlib.crc32(data[first[i] + STEPS : last[i]], int(crc[i]))
    return crc


def _features(data: np.ndarray, offsets: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets of all features of a block of texts, and the words of each row.

    Features that end within the block's first ``known`` words are left out.
    """
    first, last, bounds = word_bounds(data, offsets, "alnum")
    n_words = np.diff(bounds)
    row = np.repeat(np.arange(len(n_words)), n_words)
    # Words stand one after the other, a blank before each.
    size = last - first
    ends = np.cumsum(size + 1)
    begins = ends - size
    lower = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(lower), bool)
    inside[begins - 1] = False
    lower[inside] = LOWER[data[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]]
    rows, buckets, crc = [], [], None
    for n in range(MOST_WORDS):
        if n >= len(first):
            break
        crc = crc_of_spans(lower, begins, ends) if n == 0 else crc_of_spans(lower, begins[n:] - 1, ends[n:], crc[:-1])
        inside = row[: len(crc)] == row[n:]
        inside[: max(known - n, 0)] = False
        rows.append(row[: len(crc)][inside])
        buckets.append((crc[inside] % BUCKETS).astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(buckets or [none]), n_words


def _long_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a long text's features and their counts, and its words, part by part; a part begins with the words before it that its features need."""
    total, n_words, carried, known = np.zeros(BUCKETS, np.int64), 0, b"", 0
    for part, _ in word_slices(data, np.array([0, len(data)])):
        own = np.frombuffer(carried + part.tobytes(), np.uint8)
        _, bucket, n = _features(own, np.array([0, len(own)]), known)
        total += np.bincount(bucket, minlength=BUCKETS)
        n_words += int(n[0]) - known
        first, last, _ = word_bounds(own, np.array([0, len(own)]), "alnum")
        known = min(MOST_WORDS - 1, len(first))
        carried = b"".join(own[a:b].tobytes() + b" " for a, b in zip(first[len(first) - known :].tolist(), last[len(first) - known :].tolist(), strict=True))
    some = np.flatnonzero(total)
    return some, total[some], n_words


def _least(values: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds them; its width is what the bytes say."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _csr_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list = []
    words, sizes, buckets, counts = [], [], [], []

    def packed(number: int) -> pa.RecordBatch:
        starts = np.cumsum(np.concatenate([[0], *sizes]))
        own = [number], [ids], [np.concatenate(words).tolist()], [starts.astype(np.int64).tobytes()], [np.concatenate(buckets).astype(np.uint16).tobytes()], [_least(np.concatenate(counts)).tobytes()]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=True)], names=["block", "doc_ids", "n_words", "starts", "buckets", "counts"])

    for rows, data, offsets in blocks(batches, limit=TEXT_BYTES):
        if rows.num_rows == 1 and len(data) > 2 * BLOCK_BYTES:
            keys, n, own = _long_features(data)
            n_words = np.array([own])
        else:
            row, bucket, n_words = _features(data, offsets)
            keys, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        ids += rows.column("doc_id").to_pylist()
        words.append(n_words)
        sizes.append(np.bincount(keys // BUCKETS, minlength=rows.num_rows))
        buckets.append(keys % BUCKETS)
        counts.append(n)
        if len(ids) >= BLOCK_ROWS or sum(map(len, counts)) >= BLOCK_ENTRIES:
            yield packed(number)
            number, ids, words, sizes, buckets, counts = number + 1, [], [], [], [], []
    if ids:
        yield packed(number)


def count_matrix(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document-by-bucket counts in blocks of compressed rows.

    Each row is a block: block, doc_ids, n_words, and as bytes starts (64 bits,
    one more than documents), buckets (16 bits) and counts (8, 16 or 32 bits).
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_csr_blocks, _CSR)


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buckets = np.frombuffer(row["buckets"], np.uint16)
    return np.frombuffer(row["starts"], np.int64), buckets, _unpacked(row["counts"], len(buckets))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for row in rows_of(batches):
        _, buckets, counts = _entries(row)
        total += np.bincount(buckets, counts, BUCKETS).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def column_sums(matrix: DataFrame) -> np.ndarray:
    """Features in each bucket; at most BUCKETS rows come to the driver."""
    found = matrix.select("starts", "buckets", "counts").mapInArrow(_sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, both smoothed by one."""
    whole, aim = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    shares = (target + 1.0) * whole / ((corpus + 1.0) * aim)
    return np.array([math.floor(1000 * math.log(x)) for x in shares.tolist()], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weights(gain: np.ndarray, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            starts, buckets, counts = _entries(row)
            n, w = (np.append(0, np.cumsum(x))[starts] for x in (counts, counts * gain[buckets]))
            n, w = np.diff(n), np.diff(w)
            score = w + np.array([gumbel(i, seed) for i in row["doc_ids"]], np.int64)
            place = np.arange(len(w))
            cols = pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.int64()), pa.array(score, pa.int64()), pa.array(np.full(len(w), row["block"]), pa.int64()), pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "n_words", "n_features", "weight", "score", "block", "place"])

    return run, "doc_id long, n_words long, n_features long, weight long, score long, block long, place long"


def scored_documents(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and the row's place in the matrix (block, place)."""
    return matrix.mapInArrow(*_weights(gain, seed))


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n))], names=[*batch.schema.names, "part", "at"])
        place += n


def ranked_globally(rows: DataFrame, order: list[Column], most: int | Column) -> DataFrame:
    """The rows with ``rank`` in the order, null beyond ``most``, without bringing them into one task.

    The rows are range-partitioned and sorted, and each learns its place in its
    partition; the partitions' sizes, one row each, give what comes before.
    """
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = settle(own.mapInArrow(_places, f"{schema}, part int, at long"), "places")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, begins = 0, []
    for part, n in sizes:
        begins.append((part, before))
        before += n
    begun = placed.sparkSession.createDataFrame(begins, "part int, before long")
    rank = F.col("before") + F.col("at") + 1
    return placed.join(F.broadcast(begun), "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "at", "before")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Documents with their weights, and the rank of those that are drawn.

    ``docs`` has doc_id and text, ``target`` text.  Of the N documents with
    ``least_words`` words, floor(percent * N / 100) of the highest scores are drawn,
    ties by the smaller doc_id.  Returns doc_id, n_words, n_features, weight,
    score, rank (null: not drawn).
    """
    matrix = settle(count_matrix(docs), "counts")
    aim = column_sums(count_matrix(target.withColumn("_none", F.lit(None).cast("long")), "_none"))
    rows = scored_documents(matrix, gains(column_sums(matrix), aim), seed)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    scored = settle(rows, "weights")
    drop_settled(matrix)
    long = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.coalesce("doc_id", F.lit(NULL_ID)), F.desc("weight"), F.desc("n_features"), F.col("block"), F.col("place")]
    ranked = ranked_globally(long, order, percent * long.count() // 100)
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out, "rank").unionByName(short.select(*out, "rank"))
