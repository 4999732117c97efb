"""Lexical retrieval packing: windows filled with the seed's BM25 neighbours.

Document frequencies are counted over the whole corpus in a table of hashed
terms of fixed size, the only thing that is broadcast.  Documents are dealt by
content: each by one of its terms, drawn by a hash that all documents share and
the likelier the rarer the term, so that two documents meet the likelier the more
of their weighted terms they have in common.  A term of very many documents has
several dealings.  A task streams what it is dealt into shards of bounded size.

A shard has an inverted index with BM25 weights; each window begins with what is
left of the document that the last one cut, or with the first unused document,
and takes that seed's best unused neighbours (any unused one where no neighbour
is left) until it is full; the document that doesn't fit is cut.  So only a
shard's end is not a full window: it is cut into lengths that are powers of two,
which need no padding.

Defined cases: a null or empty text is its end id alone; rows without doc_id and
rows that repeat one are packed like all others; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .textblocks import BASE, blocks, mixed, word_bounds, word_hashes
from .tokens import piece_encoder

WINDOW = 2048
END_ID = 1
K1, B = 1.5, 0.75
#: Bytes of a block of texts, so that its words' figures stay in the processor's cache.
BLOCK = 1 << 17
#: Cells of the table of hashed document frequencies, and the rows in which it is summed.
CELLS, SLICES = 1 << 20, 64
#: Terms in more than this part of a shard's documents have a row of weights over all its documents instead of postings.
COMMON = 1 / 16
#: Tokens and documents at which a shard is closed.
SHARD_TOKENS, SHARD_DOCS = 4 << 20, 8192
#: Documents of one term that are dealt together.
DEALT_DOCS = 1024


def _doc_terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct term hashes (32 bits) of each text and their counts."""
    first, last, bounds = word_bounds(data, offsets, "alnum")
    words = word_hashes(data, first, last).astype(np.uint32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(words[a:b])
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        yield own[at], np.diff(np.append(at, len(own))).astype(np.uint32)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CELLS, np.int64)
    docs = words = 0
    for rows, data, offsets in blocks(batches, limit=BLOCK):
        docs += rows.num_rows
        first, last, bounds = word_bounds(data, offsets, "alnum")
        own = (word_hashes(data, first, last) & np.uint64(CELLS - 1)).astype(np.int64)
        words += len(own)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            cells[own[a:b]] += 1  # once a cell, however often a text has it
    if docs:
        parts = [zlib.compress(x.tobytes(), 1) for x in cells.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary()), pa.array([docs] + [0] * (SLICES - 1)), pa.array([words] + [0] * (SLICES - 1))], names=["part", "cells", "docs", "words"])


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for part, cells, docs, words in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "docs", "words")), strict=True):
            own = sums.setdefault(part, [np.zeros(CELLS // SLICES, np.int64), 0, 0])
            own[0] += np.frombuffer(zlib.decompress(cells), np.int64)
            own[1] += docs
            own[2] += words
    if sums:
        parts = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([zlib.compress(sums[p][0].tobytes(), 1) for p in parts], pa.binary()), pa.array([sums[p][1] for p in parts], pa.int64()), pa.array([sums[p][2] for p in parts], pa.int64())], names=["part", "cells", "docs", "words"])


COUNTS = "part int, cells binary, docs long, words long"


class Corpus(NamedTuple):
    """Of each cell: BM25's idf, the turn of its term in drawing (the least is drawn), its dealings; and the mean document length."""

    idf: np.ndarray
    turn: np.ndarray
    parts: np.ndarray
    mean_words: float


def corpus_figures(docs: DataFrame) -> Corpus:
    """Over all documents; the driver receives SLICES rows, together one table of CELLS numbers."""
    counted = docs.select("text").mapInArrow(_count, COUNTS).repartition(SLICES, "part").mapInArrow(_sum, COUNTS).collect()
    df = np.zeros((SLICES, CELLS // SLICES), np.int64)
    n = words = 0
    for row in counted:
        df[row.part] = np.frombuffer(zlib.decompress(bytes(row.cells)), np.int64)
        n += row.docs
        words += row.words
    df = df.reshape(-1)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    chance = (mixed(np.arange(CELLS, dtype=np.uint64) + BASE) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    # What stands in one document brings it near no other.
    turn = np.where(df > 1, -np.log1p(-chance) / idf**2, np.inf)
    return Corpus(idf.astype(np.float32), turn.astype(np.float32), np.maximum(1, -(-df // DEALT_DOCS)), words / max(n, 1))


class Shard:
    """Documents of one shard, their inverted index and their packing."""

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.terms.append(terms)
        self.counts.append(counts)
        self.tokens += len(ids)

    def full(self) -> bool:
        return self.tokens >= SHARD_TOKENS or len(self.docs) >= SHARD_DOCS

    def index(self, idf: np.ndarray, mean_words: float) -> None:
        sizes = np.array([len(t) for t in self.terms])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts).astype(np.float32)
        length = np.array([c.sum() for c in self.counts], np.float32)
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.append(True, term[order][1:] != term[order][:-1])) if len(term) else np.zeros(0, np.int64)
        number = np.empty(len(term), np.int64)
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        weight = idf[term & np.uint32(CELLS - 1)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_words, 1e-6)))
        self.post_doc, self.post_weight = doc[order], weight[order].astype(np.float64)
        self.starts = starts
        self.uses = uses = np.diff(np.append(starts, len(term)))
        common = uses > max(2, COMMON * len(sizes))
        rare = (uses > 1) & ~common
        own = np.split(number, np.cumsum(sizes)[:-1])
        self.own_terms = [t[rare[t]] for t in own]
        # At most 1 / COMMON numbers for each posting of such a term, however many documents there are.
        row = np.cumsum(common) - 1
        self.own_rows = [row[t[common[t]]] for t in own]
        self.rows = np.zeros((int(common.sum()), len(sizes)), np.float32)
        at = np.flatnonzero(common[number])
        self.rows[row[number[at]], doc[at]] = weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms; those of the seed alone find nothing else."""
        terms, shared = self.own_terms[seed], np.zeros(len(self.docs), np.float32)
        for row in self.own_rows[seed].tolist():
            shared += self.rows[row]
        if not len(terms):
            return shared.astype(np.float64)
        n = self.uses[terms]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[terms] - ends + n, n)
        at += np.arange(len(at))
        return np.bincount(self.post_doc[at], self.post_weight[at], minlength=len(self.docs)) + shared

    def pack(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, length)."""
        unused = np.ones(len(self.docs), bool)
        sizes = [len(ids) for _, ids in self.docs]
        next_ = 0
        rest: tuple[int, int] | None = None
        left = self.tokens
        while left:
            room = window if left >= window else 1 << (left.bit_length() - 1)
            left -= room
            sequence: list[tuple[int, int, int]] = []
            near: np.ndarray | None = None
            seed = -1
            while room:
                if rest is not None:
                    doc, start = rest
                    rest = None
                else:
                    doc, start = -1, 0
                    if seed >= 0:
                        if near is None:
                            near = self.scores(seed)
                        np.multiply(near, unused, out=near)
                        best = int(near.argmax())
                        if near[best] > 0:
                            doc = best
                    if doc < 0:
                        while not unused[next_]:
                            next_ += 1
                        doc = next_
                    unused[doc] = False
                if seed < 0:
                    seed = doc
                take = min(room, sizes[doc] - start)
                sequence.append((doc, start, take))
                room -= take
                if start + take < sizes[doc]:
                    rest = (doc, start + take)
            yield sequence


DEALT = "key int, part long, doc_id long, row long, ids binary, terms binary, counts binary"


def _dealt(path: str, corpus):
    """Documents as ids and terms, with the cell of the term by which they are dealt."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        turn, parts = corpus.value.turn, corpus.value.parts
        for rows, data, offsets in blocks(batches, limit=BLOCK):
            row = rows.column("row").to_numpy()
            key, ids, terms, counts = np.full(rows.num_rows, -1, np.int32), [], [], []
            for i, (text, (own, n)) in enumerate(zip(rows.column("text").to_pylist(), _doc_terms(data, offsets), strict=True)):
                ids.append(encoder.encode(text).astype(encoder.kind).tobytes())
                terms.append(own.tobytes())
                counts.append(n.tobytes())
                if len(own):
                    cells = own & np.uint32(CELLS - 1)
                    turns = turn[cells]
                    first = int(turns.argmin())
                    if turns[first] < np.inf:
                        key[i] = cells[first]
            spread = mixed(row.view(np.uint64) ^ rows.column("doc_id").fill_null(-1).to_numpy().view(np.uint64))
            part = (spread % np.where(key < 0, 1 << 16, parts[key]).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), rows.column("doc_id"), rows.column("row"), *(pa.array(x, pa.binary()) for x in (ids, terms, counts))], names=["key", "part", "doc_id", "row", "ids", "terms", "counts"])

    return run


def _pack(path: str, window: int, corpus, with_ids: bool):
    """Over rows sorted by key and part: pieces of sequences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = piece_encoder(path).kind
        base, number = TaskContext.get().partitionId() << 32, 0

        def packed(shard: Shard) -> Iterator[pa.RecordBatch]:
            nonlocal number
            shard.index(corpus.value.idf, corpus.value.mean_words)
            rows: list[tuple] = []
            for sequence in shard.pack(window):
                offset = 0
                for doc, start, length in sequence:
                    doc_id, ids = shard.docs[doc]
                    own = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(own), len(ids), base + number, offset, own.tolist() if with_ids else None))
                    offset += length
                number += 1
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

        shard = Shard()
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for doc_id, ids, terms, counts in zip(batch.column("doc_id").to_pylist(), *(batch.column(c) for c in ("ids", "terms", "counts")), strict=True):
                whole = np.concatenate([np.frombuffer(ids.as_buffer(), kind).astype(np.uint32), end])
                shard.add(doc_id, whole, *(np.frombuffer(x.as_buffer(), np.uint32).copy() for x in (terms, counts)))
                if shard.full():
                    yield from packed(shard)
                    shard = Shard()
        if shard.docs:
            yield from packed(shard)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
TYPES = [*[pa.int64()] * 7, pa.list_(pa.int32())]


def retrieval_packing(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """All documents in windows of ``window`` tokens beside their lexical neighbours.

    One row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens (with the end id), sequence_id, offset in the sequence
    and, if asked for, ids.
    """
    rows = keyed(docs)
    corpus = docs.sparkSession.sparkContext.broadcast(corpus_figures(rows))
    dealt = rows.mapInArrow(_dealt(tokenizer, corpus), DEALT).repartition("key", "part").sortWithinPartitions("key", "part", "doc_id", "row")
    columns = ", ".join(f"{x} long" for x in NAMES[:-1])
    return dealt.mapInArrow(_pack(tokenizer, window, corpus, with_ids), f"{columns}, ids array<int>").drop(*([] if with_ids else ["ids"]))
