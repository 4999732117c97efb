"""Line deduplication over a corpus.

Hashes of line keys are range-partitioned together with document and position,
so a key that stands in a third of all lines spreads over many partitions.  Each
partition streams its rows in order and knows the first document of every key
that begins in it; for the one key that may have begun before, it reports its
rows undecided, and a table of two rows a partition decides them.  Documents get
back compressed keep bitmaps; their texts take no part until those are applied.

Defined cases: a null or empty text is one empty line; all rows without doc_id
count as one document, after all others; rows that repeat a doc_id are one
document for the counts, and each gets its own result; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, settle
from .textblocks import blocks

SPACE = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc_id long, row long, pos int, n_lines int"
FOUND = "kind int, h1 long, h2 long, first long, doc_id long, row long, pos int, n_lines int"
DROP, OPEN, FIRST = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _line_rows(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            ids, own = rows.column("doc_id").to_pylist(), rows.column("row").to_pylist()
            digests, at = [], []
            for i in range(rows.num_rows):
                lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
                for pos, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(key))
                        at.append((ids[i], own[i], pos, len(lines)))
            if digests:
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                doc, row, pos, n = zip(*at, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32())], names=["h1", "h2", "doc_id", "row", "pos", "n_lines"])

    return run


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order of key, document and position: drops, undecided rows and first documents."""
    head = last = None
    first = 0

    def out(kind: int, h1, h2, firsts, doc, row, pos, n) -> pa.RecordBatch:
        size = len(h1)
        docs = pa.array(doc, pa.int64(), mask=doc == NULL_ID) if size else pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, kind, np.int32)), pa.array(h1), pa.array(h2), pa.array(np.asarray(firsts, np.int64)), docs, pa.array(row), pa.array(pos, pa.int32()), pa.array(n, pa.int32())],
            names=["kind", "h1", "h2", "first", "doc_id", "row", "pos", "n_lines"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, row, pos, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "row", "pos", "n_lines"))
        doc = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        begins = np.ones(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        key0 = (int(h1[0]), int(h2[0]))
        if head is None:
            head, last, first = key0, key0, int(doc[0])
            yield out(FIRST, h1[:1], h2[:1], doc[:1], doc[:1], row[:1], pos[:1], n[:1])
        starts = np.flatnonzero(begins)
        firsts = doc[starts].copy()
        if key0 == last:
            firsts[0] = first
        firsts_all = firsts[np.cumsum(begins) - 1]
        opened = (h1 == head[0]) & (h2 == head[1])
        dropped = ~opened & (doc != firsts_all)
        for kind, mask in ((DROP, dropped), (OPEN, opened)):
            if mask.any():
                yield out(kind, h1[mask], h2[mask], firsts_all[mask], doc[mask], row[mask], pos[mask], n[mask])
        last, first = (int(h1[-1]), int(h2[-1])), int(firsts[-1])
    if head is not None and last != head:
        one = np.array([0], np.int64)
        yield out(FIRST, np.array([last[0]]), np.array([last[1]]), np.array([first]), one, one, one, one)


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for lost, n in zip(batch.column("lost").to_pylist(), batch.column("n_lines").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[lost] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(maps, pa.binary())], names=["doc_id", "row", "n_lines", "n_dropped", "keep"])


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Keep bitmaps of the documents that lose lines.

    A line whose key (stripped of ASCII white space, A-Z lower-cased) has at
    least ``min_chars`` code points and stands in several documents stays only
    in the document with the smallest doc_id.  Returns doc_id, row (hash of the
    text), n_lines, n_dropped, keep (zlib over one bit a line).
    """
    lines = keyed(docs).mapInArrow(_line_rows(min_chars), LINES)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("row"), F.col("pos")]
    found = settle(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, FOUND), "lines")
    firsts = found.where(F.col("kind") == FIRST).groupBy("h1", "h2").agg(F.min("first").alias("origin"))
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(firsts), ["h1", "h2"]).where(F.coalesce("doc_id", F.lit(NULL_ID)) != F.col("origin"))
    columns = ["doc_id", "row", "pos", "n_lines"]
    lost = found.where(F.col("kind") == DROP).select(columns).unionByName(late.select(columns))
    by_doc = lost.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("lost"), F.first("n_lines").alias("n_lines"))
    return by_doc.withColumn("n_dropped", F.size("lost")).mapInArrow(_bitmaps, "doc_id long, row long, n_lines int, n_dropped int, keep binary")


def _applied(digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            n_lines, n_dropped, kept = [], [], []
            for i, packed in enumerate(rows.column("keep").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                n = text.count(b"\n") + 1
                left = text
                if packed is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).tolist()
                    left = b"\n".join(line for line, k in zip(text.split(b"\n"), keep, strict=True) if k)
                    n_dropped.append(n - sum(keep))
                else:
                    n_dropped.append(0)
                n_lines.append(n)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "row", "n_lines", "n_dropped", "kept"])

    return run


def apply_keep_bitmaps(docs: DataFrame, maps: DataFrame, digest: bool = False) -> DataFrame:
    """Texts without their dropped lines, or their SHA-256: doc_id, row, n_lines, n_dropped, kept."""
    d, m = keyed(docs).alias("d"), maps.alias("m")
    both = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.row") == F.col("m.row")), "left")
    return both.select("d.doc_id", "d.row", "d.text", "m.keep").mapInArrow(_applied(digest), "doc_id long, row long, n_lines long, n_dropped long, kept string")


def line_dedup(docs: DataFrame, min_chars: int = 10, digest: bool = False) -> DataFrame:
    """``line_keep_bitmaps`` applied: doc_id, row, n_lines, n_dropped, kept."""
    return apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_chars), digest)
