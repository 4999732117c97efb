"""Vectorised views of text columns: byte blocks, word bounds and rolling word hashes.

Every helper works on a *block*: the UTF-8 bytes of some rows' whole texts, one
after the other, as one numpy array with the rows' offsets.  A null text counts
as an empty one.  Blocks hold about ``BLOCK_BYTES`` bytes (a longer text has a
block of its own), which bounds what a Python worker allocates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: Odd multipliers of the word and shingle hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _ALNUM[_low : _high + 1] = False
_ALNUM[ord("A") : ord("Z") + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_VALUE = LOWER.astype(np.uint64) + np.uint64(1)
_VALUE = np.arange(1, 257, dtype=np.uint64)
#: Bytes of words: everything but ASCII white space; digits, letters (A-Z are lower-cased) and everything beyond ASCII.
WORD_BYTES = {"space": ~_SPACE, "alnum": _ALNUM}


def text_array(column: pa.Array) -> pa.Array:
    """The column as 32-bit-offset strings; nulls stay nulls of length 0."""
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes (whole buffer) and its rows' offsets (n + 1)."""
    column = text_array(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into (rows, bytes, offsets) of about ``limit`` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = spans_of(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a block's words, and the index of the first word of each row (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORD_BYTES[kind][data]
    turns = np.empty(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=turns[1:-1])
    turns[0], turns[-1] = inside[0], inside[-1]
    # A word that would go on from one row to the next ends and begins there.
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    through = np.unique(edges[inside[edges] & inside[edges - 1]])
    at = np.flatnonzero(turns)
    if len(through):
        at = np.sort(np.concatenate([at, through, through]))
    first, last = at[0::2], at[1::2]
    return first, last, np.searchsorted(first, offsets)


def word_slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block as it is, or a long text in parts that end between words."""
    if len(offsets) > 2 or len(data) <= 2 * BLOCK_BYTES:
        yield data, offsets
        return
    start = 0
    while start < len(data):
        stop = start + BLOCK_BYTES
        while stop < len(data):
            other = np.flatnonzero(~WORD_BYTES["alnum"][data[stop : stop + BLOCK_BYTES]])
            if len(other):
                stop += int(other[0])
                break
            stop += BLOCK_BYTES
        stop = min(stop, len(data))
        yield data[start:stop], np.array([0, stop - start])
        start = stop


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 64)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def _hashes(data: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    own = values[data]
    own *= up[: len(data)]
    np.cumsum(own, out=sums[1:])
    raw = sums[last]
    raw -= sums[first]
    raw *= down[first]
    raw ^= (last - first).astype(np.uint64) * MIX_B
    return mixed(raw)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words, by prefix polynomial sums."""
    return _hashes(data, _LOWER_VALUE, first, last)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans' bytes as they are."""
    return _hashes(data, _VALUE, first, last)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the i-th starts at word i (rows are not told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += words[j : j + n]
    return mixed(out)


def row_grams(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words inside each row, and each run's row."""
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(words, k)
    inside = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
    return grams[inside], rows[: len(grams)][inside]
