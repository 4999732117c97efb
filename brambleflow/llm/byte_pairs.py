"""Byte-level BPE by padded matrices, and decoding.

A text's pre-tokens are found by comparing the classes of neighbouring
characters, a block of texts at a time.  Pre-tokens that a worker hasn't met yet
are dealt to buckets by length; each bucket is a matrix of ids, a row a
pre-token, padded on the right.  In each round every row merges its leftmost
pair of least rank: all ranks of a row's pairs stand beside it, and only the two
pairs around a merge are looked up again, in a hash table of all pairs whose
merge is a token.  A merge moves the rest of its row one place to the left, so
the matrix loses a column a round, and rows without a pair leave it.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
without doc_id and rows that repeat one are encoded like all others; special
tokens' strings are ordinary text; an empty table gives an empty result; further
columns are ignored.  A text of any length is encoded in parts that end between
two pre-tokens, and a pre-token beyond the widest matrix over a heap, so memory
follows the part, time the length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import keyed
from .textblocks import BASE, BLOCK_BYTES, blocks, ragged, span_hashes
from .tokens import PATTERN

#: Columns of the matrices; a longer pre-token goes over a heap.
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
#: Rows of a matrix, so that it stays within the cache.
MATRIX_ROWS = 1 << 12
#: Pre-tokens and ids of theirs that a worker remembers before it starts afresh.
MEMO_PIECES, MEMO_IDS = 1_000_000, 1 << 23
NO_RANK = np.int32((1 << 31) - 1)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space after a character that is none: no pre-token crosses it, so a part may end there.
_CUT = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=\xe3\x80[\x81-\xbf])|(?<=\xe3[\x81-\xbf][\x80-\xbf])|(?<=[\xe4-\xef][\x80-\xbf]{2}))[ \t\n\r]")
#: What follows an apostrophe as a pre-token of its own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a base64 token and a number a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _told_apart(before: str, chars: str, pattern: str) -> np.ndarray:
    """For each character, whether the library's matcher keeps it in one match with the one before.

    Tokens are the single bytes and ``before`` with any byte, so that the two
    make such a token exactly where they are matched together.
    """
    import tiktoken

    lead = before.encode()
    ranks = {bytes([b]): b for b in range(256)} | {lead + bytes([b]): 256 + b for b in range(256)}
    asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return np.array([asked.encode_ordinary(before + c)[0] >= 256 for c in chars])


def character_classes(pattern: str = PATTERN) -> np.ndarray:
    """The class of every code point, as the library's Unicode tables have it.

    Other tables may know newer characters, so those that might be letters,
    numbers or white space are asked for one by one.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, name, before in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1"), (SPACE, r"\s", "\n")):
        chars = "".join(regex.findall(f"{name}+", every))
        own = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        out[own[_told_apart(before, chars, pattern)]] = kind
    return out


class HashTable:
    """Whole numbers by 64-bit keys, with open addressing."""

    def __init__(self, most: int) -> None:
        bits = max(4, (4 * max(most, 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * BASE >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in the table, at most as many as it was made for; values aren't negative."""
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.values[at] < 0)
            taken = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[taken]], self.values[at[taken]] = keys[taken], values[taken]
            rest = np.ones(len(keys), bool)
            rest[taken] = False
            keys, at, values = keys[rest], at[rest] + 1 & self.mask, values[rest]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        at = self._slots(keys)
        out = self.values[at]
        rest = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            out[rest] = self.values[at[rest]]
            rest = rest[(out[rest] >= 0) & (self.keys[at[rest]] != keys[rest])]
        return out


class BytePairs:
    """A byte-level vocabulary given by ranks: a token's rank is its id."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        if pattern != PATTERN:
            raise ValueError("only the pattern of byte-level pre-tokens is supported")
        self.ranks = read_ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte is no token")
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(a << 32 | b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None]
        self.table = HashTable(len(splits))
        keys, ids = zip(*splits, strict=True) if splits else ((), ())
        self.table.put(np.array(keys, np.uint64), np.array(ids, np.int32))
        self.classes = character_classes(pattern)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK where they make no token (negative ids never do)."""
        found = self.table.get((left.astype(np.int64) << 32 | right.astype(np.int64)).ravel().view(np.uint64))
        return np.where(found < 0, NO_RANK, found).reshape(left.shape)

    # Pre-tokens.

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of a block of texts begin, and the block's end."""
        if not len(data):
            return np.zeros(1, np.int64)
        if data.max() < 0x80:
            at, chars = np.arange(len(data)), data
        else:
            at = np.flatnonzero((data & 0xC0) != 0x80)
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.classes[chars]
        edge = np.zeros(len(chars) + 1, bool)
        edge[np.searchsorted(at, offsets)] = True  # texts never share a pre-token
        begins = edge.copy()
        begins[1:-1] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # The last of a run of white space goes with what follows, if that is no end: as its first character if it is a blank, else alone.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
        blank = chars[last] == 0x20
        begins[last] = True
        begins[last[blank] + 1] = False
        # An apostrophe alone between a match's begin and a letter may make a contraction.
        quote = np.flatnonzero((chars == 0x27) & begins[:-1])
        quote = quote[quote + 1 < len(chars)]
        quote = quote[begins[quote + 1] & ~edge[quote + 1] & (kind[quote + 1] == LETTER)]
        one, two = chars[quote + 1], np.where(edge[np.minimum(quote + 2, len(chars))], 0, chars[np.minimum(quote + 2, len(chars) - 1)])
        size = np.zeros(len(quote), np.int64)
        for word in CONTRACTIONS:
            size[(one == word[0]) & ((two == word[1]) if len(word) > 1 else True)] = len(word)
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[quote + 1 + size] = True
        # A letter run that went on begins anew; what a contraction ended at was a begin already.
        return np.append(at, len(data))[begins]

    # Merges.

    def _matrix(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of at most ``width`` bytes, round by round, and how many each has."""
        columns = np.arange(width)
        inside = columns < size[:, None]
        ids = np.where(inside, self.single[data[np.minimum(first[:, None] + columns, len(data) - 1)]], np.int32(-1))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        own, out, n = np.arange(len(first)), np.empty((len(first), width), np.int32), np.zeros(len(first), np.int64)
        while len(own):
            rows = np.arange(len(own))
            place = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            best = ranks[rows, place] if ranks.shape[1] else np.full(len(own), NO_RANK)
            ended = best == NO_RANK
            if ended.any():
                out[own[ended], : ids.shape[1]] = ids[ended]
                n[own[ended]] = size[own[ended]] - (width - ids.shape[1])
                rest = ~ended
                own, ids, ranks, place, best = own[rest], ids[rest], ranks[rest], place[rest], best[rest]
                rows = np.arange(len(own))
            if not len(own):
                break
            ids[rows, place] = best
            stays = np.ones(ids.shape, bool)
            stays[rows, place + 1] = False
            ids = ids[stays].reshape(len(own), -1)
            ranks = ranks[stays[:, 1:]].reshape(len(own), -1)
            for left in (place - 1, place):
                there = np.flatnonzero((left >= 0) & (left < ranks.shape[1]))
                ranks[there, left[there]] = self.pairs(ids[there, left[there]], ids[there, left[there] + 1])
        return out[columns < n[:, None]], n

    def _heap(self, piece: bytes) -> list[int]:
        """Ids of a long pre-token: the pairs wait in a heap by rank and place."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        some = np.flatnonzero(first != NO_RANK)
        waiting = list(zip(first[some].tolist(), some.tolist(), strict=True))
        heapq.heapify(waiting)
        tokens: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        before, after = list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1))
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if tokens[i] is None or j >= len(piece) or self.ranks.get(tokens[i] + tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = tokens[i] + tokens[j], None
            after[i] = after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(piece) and (found := self.ranks.get(tokens[a] + tokens[after[a]])) is not None:
                    heapq.heappush(waiting, (found, a))
        return [self.ranks[t] for t in tokens if t is not None]

    def merged(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that aren't tokens as a whole, one after the other, and how many each has."""
        size = last - first
        order = np.argsort(size, kind="stable")
        sizes, counts, flat, start = size[order], np.zeros(len(first), np.int64), [], 0
        for width in WIDTHS:
            stop = int(np.searchsorted(sizes, width, side="right"))
            for a in range(start, stop, MATRIX_ROWS):
                own = order[a : min(a + MATRIX_ROWS, stop)]
                ids, counts[own] = self._matrix(data, first[own], size[own], width)
                flat.append(ids)
            start = stop
        for k in order[start:].tolist():
            ids = self._heap(data[first[k] : last[k]].tobytes())
            counts[k] = len(ids)
            flat.append(np.array(ids, np.int32))
        # Back from the order by size.
        n = counts[order]
        begins = np.empty(len(first), np.int64)
        begins[order] = np.cumsum(n) - n
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32))[ragged(begins, counts)], counts

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class MemoPairs:
    """Encodes blocks of texts, with a bounded memo of pre-tokens by their hashes.

    Every block is decoded again: where two pre-tokens share a hash, the bytes
    differ from the block's, and it is encoded without the memo.
    """

    def __init__(self, path: str) -> None:
        self.pairs = BytePairs(path)
        tokens = self.pairs.bytes_of
        most = max(tokens) + 1
        self.token_size = np.array([len(tokens.get(i, b"")) for i in range(most)], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(most)), np.uint8)
        #: Ids in decimal, a blank before each, padded on the right.
        shown = [b" %d" % i for i in range(most)]
        self.shown_size = np.array(list(map(len, shown)), np.int64)
        width = int(self.shown_size.max())
        self.shown = np.frombuffer(b"".join(x.ljust(width) for x in shown), np.uint8).reshape(most, width)
        self.shown_inside = np.arange(width) < self.shown_size[:, None]
        self._forget()

    def _forget(self) -> None:
        """A fresh memo holds the tokens themselves."""
        self.table, self.entries, self.used = HashTable(MEMO_PIECES + len(self.token_size)), 0, 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        some = np.flatnonzero(self.token_size > 0)
        first = self.token_start[some]
        self._add(span_hashes(self.token_bytes, first, first + self.token_size[some]), some.astype(np.int32), np.ones(len(some), np.int64))
        self.tokens = self.entries

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Entries of distinct new keys."""
        for name, need in (("start", self.entries + len(keys)), ("count", self.entries + len(keys)), ("flat", self.used + len(ids))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))
        rows = slice(self.entries, self.entries + len(keys))
        self.start[rows] = self.used + np.cumsum(counts) - counts
        self.count[rows] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.table.put(keys, np.arange(rows.start, rows.stop, dtype=np.int32))
        self.entries, self.used = rows.stop, self.used + len(ids)

    def _by_memo(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = span_hashes(data, first, last)
        found = self.table.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            if self.entries + len(new) > MEMO_PIECES or self.used > MEMO_IDS:
                if self.entries == self.tokens:  # more than a fresh memo holds
                    return self._alone(data, first, last)
                self._forget()
                return self._by_memo(data, first, last)
            self._add(new, *self.pairs.merged(data, first[at], last[at]))
            found[missing] = self.table.get(keys[missing])
        n = self.count[found]
        return self.flat[ragged(self.start[found], n)], n

    def _alone(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without hashes of pre-tokens."""
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        rest = np.array([k for k, p in enumerate(pieces) if p not in self.pairs.ranks], np.int64)
        flat, counts = self.pairs.merged(data, first[rest], last[rest])
        n = np.ones(len(pieces), np.int64)
        n[rest] = counts
        ids = np.array([self.pairs.ranks.get(p, -1) for p in pieces], np.int32)
        out = np.repeat(ids, n)
        out[ragged((np.cumsum(n) - n)[rest], counts)] = flat
        return out, n

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[ragged(self.token_start[ids], self.token_size[ids])]

    def decimals(self, ids: np.ndarray) -> bytes:
        """A blank and the number, for each id."""
        return self.shown[ids][self.shown_inside[ids]].tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block of texts, where each text's begin (n + 1), and the decoded bytes, which stand at the texts' offsets."""
        bounds = self.pairs.starts(data, offsets)
        first, last = bounds[:-1], bounds[1:]
        ids, n = self._by_memo(data, first, last)
        back = self.decoded(ids)
        if not np.array_equal(back, data):
            ids, n = self._alone(data, first, last)
            back = self.decoded(ids)
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(bounds, offsets)], back

    def parts(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes of one long text, part by part."""
        raw = data.tobytes()
        start = 0
        while start < len(raw):
            cut = _CUT.search(raw, start + BLOCK_BYTES)
            stop = cut.start() if cut else len(raw)
            ids, _, back = self.encode(data[start:stop], np.array([0, stop - start]))
            yield ids, back
            start = stop

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Iterable[tuple[np.ndarray, np.ndarray]]]:
        """For each text of a block, its parts."""
        if len(data) > 2 * BLOCK_BYTES:
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield self.parts(data[a:b])
            return
        ids, bounds, back = self.encode(data, offsets)
        for a, b, x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield [(ids[a:b], back[x:y])]


_encoders: dict[str, MemoPairs] = {}


def _encoder(path: str) -> MemoPairs:
    if path not in _encoders:
        _encoders[path] = MemoPairs(path)
    return _encoders[path]


def _encode(path: str, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for rows, data, offsets in blocks(batches):
            n, ids, back = [], [], []
            for parts in encoder.texts(data, offsets):
                if digest:
                    count, own, text = 0, hashlib.sha256(), hashlib.sha256()
                    for found, raw in parts:
                        own.update(encoder.decimals(found)[not count :])
                        text.update(raw)
                        count += len(found)
                    n.append(count)
                    ids.append(own.hexdigest())
                    back.append(text.hexdigest())
                else:
                    both = list(parts)
                    ids.append(np.concatenate([found for found, _ in both] or [np.zeros(0, np.int32)]))
                    back.append(b"".join(raw.tobytes() for _, raw in both))
                    n.append(len(ids[-1]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(back, pa.string() if digest else pa.binary())], names=["doc_id", "row", "n_tokens", "ids", "decoded"])

    return run, f"doc_id long, row long, n_tokens long, ids {'string' if digest else 'array<int>'}, decoded {'string' if digest else 'binary'}"


def encode_bytes_bpe(docs: DataFrame, ranks: str, digest: bool = False) -> DataFrame:
    """Ids of whole texts and the bytes they decode to: doc_id, row, n_tokens, ids, decoded.

    ``ranks`` is the file of tokens and ranks.  ``digest`` gives SHA-256 of the
    ids, joined by a blank, and of the decoded bytes instead.
    """
    return keyed(docs).mapInArrow(*_encode(ranks, digest))


def decode_bytes_bpe(rows: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of the ids in an array column (null ids: null)."""
    own = rows.select(*(c for c in rows.columns if c != "decoded"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(ranks).pairs.decode
        for batch in batches:
            found = [None if x is None else decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("decoded", T.BinaryType())]))
