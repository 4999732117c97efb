"""Removal of byte strings that an earlier document holds, by hash-compared suffix sorting.

Every window of ``length`` bytes selects the smallest of its k-gram hashes (the
rightmost of equal ones) as its anchor, so equal windows have equal anchors at
equal distances.  Three jobs follow, each leaving a settled table:

1. Anchors are dealt by hash as packed arrays; those of two different texts or
   more are returned, packed, to the groups of documents that hold them.
2. Each group finds its windows with such an anchor.  A record carries the bytes
   around an anchor; equal windows meet in one partition.  There suffixes
   starting at the windows are sorted: by their first eight bytes, then by
   mergesort whose comparisons find the common extension by binary search over
   prefix polynomial hashes.  Neighbours that share ``length`` bytes, confirmed
   byte by byte, form a class; all but those of its smallest document go.
   A partition takes its records in chunks and carries the last key's distinct
   ones on, so a key's records need not fit into memory.
   Where an anchor stands very often, its windows are sent one by one, keyed by
   their own hash; a group sends a window once and decides that of its later
   documents at home, by the bytes.  What a document holds repeatedly is sent
   once, too; step 3 finds the other places in its text.
   Whole texts that an earlier document seems to have too, by two hashes and the
   length, are sent whole, once a group, and compared byte by byte instead.
   Should such a comparison fail, the job runs again without this for that hash.
3. Removed ranges join their documents.

Defined cases: a null or empty text has no bytes and loses none; all rows
without doc_id count as one document after all others; rows that share a doc_id
are one document, so none removes what another holds; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, drop_settled, keyed, settle
from .textblocks import BASE, blocks, mixed, powers, spans_of

#: Places of one anchor, copies of a text counted once, above which its windows are dealt one by one.
HOT_PLACES = 2_000
#: Windows and bytes of whole texts that a group remembers before it starts afresh.
SEEN_WINDOWS, SEEN_BYTES = 1 << 17, 1 << 23
#: Bytes of a block of texts, so that its figures stay in the processor's cache.
BLOCK = 1 << 17
#: Anchors that a task holds before it passes them on.
FLUSH = 1 << 18
CHUNK_BYTES = 1 << 18
#: Places of anchors that a task holds before it reduces those of hot ones to one a group.
HELD_ANCHORS = 1 << 21
#: Parts of the anchors that a task takes one after another.
PARTS_PER_TASK = 4
#: Such anchors whose windows are dealt out at once.
HOT_ANCHORS = 1024
#: Bits of a position inside a block of texts; longer texts are cut into overlapping pieces.
PLACE = 23
PIECE = 1 << (PLACE - 1)


def gram_size(length: int) -> int:
    return max(4, length * 2 // 5)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial sums of the bytes, and the inverse powers that align them."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash and place, the first and last window start."""
    k = gram_size(length)
    wide = length - k + 1
    if len(data) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    sums, down = prefix_sums(data)
    n = len(data) - k + 1
    hashes = mixed((sums[k:] - sums[:n]) * down[:n])
    low = np.uint64((1 << PLACE) - 1)
    least = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    starts, ends = offsets[:-1], offsets[1:]
    open_ = np.zeros(len(data) + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(open_, starts[whole], 1)
    np.add.at(open_, ends[whole] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(open_[: len(least)]))
    if not len(s):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    place = (low - (least[s] & low)).astype(np.int64)
    begins = np.ones(len(s), bool)
    begins[1:] = (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(begins)
    last = np.append(at[1:], len(s)) - 1
    return hashes[place[at]], place[at], s[at], s[last]


def pieces(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Blocks as (rows, bytes, offsets, row of each piece, place of the first byte); a very long text comes in pieces that overlap by length - 1."""
    for rows, data, offsets in blocks(batches, limit=BLOCK):
        if len(data) <= PIECE:
            yield rows, data, offsets, np.arange(rows.num_rows), 0
        else:
            for start in range(0, max(1, len(data) - length + 1), PIECE - length + 1):
                part = data[start : start + PIECE]
                yield rows, part, np.array([0, len(part)]), np.array([0]), start


def _anchors(length: int, parts: int):
    """Packed anchors for each part: values (lower 32 bits), indices of texts, their groups and hashes."""

    def packed(h: np.ndarray, group: np.ndarray, text: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.lexsort((h, part))
        part, value = part[order].astype(np.int32), (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        pair = np.stack([group[order], text[order], more[order]], axis=1)
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
            own = pair[a:b]
            by = np.lexsort((own[:, 2], own[:, 1], own[:, 0]))
            fresh = np.append(True, (own[by][1:] != own[by][:-1]).any(axis=1))
            index = np.empty(len(own), np.uint32)
            index[by] = np.cumsum(fresh) - 1
            docs = own[by][fresh]
            rows.append((int(part[a]), value[a:b].tobytes(), index.astype(np.uint32 if len(docs) > 65535 else np.uint16).tobytes(), docs.tobytes()))
        p, v, i, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(v, pa.binary()), pa.array(i, pa.binary()), pa.array(d, pa.binary())], names=["part", "vals", "idx", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows, data, offsets, owner, _ in pieces(batches, length):
            h, place, _, _ = anchor_runs(data, offsets, length)
            if not len(h):
                continue
            own = owner[np.searchsorted(offsets, place, side="right") - 1]
            held.append((h, *(rows.column(c).to_numpy()[own] for c in ("g", "row", "more"))))
            n += len(h)
            if n >= FLUSH:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return run, "part int, vals binary, idx binary, docs binary"


def _shared(hot: int, most: int = HELD_ANCHORS):
    """Over rows sorted by part: to each group of documents, the values that several texts hold, and which of these stand very often."""

    def judged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Places sorted by value; the first place of each value, text and group; each value's number, and whether it is shared and hot."""
        value, group, text, more, sure = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((group, more, text, value))
        value, group, text, more, sure = value[order], group[order], text[order], more[order], sure[order]
        first = np.append(True, value[1:] != value[:-1])
        fresh = first | np.append(True, (text[1:] != text[:-1]) | (more[1:] != more[:-1]))
        own = np.flatnonzero(fresh | np.append(True, group[1:] != group[:-1]))
        # A text's places are those of one of its copies: the fewest of a group.
        texts = np.minimum.reduceat(np.diff(np.append(own, len(value))), np.flatnonzero(fresh[own]))
        starts = np.flatnonzero(first[fresh])
        known = np.logical_or.reduceat(sure, np.flatnonzero(first))
        several = (np.diff(np.append(starts, len(texts))) > 1) | known
        return value, group, text, more, own, np.cumsum(first) - 1, several, several & ((np.add.reduceat(texts, starts) > hot) | known)

    def thinned(held: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        """Of values that are shared and hot already, one place a group."""
        value, group, text, more, _, which, _, many = judged(held)
        sure = many[which]
        cold, warm = np.flatnonzero(~sure), np.flatnonzero(sure)
        warm = warm[np.lexsort((group[warm], value[warm]))]
        new = np.append(True, (value[warm][1:] != value[warm][:-1]) | (group[warm][1:] != group[warm][:-1]))[: len(warm)]
        keep = np.concatenate([cold, warm[new]])
        return [(value[keep], group[keep], text[keep], more[keep], sure[keep])]

    def found(part: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        value, group, _, _, own, which, several, many = judged(held)
        own = own[several[which[own]]]
        if not len(own):
            return None
        to, key = group[own].astype(np.int32), (value[own].astype(np.uint64) << np.uint64(1)) | many[which[own]].astype(np.uint64)
        order = np.lexsort((key, to))
        to, key = to[order], key[order]
        fresh = np.append(True, (to[1:] != to[:-1]) | (key[1:] != key[:-1]))
        to, key = to[fresh], key[fresh]
        edges = np.flatnonzero(np.diff(to, prepend=-1))
        blobs = [key[a:b].tobytes() for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(to)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[edges]), pa.array(np.full(len(edges), part, np.int32)), pa.array(blobs, pa.binary())], names=["g", "part", "keys"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, limit = None, [], 0, most
        for batch in batches:
            for p, v, i, d in zip(*(batch.column(c) for c in ("part", "vals", "idx", "docs")), strict=True):
                if p.as_py() != part and held:
                    if (out := found(part, held)) is not None:
                        yield out
                    held, size, limit = [], 0, most
                part = p.as_py()
                docs = np.frombuffer(d.as_buffer(), np.int64).reshape(-1, 3)
                index = np.frombuffer(i.as_buffer(), np.uint32 if len(docs) > 65535 else np.uint16)
                held.append((np.frombuffer(v.as_buffer(), np.uint32), *docs[index].T, np.zeros(len(index), bool)))
                size += len(index)
                if size > limit:
                    held = thinned(held)
                    size = len(held[0][0])
                    limit = max(most, 2 * size)
        if held and (out := found(part, held)) is not None:
            yield out

    return run, "g int, part int, keys binary"


RECORDS = "key long, doc long, row long, start int, n int, back int, ctx binary"
#: Marks a record of a whole text (back), one of a text that holds windows repeatedly (start) and a text that isn't the copy it seemed (n).
WHOLE, REPEATS, NO_COPY = -1, -1, -1


class Group:
    """What the texts of one group of documents are held against."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.parts: list[np.ndarray] = []
        self.sorted: np.ndarray | None = None
        #: Smallest document by the hashes of texts that several documents seem to have.
        self.origins: dict[tuple[int, int], int] = {}
        self.windows: dict[bytes, tuple[int, int]] = {}
        self.wholes: dict[tuple[int, int], tuple[int, bytes]] = {}
        self.held = 0

    def keys(self) -> np.ndarray:
        if self.sorted is None:
            self.sorted = np.sort(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint64)
            self.parts = []
        return self.sorted


def _records(length: int, parts: int):
    """Over rows sorted by group, packed values before texts and texts by document: records of shared windows.

    A record is about n windows from ``start`` on, the first of them ``back``
    bytes before its anchor; ctx null marks windows that are decided already.
    """

    def rows_of(key, doc, row, start, n, back, ctx) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(back.astype(np.int32)), ctx], names=["key", "doc", "row", "start", "n", "back", "ctx"])

    def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]

    def decided(doc, row, start, n) -> pa.RecordBatch:
        """Ranges that need no comparison; dealt by document."""
        return rows_of(mixed(doc.view(np.uint64) ^ row.view(np.uint64)), doc, row, start, n, start * 0, pa.nulls(len(doc), pa.binary()))

    def repeating(doc: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        pair = np.unique(np.stack([doc, row], axis=1), axis=0)
        at = np.full(len(pair), REPEATS)
        return decided(pair[:, 0].copy(), pair[:, 1].copy(), at, at * 0)

    def without_copies(group: Group, batch: pa.RecordBatch, out: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The texts that aren't copies; the first copies of the group are sent whole, later ones of the same bytes decided."""
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "more")), strict=True))
        known = [i for i, (_, row, more) in enumerate(ids) if (row, more) in group.origins]
        if not known:
            return batch
        texts, gone = batch.column("text"), []
        sent: list[tuple] = []
        ready: list[tuple] = []
        for i in known:
            doc, row, more = ids[i]
            text = texts[i].as_py().encode()
            mark = (row, more)
            if group.origins[mark] < doc:
                gone.append(i)
            first, same = group.wholes.get(mark, (doc, None))
            if same is None:
                if group.held > SEEN_BYTES:
                    group.wholes.clear()
                    group.held = 0
                group.wholes[mark] = (doc, text)
                group.held += len(text)
            if same is None or same != text:
                sent.append((row ^ more, doc, row, len(text) - length + 1, text))
            elif first < doc:
                ready.append((doc, row, len(text) - length + 1))
        if sent:
            key, doc, row, n, text = zip(*sent, strict=True)
            zero = np.zeros(len(sent), np.int64)
            out.append(rows_of(mixed(np.array(key, np.int64).view(np.uint64)), np.array(doc), np.array(row), zero, np.array(n), zero + WHOLE, pa.array(text, pa.binary())))
        if ready:
            doc, row, n = (np.array(x) for x in zip(*ready, strict=True))
            out.append(decided(doc, row, n * 0, n))
        keep = np.ones(batch.num_rows, bool)
        keep[gone] = False
        return batch.filter(pa.array(keep))

    def singles(group: Group, data, first, last, base, doc, row) -> Iterator[pa.RecordBatch]:
        """Windows one by one: records of those that are new in the group, runs of those that an earlier document of it has."""
        n = last - first + 1
        which = np.repeat(np.arange(len(first)), n)
        s = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        own, text = doc[which], row[which]
        windows = slices(data, s, np.full(len(s), length))
        if len(group.windows) > SEEN_WINDOWS:
            group.windows.clear()
        kind = np.empty(len(s), np.int8)  # 0: new, 1: an earlier document's, 2: this text's
        held = group.windows
        for i, (x, d, t) in enumerate(zip(windows, own.tolist(), text.tolist(), strict=True)):
            first = held.get(x)
            if first is None:
                held[x] = (d, t)
                kind[i] = 0
            else:
                kind[i] = 1 if first[0] < d else 2 if first[1] == t else 0
        if len(at := np.flatnonzero(kind == 0)):
            ctx = np.lib.stride_tricks.sliding_window_view(data, length)[s[at]]
            key = np.zeros(len(at), np.uint64)
            for j in range(length):
                key *= BASE
                key += ctx[:, j] + np.uint64(1)
            yield rows_of(mixed(key), own[at], text[at], (s - base[which])[at], at * 0 + 1, at * 0, pa.array([windows[i] for i in at.tolist()], pa.binary()))
        if len(at := np.flatnonzero(kind == 1)):
            place = (s - base[which])[at]
            cut = np.append(True, (place[1:] != place[:-1] + 1) | (own[at][1:] != own[at][:-1]) | (text[at][1:] != text[at][:-1]))
            begin = np.flatnonzero(cut)
            yield decided(own[at][begin], text[at][begin], place[begin], np.diff(np.append(begin, len(at))))
        if len(at := np.flatnonzero(kind == 2)):
            yield repeating(own[at], text[at])

    def of_texts(group: Group, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if group.origins:
            out: list[pa.RecordBatch] = []
            batch = without_copies(group, batch, out)
            yield from out
        keys = group.keys()
        if not len(keys):
            return
        for rows, data, offsets, owner, ahead in pieces([batch], length):
            h, place, first, last = anchor_runs(data, offsets, length)
            if not len(h):
                continue
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            want = (part << np.uint64(33)) | ((h & np.uint64(0xFFFFFFFF)) << np.uint64(1))
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[at] | np.uint64(1)) == (want | np.uint64(1))
            if not hit.any():
                continue
            hot = (keys[at[hit]] & np.uint64(1)).astype(bool)
            h, place, first, last = h[hit], place[hit], first[hit], last[hit]
            piece = np.searchsorted(offsets, place, side="right") - 1
            own = owner[piece]
            base = offsets[:-1][piece] - ahead
            doc, row = rows.column("doc").to_numpy()[own], rows.column("row").to_numpy()[own]
            cold = np.flatnonzero(~hot)
            if len(cold):
                f, n = first[cold], (last - first + 1)[cold]
                ctx = slices(data, f, n + length - 1)
                back = place[cold] - f
                seen: dict[tuple, int] = {}
                once = [seen.setdefault(x, i) == i for i, x in enumerate(zip(piece[cold].tolist(), back.tolist(), ctx, strict=True))]
                if len(seen) < len(ctx):
                    again = np.array(once)
                    yield repeating(doc[cold][~again], row[cold][~again])
                    ctx = [x for x, new in zip(ctx, once, strict=True) if new]
                    cold, f, n, back = cold[again], f[again], n[again], back[again]
                yield rows_of(mixed(h[cold]), doc[cold], row[cold], f - base[cold], n, back, pa.array(ctx, pa.binary()))
            at = np.flatnonzero(hot)
            for part in np.array_split(at, max(1, len(at) // HOT_ANCHORS)):
                if len(part):
                    yield from singles(group, data, first[part], last[part], base[part], doc[part], row[part])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(-1)
        for batch in batches:
            g = batch.column("g").to_numpy()
            is_text = batch.column("kind").to_numpy() == 1
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if a == b:
                    continue
                if g[a] != group.number:
                    group = Group(int(g[a]))
                rows = batch.slice(a, b - a)
                if is_text[a]:
                    yield from of_texts(group, rows)
                    continue
                for p, x, row, more, origin in zip(rows.column("part").to_pylist(), rows.column("keys"), *(rows.column(c).to_pylist() for c in ("row", "more", "doc")), strict=True):
                    if p is None:
                        group.origins[(row, more)] = origin
                    else:
                        group.parts.append(np.frombuffer(x.as_buffer(), np.uint64) | (np.uint64(p) << np.uint64(33)))

    return run, RECORDS


class Suffixes:
    """Suffixes of one byte array, compared over their first ``limit`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.limit = limit
        self.data = np.concatenate([data, np.zeros(limit + 8, np.uint8)])
        self.sums, self.down = prefix_sums(self.data)
        self.eights = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))

    def same(self, x: np.ndarray, y: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        """Whether the prefix hashes say that the suffixes at x and y share m bytes."""
        return (self.sums[x + m] - self.sums[x]) * self.down[x] == (self.sums[y + m] - self.sums[y]) * self.down[y]

    def before(self, x: np.ndarray, y: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix x sorts before y, and whether they are equal; they share ``known`` bytes."""
        equal = self.same(x, y, self.limit)
        less = np.zeros(len(x), bool)
        rest = np.flatnonzero(~equal)
        if len(rest):
            a, b = x[rest], y[rest]
            low, high = np.full(len(rest), min(known, self.limit - 1)), np.full(len(rest), self.limit - 1)
            while (open_ := low < high).any():
                mid = (low + high + 1) // 2
                ok = self.same(a, b, mid)
                low, high = np.where(ok & open_, mid, low), np.where(~ok & open_, mid - 1, high)
            less[rest] = self.data[a + low] < self.data[b + low]
        return less, equal

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes' order (indices into ``at``), and whether each equals the one before it."""
        lead = self.eights[at].astype(np.uint64)
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        tied = np.append(False, lead[1:] == lead[:-1])
        group = np.flatnonzero(~tied)
        sizes = np.diff(np.append(group, len(at)))
        begin, size = np.repeat(group, sizes), np.repeat(sizes, sizes)
        local = np.arange(len(at)) - begin
        known = min(8, self.limit)
        width = 1
        while width < int(sizes.max(initial=0)):
            act = np.flatnonzero(size > width)
            off = local[act]
            block = off - off % (2 * width)
            left = off - block < width
            low = begin[act] + np.where(left, np.minimum(block + width, size[act]), block)
            high = begin[act] + np.where(left, np.minimum(block + 2 * width, size[act]), block + width)
            first = low.copy()
            suffix = at[order[act]]
            while len(live := np.flatnonzero(low < high)):
                mid = (low[live] + high[live]) // 2
                less, equal = self.before(at[order[mid]], suffix[live], known)
                ahead = less | (equal & ~left[live])
                low[live] = np.where(ahead, mid + 1, low[live])
                high[live] = np.where(ahead, high[live], mid)
            own = off - block - np.where(left, 0, width)
            merged = order.copy()
            merged[begin[act] + block + own + (low - first)] = order[act]
            order = merged
            width *= 2
        equal = np.zeros(len(at), bool)
        next_ = np.flatnonzero(tied)
        equal[next_] = self.equal(at[order[next_ - 1]], at[order[next_]])
        return order, equal

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Byte by byte: the suffixes at x and y share ``limit`` bytes."""
        out = np.ones(len(x), bool)
        if self.limit < 8:
            for j in range(self.limit):
                out &= self.data[x + j] == self.data[y + j]
            return out
        for j in [*range(0, self.limit - 8, 8), self.limit - 8]:
            out &= self.eights[x + j] == self.eights[y + j]
        return out


def _decided(length: int):
    """Over records sorted by key and document: ranges of window starts to remove."""

    def out(doc, row, start, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "row", "start", "n"])

    def judged(t: pa.Table, found: list[pa.RecordBatch]) -> np.ndarray:
        """Adds what is removed; the last key's distinct records, of the smallest document each."""
        key, doc, row, start, n, back = (t.column(c).to_numpy() for c in ("key", "doc", "row", "start", "n", "back"))
        ctx = pa.concat_arrays(t.column("ctx").chunks)
        offsets = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        data = np.frombuffer(ctx.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        sums, down = prefix_sums(data)
        whole = mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]]) ^ mixed(key.view(np.uint64) + n.astype(np.uint64) * np.uint64(3) + (back.astype(np.uint64) << np.uint64(32)))
        _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
        rep = first[inverse]
        size = np.diff(offsets)
        same = np.flatnonzero((rep != np.arange(len(rep))) & (size == size[rep]) & (key == key[rep]))
        if len(same):
            size = size[same]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            alike = data[np.repeat(offsets[same], size) + step] == data[np.repeat(offsets[rep[same]], size) + step]
            same = same[np.logical_and.reduceat(alike, np.cumsum(size) - size)]
        copy = same[doc[same] > doc[rep[same]]]
        if len(copy):
            found.append(out(doc[copy], row[copy], start[copy], n[copy]))
        distinct = np.ones(len(key), bool)
        distinct[same] = False
        left = np.ones(len(key), bool)
        left[copy] = False
        own = np.flatnonzero(left)
        k = key[own]
        alone = np.append(True, k[1:] != k[:-1]) & np.append(k[1:] != k[:-1], True)
        own = own[~alone]
        if len(own):
            count = n[own].astype(np.int64)
            which = np.repeat(own, count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[which] + step
            order, equal = Suffixes(data, length).order(at)
            starts = np.flatnonzero(~equal)
            least = np.repeat(np.minimum.reduceat(doc[which[order]], starts), np.diff(np.append(starts, len(order))))
            gone = np.zeros(len(at), bool)
            gone[order] = doc[which[order]] > least
            hit = np.flatnonzero(gone)
            if len(hit):
                begin = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])))
                w = which[hit[begin]]
                found.append(out(doc[w], row[w], start[w] + step[hit[begin]], np.diff(np.append(begin, len(hit)))))
        return np.flatnonzero(distinct & (key == key[-1]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[pa.RecordBatch] = []
        size, first = 0, (None, 0, b"")
        for batch in batches:
            done = batch.column("ctx").is_null().to_numpy(zero_copy_only=False)
            whole = ~done & (batch.column("back").to_numpy() == WHOLE)
            if done.any():
                over = batch.filter(pa.array(done))
                yield out(*(over.column(c).to_numpy() for c in ("doc", "row", "start", "n")))
            if whole.any():
                texts = batch.filter(pa.array(whole))
                judgements = []
                for key, doc, row, n, text in zip(*(texts.column(c).to_pylist() for c in ("key", "doc", "row", "n", "ctx")), strict=True):
                    if key != first[0]:
                        first = (key, doc, text)
                    elif text != first[2]:
                        judgements.append((doc, row, 0, NO_COPY))
                    elif doc > first[1]:
                        judgements.append((doc, row, 0, n))
                if judgements:
                    yield out(*(np.array(x) for x in zip(*judgements, strict=True)))
            if (done | whole).any():
                batch = batch.filter(pa.array(~(done | whole)))
            ends = np.cumsum(pa.compute.binary_length(batch.column("ctx")).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                before = int(ends[a - 1]) if a else 0
                b = min(batch.num_rows, int(np.searchsorted(ends, before + CHUNK_BYTES - size)) + 1)
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1]) - before
                if size >= CHUNK_BYTES:
                    t = pa.Table.from_batches(held)
                    on = t.take(judged(t, found)).combine_chunks().to_batches()
                    yield from found
                    found.clear()
                    # What goes on counts as nothing: a key's distinct records are few.
                    held, size = on, 0
                a = b
        if held:
            judged(pa.Table.from_batches(held), found)
            yield from found

    return run, "doc long, row long, start int, n int"


def fingerprints() -> list:
    """Columns row, more and size: by them a text seems to be another's copy."""
    return ["row", F.xxhash64(F.lit(1), "text").alias("more"), F.octet_length("text").alias("size")]


def repeated_windows(docs: DataFrame, length: int = 50, hot: int = HOT_PLACES, but: DataFrame | None = None) -> DataFrame:
    """Ranges (doc, row, start, n): the n windows of ``length`` bytes from ``start`` on stand in an earlier document too.

    doc is doc_id (the largest long where null), row the hash of the text.  A
    start of REPEATS says that other places of a document's removed windows go
    too.  ``but`` has rows whose texts aren't taken for copies.
    """
    spark = docs.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS_PER_TASK * groups
    texts = keyed(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "row", "text")
    texts = texts.withColumn("g", F.pmod(F.xxhash64("doc", "row"), F.lit(groups)).cast("int"))
    # Of the same text by two hashes; once these have failed, every document's text counts as another.
    of = fingerprints()[:2] if but is None else ["row", F.col("doc").alias("more")]
    anchors = texts.select("g", *of, "text").mapInArrow(*_anchors(length, parts)).repartition(groups, "part").sortWithinPartitions("part")
    shared = settle(anchors.mapInArrow(*_shared(hot)), "anchors")

    # What seems to be a copy: a group's copies of a text are one row before they are dealt.
    thin = texts.select("g", "doc", *fingerprints()).where(F.col("size") >= length)
    firsts = thin.groupBy("g", "row", "more", "size").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    if but is not None:
        firsts = firsts.join(but, "row", "left_anti")
    origins = firsts.groupBy("row", "more", "size").agg(F.min("low").alias("doc"), F.max("high").alias("latest")).where("doc <> latest").drop("latest")
    copies = firsts.join(origins, ["row", "more", "size"])
    no_text, no_part = [F.lit(None).cast("string").alias("text")], [F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("keys")]
    no_id = [F.lit(None).cast("long").alias(c) for c in ("doc", "row", "more")]
    copied = copies.select("g", F.lit(0).alias("kind"), "doc", "row", "more", *no_text, *no_part)
    sent = shared.select("g", F.lit(0).alias("kind"), *no_id, *no_text, "part", "keys")
    own = texts.select("g", F.lit(1).alias("kind"), "doc", *fingerprints()[:2], "text", *no_part)
    grouped = sent.unionByName(copied).unionByName(own).repartition(groups, "g").sortWithinPartitions("g", "kind", "doc")
    records = grouped.mapInArrow(*_records(length, parts)).repartition(groups, "key").sortWithinPartitions("key", "doc", "row", "start")
    found = settle(records.mapInArrow(*_decided(length)), "repeats")
    drop_settled(shared)
    failed = found.where(F.col("n") == NO_COPY).select("row").distinct()
    if failed.limit(1).count():
        more = failed if but is None else failed.union(but).distinct()
        return repeated_windows(docs, length, hot, settle(more, "no-copies"))
    return found


def _all_places(text: np.ndarray, gone: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows whose bytes are those of a removed one."""
    sums, down = prefix_sums(text)
    n = len(gone)
    h = (sums[length:] - sums[:n]) * down[:n]
    maybe = np.flatnonzero(np.isin(h, np.unique(h[gone])) & ~gone)
    if len(maybe):
        raw = text.tobytes()
        held = {raw[s : s + length] for s in np.flatnonzero(gone & np.isin(h, np.unique(h[maybe]))).tolist()}
        gone = gone.copy()
        gone[maybe] = [raw[s : s + length] in held for s in maybe.tolist()]
    return gone


def _cut(length: int, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            n_removed, n_spans, kept = [], [], []
            for i, ranges in enumerate(rows.column("ranges")):
                text = data[offsets[i] : offsets[i + 1]]
                gone = spans = 0
                left = text.tobytes()
                if ranges.is_valid:
                    start, n = (ranges.values.field(c).to_numpy() for c in ("start", "n"))
                    windows = len(text) - length + 1
                    edge = np.zeros(windows + 1, np.int64)
                    np.add.at(edge, start[start >= 0], 1)
                    np.add.at(edge, (start + n)[start >= 0], -1)
                    removed = np.cumsum(edge[:-1]) > 0
                    if (start == REPEATS).any() and removed.any():
                        removed = _all_places(text, removed, length)
                    edge = np.zeros(len(text) + 1, np.int64)
                    edge[:windows] += removed
                    edge[length : length + windows] -= removed
                    cover = np.cumsum(edge[:-1]) > 0
                    if not digest:
                        char = np.cumsum((text & 0xC0) != 0x80) - 1
                        cover = np.minimum.reduceat(cover, np.flatnonzero(np.diff(char, prepend=-1)))[char]
                    gone = int(cover.sum())
                    spans = int(np.count_nonzero(cover[1:] & ~cover[:-1])) + int(cover[0])
                    left = text[~cover].tobytes()
                n_removed.append(gone)
                n_spans.append(spans)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            sizes = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), sizes, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run, "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept string"


def suffix_dedup(docs: DataFrame, length: int = 50, digest: bool = False, hot: int = HOT_PLACES) -> DataFrame:
    """Documents without the bytes that a string of ``length`` bytes of an earlier document covers.

    Returns doc_id, row, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept: the SHA-256 of the remaining bytes with ``digest``, else the remaining
    text, where a character goes only if all its bytes do.
    """
    found = repeated_windows(docs, length, hot)
    ranges = found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("ranges")).alias("r")
    d = keyed(docs).alias("d")
    both = d.join(ranges.hint("merge"), (F.coalesce("d.doc_id", F.lit(NULL_ID)) == F.col("r.doc")) & (F.col("d.row") == F.col("r.row")), "left")
    return both.select("d.doc_id", "d.row", "d.text", "r.ranges").mapInArrow(*_cut(length, digest))
