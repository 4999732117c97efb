"""SentencePiece BPE encoding by a table of prefixes, and decoding.

BPE gives every prefix of a piece of text one encoding, and that encoding's last
token decides it: it is the one match ending there that is compatible with the
last token of the prefix before it.  An automaton over the vocabulary lists the
matches, a pair test tells compatible tokens, and ids are recovered backwards
from the whole piece.  Two tokens are compatible if undoing their merges, latest
first, never meets a pair across their border that would have merged earlier.

Texts are cut where a space follows something else and at line breaks: no token
crosses these.  Undoing merges needs an order without ties, which the runs of
spaces in the vocabulary break: two tokens that make such a run are compatible if
merging their joined text, which is short, gives the two again.

Defined cases: a null or empty text has no ids and decodes to the empty text;
a character outside the vocabulary becomes its UTF-8 bytes' ids; rows without
doc_id and rows that repeat one are encoded like all others; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import keyed
from .textblocks import blocks

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Pieces, their bytes and pairs of tokens that a worker remembers before it starts afresh.
MEMO_PIECES, MEMO_BYTES, MEMO_PAIRS = 600_000, 1 << 24, 600_000
FAR = 1 << 60


class Pieces:
    """The vocabulary of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that change nothing but spaces are supported")
        #: Whether a space is put before every text, and taken off again.
        self.lead = norm.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = [p.score for p in model.pieces]
        places = {s: k for k, s in enumerate(sorted({-self.score[i] for i in self.ids.values()}))}
        #: Order of a token's last merge; characters have none.
        self.rank = [places[-s] if t in self.ids and len(t) > 1 else -1 for s, t in zip(self.score, self.text, strict=True)]
        self.ranks = {t: self.rank[i] for t, i in self.ids.items() if len(t) > 1}
        self.known = {t for t in self.ids if len(t) == 1}
        self.left, self.right = [-1] * len(self.text), [-1] * len(self.text)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) > 1:
                parts = self.merged(t, True)
                if len(parts) != 2:
                    continue
                self.left[i], self.right[i] = (self.ids[x] for x in parts)
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str, but_last: bool = False) -> list[str]:
        """Merge by merge, best score first, leftmost of equal ones; ``but_last`` leaves the text's own merge out."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, FAR), k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))]
            rank, k = min(found)
            if rank == FAR or (but_last and len(parts) == 2):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, u: int, t: int) -> bool:
        """Whether u before t stay two tokens."""
        known = self.pairs.get(u << 20 | t)
        if known is not None:
            return known
        key, bound, answer = u << 20 | t, FAR, True
        both = self.text[u] + self.text[t]
        if SPACE * 2 in both:
            return self._remember(key, self.merged(both) == [self.text[u], self.text[t]])
        while True:
            if self.ranks.get(self.text[u] + self.text[t], FAR) < bound:
                answer = False
                break
            a, b = self.rank[u], self.rank[t]
            if a < 0 and b < 0:
                break
            if a > b:
                bound, u = a, self.right[u]
            else:
                bound, t = b + 1, self.left[t]
        return self._remember(key, answer)

    def _remember(self, key: int, answer: bool) -> bool:
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def _by_prefixes(self, text: str) -> list[int]:
        """Of known characters."""
        last = [-1] * (len(text) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = end - size
                if before:
                    u = last[before]
                    fits = pairs.get(u << 20 | token)
                    if not (compatible(u, token) if fits is None else fits):
                        continue
                last[end] = token
        ids, end = [], len(text)
        while end:
            token = last[end]
            ids.append(token)
            end -= len(self.text[token])
        ids.reverse()
        return ids

    def encode_part(self, text: str) -> list[int]:
        """The ids of a piece of text that has its leading space already."""
        text = text.replace(" ", SPACE)
        if self.known.issuperset(text):
            return self._by_prefixes(text) if text else []
        ids: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if start < k:
                    ids += self._by_prefixes(text[start:k])
                ids += [self.byte[b] for b in c.encode()]
                start = k + 1
        return ids + (self._by_prefixes(text[start:]) if start < len(text) else [])

    def decode_part(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes_of.get(i) or self.text[i].replace(SPACE, " ").encode() for i in ids)

    def decode(self, ids: list[int]) -> str:
        raw = self.decode_part(ids)
        return (raw[1:] if self.lead and raw[:1] == b" " else raw).decode(errors="replace")


class MemoEncoder:
    """Encodes blocks of texts piece by piece, with a bounded memo."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.ids: dict[bytes, bytes] = {}
        self.back: dict[bytes, bytes] = {}
        self.size = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """For each text, its ids in decimal, each followed by a comma, and what they decode to."""
        raw = data.tobytes()
        if SPACE.encode() in raw:
            texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.cumsum([0, *map(len, texts)])
        if self.pieces.lead:
            some = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][some], 0x20)
            offsets = offsets + np.append(0, np.cumsum(some))
        raw = data.tobytes()
        space, line = data == 0x20, np.flatnonzero(data == 0x0A)
        space[1:] &= data[:-1] != 0x20
        edge = np.append(space, False)
        edge[line] = edge[line + 1] = edge[offsets] = True
        bounds = np.flatnonzero(edge).tolist()
        chunks = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(self.ids) > MEMO_PIECES or self.size > MEMO_BYTES:
            self.ids.clear()
            self.back.clear()
            self.size = 0
        encode, decode = self.pieces.encode_part, self.pieces.decode_part
        for chunk in set(chunks).difference(self.ids):
            ids = encode(chunk.decode())
            self.ids[chunk] = b"".join(b"%d," % i for i in ids)
            self.back[chunk] = decode(ids)
            self.size += len(chunk)
        ids, back = list(map(self.ids.__getitem__, chunks)), list(map(self.back.__getitem__, chunks))
        rows = np.searchsorted(bounds, offsets).tolist()
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            yield b"".join(ids[a:b]), b"".join(back[a:b])[self.pieces.lead :]


_encoders: dict[str, MemoEncoder] = {}


def _encoder(path: str) -> MemoEncoder:
    if path not in _encoders:
        _encoders[path] = MemoEncoder(path)
    return _encoders[path]


def _encode(path: str, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for rows, data, offsets in blocks(batches):
            n, ids, back = [], [], []
            for own, text in encoder.encode(data, offsets):
                n.append(own.count(b","))
                if digest:
                    ids.append(hashlib.sha256(own[:-1]).hexdigest())
                    back.append(hashlib.sha256(text).hexdigest())
                else:
                    ids.append([int(x) for x in own.split(b",")[:-1]])
                    back.append(text.decode())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "row", "n_tokens", "ids", "decoded"])

    return run, f"doc_id long, row long, n_tokens long, ids {'string' if digest else 'array<int>'}, decoded string"


def encode_pieces(docs: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """Ids of whole texts and what they decode to: doc_id, row, n_tokens, ids, decoded.

    ``digest`` gives SHA-256 of the comma-joined ids and of the decoded text instead.
    """
    return keyed(docs).mapInArrow(*_encode(model, digest))


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text of the ids in an array column (null ids: null)."""
    column = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(model).pieces.decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    own = rows.select(*column)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())]))
