"""Progressive JPEG: a decoder in numpy, and an encoder that stores bytes as coefficients.

The decoder accumulates the scans of a file, by spectral selection and
successive approximation, into arrays of coefficients; multiplies and inversely
transforms these in whole numbers; repeats chroma samples up to full resolution;
and converts to RGB.  Stretches of equally long codes, and the correction bits
of runs of blocks, are read in one step each; everything else code by code.

The encoder turns each byte into one coefficient, so the file holds the bytes
without loss: magnitude 128 plus the lower seven bits, positive where the
highest bit is set, no quantisation, and two chroma blocks to four of luma.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
FIX = 13
#: Blocks that are transformed at once.
STRIP_BLOCKS = 1 << 14


def _basis() -> np.ndarray:
    """Whole-number samples of the cosine products, coefficients in zigzag order by pixels in rows."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both * (1 << FIX))[ZIGZAG]


BASIS = _basis()


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    rows: int = 0
    cols: int = 0
    all_cols: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


class Codes:
    """A Huffman table: by bit strings, and by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.symbol = np.zeros(1 << 16, np.int16)
        self.length = np.zeros(1 << 16, np.int8)
        code = at = 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                low, high = code << (16 - bits), (code + 1) << (16 - bits)
                self.symbol[low:high], self.length[low:high] = symbols[at], bits
                code, at = code + 1, at + 1
            code <<= 1
        #: Symbol and length in one.
        self.key = self.length.astype(np.int32) << 8 | self.symbol


_codes = lru_cache(64)(Codes)


@lru_cache(256)
def _unit_order(high: int, wide: int, h: int, v: int) -> np.ndarray:
    """A component's blocks unit by unit."""
    y = (np.arange(high)[:, None, None, None] * v + np.arange(v)[None, None, :, None]) * (wide * h)
    x = np.arange(wide)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
    return (y + x).reshape(-1)


@lru_cache(256)
def _row_order(rows: int, cols: int, all_cols: int) -> np.ndarray:
    return (np.arange(rows)[:, None] * all_cols + np.arange(cols)).reshape(-1)


class Bits:
    """The entropy-coded bytes of a scan or restart interval."""

    def __init__(self, data: bytes) -> None:
        self.bytes = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.raw = np.frombuffer(self.bytes, np.uint8)
        self.size = (len(self.raw) - 8) * 8
        self.pos = 0

    def window(self, at: np.ndarray) -> np.ndarray:
        """The bits from each place on, 25 at least, at the top of 32."""
        fours = np.ndarray((len(self.raw) - 3,), ">u4", self.raw, strides=(1,))
        return fours[at >> 3].astype(np.uint32) << (at & 7).astype(np.uint32)

    def take(self, n: int) -> int:
        if not n:
            return 0
        i, off = self.pos >> 3, self.pos & 7
        value = int.from_bytes(self.bytes[i : i + 4], "big") >> (32 - off - n) & ((1 << n) - 1)
        self.pos += n
        return value

    def symbol(self, codes: Codes) -> int:
        i, off = self.pos >> 3, self.pos & 7
        w = int.from_bytes(self.bytes[i : i + 3], "big") >> (8 - off) & 0xFFFF
        length = int(codes.length[w])
        if not length or self.pos + length > self.size:
            raise ValueError("no such code")
        self.pos += length
        return int(codes.symbol[w])

    def many(self, n: int) -> np.ndarray:
        """The next n bits, one a byte."""
        if self.pos + n > self.size:
            raise ValueError("a scan ends too early")
        first, last = self.pos >> 3, (self.pos + n + 7) >> 3
        bits = np.unpackbits(self.raw[first:last])[self.pos & 7 :][:n]
        self.pos += n
        return bits


def _extend(value: int, size: int) -> int:
    return value if value >> (size - 1) else value - (1 << size) + 1


class Picture:
    """A progressive JPEG's coefficients, in zigzag order, and what they give."""

    def __init__(self, data: bytes, most_pixels: int | None = None) -> None:
        self.most_blocks, self.most_pixels = 8 * len(data), most_pixels
        self.quants: dict[int, np.ndarray] = {}
        self.dc: dict[int, Codes] = {}
        self.ac: dict[int, Codes] = {}
        self.parts: list[Component] = []
        self.comment = b""
        self.restart = 0
        self._read(data)

    def _read(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
                at += 1
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("a marker is missing")
            mark = data[at + 1]
            at += 2
            if mark == 0xD9:
                if not self.parts:
                    raise ValueError("the file has no picture")
                return
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            at += size
            if mark == 0xDB:
                self._quants(body)
            elif mark == 0xC4:
                self._codes(body)
            elif mark == 0xC2:
                self._frame(body)
            elif mark in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only progressive Huffman-coded files are read")
            elif mark == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif mark == 0xFE:
                self.comment = body
            elif mark == 0xDA:
                end = at
                parts = []
                start = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise ValueError("a scan has no end")
                    follow = data[end + 1]
                    if follow == 0:
                        end += 2
                    elif 0xD0 <= follow <= 0xD7:
                        parts.append(data[start:end])
                        end += 2
                        start = end
                    elif follow == 0xFF:
                        end += 1
                    else:
                        break
                parts.append(data[start:end])
                at = end
                self._scan(body, parts)

    def _quants(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            size = 128 if wide else 64
            self.quants[name] = np.frombuffer(body[at + 1 : at + 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
            at += 1 + size

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, name = body[at] >> 4, body[at] & 15
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            (self.ac if kind else self.dc)[name] = _codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("only 8-bit samples are read")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        if not self.parts or not self.height or not self.width or any(not (1 <= p.h <= 4 and 1 <= p.v <= 4) for p in self.parts):
            raise ValueError("the picture has no size")
        if self.most_pixels is not None and self.height * self.width > self.most_pixels:
            raise ValueError(f"{self.width} x {self.height} pixels are more than {self.most_pixels}")
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        # Every block takes a bit at least.
        if self.wide * self.high * sum(p.h * p.v for p in self.parts) > self.most_blocks:
            raise ValueError("the file is too short for its picture")
        for p in self.parts:
            p.cols = -(-(-(-self.width * p.h // self.h)) // 8)
            p.rows = -(-(-(-self.height * p.v // self.v)) // 8)
            p.all_cols = self.wide * p.h
            p.blocks = np.zeros((self.high * p.v * p.all_cols, 64), np.int32)

    def _order(self, parts: list[Component]) -> list[tuple[int, np.ndarray]]:
        """The scan's blocks: for one component in rows, for several unit by unit (unit, in turn of its blocks)."""
        if len(parts) == 1:
            p = parts[0]
            return [(1, _row_order(p.rows, p.cols, p.all_cols))]
        return [(p.h * p.v, _unit_order(self.high, self.wide, p.h, p.v)) for p in parts]

    def _scan(self, body: bytes, pieces: list[bytes]) -> None:
        n = body[0]
        chosen = []
        for i in range(n):
            name, tables = body[1 + 2 * i], body[2 + 2 * i]
            chosen.append((next(p for p in self.parts if p.name == name), tables >> 4, tables & 15))
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        order = self._order([c[0] for c in chosen])
        units = len(order[0][1]) // order[0][0]
        step = self.restart or units
        for k, piece in enumerate(pieces):
            span = range(k * step, min(units, (k + 1) * step))
            if not len(span):
                break
            bits = Bits(piece)
            own = [(c, ids[span.start * per : span.stop * per], per) for c, (per, ids) in zip(chosen, order, strict=True)]
            if first == 0:
                (self._dc_more if high else self._dc)(bits, own, len(span), low)
            else:
                (p, _, table), ids, _ = own[0]
                (self._ac_more if high else self._ac)(bits, p.blocks, ids, self.ac[table], first, last, low)

    def _dc(self, bits: Bits, own: list, units: int, low: int) -> None:
        found: list[list[int]] = [[] for _ in own]
        said = [0] * len(own)
        turns = [(k, self.dc[c[1]]) for k, (c, _, per) in enumerate(own) for _ in range(per)]
        for _ in range(units):
            for k, codes in turns:
                size = bits.symbol(codes)
                if size:
                    said[k] += _extend(bits.take(size), size)
                found[k].append(said[k])
        for values, (c, ids, _) in zip(found, own, strict=True):
            c[0].blocks[ids, 0] = np.array(values, np.int32) << low

    def _dc_more(self, bits: Bits, own: list, units: int, low: int) -> None:
        every = sum(per for _, _, per in own)
        got = bits.many(units * every).reshape(units, every).astype(np.int32) << low
        at = 0
        for c, ids, per in own:
            c[0].blocks[ids, 0] |= got[:, at : at + per].reshape(-1)
            at += per

    def _ac(self, bits: Bits, blocks: np.ndarray, ids: np.ndarray, codes: Codes, first: int, last: int, low: int) -> None:
        band, b, run = last - first + 1, 0, 0
        while b < len(ids):
            if run:
                skip = min(run, len(ids) - b)
                run, b = run - skip, b + skip
                continue
            done = self._ac_even(bits, blocks, ids[b:], codes, first, band, low)
            if done:
                b += done
                continue
            k, own = first, blocks[ids[b]]
            while k <= last:
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    k += zeros
                    own[k] = _extend(bits.take(size), size) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break
            b += 1

    def _ac_even(self, bits: Bits, blocks: np.ndarray, ids: np.ndarray, codes: Codes, first: int, band: int, low: int) -> int:
        """Reads whole blocks while all codes are as long as the next one and skip nothing; how many."""
        w = int.from_bytes(bits.bytes[bits.pos >> 3 : (bits.pos >> 3) + 3], "big") >> (8 - (bits.pos & 7)) & 0xFFFF
        size, code = int(codes.symbol[w]), int(codes.length[w])
        if not code or size >> 4 or not size or code + size > 24:
            return 0
        every, key = code + size, code << 8 | size
        fit = min(len(ids), (bits.size - bits.pos) // (every * band))
        done = 0
        step = 64
        while done < fit:
            n = min(step, fit - done)
            at = bits.pos + np.arange(n * band) * every
            windows = bits.window(at)
            even = codes.key[windows >> np.uint32(16)] == key
            whole = n if even.all() else int(even.argmin()) // band
            if whole:
                value = ((windows[: whole * band] >> np.uint32(32 - every)) & np.uint32((1 << size) - 1)).astype(np.int32)
                value -= (value < 1 << (size - 1)) * np.int32((1 << size) - 1)
                part = ids[done : done + whole]
                blocks[part, first : first + band] = (value << low).reshape(whole, band)
                bits.pos += whole * band * every
                done += whole
            if whole < n:
                break
            step *= 8
        return done

    def _ac_more(self, bits: Bits, blocks: np.ndarray, ids: np.ndarray, codes: Codes, first: int, last: int, low: int) -> None:
        b, run, one = 0, 0, 1 << low
        while b < len(ids):
            if run:
                span = ids[b : b + run]
                band = blocks[span, first : last + 1]
                flat = band.reshape(-1)
                held = np.flatnonzero(flat)
                more = bits.many(len(held)).astype(np.int32) << low
                if len(held) == len(flat):
                    flat += np.where(flat < 0, -more, more)
                else:
                    flat[held] += np.where(flat[held] < 0, -more, more)
                blocks[span, first : last + 1] = flat.reshape(band.shape)
                b, run = b + len(span), run - len(span)
                continue
            own, k = blocks[ids[b]], first
            while k <= last:
                start = bits.pos
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    if k == first:
                        break
                    for j in range(k, last + 1):
                        if own[j] and bits.take(1):
                            own[j] += one if own[j] > 0 else -one
                    run -= 1
                    break
                new = (one if bits.take(1) else -one) if size else 0
                while k <= last:
                    if own[k]:
                        if bits.take(1):
                            own[k] += one if own[k] > 0 else -one
                    elif zeros:
                        zeros -= 1
                    else:
                        own[k] = new
                        k += 1
                        break
                    k += 1
                if bits.pos == start:
                    raise ValueError("a scan makes no progress")
            else:
                b += 1
                continue
            if not (run and k == first):
                b += 1

    def strips(self) -> Iterator[np.ndarray]:
        """RGB samples, height by width by 3, some rows of units at a time from the top."""
        some = max(1, STRIP_BLOCKS // max(1, sum(p.v * p.all_cols for p in self.parts)))
        for top in range(0, self.high, some):
            rows = min(some, self.high - top)
            full = []
            for p in self.parts:
                own = p.blocks[top * p.v * p.all_cols : (top + rows) * p.v * p.all_cols]
                pixels = np.floor(((own * self.quants[p.quant]) @ BASIS + (1 << (FIX - 1))) / (1 << FIX)) + 128
                plane = np.clip(pixels, 0, 255).astype(np.uint8).reshape(rows * p.v, p.all_cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * p.v * 8, -1)
                up = np.repeat(np.repeat(plane, self.v // p.v, axis=0), self.h // p.h, axis=1)
                full.append(up[: self.height - top * self.v * 8, : self.width].astype(np.int32))
            if len(full) == 1:
                yield np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
                continue
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            half = 1 << 15
            out = np.empty((*y.shape, 3), np.int32)
            out[:, :, 0] = y + ((91881 * cr + half) >> 16)
            out[:, :, 1] = y - ((22554 * cb + 46802 * cr + half) >> 16)
            out[:, :, 2] = y + ((116130 * cb + half) >> 16)
            yield np.clip(out, 0, 255).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        """The whole picture: height by width by 3 samples."""
        return np.concatenate(list(self.strips()))


# Encoder.

UNIT = 384
SIDE = 4095
LOW = 2
_BANDS = ((1, 5), (6, 63))


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def _packed(bits: np.ndarray) -> bytes:
    out = np.packbits(bits)
    if len(bits) % 8:
        out[-1] |= (1 << (8 - len(bits) % 8)) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, name: int, lengths: dict[int, int]) -> bytes:
    """A segment for codes of given lengths."""
    counts = bytes(sum(x == n for x in lengths.values()) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | name]) + counts + bytes(sorted(lengths, key=lambda s: (lengths[s], s))))


#: Differences of luma and chroma means have up to 11 bits; band values have 6; runs of blocks up to 14.
_DC_LENGTHS = dict.fromkeys(range(12), 4)
_TABLES = _table(0, 0, _DC_LENGTHS) + _table(1, 0, {8 - LOW: 1}) + _table(1, 1, dict.fromkeys(range(0, 0xF0, 0x10), 4))
_DIFFERENCE = {d: f"{abs(d).bit_length():04b}" + (f"{d if d > 0 else d + (1 << abs(d).bit_length()) - 1:0{abs(d).bit_length()}b}" if d else "") for d in range(-128, 129)}


def _scan_head(parts: list[int], table: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p, table]) for p in parts) + bytes([first, last, high << 4 | low]))


def _runs(n: int) -> list[int]:
    return [min(0x7FFF, n - i) for i in range(0, n, 0x7FFF)]


def encode_bytes(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload, in units of 384 bytes (filled up with 32)."""
    units = max(1, -(-len(payload) // UNIT))
    high = -(-units // SIDE)
    wide = -(-units // high)
    data = np.frombuffer(payload.ljust(wide * high * UNIT, b" "), np.uint8).reshape(high, wide, 6, 64)
    value = np.where(data >= 128, data, -128 - data.astype(np.int16)).astype(np.int16)
    size = 128 | (data & 127)
    luma = lambda x: x[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    parts = [(luma(value), luma(size)), *((value[:, :, c].reshape(-1, 64), size[:, :, c].reshape(-1, 64)) for c in (4, 5))]

    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, b"bytes=%d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, b"\x08" + (high * 16).to_bytes(2, "big") + (wide * 16).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0"))
    out.append(_TABLES)

    means = value[:, :, :, 0].reshape(-1, 6)
    top = means >> LOW
    steps = np.empty_like(top)
    steps[:, :4] = np.diff(top[:, :4].reshape(-1), prepend=0).reshape(-1, 4)
    steps[:, 4:] = np.diff(top[:, 4:], axis=0, prepend=0)
    word = "".join(map(_DIFFERENCE.__getitem__, steps.reshape(-1).tolist()))
    word += "1" * (-len(word) % 8)
    out.append(_scan_head([1, 2, 3], 0, 0, 0, 0, LOW) + int(word, 2).to_bytes(len(word) // 8, "big").replace(b"\xff", b"\xff\x00"))

    full = (1 << (8 - LOW)) - 1
    for p, (own, mag) in enumerate(parts):
        top = mag >> LOW
        code = np.where(own > 0, top, top ^ full).astype(np.uint8)
        for first, last in _BANDS:
            bits = np.unpackbits(code[:, first : last + 1].reshape(-1, 1), axis=1)[:, LOW - 1 :]
            out.append(_scan_head([p + 1], 0, first, last, 0, LOW) + _packed(bits.reshape(-1)))
    for low in range(LOW - 1, -1, -1):
        out.append(_scan_head([1, 2, 3], 0, 0, 0, low + 1, low) + _packed((means.reshape(-1) >> low & 1).astype(np.uint8)))
        for p, (_, mag) in enumerate(parts):
            bits, at = [], 0
            for run in _runs(len(mag)):
                r = run.bit_length() - 1
                head = f"{r:04b}" + (f"{run - (1 << r):0{r}b}" if r else "")
                bits += [np.frombuffer(head.encode(), np.uint8) - 48, (mag[at : at + run, 1:] >> low & 1).reshape(-1)]
                at += run
            out.append(_scan_head([p + 1], 1, 1, 63, low + 1, low) + _packed(np.concatenate(bits)))
    out.append(b"\xff\xd9")
    return b"".join(out)


def decode_bytes(picture: Picture) -> bytes:
    """The payload that ``encode_bytes`` stored."""
    luma, *chroma = (p.blocks for p in picture.parts)
    high, wide = picture.high, picture.wide
    value = np.concatenate([luma.reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64), *(c.reshape(-1, 1, 64) for c in chroma)], axis=1)
    data = np.where(value > 0, value, -128 - value).astype(np.uint8)
    return data.tobytes()[: int(picture.comment.removeprefix(b"bytes="))]
