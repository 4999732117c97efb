"""Media columns: progressive JPEG files stored, read back and decoded.

``store_payloads`` puts bytes into progressive JPEG files (see ``jpeg``) and
``decode_media`` turns any column of such files into full-resolution RGB tensors.
``media_digests`` does both for the texts of documents and returns what
identifies payload, file and picture.

Defined cases: a null text is an empty one, whose payload is 192 bytes 32; rows
without doc_id and rows that repeat one are treated like all others; a null
medium gives a null tensor, one that isn't a progressive JPEG, is damaged or
declares more than ``most_pixels`` an error text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .jpeg import Picture, decode_bytes, encode_bytes
from .textblocks import blocks

UNIT = 192
#: Pixels above which decode_media doesn't decode: a tensor of 192 MB.
MOST_PIXELS = 1 << 26
TAIL = 16


def payload_of(text: bytes) -> bytes:
    """The bytes, filled up with spaces to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def picture_feature(picture: Picture) -> tuple[str, str]:
    """Size, mean and deviation of the channels, and the histogram of green in eight bins; the SHA-256 of the RGB tensor."""
    tensor = hashlib.sha256()
    n, total, squares, bins = 0, np.zeros(3), np.zeros(3), np.zeros(8, np.int64)
    for strip in picture.strips():
        flat = strip.reshape(-1, 3)
        tensor.update(np.ascontiguousarray(flat))
        n += len(flat)
        counts = np.stack([np.bincount(flat[:, c], minlength=256) for c in range(3)]).astype(np.float64)
        total += counts @ np.arange(256.0)
        squares += counts @ np.arange(256.0) ** 2
        bins += counts[1].astype(np.int64).reshape(8, 32).sum(axis=1)
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return f"{picture.width}x{picture.height};" + ",".join(f"{x:.3f}" for x in (*mean, *spread)) + ";" + ",".join(map(str, bins.tolist())), tensor.hexdigest()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "rgb_sha256": pa.string()}
    for rows, data, offsets in blocks(batches):
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            medium = encode_bytes(payload_of(data[a:b].tobytes()))
            picture = Picture(medium)
            back = decode_bytes(picture)
            out.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(medium), hashlib.sha256(medium).hexdigest(), *picture_feature(picture)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True))], names=["doc_id", *kinds])


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, rgb_sha256 (of the tensor)."""
    return keyed(docs).select("doc_id", "text").mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_sha256 string")


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        media = [encode_bytes(payload_of(data[a:b].tobytes())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's payload as a progressive JPEG file."""
    return keyed(docs).select("doc_id", "text").mapInArrow(_stored, "doc_id long, media binary")


def decode_media(media: DataFrame, key: str = "doc_id", column: str = "media", most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """key, height, width, rgb (row by row, three bytes a pixel) and error of a column of progressive JPEG files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height = width = rgb = error = None
                if (medium := batch.column(1)[i].as_py()) is not None:
                    try:
                        picture = Picture(medium, most_pixels)
                        height, width, rgb = picture.height, picture.width, picture.rgb().tobytes()
                    except Exception as said:  # noqa: BLE001 - whatever a damaged file leads to is its error text
                        error = f"{type(said).__name__}: {said}"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([rgb], pa.binary()), pa.array([error], pa.string())], names=[key, "height", "width", "rgb", "error"])

    own = media.select(F.col(key), F.col(column))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{key}` {kind}, height int, width int, rgb binary, error string")
