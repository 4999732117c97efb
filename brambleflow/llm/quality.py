"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text.  The weights
maximise the likelihood of preference pairs, a document labelled good before one
labelled bad: logistic loss on feature differences, fitted by Newton's method
with a ridge.  The strength's quantile at the share of bad labels becomes the
threshold, and scores are logistic in the distance from it.

Training takes at most ``MAX_LABELLED`` labelled rows, those whose hashed ids are
smallest; features of these, not texts, reach the driver.  Everything else runs
over all documents.

Defined cases: a null or empty text has features of an empty document and a
score like any other; rows without doc_id are scored, and are not held out; rows
that repeat one are scored one by one; without labels of both kinds all scores
are 0.5; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .textblocks import blocks, word_bounds, word_hashes

MAX_LABELLED = 20_000
PAIRS = 60_000
RIDGE = 1e-3
FOLDS = 5
#: The score at the threshold.
CUT = 0.3

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+<=>@\\^_`~{}[]/",
}
#: Shares of a line's bytes or words that are also taken at their largest over a document's lines.
_LINE = ("upper", "bang", "bar", "mark", "again", "ends", "caps")
FEATURES = ["log_bytes", "log_lines", "word_bytes", "distinct", *(f"mean_{k}" for k in ("upper", "digit", "stop", "bang", "bar", "mark", "again", "ends", "caps")), *(f"top_{k}" for k in _LINE), "line_words", "far_again"]


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LUTS = {k: _lut(v) for k, v in _KINDS.items()}


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    first, last, bounds = word_bounds(data, offsets, "space")
    words = word_hashes(data, first, last)
    n_words = np.diff(bounds)

    # Lines: every text has one at least.
    breaks = np.flatnonzero(data == 0x0A)
    line_doc = np.concatenate([np.arange(n), np.searchsorted(offsets[1:], breaks, side="right")])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_doc))
    line_doc, line_start = line_doc[order], line_start[order]
    line_end = np.append(line_start[1:], len(data))
    line_end = np.maximum(np.minimum(line_end, offsets[line_doc + 1]), line_start)
    line_size = np.maximum(line_end - line_start, 1)
    line_words = np.searchsorted(first, line_end) - np.searchsorted(first, line_start)

    def bytes_in(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(_LUTS[kind][data]))
        return sums[b] - sums[a]

    def words_in(flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flag))
        return sums[np.searchsorted(first, b)] - sums[np.searchsorted(first, a)]

    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    far = np.zeros(len(words), bool)
    far[2:] = words[2:] == words[:-2]
    uppers = np.append(0, np.cumsum(_LUTS["upper"][data]))
    lowers = np.append(0, np.cumsum(_LUTS["lower"][data]))
    caps = (uppers[last] - uppers[first] >= 2) & (lowers[last] == lowers[first]) if len(first) else np.zeros(0, bool)
    odd = _LUTS["mark"] | _LUTS["bang"]
    ends = odd[data[last - 1]] if len(first) else np.zeros(0, bool)
    flags = {"again": again, "ends": ends, "caps": caps}

    def share(kind: str, a: np.ndarray, b: np.ndarray, whole_bytes: np.ndarray, whole_words: np.ndarray) -> np.ndarray:
        if kind in flags:
            return words_in(flags[kind], a, b) / np.maximum(whole_words, 1)
        return bytes_in(kind, a, b) / whole_bytes

    out = np.zeros((n, len(FEATURES)))
    put = {k: i for i, k in enumerate(FEATURES)}
    a, b = offsets[:-1], offsets[1:]
    out[:, put["log_bytes"]] = np.log1p(size)
    out[:, put["word_bytes"]] = np.minimum(size / np.maximum(n_words, 1), 60)
    rows = np.repeat(np.arange(n), n_words)
    order = np.lexsort((words, rows))
    fresh = np.ones(len(words), bool)
    if len(words) > 1:
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    out[:, put["distinct"]] = np.bincount(rows[order][fresh], minlength=n) / np.maximum(n_words, 1)
    for kind in ("upper", "digit", "stop", "bang", "bar", "mark", "again", "ends", "caps"):
        out[:, put[f"mean_{kind}"]] = share(kind, a, b, np.maximum(size, 1), n_words)
    out[:, put["far_again"]] = words_in(far, a, b) / np.maximum(n_words, 1)
    lines = np.bincount(line_doc, minlength=n)
    out[:, put["log_lines"]] = np.log1p(lines)
    out[:, put["line_words"]] = np.log1p(n_words / lines)
    heads = np.flatnonzero(np.diff(line_doc, prepend=-1))
    weigh = np.minimum(line_words / 6, 1)
    for kind in _LINE:
        out[:, put[f"top_{kind}"]] = np.maximum.reduceat(share(kind, line_start, line_end, line_size, line_words) * weigh, heads)
    return out


class Ranker(NamedTuple):
    """Weights over standardised features, and the strength that scores CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -500, 500)))


def fit_ranker(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> Ranker:
    """Bradley-Terry weights from preference pairs of good before bad rows."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), float(np.log(CUT / (1 - CUT))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        gradient = d.T @ (1 - p) / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    threshold = float(np.quantile(z @ w, len(bad) / (len(good) + len(bad))))
    return Ranker(mean, scale, w, threshold)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        x = text_features(data, offsets)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), flat, rows.column("quality")], names=["doc_id", "x", "quality"])


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """A ranker from labelled rows that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = own.select("doc_id", "text", "quality").mapInArrow(_feature_rows, "doc_id long, x array<double>, quality long").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist()) if len(found) else np.zeros((0, len(FEATURES)))
    return fit_ranker(x, found["quality"].to_numpy())


def _scored(ranker: Ranker):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "_text"):
            kept = [c for c in rows.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(ranker.score(text_features(data, offsets)))], names=[*kept, "score"])

    return run


def score_quality(docs: DataFrame, ranker: Ranker, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= CUT, else 0) of every document.

    ``keep`` names columns of the documents (doc_id, which is first, left out or
    not) that are returned too.
    """
    more = [c for c in keep or [] if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, text_of().alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")
    scored = rows.mapInArrow(_scored(ranker), schema)
    return scored.select("doc_id", *more, held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
