"""Injected models: encoders as batched functions, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]


def hashed_terms(size: int = 64) -> Encode:
    """A stand-in for a text encoder: hashed term counts of length one."""

    def encode(texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for token in re.findall("[a-z0-9]+", text.lower()):
                out[i, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % size] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def encoded(df: DataFrame, text: str, load: Callable[[], Encode], into: str = "v", batch: int = 256) -> DataFrame:
    """With the vectors of a text column; ``load`` makes the encoder once a task; blank text gives null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t.strip()]
            for start in range(0, len(some), batch):
                own = some[start : start + batch]
                for i, v in zip(own, encode([texts[i] for i in own]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn(into, run(F.col(text)))


EncodeImages = Callable[[list[bytes]], np.ndarray]


def hashed_bytes(size: int = 64) -> EncodeImages:
    """A stand-in for an image encoder: byte counts of length one."""

    def encode(files: list[bytes]) -> np.ndarray:
        out = np.stack([np.bincount(np.frombuffer(f, np.uint8) % size, minlength=size) for f in files]).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def encoded_images(df: DataFrame, content: str, load: Callable[[], EncodeImages], into: str = "v", batch: int = 20) -> DataFrame:
    """With the vectors of a column of image files; an empty or null file gives null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            files = part.tolist()
            out: list = [None] * len(files)
            some = [i for i, f in enumerate(files) if f]
            for start in range(0, len(some), batch):
                own = some[start : start + batch]
                for i, v in zip(own, encode([files[i] for i in own]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn(into, run(F.col(content)))


def multimodal_features(items: DataFrame, images: DataFrame, load_text: Callable[[], Encode], load_image: Callable[[], EncodeImages]) -> DataFrame:
    """(item_id, text_vec, image_vec, v): vectors of items (item_id, text) with an image (item_id, content), and both in a row."""
    met = items.select("item_id", "text").join(images.select("item_id", "content"), "item_id")
    out = encoded_images(encoded(met, "text", load_text, "text_vec"), "content", load_image, "image_vec").drop("text", "content")
    return out.where("text_vec IS NOT NULL AND image_vec IS NOT NULL").withColumn("v", F.concat("text_vec", "image_vec"))


def answered(df: DataFrame, prompt: Column, load: Callable[[], Callable[[list[str]], list[str | None]]], fallback: Column, into: str) -> DataFrame:
    """With a language model's answers, or the fallback where there is none."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = load()
        for part in parts:
            yield pd.Series(ask(part.fillna("").tolist()))

    return df.withColumn(into, F.coalesce(run(prompt), fallback))


def attention_forward(query: np.ndarray, keys: np.ndarray, hidden: int = 16, seed: int = 42) -> np.ndarray:
    """Weights of keys for a query by a small untrained network over [key, query, product, difference]."""
    rng = np.random.default_rng(seed)
    q = np.broadcast_to(query, keys.shape)
    x = np.concatenate([keys, q, keys * q, keys - q], axis=1)
    h = np.maximum(x @ rng.normal(0, 0.1, (x.shape[1], hidden)), 0)
    z = h @ rng.normal(0, 0.1, (hidden, 1))
    e = np.exp(z - z.max())
    return (e / e.sum())[:, 0]
