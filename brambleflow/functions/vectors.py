"""Vector algebra over arrays; elements are doubles in all arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def divided(v: Column, n: Column) -> Column:
    """Elements by a number that is computed once a row, not once an element."""
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x / m)


def normalized(v: Column) -> Column:
    """Length one; a zero vector stays."""
    return bound(doubles(v), lambda w: F.when(norm(w) > 0, divided(w, norm(w))).otherwise(w))


def normalized_soft(v: Column, epsilon: float = 1e-8) -> Column:
    """Divided by its length plus epsilon."""
    return bound(doubles(v), lambda w: divided(w, norm(w) + F.lit(epsilon)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def scaled(v: Column, w: float | Column) -> Column:
    return F.transform(doubles(v), lambda x: x * w)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def blended(a: Column, b: Column, share: float) -> Column:
    """share of a and the rest of b; the one that is there where the other is null."""
    both = added(scaled(a, share), scaled(b, 1 - share))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), both), doubles(a), doubles(b))


def fused(text: Column, image: Column, alpha: float = 1.0, beta: float = 1.0, unit: bool = True) -> Column:
    """Weighted concatenation of both parts."""
    both = F.concat(scaled(normalized(text), alpha), scaled(normalized(image), beta))
    return normalized(both) if unit else both


def text_query_fused(text: Column, image_size: int) -> Column:
    return normalized(F.concat(doubles(text), F.array_repeat(F.lit(0.0), image_size)))


def summed(v: Column, size: int, weight: Column | None = None) -> Column:
    """Aggregate: the (weighted) element-wise sum."""
    return F.array(*(F.sum(v[i].cast("double") * weight if weight is not None else v[i].cast("double")) for i in range(size)))


def averaged(v: Column, size: int) -> Column:
    """Aggregate: the element-wise mean."""
    return F.array(*(F.avg(v[i].cast("double")) for i in range(size)))


def rounded(v: Column, digits: int = 6) -> Column:
    """Rounded elements, minus zero as zero."""
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))


def close(a: Column, b: Column) -> Column:
    """All elements within 1e-8 plus 1e-5 of the second's size."""
    return F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(y)), lambda x: x)
