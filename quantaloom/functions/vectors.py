"""Vectors held as ARRAY<FLOAT>; all arithmetic is done in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(c: Column) -> Column:
    return F.aggregate(as_double(c), F.lit(0.0), lambda acc, x: acc + x * x)


def sq_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x)


def length_or_one(c: Column) -> Column:
    return F.coalesce(F.nullif(F.sqrt(sq_norm(c)), F.lit(0.0)), F.lit(1.0))


def unit(c: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    norm = length_or_one(c)
    # repeat the norm instead of naming it inside the lambda, which would recompute it per component
    return F.zip_with(as_double(c), F.array_repeat(norm, F.size(c)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def scale(c: Column, factor: Column) -> Column:
    return F.transform(as_double(c), lambda x: x * factor)


def blend(cs: list[Column], text: Column, alpha: float, beta: float) -> Column:
    """``alpha`` times the mean of ``cs`` plus ``beta`` times ``text``; the weights must add up to one."""
    if abs(alpha + beta - 1.0) > 1e-8:
        raise ValueError(f"alpha + beta must be 1, got {alpha} + {beta}")
    total = as_double(cs[0])
    for c in cs[1:]:
        total = add(total, c)
    n = len(cs)
    same = F.size(cs[0]) == F.size(text)
    for c in cs[1:]:
        same = same & (F.size(c) == F.size(text))
    out = F.zip_with(total, as_double(text), lambda m, t: F.lit(float(alpha)) * (m / n) + F.lit(float(beta)) * t)
    return F.when(same, out).otherwise(F.raise_error(F.lit("vectors of different length cannot be blended")))


def subvector(c: Column, i: int, width: int) -> Column:
    """Part ``i`` (0-based) of a vector cut into parts of ``width``; a tail is dropped."""
    return F.slice(c, i * width + 1, width)


def zero_fill(c: Column, dim: int) -> Column:
    return F.coalesce(c, F.array_repeat(F.lit(0.0).cast("float"), dim))


def finite(c: Column) -> Column:
    """True when no component is NaN, infinite or null."""
    return ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
