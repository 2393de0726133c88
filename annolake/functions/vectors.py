"""Arithmetic over arrays of numbers, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector shorter than this has no direction.
LEAST = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where the lengths differ."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda done, x: done + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a with length one; null for a vector without direction."""
    n = norm(a)
    return F.when(n >= LEAST, F.transform(a.cast("array<double>"), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a vector has no direction."""
    n = norm(a) * norm(b)
    return F.when((norm(a) >= LEAST) & (norm(b) >= LEAST), dot(a, b) / n)
