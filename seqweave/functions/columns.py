"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def circular_distance(a: Column, b: Column, length: Column) -> Column:
    """Distance between two positions of a circle, the short way round."""
    gap = F.abs(a - b)
    return F.least(gap, length - gap)


def significant(x: Column, digits: int = 3) -> Column:
    """``x`` with ``digits`` significant digits, never fewer than none after the point."""
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))).cast("int")
    scale = F.pow(F.lit(10.0), places)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale, 0) / scale)


def entropy_bits(p: Column, floor: float = 1e-12) -> Column:
    """Entropy in bits of an array of probabilities."""
    return -F.aggregate(
        p, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(floor)) * F.log2(F.greatest(x, F.lit(floor)))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cmh_terms(a: Column, row: Column, col: Column, n: Column) -> tuple[Column, Column]:
    """Observed minus expected, and variance, of one 2x2 stratum with n > 1."""
    a, row, col, n = (c.cast("double") for c in (a, row, col, n))
    return a - row * col / n, row * (n - row) * col * (n - col) / (n * n * (n - 1))
