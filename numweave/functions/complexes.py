"""Complex numbers as pairs of double columns (real, imaginary)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Pair, b: Pair) -> Pair:
    return a[0] - b[0], a[1] - b[1]


def multiply(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: Pair) -> Pair:
    return a[0], -a[1]


def unit(angle: Column) -> Pair:
    """exp(i * angle)."""
    return F.cos(angle), F.sin(angle)


def modulus(a: Pair) -> Column:
    return F.hypot(*a)
