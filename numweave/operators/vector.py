"""Vectors (i, v), complex vectors (i, re, im) and matrices (i, j, v) as tables: products, sums, norms, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero(x: Column | str) -> Column:
    return F.coalesce(x, F.lit(0.0))


def validate_vector(x: DataFrame, n: int) -> DataFrame:
    """The vector, or an error if a place is outside 0 .. n-1, twice there, or absent."""
    found = x.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    if tuple(found) != (n, n, 0 if n else None, n - 1 if n else None):
        raise ValueError(f"not a vector of length {n}: {found}")
    return x


def validate_square(a: DataFrame, n: int) -> DataFrame:
    """The matrix, or an error if an entry lies outside n by n."""
    if bad := a.where(f"i < 0 OR j < 0 OR i >= {n} OR j >= {n}").limit(1).collect():
        raise ValueError(f"outside {n} by {n}: {bad[0]}")
    return a


def joined(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], how: str = "full") -> DataFrame:
    """Rows of both by key; values of b get the suffix _b. Absent values are 0."""
    b = b.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values))
    return a.select(*keys, *values).join(b, keys, how).select(*keys, *(zero(c).alias(c) for v in values for c in (v, f"{v}_b")))


def inner_product(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the sum of products; 0 if nothing meets."""
    return joined(x, y, ["i"], ["v"], "inner").agg(zero(F.sum(F.col("v") * F.col("v_b"))).alias("value"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + alpha * x; an absent entry is 0."""
    return joined(x, y, ["i"], ["v"]).select("i", (F.col("v_b") + alpha * F.col("v")).alias("v"))


def scale(x: DataFrame, a: float) -> DataFrame:
    return x.withColumn("v", F.col("v") * a)


def total(x: DataFrame) -> DataFrame:
    """One row: the sum of the values of a vector or matrix."""
    return x.agg(zero(F.sum("v")).alias("value"))


def checksum_error(u: DataFrame, a: DataFrame) -> DataFrame:
    """One row: |sum of u - sum of A|; 0 for u = A * ones."""
    both = u.select("v", F.lit(1.0).alias("w")).union(a.select("v", F.lit(-1.0).alias("w")))
    return both.agg(F.abs(zero(F.sum(F.col("v") * F.col("w")))).alias("value"))


def frobenius_norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(zero(F.sum(F.col("v") * F.col("v")))).alias("value"))


def residual_norm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frobenius norm of a - b."""
    both = joined(a, b, ["i", "j"], ["v"])
    return frobenius_norm(both.select((F.col("v") - F.col("v_b")).alias("v")))


def max_abs_error(a: DataFrame, b: DataFrame, n: int | None = None) -> DataFrame:
    """Greatest |a - b| of vectors or matrices, real or complex; divided by n if given."""
    keys = [c for c in ("i", "j") if c in a.columns]
    values = ["re", "im"] if "re" in a.columns else ["v"]
    both = joined(a, b, keys, values)
    off = [F.col(v) - F.col(f"{v}_b") for v in values]
    error = F.hypot(*off) if len(off) == 2 else F.abs(off[0])
    return both.agg((zero(F.max(error)) / (n or 1)).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), *(c for c in a.columns if c not in ("i", "j")))


def outer_update(a: DataFrame, *pairs: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A + u1 v1' + u2 v2' ...: each entry of A fetches its factors by row and by column. A must hold every entry."""
    value = F.col("v")
    for k, (u, v) in enumerate(pairs):
        a = a.join(u.select("i", F.col("v").alias(f"u{k}")), "i", "left").join(v.select(F.col("i").alias("j"), F.col("v").alias(f"w{k}")), "j", "left")
        value = value + zero(f"u{k}") * zero(f"w{k}")
    return a.select("i", "j", value.alias("v"))
