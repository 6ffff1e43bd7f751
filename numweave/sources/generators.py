"""Generated vectors, matrices and graphs with known results, as tables made in parallel from ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.index import div
from ..operators.blocks import matmul
from ..operators.vector import transpose


def vector(spark: SparkSession, n: int, value) -> DataFrame:
    """(i, v) with v = value(i)."""
    return spark.range(n).select(F.col("id").alias("i"), value(F.col("id")).cast("double").alias("v"))


def matrix(spark: SparkSession, n: int, m: int, value) -> DataFrame:
    """(i, j, v), n by m, with v = value(i, j)."""
    rows = spark.range(n * m).select(div(F.col("id"), m).alias("i"), (F.col("id") % m).alias("j"))
    return rows.select("i", "j", value(F.col("i"), F.col("j")).cast("double").alias("v"))


def ramp(spark: SparkSession, n: int) -> DataFrame:
    return vector(spark, n, lambda i: i + 1)


def random_uniform(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.rand(seed).alias("v"))


def ramp_complex(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").cast("double").alias("re"), F.lit(1.0).alias("im"))


def rotated_lu_matrix(spark: SparkSession, n: int) -> DataFrame:
    """Factors L = 0.5 under the diagonal and U = 1, rows turned by one: pi(i) = (i + 1) mod n."""
    whole = lambda r, j: F.when(r <= j, 0.5 * r + 1).otherwise(0.5 * (j + 1))
    return matrix(spark, n, n, lambda i, j: whole(F.pmod(i - 1, F.lit(n)), j))


def jacobi_grid(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    return matrix(spark, n, n, lambda i, j: (i * (j + 2) + 2) / n), matrix(spark, n, n, lambda i, j: (i * (j + 3) + 3) / n)


def lu_spd_matrix(spark: SparkSession, n: int, block: int = 256) -> DataFrame:
    """T T' with T = 1 - j / n under and 1 on the diagonal: symmetric positive definite."""
    t = matrix(spark, n, n, lambda i, j: F.when(j < i, 1 - j / n).when(i == j, 1.0).otherwise(0.0)).where("v != 0")
    return matmul(t, transpose(t), block)


def part(of: Column, over: int) -> Column:
    return of % over / over


def kernel_inputs(spark: SparkSession, kernel: str, n: int) -> dict[str, DataFrame]:
    """Inputs of the matrix kernels for square size n. The formulas are fixed values."""
    m = lambda f: matrix(spark, n, n, f)
    v = lambda f: vector(spark, n, f)
    lower = lambda f: lambda i, j: F.when(j < i, f(i, j)).when(i == j, 1.0).otherwise(0.0)
    tables = {
        "correlation": lambda: {"x": m(lambda i, j: i * j / n + i + 1)},
        "covariance": lambda: {"x": m(lambda i, j: i * j / n)},
        "gemm": lambda: {"c": m(lambda i, j: part(i * j + 1, n)), "a": m(lambda i, j: part(i * (j + 1), n)), "b": m(lambda i, j: part(i * (j + 2), n))},
        "gemver": lambda: {"a": m(lambda i, j: part(i * j, n)), "u1": v(lambda i: i), **{c: v(lambda i, d=d: (i + 1) / n / d) for c, d in (("u2", 2), ("v1", 4), ("v2", 6), ("y", 8), ("z", 9))}},
        "gesummv": lambda: {"x": v(lambda i: part(i, n)), "a": m(lambda i, j: part(i * j + 1, n)), "b": m(lambda i, j: part(i * j + 2, n))},
        "symm": lambda: {"c": m(lambda i, j: (i + j) % 100 / n), "b": m(lambda i, j: (n + i - j) % 100 / n), "a": m(lambda i, j: (i + j) % 100 / n)},
        "syrk": lambda: {"a": m(lambda i, j: part(i * j + 1, n)), "c": m(lambda i, j: part(i * j + 2, n))},
        "syr2k": lambda: {"a": m(lambda i, j: part(i * j + 1, n)), "b": m(lambda i, j: part(i * j + 2, n)), "c": m(lambda i, j: part(i * j + 3, n))},
        "trmm": lambda: {"a": m(lower(lambda i, j: part(i + j, n))), "b": m(lambda i, j: part(n + i - j, n))},
        "2mm": lambda: {"a": m(lambda i, j: part(i * j + 1, n)), "b": m(lambda i, j: part(i * (j + 1), n)), "c": m(lambda i, j: part(i * (j + 3) + 1, n)), "d": m(lambda i, j: part(i * (j + 2), n))},
        "3mm": lambda: {"a": m(lambda i, j: part(i * j + 1, n) / 5), "b": m(lambda i, j: part(i * (j + 1) + 2, n) / 5), "c": m(lambda i, j: part(i * (j + 3), n) / 5), "d": m(lambda i, j: part(i * (j + 2) + 2, n) / 5)},
        "atax": lambda: {"x": v(lambda i: 1 + i / n), "a": m(lambda i, j: (i + j) % n / (5 * n))},
        "mvt": lambda: {"x1": v(lambda i: part(i, n)), "x2": v(lambda i: part(i + 1, n)), "y1": v(lambda i: part(i + 3, n)), "y2": v(lambda i: part(i + 4, n)), "a": m(lambda i, j: part(i * j, n))},
        "qr": lambda: {"a": m(lambda i, j: part(i * j, n) * 100 + 10)},
        "ludcmp": lambda: {"a": lu_spd_matrix(spark, n), "b": v(lambda i: (i + 1) / n / 2 + 4)},
        "trisolv": lambda: {"l": m(lambda i, j: F.when(j <= i, 2 * (i + n - j + 1) / n).otherwise(0.0)).where("v != 0"), "b": v(lambda i: i)},
        "toeplitz": lambda: {"r": vector(spark, n + 1, lambda i: F.when(i == 0, 1).otherwise(n + 2 - i))},
    }
    return tables[kernel]()
