"""Fourier transforms of complex vectors (i, re, im) whose length is a power of two."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import div

COLUMNS = "a long, b long, re double, im double"


def lengths(n: int) -> tuple[int, int]:
    """n = n1 * n2, as even as powers of two allow."""
    if n < 1 or n & (n - 1):
        raise ValueError(f"length {n} is not a power of two")
    n1 = 1 << ((n.bit_length() - 1) // 2)
    return n1, n // n1


def groups(batches: Iterator[pa.RecordBatch], size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys and values (complex, a group to a row) of a task; columns a (key), b (place), re, im."""
    held = [x for x in batches if len(x)]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    a, b, re, im = (table.column(c).to_numpy() for c in ("a", "b", "re", "im"))
    order = np.lexsort((b, a))
    return a[order].reshape(-1, size)[:, 0], (re + 1j * im)[order].reshape(-1, size)


def rows_of(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ravel(v)) for v in (a, b, x.real, x.imag)], names=["a", "b", "re", "im"])


def transform(x: DataFrame, n: int, sign: int, local_fft: Callable | None = None) -> DataFrame:
    """sum_j x_j exp(sign 2 pi i j k / n) in natural order; (i, re, im) must hold every place of 0 .. n-1 once.

    Four steps: with j = j1 n2 + j2 and k = k1 + n1 k2, transforms over j1 for each j2, a twist, and transforms over j2
    for each k1. Two shuffles; a task transforms all its groups as one matrix. ``local_fft`` takes a matrix and acts on
    its rows; without it numpy's is used.
    """
    n1, n2 = lengths(n)
    if x.agg(F.countDistinct("i"), F.count("*")).first() != (n, n) or x.where(f"i < 0 OR i >= {n}").limit(1).count():
        raise ValueError(f"the vector must hold each place of 0 .. {n - 1} once")
    forward = local_fft or (lambda m: np.fft.fft(m, axis=1))
    local = forward if sign < 0 else (lambda m: np.conj(forward(np.conj(m))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := groups(batches, n1)) is not None:
            j2, m = got
            k1 = np.arange(n1)
            m = local(m) * np.exp(sign * 2j * np.pi * (j2[:, None] * k1 % n) / n)
            yield rows_of(np.broadcast_to(k1, m.shape), np.broadcast_to(j2[:, None], m.shape), m)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := groups(batches, n2)) is not None:
            k1, m = got
            m = local(m)
            k = k1[:, None] + n1 * np.arange(n2)
            yield rows_of(k, np.zeros_like(k), m)

    dealt = x.select((F.col("i") % n2).alias("a"), div(F.col("i"), n2).alias("b"), "re", "im").repartition("a")
    out = dealt.mapInArrow(first, COLUMNS).repartition("a").mapInArrow(second, COLUMNS)
    return out.select(F.col("a").alias("i"), "re", "im")


def fft(x: DataFrame, n: int, local_fft: Callable | None = None) -> DataFrame:
    return transform(x, n, -1, local_fft)


def ifft(x: DataFrame, n: int, local_fft: Callable | None = None) -> DataFrame:
    """The inverse: the other sign, divided by n."""
    return transform(x, n, 1, local_fft).select("i", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im"))


def fft_grouped(x: DataFrame, key: str, local_fft: Callable | None = None) -> DataFrame:
    """One transform for each key of (key, i, re, im); a key's vector is short, its length any power of two."""
    forward = local_fft or (lambda m: np.fft.fft(m, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("a", "ascending"), ("b", "ascending")])
        a, re, im = (table.column(c).to_numpy() for c in ("a", "re", "im"))
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for s, e in zip(at, [*at[1:], len(a)]):
            lengths(int(e - s))
            yield rows_of(a[s:e], np.arange(e - s), forward((re[s:e] + 1j * im[s:e])[None])[0])

    return x.select(F.col(key).alias("a"), F.col("i").alias("b"), "re", "im").repartition("a").mapInArrow(run, COLUMNS).select(F.col("a").alias(key), F.col("b").alias("i"), "re", "im")
