"""Columns for places and parts: cyclic, block and group-cyclic ownership, radix buckets, bit reversal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def cyclic_part(i: Column, p: int) -> Column:
    return F.pmod(i, F.lit(p))


def local_index(i: Column, p: int) -> Column:
    return div(i, p)


def global_index(local: Column, p: int, part: Column) -> Column:
    return local * p + part


def n_local(p: int, part: Column, n: int) -> Column:
    """Entries of a part in the cyclic distribution of n."""
    return div(F.lit(n + p - 1) - part, p)


def block_part(i: Column, p: int, n: int) -> Column:
    """Part in the block distribution: the first n % p parts take one entry more."""
    small, more = divmod(n, p)
    edge = more * (small + 1)
    return F.when(i < edge, div(i, small + 1)).otherwise(more + div(i - edge, max(small, 1)))


def block_start(part: Column, p: int, n: int) -> Column:
    """First entry of a part in the block distribution."""
    small, more = divmod(n, p)
    return part * small + F.least(part, F.lit(more))


def grid_shape(p: int) -> tuple[int, int]:
    """(M, N) with M the largest proper divisor of p, and 1 for p = 1."""
    least = next((d for d in range(2, int(p**0.5) + 1) if p % d == 0), p)
    return (1, 1) if p == 1 else (p // least, least)


def cyclic_part_2d(i: Column, j: Column, shape: tuple[int, int]) -> tuple[Column, Column]:
    return F.pmod(i, F.lit(shape[0])), F.pmod(j, F.lit(shape[1]))


def group_cyclic(j: Column, c: int, p: int, n: int) -> tuple[Column, Column]:
    """(part, local place) in the group-cyclic distribution with cycle c: 1 is block, p is cyclic."""
    span = c * n // p
    return div(j, span) * c + j % c, div(j % span, c)


def default_radix(n: int) -> int:
    """The smallest power of two whose square is n or more."""
    radix = 1
    while radix * radix < n:
        radix *= 2
    return radix


def bucket_key(i: Column, radix: int, digit: str) -> Column:
    """High ('div') or low ('mod') digit of i."""
    return div(i, radix) if digit == "div" else i % radix


def bit_reverse(i: Column, m: int) -> Column:
    """i with its m low bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(i), m, "0")), 2, 10).cast("long")
