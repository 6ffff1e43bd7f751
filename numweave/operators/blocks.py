"""Dense matrices as triples (i, j, v), multiplied by square blocks; the matrix-matrix and matrix-vector kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import div
from ..storage import stored
from .sparse import spmv
from .vector import axpy, outer_update, scale, transpose

#: Side of a block: 512 KB of doubles.
BLOCK = 256
#: Side of the tiles in which entries travel and are added up: 8 MB of doubles, or one block where that is larger.
TILE = 1024
#: Entries that a task packs at a time.
PACKED = 1 << 20
#: Bytes of the part of a product that a task sums up.
HELD = 64 << 20
#: Products' parts at least, where there are blocks for them.
PARTS = 16
#: Blocks on the inner index that are multiplied at a time.
DEEP = 8

BLOCKS = "bi long, bj long, data binary"
CELLS = "i long, j long, v double"


def packed_cells(a: DataFrame, tile: int) -> DataFrame:
    """(ti, tj, at, k, v): entries packed by their tile, places in it as 32-bit integers and values as doubles; at is null.
    Entries whose place is null are left out, null values are 0."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        i, j = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("i", "j"))
        v = np.concatenate([x.column("v").to_numpy(zero_copy_only=False) for x in held])
        ti, tj = i // tile, j // tile
        code = ti * (int(tj.max()) + 1) + tj
        order = np.argsort(code.astype(np.uint16) if 0 <= code.min() and code.max() < 1 << 16 else code, kind="stable")
        code, k, v = code[order], ((i % tile) * tile + j % tile).astype(np.int32)[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(first[1:], len(code))
        data = [pa.array([x[s:e].tobytes() for s, e in zip(first, ends)], pa.binary()) for x in (k, v)]
        return pa.RecordBatch.from_arrays([pa.array(ti[order[first]]), pa.array(tj[order[first]]), pa.nulls(len(first), pa.int32()), *data], names=["ti", "tj", "at", "k", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= PACKED:
                yield pack(held)
                held, count = [], 0
        if count:
            yield pack(held)

    cells = a.where("i IS NOT NULL AND j IS NOT NULL").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    return cells.mapInArrow(run, "ti long, tj long, at int, k binary, v binary")


def gathered(rows: DataFrame, block: int, tile: int, as_cells: bool) -> DataFrame:
    """Packed entries and whole blocks (at is the block's number in its tile) of one tile added up, in one shuffle; a task
    holds a tile at a time. ``as_cells``: triples, of the packed entries and of what is not 0 in a block; otherwise blocks
    that hold such an entry."""
    side = tile // block

    def told(key: tuple[int, int], x: np.ndarray, there: np.ndarray) -> Iterator[pa.RecordBatch]:
        for r in range(side):
            strip, some = x[r * block : (r + 1) * block], there[r * block : (r + 1) * block]
            if as_cells:
                i, j = np.nonzero(some)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(key[0] * tile + r * block + i), pa.array(key[1] * tile + j), pa.array(strip[i, j])], names=["i", "j", "v"])
            else:
                full = np.flatnonzero(some.reshape(block, side, block).any(axis=(0, 2)))
                if len(full):
                    yield block_rows({(key[0] * side + r, key[1] * side + int(c)): strip[:, c * block : (c + 1) * block] for c in full})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, there = None, np.zeros((tile, tile)), np.zeros((tile, tile), bool)
        for batch in batches:
            for ti, tj, at, k, v in zip(*(c.to_pylist() for c in batch.select(["ti", "tj", "at"]).columns), batch.column("k"), batch.column("v")):
                if now != (ti, tj):
                    if now:
                        yield from told(now, x, there)
                        x.fill(0)
                        there.fill(False)
                    now = (ti, tj)
                values = np.frombuffer(v.as_buffer())
                if at is None:
                    places = np.frombuffer(k.as_buffer(), np.int32)
                    np.add.at(x.reshape(-1), places, values)
                    there.reshape(-1)[places] = True
                else:
                    r, c = at // side * block, at % side * block
                    values = values.reshape(block, block)
                    x[r : r + block, c : c + block] += values
                    there[r : r + block, c : c + block] |= values != 0
        if now:
            yield from told(now, x, there)

    return rows.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(add, CELLS if as_cells else BLOCKS)


def tile_of(block: int) -> int:
    return max(1, TILE // block) * block


def to_blocks(a: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bi, bj, data): square blocks, row-major doubles; absent entries are 0, duplicates add up. Entries are packed before
    the one shuffle; a block is one row after it."""
    return gathered(packed_cells(a, tile_of(block)), block, tile_of(block), False)


def merged(products: list[DataFrame], factor: float, c: DataFrame, block: int = BLOCK) -> DataFrame:
    """The sum of block tables and factor times C, as triples: the entries of C, and those that are not 0 in a block."""
    tile = tile_of(block)
    side, rows = tile // block, packed_cells(c.select("i", "j", (F.col("v") * float(factor)).alias("v")), tile)
    for x in products:
        at = ((F.col("bi") % side) * side + F.col("bj") % side).cast("int")
        rows = rows.union(x.select(div(F.col("bi"), side), div(F.col("bj"), side), at, F.lit(None).cast("binary"), "data"))
    return gathered(rows, block, tile, True)


def from_blocks(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Triples of the entries that are not 0."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, data in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data)
                k = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(bi * block + k // block), pa.array(bj * block + k % block), pa.array(x[k])], names=["i", "j", "v"])

    return blocks.select("bi", "bj", "data").mapInArrow(cells, CELLS)


def flipped(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """The transpose of a block table."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([np.frombuffer(x.as_buffer()).reshape(block, block).T.tobytes() for x in batch.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("bj"), batch.column("bi"), data], names=["bi", "bj", "data"])

    return blocks.select("bi", "bj", "data").mapInArrow(turn, BLOCKS)


def block_rows(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """Blocks by their place as rows; the dictionary is emptied."""
    keys, data = list(held), [x.tobytes() for x in held.values()]
    held.clear()
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(data, pa.binary())], names=["bi", "bj", "data"])


def span(count: int, most: int) -> int:
    """Blocks of a part's side, where count of them stand in a row: as even as can be, most at most, and several parts."""
    return -(-count // max(-(-count // most), min(count, math.isqrt(PARTS))))


def block_product(a: DataFrame, b: DataFrame, block: int = BLOCK, factor: float = 1.0, lower: bool = False) -> DataFrame:
    """factor A B of block tables, which are read several times and so should be stored. ``lower``: only the parts of the
    product that hold entries on or under the diagonal.

    The product is cut into square parts of 64 MB at most. A task gets the rows of A and the columns of B that its part
    needs, sorted by the inner index, and adds up their products as they stream by; so what is sent is A and B once for
    each row or column of parts, and no product leaves a task before it is summed. Blocks are sent only to the parts where
    the inner index has a partner. Where parts are few, or the inner index is far longer than they, it is cut too, and
    the sums of its pieces are added.
    """
    ends = [x.agg(F.max(c), F.min(k), F.max(k)).first() for x, c, k in ((a, "bi", "bj"), (b, "bj", "bi"))]
    if any(x[0] is None for x in ends):
        return a.select("bi", "bj", "data").limit(0)
    start, last = max(x[1] for x in ends), min(x[2] for x in ends)
    rows, columns, inner = ends[0][0] + 1, ends[1][0] + 1, max(1, last - start + 1)
    most = max(1, math.isqrt(HELD // 8) // block)
    high, wide = span(rows, most), span(columns, most)
    across = -(-columns // wide)
    parts = -(-rows // high) * across
    pieces = max(1, min(inner, PARTS // parts), inner // (8 * max(high, wide)))
    deep = -(-inner // pieces)
    up, left = div(F.col("bi"), high), div(F.col("bj"), wide)
    of_a = a.groupBy(up.alias("up")).agg(F.min("bj").alias("lo"), F.max("bj").alias("hi"))
    of_b = b.groupBy(left.alias("left")).agg(F.min("bi").alias("lo"), F.max("bi").alias("hi"))
    x = a.select(up.alias("up"), F.col("bj").alias("bk"), F.col("bi").alias("place"), F.lit(0).alias("right"), "data")
    y = b.select(left.alias("left"), F.col("bi").alias("bk"), F.col("bj").alias("place"), F.lit(1).alias("right"), "data")
    met = F.col("bk").between(F.col("lo"), F.col("hi"))
    names = ["up", "left", "bk", "right", "place", "data"]
    sent = x.join(F.broadcast(of_b), met).select(*names).union(y.join(F.broadcast(of_a), met).select(*names))
    if lower:
        sent = sent.where((F.col("up") + 1) * (high * block) > F.col("left") * (wide * block))
    key = (F.col("up") * across + F.col("left")) * pieces + div(F.col("bk") - start, deep)
    sent = sent.where(F.col("bk").between(start, last)).select(key.alias("key"), "bk", "right", "place", "data")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, panels, met = None, np.zeros((high * block, wide * block)), {}, [high, 0, wide, 0]

        def added() -> None:
            full = [p for p in panels.values() if p[0] and p[1]]
            panels.clear()
            if not full:
                return
            (r0, r1), (c0, c1) = ((min(min(p[s]) for p in full), max(max(p[s]) for p in full) + 1) for s in (0, 1))
            x, y = np.zeros(((r1 - r0) * block, len(full) * block)), np.zeros((len(full) * block, (c1 - c0) * block))
            for k, (ours, theirs) in enumerate(full):
                at = slice(k * block, (k + 1) * block)
                for r, data in ours.items():
                    x[(r - r0) * block : (r - r0 + 1) * block, at] = np.frombuffer(data).reshape(block, block)
                for c, data in theirs.items():
                    y[at, (c - c0) * block : (c - c0 + 1) * block] = np.frombuffer(data).reshape(block, block)
            total[r0 * block : r1 * block, c0 * block : c1 * block] += x @ y
            met[:] = min(met[0], r0), max(met[1], r1), min(met[2], c0), max(met[3], c1)

        def done() -> Iterator[pa.RecordBatch]:
            added()
            r0, r1, c0, c1 = met
            up, left = divmod(key // pieces, across)
            for r in range(r0, r1):
                strip = total[r * block : (r + 1) * block, c0 * block : c1 * block]
                whole = {(up * high + r, left * wide + c): strip[:, (c - c0) * block : (c - c0 + 1) * block] for c in range(c0, c1)}
                some = {at: x * factor for at, x in whole.items() if x.any()}
                if some:
                    yield block_rows(some)
            total.fill(0)
            met[:] = high, 0, wide, 0

        for batch in batches:
            for now, bk, right, place, data in zip(*(c.to_pylist() for c in batch.select(["key", "bk", "right", "place"]).columns), batch.column("data")):
                if now != key:
                    if key is not None:
                        yield from done()
                    key = now
                if bk not in panels:
                    if len(panels) == DEEP:
                        added()
                    panels[bk] = ({}, {})
                panels[bk][right][place % (wide if right else high)] = data.as_py()
        if key is not None:
            yield from done()

    dealt = min(parts * pieces, 4096)
    out = sent.repartitionById(dealt, (F.col("key") % dealt).cast("int")).sortWithinPartitions("key", "bk").mapInArrow(multiply, BLOCKS)
    return block_sum(out) if pieces > 1 else out


def block_sum(blocks: DataFrame) -> DataFrame:
    """Blocks of one place added up. They come sorted by place, so a task holds one sum at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bi, bj, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (bi, bj) in held:
                    held[bi, bj] = held[bi, bj] + np.frombuffer(data)
                    continue
                if held:
                    yield block_rows(held)
                held[bi, bj] = np.frombuffer(data)
        if held:
            yield block_rows(held)

    return blocks.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(add, BLOCKS)


def blocked(a: DataFrame, block: int) -> DataFrame:
    return stored(to_blocks(a, block), "blocks")


def matmul(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """A B as triples, multiplied by blocks."""
    return from_blocks(block_product(blocked(a, block), blocked(b, block), block), block)


def combine(*terms: tuple[float, DataFrame]) -> DataFrame:
    """Sum of multiples of matrices or vectors, as triples or pairs."""
    first = terms[0][1]
    keys = [c for c in ("i", "j") if c in first.columns]
    out = None
    for factor, x in terms:
        part = x.select(*keys, (F.col("v") * float(factor)).alias("v"))
        out = part if out is None else out.union(part)
    return out.groupBy(*keys).agg(F.sum("v").alias("v"))


def gemm(alpha: float, a: DataFrame, b: DataFrame, beta: float, c: DataFrame, block: int = BLOCK) -> DataFrame:
    """alpha A B + beta C."""
    return merged([block_product(blocked(a, block), blocked(b, block), block, alpha)], beta, c, block)


def two_mm(alpha: float, a: DataFrame, b: DataFrame, c: DataFrame, beta: float, d: DataFrame, block: int = BLOCK) -> DataFrame:
    """alpha A B C + beta D."""
    first = stored(block_product(blocked(a, block), blocked(b, block), block), "product")
    return merged([block_product(first, blocked(c, block), block, alpha)], beta, d, block)


def three_mm(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, block: int = BLOCK) -> DataFrame:
    """(A B)(C D)."""
    first, second = (stored(block_product(blocked(x, block), blocked(y, block), block), "product") for x, y in ((a, b), (c, d)))
    return from_blocks(block_product(first, second, block), block)


def mirrored(a: DataFrame) -> DataFrame:
    """The symmetric matrix of which a holds the upper triangle."""
    upper = a.where("i <= j").select("i", "j", "v")
    return upper.union(transpose(upper.where("i < j")))


def symm(alpha: float, a: DataFrame, b: DataFrame, beta: float, c: DataFrame, block: int = BLOCK) -> DataFrame:
    """alpha A B + beta C with A symmetric, given by its upper triangle."""
    return gemm(alpha, mirrored(a), b, beta, c, block)


def syrk(alpha: float, a: DataFrame, beta: float, c: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lower triangle of alpha A A' + beta C."""
    a = blocked(a, block)
    return merged([block_product(a, flipped(a, block), block, alpha, lower=True)], beta, c.where("i >= j"), block).where("i >= j")


def syr2k(alpha: float, a: DataFrame, b: DataFrame, beta: float, c: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lower triangle of alpha (A B' + B A') + beta C."""
    product = stored(block_product(blocked(a, block), blocked(transpose(b), block), block, alpha), "product")
    return merged([product.where("bi >= bj"), flipped(product.where("bi <= bj"), block)], beta, c.where("i >= j"), block).where("i >= j")


def trmm(alpha: float, a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """alpha A' B with A unit lower: entries over the diagonal are ignored, the diagonal counts as 1."""
    product = block_product(blocked(transpose(a.where("i > j")), block), blocked(b, block), block, alpha)
    return merged([product], alpha, b, block)


def atax(a: DataFrame, x: DataFrame) -> DataFrame:
    """A' (A x)."""
    return spmv(transpose(a), spmv(a, x))


def mvt(a: DataFrame, x1: DataFrame, y1: DataFrame, x2: DataFrame, y2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x1 + A y1, x2 + A' y2)."""
    return axpy(1.0, spmv(a, y1), x1), axpy(1.0, spmv(transpose(a), y2), x2)


def gesummv(alpha: float, a: DataFrame, beta: float, b: DataFrame, x: DataFrame) -> DataFrame:
    """alpha A x + beta B x."""
    return combine((alpha, spmv(a, x)), (beta, spmv(b, x)))


def gemver(alpha: float, beta: float, a: DataFrame, u1: DataFrame, v1: DataFrame, u2: DataFrame, v2: DataFrame, y: DataFrame, z: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(A + u1 v1' + u2 v2' = B, x = beta B' y + z, w = alpha B x)."""
    b = outer_update(a, (u1, v1), (u2, v2))
    x = axpy(beta, spmv(transpose(b), y), z)
    return b, x, scale(spmv(b, x), alpha)
