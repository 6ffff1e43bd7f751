"""Two-dimensional Jacobi sweeps on a grid of triples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .blocks import to_blocks


def interior(n: int) -> str:
    return f"i BETWEEN 1 AND {n - 2} AND j BETWEEN 1 AND {n - 2}"


def sweep_cells(source: DataFrame, target: DataFrame, n: int) -> DataFrame:
    """Target with its interior replaced by 0.2 * (cell + 4 neighbours) of the source; each source cell goes to five
    places, sums are combined map-side."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))))
    sent = source.select("i", "j", "v", F.inline(steps)).select((F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"), "v").where(interior(n))
    inside = sent.groupBy("i", "j").agg((F.sum("v") * 0.2).alias("v"))
    return inside.union(target.where(f"NOT ({interior(n)})").select("i", "j", "v"))


def jacobi_cells(a: DataFrame, b: DataFrame, n: int, steps: int) -> DataFrame:
    """A after ``steps`` double sweeps, cell by cell: for small grids and as a plain statement of the rule."""
    for _ in range(steps):
        b = sweep_cells(a, b, n)
        a = stored(sweep_cells(b, a, n), "grid")
    return a.select("i", "j", "v")


def jacobi2d(a: DataFrame, b: DataFrame, n: int, steps: int, tile: int = 256, depth: int = 16) -> DataFrame:
    """A after ``steps`` times: B's interior from A, then A's interior from B; both borders keep their first values.

    Tiles of A and B travel with a margin: in each round every tile sends strips ``depth`` wide to its eight neighbours
    (one shuffle), then runs depth half-sweeps on the widened tile, of which the middle stays right. Rounds are written
    to the shared folder. Memory of a task is a few widened tiles at a time.
    """
    depth = max(2, min(depth, tile) // 2 * 2)
    pair = to_blocks(a, tile).withColumnRenamed("data", "a").join(to_blocks(b, tile).withColumnRenamed("data", "b"), ["bi", "bj"], "full")
    last = (n - 1) // tile
    zeros = bytes(8 * tile * tile)
    state = stored(pair.select("bi", "bj", F.coalesce("a", F.lit(zeros)).alias("a"), F.coalesce("b", F.lit(zeros)).alias("b")), "tiles")
    left = 2 * steps
    while left:
        half = min(depth, left)
        state = stored(superstep(state, n, tile, half, last), "tiles")
        left -= half

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "a"))):
                rows, cols = min(tile, n - bi * tile), min(tile, n - bj * tile)
                x = np.frombuffer(data).reshape(tile, tile)[:rows, :cols]
                i, j = np.indices(x.shape)
                yield pa.RecordBatch.from_arrays([pa.array((i + bi * tile).ravel()), pa.array((j + bj * tile).ravel()), pa.array(x.ravel())], names=["i", "j", "v"])

    return state.mapInArrow(cells, "i long, j long, v double")


def superstep(state: DataFrame, n: int, tile: int, half: int, last: int) -> DataFrame:
    """``half`` half-sweeps (an even number) of every tile."""

    def margin(k: int) -> slice:
        """What a neighbour at offset k needs of a tile: its near edge."""
        return slice(tile - half, tile) if k > 0 else slice(0, half) if k < 0 else slice(0, tile)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, a, b in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "a", "b"))):
                x, y = (np.frombuffer(d).reshape(tile, tile) for d in (a, b))
                rows = [
                    (bi + p, bj + q, -p, -q, np.stack([x[margin(p), margin(q)], y[margin(p), margin(q)]]).tobytes())
                    for p in (-1, 0, 1)
                    for q in (-1, 0, 1)
                    if 0 <= bi + p <= last and 0 <= bj + q <= last
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["bi", "bj", "p", "q", "data"])

    def size(k: int) -> int:
        return half if k else tile

    def place(k: int) -> slice:
        return slice(0, half) if k < 0 else slice(half + tile, 2 * half + tile) if k > 0 else slice(half, half + tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bi, bj, p, q, data in zip(*(c.to_pylist() for c in batch.columns)):
                wide = held.setdefault((bi, bj), np.zeros((2, tile + 2 * half, tile + 2 * half)))
                wide[:, place(p), place(q)] = np.frombuffer(data).reshape(2, size(p), size(q))
        while held:
            (bi, bj), (x, y) = held.popitem()
            i = np.arange(-half, tile + half) + bi * tile
            j = np.arange(-half, tile + half) + bj * tile
            free = ((i > 0) & (i < n - 1))[1:-1, None] & ((j > 0) & (j < n - 1))[None, 1:-1]
            for k in range(half):
                old, new = (x, y) if k % 2 == 0 else (y, x)
                mean = 0.2 * (old[1:-1, 1:-1] + old[1:-1, :-2] + old[1:-1, 2:] + old[2:, 1:-1] + old[:-2, 1:-1])
                new[1:-1, 1:-1] = np.where(free, mean, new[1:-1, 1:-1])
            own = slice(half, half + tile)
            yield pa.RecordBatch.from_arrays([pa.array([bi]), pa.array([bj]), pa.array([x[own, own].tobytes()], pa.binary()), pa.array([y[own, own].tobytes()], pa.binary())], names=["bi", "bj", "a", "b"])

    strips = state.mapInArrow(send, "bi long, bj long, p int, q int, data binary")
    return strips.repartition("bi", "bj").mapInArrow(run, "bi long, bj long, a binary, b binary")
