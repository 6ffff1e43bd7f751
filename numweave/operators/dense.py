"""Dense factorisations: LU by rows with a reduction tree for the pivots, Cholesky by tiles, triangular and general solves by
inverting blocks, tall QR.

LU holds a row of doubles for each index. A stage works on a panel of columns. Its pivots come from a tree over tasks;
the pivot rows, at most ``PANEL_MB`` of them, are what is broadcast, and every other row is changed where it lies. What
is finished is written once. Cholesky and the triangular solves hold square blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import div
from ..storage import discard, shared_dir, stored, written
from .blocks import BLOCKS, block_product, block_rows, blocked, from_blocks, matmul, merged, to_blocks
from .vector import frobenius_norm, transpose

EPS = 1e-15
PANEL_MB = 64
ROWS = "pos long, i long, row binary"
HALVES = "i long, head binary, rest binary"
#: Tasks whose best rows meet in one task of the next round of a pivot tree.
ARITY = 4


def panel_width(n: int, block: int) -> int:
    return max(1, min(block, PANEL_MB * (1 << 20) // (8 * max(1, n))))


def slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose rows of n doubles take 32 MB at most, or one row."""
    most = max(1, (32 << 20) // (8 * max(1, n)))
    for batch in batches:
        for k in range(0, len(batch), most):
            yield batch.slice(k, most)


def packed(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), n)


def to_rows(a: DataFrame, n: int) -> DataFrame:
    """(pos, i, row): n doubles for each row that holds an entry; duplicates add up."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            cells = batch.column("x")
            flat, row = cells.flatten(), np.repeat(np.arange(len(batch)), cells.value_lengths().to_numpy())
            x = np.zeros((len(batch), n))
            np.add.at(x, (row, flat.field("j").to_numpy()), flat.field("v").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("i"), packed(x)], names=["pos", "i", "row"])

    return a.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("x")).mapInArrow(fill, ROWS)


def from_rows(rows: DataFrame, n: int, index: str = "pos") -> DataFrame:
    """Triples of the entries that are not 0."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            x = unpacked(batch.column("row"), n)
            i, j = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(index).to_numpy()[i]), pa.array(j), pa.array(x[i, j])], names=["i", "j", "v"])

    return rows.mapInArrow(cells, "i long, j long, v double")


def full_rows(a: DataFrame, n: int, columns: int | None = None) -> DataFrame:
    """Rows 0 .. n-1 of n or so many columns, those without entries as zeros."""
    zeros = a.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v"))
    return to_rows(a.select("i", "j", "v").union(zeros), columns or n)


def cells_of(pieces: DataFrame) -> DataFrame:
    """Triples of the entries of pieces that are not 0."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, row in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(row)
                j = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(first + j), pa.array(x[j])], names=["i", "j", "v"])

    return pieces.select("i", "first", "row").mapInArrow(cells, "i long, j long, v double")


def pivoted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, factors) of elimination with partial pivoting over the columns of x: which row comes to each place, of equals
    the first, and L below and U on and over the diagonal. A column without a pivot over EPS is left as it is."""
    x, order = x.copy(), np.arange(len(x))
    for k in range(min(x.shape)):
        r = k + int(np.argmax(np.abs(x[k:, k])))
        if r != k:
            x[[k, r]], order[[k, r]] = x[[r, k]], order[[r, k]]
        if abs(x[k, k]) > EPS:
            x[k + 1 :, k] /= x[k, k]
            x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
    return order, x


def pivot_rows(rows: DataFrame, w: int, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The w pivot rows (their i, in order) of a panel, rows (i, head) with w doubles each, and the factors of their corner.

    Without ``places`` by a tree: each task eliminates its own rows and keeps its w pivots, ARITY tasks' pivots meet in
    one task of the next round, and so on; the last one's are the panel's. With ``places`` (the present place of each i)
    one task eliminates the whole panel, whose size is bounded, as partial pivoting has it.
    """
    schema = "g int, i long, head binary"
    told = rows.sparkSession.sparkContext.broadcast(places)

    def own(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        held = [x for x in batches if len(x)]
        i = np.concatenate([x.column("i").to_numpy() for x in held]) if held else np.zeros(0, np.int64)
        x = unpacked(pa.chunked_array([x.column("head") for x in held], pa.binary()), w)
        order = np.argsort(i if told.value is None else told.value[i])
        return i[order], x[order]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, x = own(batches)
        kept = pivoted(x)[0][:w] if len(i) > w else np.arange(len(i))
        group = TaskContext.get().partitionId() // ARITY
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), group, np.int32)), pa.array(i[kept]), packed(x[kept])], names=["g", "i", "head"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, x = own(batches)
        order, factors = pivoted(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(w, dtype=np.int32)), pa.array(i[order[:w]]), packed(factors[:w])], names=["g", "i", "head"])

    rows = rows.select("i", "head")
    if places is None:
        parts = rows.rdd.getNumPartitions()
        rows = rows.mapInArrow(best, schema)
        while parts > ARITY:
            parts = -(-parts // ARITY)
            rows = rows.repartition(parts, "g").mapInArrow(best, schema)
    got = rows.repartition(1).mapInArrow(last, schema).toArrow().sort_by("g")
    return got.column("i").to_numpy(), unpacked(got.column("head"), w)


class Elimination:
    """The finished parts of an LU factorisation in the shared folder, rows (i, first column, doubles) by row of A: the
    corners (L and U of the pivot rows), what lies beyond them (U and right-hand sides), and what lies below (L)."""

    def __init__(self, spark, n: int):
        self.spark, self.n, self.path, self.row_at = spark, n, f"{shared_dir(spark)}/lu-{uuid.uuid4().hex}", np.arange(n)

    def write(self, kind: str, stage: int, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{kind}/stage={stage}")

    def read(self, kind: str, stage: int | None = None) -> DataFrame:
        below = "" if stage is None else f"/stage={stage}"
        return self.spark.read.schema("i long, first long, row binary" + ", stage int" * (stage is None)).parquet(f"{self.path}/{kind}{below}").drop("stage")

    def parts(self) -> DataFrame:
        """All rows of parts, by row of A."""
        kinds = [self.read("corner"), self.read("beyond")]
        if self.stages > 1:
            kinds.append(self.read("below"))
        out = kinds[0].select("i", "first", "row")
        for x in kinds[1:]:
            out = out.union(x.select("i", "first", "row"))
        return out

    def places(self) -> DataFrame:
        """(i, pi): row pi of A is at place i; n numbers."""
        return self.spark.createDataFrame(pa.table({"i": pa.array(np.arange(self.n)), "pi": pa.array(self.row_at)}))

    def placed(self) -> DataFrame:
        """All rows of parts, by place."""
        return self.parts().withColumnRenamed("i", "pi").join(F.broadcast(self.places()), "pi").select("i", "first", "row")


def halves(rows: DataFrame, n: int, w: int) -> DataFrame:
    """(i, head, rest) of rows of n doubles, cut after w."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            x = unpacked(batch.column("row"), n)
            yield pa.RecordBatch.from_arrays([batch.column("i"), packed(x[:, :w]), packed(x[:, w:])], names=["i", "head", "rest"])

    return rows.mapInArrow(cut, HALVES)


def eliminated(a: DataFrame, n: int, block: int, right: int = 0, pivoting: str = "tournament") -> Elimination:
    """LU of n rows by panels of columns, with ``right`` more columns, which take part as right-hand sides.

    ``tournament``: a panel's pivots come from a tree over tasks (``pivot_rows``); entries of L may pass 1 a little.
    ``partial``: the pivot is the greatest absolute value of its column, of equals the first row; the panel, bounded by
    PANEL_MB, goes through one task. A pivot of 1e-15 or less is an error that names the stage. The driver sees the
    order of the rows (n numbers), corners of block by block, and the pivot rows that it broadcasts. What is not finished
    is written anew in each stage and the stage's own copy deleted, so the folder holds two copies at most.
    """
    spark, width, total = a.sparkSession, panel_width(n + right, block), n + right
    out, place_of = Elimination(spark, n), np.arange(n)
    out.stages = -(-n // width)
    w = min(n, width)
    rows, path = written(halves(full_rows(a, n, total), total, w), "lu")
    for k0 in range(0, n, width):
        k1 = k0 + w
        wide, after = total - k1, min(width, n - k1)
        chosen, corner = pivot_rows(rows, w, place_of if pivoting == "partial" else None)
        if (found := np.flatnonzero(np.abs(np.diag(corner)) <= EPS)).size or len(chosen) < w:
            raise ValueError(f"singular at stage {k0 + int(found[0]) if found.size else k0 + len(chosen)}")
        for k, i in enumerate(chosen.tolist(), k0):
            there, other = place_of[i], out.row_at[k]
            out.row_at[[k, there]], place_of[[i, other]] = (i, other), (k, there)
        out.write("corner", k0, spark.createDataFrame(pa.table({"i": pa.array(chosen), "first": pa.array(np.full(w, k0)), "row": packed(corner)})).coalesce(1))

        def beyond(batches: Iterator[pa.RecordBatch], w=w, wide=wide, chosen=chosen, corner=corner, k1=k1) -> Iterator[pa.RecordBatch]:
            held = [x for x in batches if len(x)]
            if held:
                i = np.concatenate([x.column("i").to_numpy() for x in held])
                x = np.concatenate([unpacked(x.column("rest"), wide) for x in held])[np.argsort(i)][np.argsort(np.argsort(chosen))]
                x = np.linalg.solve(np.tril(corner, -1) + np.eye(w), x)
                yield pa.RecordBatch.from_arrays([pa.array(chosen), pa.array(np.full(w, k1)), packed(x)], names=["i", "first", "row"])

        top = rows.where(F.col("i").isin(chosen.tolist())).select("i", "rest").repartition(1)
        out.write("beyond", k0, top.mapInArrow(beyond, "i long, first long, row binary"))
        if k1 == n:
            break
        got = out.read("beyond", k0).toArrow()
        order = {i: k for k, i in enumerate(got.column("i").to_pylist())}
        told = spark.sparkContext.broadcast((np.sort(chosen), corner, unpacked(got.column("row"), wide)[[order[i] for i in chosen.tolist()]]))

        def alive(i: np.ndarray, told=told) -> np.ndarray:
            gone = told.value[0]
            return gone[np.minimum(np.searchsorted(gone, i), len(gone) - 1)] != i

        def below(head: pa.Array, w=w, told=told) -> np.ndarray:
            return np.linalg.solve(np.triu(told.value[1]).T, unpacked(head, w).T).T

        def lows(batches: Iterator[pa.RecordBatch], w=w, k0=k0, alive=alive, below=below) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, w):
                batch = batch.filter(pa.array(alive(batch.column("i").to_numpy())))
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(np.full(len(batch), k0)), packed(below(batch.column("head")))], names=["i", "first", "row"])

        def step(batches: Iterator[pa.RecordBatch], w=w, wide=wide, after=after, told=told, alive=alive, below=below) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, w + wide):
                batch = batch.filter(pa.array(alive(batch.column("i").to_numpy())))
                x = unpacked(batch.column("rest"), wide) - below(batch.column("head")) @ told.value[2]
                yield pa.RecordBatch.from_arrays([batch.column("i"), *map(packed, (x[:, :after], x[:, after:]))], names=["i", "head", "rest"])

        out.write("below", k0, rows.select("i", "head").mapInArrow(lows, "i long, first long, row binary"))
        old = path
        rows, path = written(rows.mapInArrow(step, HALVES), "lu")
        discard(spark, old)
        told.destroy()
        w = after
    discard(spark, path)
    return out


def lu(a: DataFrame, n: int, block: int = 256, pivoting: str = "tournament") -> tuple[DataFrame, DataFrame]:
    """(L below and U on and over the diagonal as triples, (i, pi)) with A(pi(i), j) = (L U)(i, j); see ``eliminated``."""
    done = eliminated(a, n, block, 0, pivoting)
    return cells_of(done.placed()), done.places()


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def split_lu(factors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(L unit lower, U upper) of the factors in one matrix."""
    return factors.where("i > j").union(identity(factors.sparkSession, n)), factors.where("i <= j")


def permuted_rows(a: DataFrame, pi: DataFrame) -> DataFrame:
    """Row i of the result is row pi(i) of a."""
    return a.join(pi.select(F.col("i").alias("to"), F.col("pi").alias("i")), "i").select(F.col("to").alias("i"), *(c for c in a.columns if c != "i"))


def compose_swaps(swaps: list[tuple[int, int]], n: int) -> list[int]:
    """pi of swapping rows in the given order: pi[i] is the row that ends at place i."""
    pi = list(range(n))
    for a, b in swaps:
        pi[a], pi[b] = pi[b], pi[a]
    return pi


def reconstruct_lu(factors: DataFrame, pi: DataFrame, n: int, block: int = 256) -> DataFrame:
    """A of its factors: row pi(i) is row i of L U."""
    product = matmul(*split_lu(factors, n), block)
    return product.join(F.broadcast(pi), "i").select(F.col("pi").alias("i"), "j", "v")


def verify_lu(a: DataFrame, factors: DataFrame, pi: DataFrame, n: int, block: int = 256) -> DataFrame:
    """One row: the Frobenius norm of L U - P A, which is that of P' L U - A."""
    low, up = split_lu(factors, n)
    product = block_product(blocked(low, block), blocked(up, block), block)
    return frobenius_norm(merged([product], -1.0, permuted_rows(a.select("i", "j", "v"), F.broadcast(pi)), block))


def told_of(error: PythonException, words: str) -> str | None:
    """What a task's ValueError says, if it has the words."""
    return next((line.removeprefix("ValueError: ") for line in str(error).splitlines() if line.startswith("ValueError: ") and words in line), None)


def cholesky(a: DataFrame, n: int, block: int = 256) -> DataFrame:
    """R upper with R' R = A for A symmetric positive definite (its lower triangle is read); otherwise an error that names
    the columns.

    By square tiles (bi, bj) of the lower triangle: a stage factors its diagonal tile in a task, which goes to each tile
    below, and the finished column, PANEL_MB at most, to each trailing tile (both broadcast), so tiles are changed where
    they lie, without a shuffle. The factor's columns are written once. The trailing tiles are written anew in each stage,
    the next column apart from the others, and the stage's own copy is deleted then, so there are two copies at most.
    """
    block = panel_width(n, block)
    spark, path, count = a.sparkSession, f"{shared_dir(a.sparkSession)}/cholesky-{uuid.uuid4().hex}", -(-n // block)

    def kept(rows: DataFrame, k: int) -> tuple[DataFrame, str]:
        place = f"{path}/tiles={k}"
        rows.withColumn("ahead", F.col("bj") == k).write.partitionBy("ahead").parquet(place)
        return spark.read.schema(BLOCKS + ", ahead boolean").parquet(place), place

    tiles, place = kept(to_blocks(a.where(f"i >= j AND i < {n}").select("i", "j", "v"), block), 0)

    def diagonal(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}
            for data in (x for batch in batches for x in batch.column("data").to_pylist()):
                x = np.frombuffer(data).reshape(block, block).copy()
                inside = min(block, n - k * block)
                x[range(inside, block), range(inside, block)] = 1.0
                try:
                    held[k, k] = np.linalg.cholesky(np.tril(x) + np.tril(x, -1).T)
                except np.linalg.LinAlgError:
                    raise ValueError(f"not positive definite in columns {k * block} to {min(n, (k + 1) * block) - 1}") from None
            yield block_rows(held)

        return run

    def sent(table: DataFrame):
        """The tiles of a table by their row, broadcast."""
        got = table.select("bi", "data").toArrow()
        return spark.sparkContext.broadcast({i: np.frombuffer(x).reshape(block, block) for i, x in zip(got.column("bi").to_pylist(), got.column("data").to_pylist())})

    def column(k: int, told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, data in zip(batch.column("bi").to_pylist(), batch.column("data")):
                    x = np.frombuffer(data.as_buffer()).reshape(block, block)
                    yield block_rows({(bi, k): np.linalg.solve(told.value[k], x.T).T})

        return run

    def trailing(told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, data in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("data")):
                    x = np.frombuffer(data.as_buffer()).reshape(block, block) if data.is_valid else np.zeros((block, block))
                    left, right = told.value.get(bi), told.value.get(bj)
                    yield block_rows({(bi, bj): x if left is None or right is None else x - left @ right.T})

        return run

    read = lambda part: spark.read.schema(BLOCKS).parquet(f"{path}/{part}")
    try:
        for k in range(count):
            tiles.where(F.col("ahead") & (F.col("bi") == k)).select("bi", "bj", "data").mapInArrow(diagonal(k), BLOCKS).write.parquet(f"{path}/column={k}/diagonal")
            corner = sent(read(f"column={k}/diagonal"))
            if k not in corner.value:
                raise ValueError(f"not positive definite in columns {k * block} to {min(n, (k + 1) * block) - 1}")
            if k + 1 == count:
                break
            tiles.where(F.col("ahead") & (F.col("bi") > k)).select("bi", "bj", "data").mapInArrow(column(k, corner), BLOCKS).write.parquet(f"{path}/column={k}/below")
            done = read(f"column={k}/below")
            told, rest = sent(done), tiles.where("NOT ahead").select("bi", "bj", "data")
            pairs = done.select("bi", F.explode(F.sequence(F.lit(k + 1).cast("long"), "bi")).alias("bj"))
            absent = pairs.join(done.select(F.col("bi").alias("bj")), "bj", "left_semi").join(rest.select("bi", "bj"), ["bi", "bj"], "left_anti")
            rest = rest.union(absent.select("bi", "bj", F.lit(None).cast("binary")))
            old = place
            tiles, place = kept(rest.mapInArrow(trailing(told), BLOCKS), k + 1)
            discard(spark, old)
            told.destroy()
            corner.destroy()
        discard(spark, place)
    except PythonException as error:
        if said := told_of(error, "not positive definite in columns"):
            raise ValueError(said) from None
        raise
    whole = spark.read.schema(BLOCKS + ", column int").parquet(*(f"{path}/column={k}/{part}" for k in range(count) for part in ("diagonal", "below")[: 1 + (k + 1 < count)]))
    return transpose(from_blocks(whole, block)).where(f"i < {n} AND j < {n}")


def tiled(pieces: DataFrame, n: int, block: int) -> DataFrame:
    """Square blocks of pieces (i, first, row) of the rows of an n by n matrix, by strips of a block's width."""

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, row in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(row)[: n - first]
                if not len(x):
                    continue
                whole = np.zeros((first + len(x) - 1) // block * block + block - first // block * block)
                whole[first % block : first % block + len(x)] = x
                count = len(whole) // block
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, i // block)), pa.array(first // block + np.arange(count)), pa.array(np.full(count, i % block)), packed(whole.reshape(count, block))], names=["bi", "bj", "r", "strip"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, parts in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.zeros((block, block))
                for part in parts:
                    x[part["r"]] += np.frombuffer(part["strip"])
                yield block_rows({(bi, bj): x})

    rows = pieces.select("i", "first", "row").mapInArrow(strips, "bi long, bj long, r long, strip binary")
    return rows.groupBy("bi", "bj").agg(F.collect_list(F.struct("r", "strip")).alias("parts")).mapInArrow(fill, BLOCKS)


def inverted(lower: DataFrame, n: int, block: int) -> DataFrame:
    """Blocks of the inverse of a lower triangle, given by blocks; what lies over the diagonal is not read.

    The blocks on the diagonal are inverted first. A round joins neighbouring inverses two and two: of [A 0; C B] the
    missing part is -B^-1 C A^-1, two products of blocks for all pairs at once. So the rounds are as many as the count of
    blocks can be halved. A diagonal entry of 1e-15 or less is an error that names its rows.
    """
    count = -(-n // block)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column("bi").to_pylist(), batch.column("data").to_pylist()):
                x = np.tril(np.frombuffer(data).reshape(block, block))
                inside = min(block, n - k * block)
                x[range(inside, block), range(inside, block)] = 1.0
                if (np.abs(np.diag(x)) <= EPS).any():
                    raise ValueError(f"singular in rows {k * block} to {k * block + inside - 1}")
                yield block_rows({(k, k): np.linalg.inv(x)})

    lower = lower.where("bi >= bj")
    try:
        inverse = stored(lower.where("bi = bj").mapInArrow(corners, BLOCKS), "inverse")
    except PythonException as error:
        if said := told_of(error, "singular in rows"):
            raise ValueError(said) from None
        raise
    if (there := inverse.count()) < count:
        raise ValueError(f"singular: {count - there} blocks on the diagonal are empty")
    size = 1
    while size < count:
        pair = (div(F.col("bi"), 2 * size) == div(F.col("bj"), 2 * size)) & (F.col("bi") % (2 * size) >= size) & (F.col("bj") % (2 * size) < size)
        missing = block_product(inverse, stored(block_product(lower.where(pair), inverse, block), "inverse"), block, -1.0)
        inverse, size = stored(inverse.union(missing), "inverse"), 2 * size
    return inverse


def times_vector(blocks: DataFrame, b: DataFrame, n: int, block: int) -> DataFrame:
    """(i, v): a matrix of blocks times a vector (i, v), absent entries 0. Pieces of the vector meet blocks by column."""
    pieces = b.where(f"i >= 0 AND i < {n}").groupBy(div(F.col("i"), block).alias("bj")).agg(F.collect_list(F.struct((F.col("i") % block).alias("k"), F.coalesce("v", F.lit(0.0)).alias("v"))).alias("x"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, data, part in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.zeros(block)
                np.add.at(x, [p["k"] for p in part], [p["v"] for p in part])
                y = np.frombuffer(data).reshape(block, block) @ x
                inside = min(block, n - bi * block)
                yield pa.RecordBatch.from_arrays([pa.array(bi * block + np.arange(inside)), pa.array(y[:inside])], names=["i", "v"])

    sums = blocks.join(pieces, "bj").select("bi", "data", "x").mapInArrow(multiply, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return b.sparkSession.range(n).select(F.col("id").alias("i")).join(sums, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def trisolv(lower: DataFrame, b: DataFrame, n: int, block: int = 256) -> DataFrame:
    """x with L x = b, L lower with its diagonal, through the inverse of its blocks (``inverted``)."""
    blocks = stored(to_blocks(lower.where(f"i < {n} AND j <= i").select("i", "j", "v"), block), "lower")
    return times_vector(inverted(blocks, n, block), b, n, block)


def turned(a: DataFrame, n: int) -> DataFrame:
    """A matrix or vector with its indices counted from the end."""
    return a.select(*((F.lit(n - 1) - F.col(c)).alias(c) if c in ("i", "j") else c for c in a.columns))


def backsolv(upper: DataFrame, b: DataFrame, n: int, block: int = 256) -> DataFrame:
    """x with U x = b: the forward solve with both indices turned round."""
    return turned(trisolv(turned(upper.select("i", "j", "v"), n), turned(b.select("i", "v"), n), n, block), n)


def solve(a: DataFrame, b: DataFrame, n: int, block: int = 256) -> DataFrame:
    """x with A x = b, by LU. The right-hand side goes along as one more column, so only U is left to solve: its blocks are
    turned round, which makes them a lower triangle, and inverted."""
    right = b.select("i", F.lit(n).cast("long").alias("j"), "v")
    done = eliminated(a.select("i", "j", "v").union(right), n, block, 1)
    placed, last = stored(done.placed(), "placed"), n - 1

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, row in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(row)
                if first + len(x) == n + 1:
                    yield pa.RecordBatch.from_arrays([pa.array([last - i]), pa.array(x[-1:])], names=["i", "v"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, first, np.frombuffer(row)[: n - first]) for i, first, row in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [(last - i, n - first - len(x), x[::-1].tobytes()) for i, first, x in rows if len(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["i", "first", "row"])

    y = placed.mapInArrow(ends, "i long, v double")
    lower = tiled(placed.mapInArrow(around, "i long, first long, row binary"), n, block)
    return turned(times_vector(inverted(stored(lower, "lower"), n, block), y, n, block), n)


def toeplitz_solve(r: DataFrame, n: int, block: int = 256) -> DataFrame:
    """x with toeplitz(r_0 .. r_{n-1}) x = -(r_1 .. r_n); r holds (i, v) for i = 0 .. n."""
    spark = r.sparkSession
    grid = spark.range(n * n).selectExpr(f"id div {n} AS i", f"id % {n} AS j")
    matrix = grid.withColumn("d", F.abs(F.col("i") - F.col("j"))).join(r.select(F.col("i").alias("d"), "v"), "d").select("i", "j", "v")
    right = r.where("i > 0").select((F.col("i") - 1).alias("i"), (-F.col("v")).alias("v"))
    return solve(matrix, right, n, block)


def qr(a: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Thin (Q, R) as triples with the diagonal of R positive, for many rows and n columns (n * n bounded by a panel).

    A tree: each chunk of rows is factored on its own and keeps n by n; ARITY of these meet, are factored again, and so
    on to one R. Each level's orthogonal factors stay, and Q is the chunks' own times those on their way up, so its
    columns are orthogonal to rounding, however close to dependent the columns of A are. Chunks take 32 MB, or n rows
    if those are more. Only R, n by n, reaches the driver.
    """
    if 8 * n * n > PANEL_MB << 20:
        raise ValueError("too many columns for a tall QR")
    most = max(n, (32 << 20) // (8 * n))
    node = "id long, up long, q binary, r binary"

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, k = [], 0, TaskContext.get().partitionId() << 32

        def factored() -> pa.RecordBatch:
            x = np.concatenate([unpacked(b.column("row"), n) for b in held])
            i = np.concatenate([b.column("i").to_numpy() for b in held])
            order = np.argsort(i)
            q, r = np.linalg.qr(np.concatenate([x[order], np.zeros((max(0, n - len(x)), n))]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k)), pa.array(i[order]), packed(q[: len(x)]), pa.array([r.tobytes()] + [None] * (len(x) - 1), pa.binary())], names=["id", "i", "row", "r"])

        for batch in batches:
            for part in (batch.slice(a, most) for a in range(0, len(batch), most)):
                held.append(part)
                rows += len(part)
                if rows >= most:
                    yield factored()
                    held, rows, k = [], 0, k + 1
        if rows:
            yield factored()

    def joined(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        q, r = np.linalg.qr(unpacked(part.column("r"), n * n).reshape(-1, n))
        count = len(part)
        return pa.table({"id": part.column("id"), "up": part.column("up"), "q": packed(q.reshape(count, n * n)), "r": pa.array([r.tobytes()] + [None] * (count - 1), pa.binary())})

    def down(own: pa.Table, above: pa.Table) -> pa.Table:
        top = np.frombuffer(above.column("q")[0].as_py()).reshape(n, n)
        return pa.table({"id": own.column("id"), "q": pa.array([(np.frombuffer(x).reshape(n, n) @ top).tobytes() for x in own.column("q").to_pylist()], pa.binary())})

    def turned_rows(own: pa.Table, above: pa.Table) -> pa.Table:
        top = np.frombuffer(above.column("q")[0].as_py()).reshape(n, n)
        return pa.table({"pos": own.column("i"), "i": own.column("i"), "row": packed(unpacked(own.column("row"), n) @ top)})

    spark = a.sparkSession
    rows = stored(to_rows(a, n).mapInArrow(leaves, "id long, i long, row binary, r binary"), "qr")
    ends, levels = rows.where("r IS NOT NULL").select("id", "r"), []
    while (count := ends.count()) > 1 or not levels:
        groups = max(1, count // ARITY)
        level = ends.withColumn("up", F.pmod(F.xxhash64("id", F.lit(len(levels))), F.lit(groups)))
        levels.append(stored(level.groupBy("up").applyInArrow(joined, node), "qr"))
        ends = levels[-1].where("r IS NOT NULL").select(F.col("up").alias("id"), "r")
        if not count:
            raise ValueError("the columns are dependent")
    r = np.frombuffer(ends.first()["r"]).reshape(n, n)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    r = r * sign[:, None]
    if (np.abs(np.diag(r)) <= EPS).any():
        raise ValueError("the columns are dependent")
    above = spark.createDataFrame(pa.table({"id": pa.array([0], pa.int64()), "q": pa.array([np.diag(sign).tobytes()])}))
    for level in reversed(levels):
        own = level.select("id", "up", "q").groupBy("up")
        above = stored(own.cogroup(above.groupBy("id")).applyInArrow(down, "id long, q binary"), "qr")
    done = rows.select("id", "i", "row").groupBy("id").cogroup(above.groupBy("id")).applyInArrow(turned_rows, ROWS)
    upper = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(n) for j in range(i, n)], "i long, j long, v double")
    return from_rows(done, n, "i"), upper
