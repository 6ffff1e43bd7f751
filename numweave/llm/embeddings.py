"""Embedding near-dedup: NN-descent finds the neighbour graph, its components bound the exact links."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, stored
from .components import components

#: Least and most entries of a neighbour list; candidates a list lends to a local join, and as many from the lists that name it.
LEAST, MOST, LENT = 8, 64, 5
#: Rows compared at once when the first graph is made, and vectors of one cell in the exact comparison.
BLOCK, CELL = 256, 256
TREES = 4
#: Members of a component that look for neighbours in others, of those with full lists.
SPEAKERS = 4
#: Candidates travel in half precision, which changes a cosine by under 2 ** -10; links within SLACK of the threshold are
#: tested again, in doubles.
SLACK = 0.002
#: Most bytes of pivots sent to the executors.
PIVOT_BYTES = 1 << 26
EDGES = "v long, u long, s double"
LOG = logging.getLogger(__name__)


def first(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for x in keys:
        out[1:] |= x[1:] != x[:-1]
    return out


def rank_in(key: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal keys."""
    at = np.flatnonzero(first(key)) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))


def matrix(column: pa.ChunkedArray | pa.Array, stored_as: str = "<f8", kind=np.float64) -> np.ndarray:
    """Rows of numbers from a column of their bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(stored_as).reshape(len(column), -1).astype(kind)


def halves(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return matrix(column, "<f2", np.float32)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [x for x in batches if len(x)]
    return pa.Table.from_batches(held) if held else None


def edges_of(v, u, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(s, pa.float64())], names=["v", "u", "s"])


def unit_rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, n, x) of each row: length and unit vector as doubles. n is 0 and x null where the id is null and where the
    vector is null, zero, or holds null or non-finite components; squares that overflow are avoided by scaling."""
    vector = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull())
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, vector).otherwise(F.array().cast("array<double>")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column("vec_id"), batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            flat, start = batch.column("x").flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                x = flat[start[at][:, None] + np.arange(n)]
                scale = np.abs(x).max(1, initial=0)
                good = np.isfinite(scale) & (scale > 0)
                x = x[good] / scale[good, None]
                x = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0  # no negative zeros: equal vectors have equal bytes
                parts = ((at[good], n, [r.tobytes() for r in x]), (at[~good], 0, [None] * int((~good).sum())))
                for which, m, data in parts:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(np.full(len(which), m, np.int32)), pa.array(data, pa.binary())], names=["vec_id", "n", "x"])

    return rows.mapInArrow(run, "vec_id long, n int, x binary")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, own, x, h, w, rep) of rows (vec_id, x): each different vector under a number of its own, with its bytes in
    double and half precision, the rows that have it, and the smallest of their ids."""

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                low = matrix(batch.column("x")).astype("<f2")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in low], pa.binary())], names=["vec_id", "own", "x", "w", "rep", "h"])

    each = rows.groupBy("x").agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"))
    numbered = stored(each.withColumn("vec_id", F.monotonically_increasing_id()), "distinct")
    return stored(numbered.select("vec_id", F.col("vec_id").alias("own"), "x", "w", "rep").mapInArrow(half, "vec_id long, own long, x binary, w long, rep long, h binary"), "vectors")


def first_graph(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """Neighbours within blocks of vectors that random hyperplanes put side by side: a few orders of all vectors, each
    by the sides of its hyperplanes and then by one projection; neighbours in an order are compared in blocks. Vectors
    of one group (column own) are no neighbours."""
    bits = max(1, math.ceil(math.log2(max(2, n / BLOCK))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = halves(batch.column("h"))
            for t in range(TREES):
                planes = np.random.default_rng((seed, t)).standard_normal((x.shape[1], bits + 1), np.float32)
                sides = x @ planes
                code = (sides[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(sides[:, bits].astype(np.float64)), batch.column("vec_id"), batch.column("own"), batch.column("h")], names=["tree", "code", "side", "vec_id", "own", "h"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        for k in range(0, len(table) if table else 0, BLOCK):
            part = table.slice(max(0, min(k, len(table) - BLOCK)), BLOCK)
            ids, own, x = part.column("vec_id").to_numpy(), part.column("own").to_numpy(), halves(part.column("h"))
            s = x @ x.T
            s[own[:, None] == own[None]] = -2
            best = np.argpartition(-s, min(LEAST, len(ids) - 1), axis=1)[:, :LEAST]
            v, u, s = np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()
            yield edges_of(v[s > -2], u[s > -2], s[s > -2])

    rows = vectors.select("vec_id", "own", "h").mapInArrow(spread, "tree int, code long, side double, vec_id long, own long, h binary")
    order = ["tree", "code", "side", "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near, EDGES)


def best_lists(edges: DataFrame, threshold: float) -> DataFrame:
    """The best entries of each list: LEAST, or where all of them are links (the list is saturated) twice as many, and
    so on up to MOST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := whole(batches)) is None:
            return
        v, u, s = (table.column(c).to_numpy() for c in "vus")
        order = np.lexsort((-s, u, v))
        order = order[first(v[order], u[order])]
        order = order[np.lexsort((u[order], -s[order], v[order]))]
        v, u, s = v[order], u[order], s[order]
        run_id = np.cumsum(first(v)) - 1
        linked = np.bincount(run_id, s >= threshold - SLACK)
        size = np.clip(2.0 ** np.ceil(np.log2(linked + 1)), LEAST, MOST)
        keep = rank_in(v) < size[run_id]
        yield edges_of(v[keep], u[keep], s[keep])

    return edges.repartition("v").mapInArrow(run, EDGES)


def mixed_order(v: np.ndarray, u: np.ndarray, seed: int) -> np.ndarray:
    x = (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (u.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93)


def descend(graph: DataFrame, vectors: DataFrame, threshold: float, seed: int) -> DataFrame:
    """One round: each vector lets its neighbours, and some of those that name it, meet each other. Vectors of one group
    (column own) do not become neighbours."""

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(v, u): who meets at v. Of the reverse entries a task sends a few for each list, so hubs stay small."""
        if (table := whole(batches)) is None:
            return
        v, u = (table.column(c).to_numpy() for c in "vu")
        for at, other in ((v, u), (u, v)):
            order = np.lexsort((mixed_order(at, other, seed), at))
            order = order[rank_in(at[order]) < LENT]
            yield edges_of(at[order], other[order], np.full(len(order), float(at is u)))
        own = np.unique(v)
        yield edges_of(own, own, np.zeros(len(own)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := whole(batches)) is None:
            return
        v, u, s = (table.column(c).to_numpy() for c in "vus")
        order = np.lexsort((mixed_order(v, u, seed), s, u, v))
        order = order[first(v[order], u[order])]
        order = order[np.lexsort((mixed_order(v[order], u[order], seed), s[order], v[order]))]
        order = order[rank_in(v[order]) < 2 * LENT + 1]
        x, own = halves(table.column("h").take(pa.array(order))), table.column("own").to_numpy()[order]
        v, u = v[order], u[order]
        at = np.flatnonzero(first(v))
        size = np.diff(np.append(at, len(v)))
        width = 2 * LENT + 1
        for k in range(0, len(at), 2048):
            a, n = at[k : k + 2048], size[k : k + 2048]
            place = np.minimum(a[:, None] + np.arange(width), len(v) - 1)
            there = np.arange(width) < n[:, None]
            sims = np.einsum("gid,gjd->gij", x[place], x[place])
            ids, group = u[place], own[place]
            sims[~(there[:, :, None] & there[:, None, :]) | (group[:, :, None] == group[:, None, :])] = -2
            best = np.argpartition(-sims, 4, axis=2)[:, :, :4]
            s = np.take_along_axis(sims, best, 2)
            g = np.arange(len(a))[:, None, None]
            got = s > -2
            yield edges_of(np.broadcast_to(ids[:, :, None], s.shape)[got], ids[g, best][got], s[got])

    pairs = graph.mapInArrow(lend, EDGES)
    known = vectors.select(F.col("vec_id").alias("u"), "own", "h")
    found = pairs.join(known, "u").select("v", "u", "s", "own", "h").repartition("v").mapInArrow(meet, EDGES)
    return stored(best_lists(graph.union(found), threshold), "graph")


def checked(edges: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The edges whose cosine reaches the threshold. Half precision decides those beyond its error, doubles the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = cosines(matrix(batch.column("x")), matrix(batch.column("y"))) >= threshold
                yield batch.select(["a", "b"]).filter(pa.array(good))

    ends = [F.greatest("v", "u").alias("a"), F.least("v", "u").alias("b")]
    sure = edges.where(F.col("s") >= threshold + SLACK).select(*ends)
    close = edges.where((F.col("s") >= threshold - SLACK) & (F.col("s") < threshold + SLACK)).select(*ends).distinct()
    close = close.join(vectors.select(F.col("vec_id").alias("a"), "x"), "a").join(vectors.select(F.col("vec_id").alias("b"), F.col("x").alias("y")), "b")
    return sure.union(close.mapInArrow(run, "a long, b long")).distinct()


def joined(graph: DataFrame, vectors: DataFrame, threshold: float, rounds: int, seed: int) -> DataFrame:
    """(node, root): components of the graph's links and of links across them.

    Every vector looks for neighbours in other components than its own, until none are found. Only those whose lists are
    full of links lie so deep in a group that they would meet none but their own: of each component SPEAKERS of them.
    """
    links = stored(checked(graph, vectors, threshold), "links")
    full = stored(graph.where(F.col("s") >= threshold - SLACK).groupBy(F.col("v").alias("vec_id")).count().where(F.col("count") >= MOST).select("vec_id", F.lit(True).alias("full")), "full")
    while True:
        roots = stored(components(links), "roots")
        placed = vectors.select("vec_id", "h").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(full, "vec_id", "left")
        placed = stored(placed.select("vec_id", F.coalesce("root", "vec_id").alias("own"), "h", F.coalesce("full", F.lit(False)).alias("full")), "placed")
        turn = Window.partitionBy("own").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id")
        deep = placed.where("full").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SPEAKERS)
        some = stored(placed.where("NOT full").select("vec_id", "own", "h").union(deep.select("vec_id", "own", "h")), "speakers")
        across = stored(best_lists(first_graph(some, some.count(), seed), threshold), "graph")
        for k in range(rounds):
            across = descend(across, some, threshold, seed + k)
        more = stored(checked(across, vectors, threshold), "across")
        if not more.count():
            return roots
        links, seed = stored(links.union(more), "links"), seed + 1


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed in one fixed order, so that a pair has one value wherever it is computed."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.size else np.zeros(len(x))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def large_components(members: DataFrame, threshold: float, cell_size: int) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, root, x, w) of components over ``cell_size``, dealt out by pivots: what is to compare (cell, home,
    ask, side, vec_id, x, w), and the links that bounds settle (vec_id, n).

    Roots and vectors drawn by a hash, some two for each ``cell_size`` members, are pivots; the nearest one is a vector's
    home, whose radius is its farthest member's angle. A vector asks in a home only where the triangle bound leaves links
    and non-links possible. Homes and askers beyond ``cell_size`` are dealt into blocks.
    """
    context = members.sparkSession.sparkContext
    share = 2 / cell_size
    drawn = members.where((F.col("vec_id") == F.col("root")) | (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("root", "vec_id", "x").toArrow().sort_by([("root", "ascending"), ("vec_id", "ascending")])
    roots = drawn.column("root").to_numpy()
    cut = np.flatnonzero(first(roots))
    ranges = {int(roots[a]): (int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(roots)))}
    pivots = context.broadcast((matrix(drawn.column("x")) if len(drawn) else np.zeros((0, 1)), ranges))
    reach, blur = math.acos(threshold), 1e-6

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Places of the rows of a component, its first pivot, their vectors and angles to its pivots."""
        x, root = matrix(batch.column("x")), batch.column("root").to_numpy()
        for r in np.unique(root).tolist():
            a, b = pivots.value[1][r]
            step = max(1, (1 << 22) // (b - a))
            at = np.flatnonzero(root == r)
            for k in range(0, len(at), step):
                yield at[k : k + step], a, x[at[k : k + step]], angles(x[at[k : k + step]], pivots.value[0][a:b])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for at, a, _, to in parts(batch) if len(batch) else ():
                near = to.argmin(1)
                cell[at], angle[at] = a + near, to[np.arange(len(at)), near]
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(cell), pa.array(angle)], names=["w", "cell", "angle"])

    rows = members.select("vec_id", "root", "x", "w")
    homes = rows.mapInArrow(assign, "w long, cell long, angle double").groupBy("cell").agg(F.max("angle"), F.sum("w"), F.count("*")).collect()
    radius, held, size = np.zeros(len(drawn)), np.zeros(len(drawn), np.int64), np.zeros(len(drawn), np.int64)
    for cell, r, w, n in homes:
        radius[cell], held[cell], size[cell] = r, w, n
    known = context.broadcast((radius, held, size))

    def settle(a: int, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that bounds give each row, and which homes it must ask."""
        radius, held, size = (x[a : a + to.shape[1]] for x in known.value)
        inside = to + radius <= reach - blur
        return inside @ held, ~inside & (to - radius <= reach + blur) & (size > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = np.zeros(len(drawn_size.value), np.int64)
        for batch in batches:
            for _, a, _, to in parts(batch) if len(batch) else ():
                asks[a : a + to.shape[1]] += settle(a, to)[1].sum(0)
        some = np.flatnonzero(asks)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(asks[some])], names=["cell", "asks"])

    drawn_size = context.broadcast(size)
    asks = np.zeros(len(drawn), np.int64)
    for cell, n in rows.mapInArrow(count, "cell long, asks long").groupBy("cell").agg(F.sum("asks")).collect():
        asks[cell] = n
    blocks = context.broadcast((np.maximum(1, -(-size // cell_size)), -(-asks // (4 * cell_size))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "home", "ask", "side", "vec_id", "x", "w"]
        for batch in batches:
            ids = batch.column("vec_id").to_numpy() if len(batch) else np.zeros(0, np.int64)
            for at, a, _, to in parts(batch) if len(batch) else ():
                n_home, n_ask = blocks.value
                own = a + to.argmin(1)
                mixed = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                row, cell = np.nonzero(settle(a, to)[1])
                cell += a
                # a vector that asks goes to each block of the home, one that is asked to each block of the askers
                for side, row, cell, copies in ((0, row, cell, n_home[cell]), (1, np.arange(len(at)), own, n_ask[own])):
                    every = np.repeat(np.arange(len(row)), copies)
                    turn = np.arange(len(every)) - np.repeat(np.cumsum(copies) - copies, copies)
                    other = (mixed[row] % np.maximum(1, (n_ask if side == 0 else n_home)[cell]).astype(np.uint64)).astype(np.int64)[every]
                    home, ask = (turn, other) if side == 0 else (other, turn)
                    take = pa.array(at[row[every]])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[every]), pa.array(home), pa.array(ask), pa.array(np.full(len(every), side, np.int32)), batch.column("vec_id").take(take), batch.column("x").take(take), batch.column("w").take(take)], names=names)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            for at, a, _, to in parts(batch) if len(batch) else ():
                n[at] = settle(a, to)[0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(n)], names=["vec_id", "n"])

    return rows.mapInArrow(deal, "cell long, home long, ask long, side int, vec_id long, x binary, w long"), rows.mapInArrow(bound, "vec_id long, n long")


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n_links) within components (columns vec_id, root, x, w: so many rows have the vector x).

    A component of CELL members or fewer is one cell, in which all are compared with all; larger ones are dealt out by
    pivots. Cells are larger only where the pivots of so many members would take over PIVOT_BYTES. A vector finds
    itself, so one is taken off.
    """
    sizes = stored(members.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    both = stored(members.join(sizes.where("n > 1"), "root"), "members")
    total, width = both.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    cell_size = max(CELL, math.ceil(3 * total * (width or 8) / PIVOT_BYTES))
    small, large = both.where(F.col("n") <= cell_size), both.where(F.col("n") > cell_size)
    zero = F.lit(0).cast("long")
    cells = small.select(F.col("root").alias("cell"), (zero - 1).alias("home"), zero.alias("ask"), F.lit(2).alias("side"), "vec_id", "x", "w")
    settled = None
    if not large.isEmpty():
        asked, settled = large_components(large.drop("n"), threshold, cell_size)
        cells = cells.union(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, ["cell", "home", "ask"]):
            side, ids, w, x = table.column("side").to_numpy(), table.column("vec_id").to_numpy(), table.column("w").to_numpy(), matrix(table.column("x"))
            asks, homes = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            n = np.zeros(len(asks), np.int64)
            step = max(1, (1 << 21) // max(1, len(homes)))
            for k in range(0, len(asks), step):
                part = asks[k : k + step]
                s = x[part] @ x[homes].T
                n[k : k + step] = (s >= threshold + 1e-9) @ w[homes]
                i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
                near = cosines(x[part[i]], x[homes[j]]) >= threshold
                np.add.at(n, k + i[near], w[homes[j[near]]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[asks]), pa.array(n)], names=["vec_id", "n"])

    keys = ["cell", "home", "ask"]
    counted = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "vec_id long, n long")
    counted = (counted.union(settled) if settled is not None else counted).groupBy("vec_id").agg(F.sum("n").alias("n"))
    return members.select("vec_id", "w").join(counted, "vec_id", "left").select("vec_id", (F.coalesce("n", "w") - 1).cast("long").alias("n_links"))


def recall(vectors: DataFrame, links: DataFrame, threshold: float, queries: int = 512) -> float:
    """Share of vectors whose links are all found, of about ``queries`` distinct vectors drawn by a hash of the id, as far
    as they link with another distinct one, against all rows. Each counts once, however large its group."""
    share = int(min(1.0, queries / max(1, vectors.count())) * (1 << 30))
    asked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).toPandas()
    ids = asked["vec_id"].to_numpy()
    if not len(ids):
        return 1.0
    block = vectors.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(asked["x"]), "<f8").reshape(len(ids), -1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                other, w = batch.column("vec_id").to_numpy(), batch.column("w").to_numpy()
                close = (block.value @ matrix(batch.column("x")).T >= threshold + 1e-9) & (ids[:, None] != other[None])
                nodes += close.sum(1)
                total += close @ w
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, nodes, total)], names=["vec_id", "nodes", "total"])

    there = vectors.mapInArrow(count, "vec_id long, nodes long, total long").groupBy("vec_id").agg(F.sum("nodes").alias("nodes"), F.sum("total").alias("total")).where("nodes > 0").toPandas()
    found = links.where(F.col("vec_id").isin([int(x) for x in ids])).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"]
    own = asked.set_index("vec_id")["w"] - 1
    whole_ = [found.get(v, 0) - own[v] >= n for v, n in zip(there["vec_id"], there["total"])]
    return float(np.mean(whole_)) if whole_ else 1.0


def links_of_length(rows: DataFrame, threshold: float, rounds: int, least_recall: float, most_rounds: int, seed: int) -> DataFrame:
    """(vec_id, n_links, component_id) of rows (vec_id, x) whose vectors all have one length."""
    vectors = distinct_vectors(rows)
    n = vectors.count()
    graph = stored(best_lists(first_graph(vectors, n, seed), threshold), "graph")
    done = 0
    while True:
        for done in range(done + 1, done + rounds + 1):
            graph = descend(graph, vectors, threshold, seed + done)
        roots = joined(graph, vectors, threshold, rounds, seed + done)
        members = stored(vectors.select("vec_id", "x", "w", "rep").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id")), "members")
        links = stored(exact_links(members.select("vec_id", "root", "x", "w"), threshold), "links")
        share = recall(vectors, links, threshold)
        LOG.info("%d different vectors, %d rounds: %.4f of the audited ones have all their links", n, done, share)
        if share >= least_recall:
            break
        if done >= most_rounds:
            raise RuntimeError(f"after {done} rounds {share:.3f} of the audited vectors have all their links, less than {least_recall}")
        graph = stored(best_lists(graph.union(first_graph(vectors, n, seed + 1000 * done)), threshold), "graph")
    least = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = members.select("vec_id", "root", "x").join(least, "root").join(links, "vec_id").select("x", "n_links", "component_id")
    return rows.join(placed, "x").select("vec_id", "n_links", "component_id")


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    rounds: int = 2,
    least_recall: float = 0.95,
    most_rounds: int = 8,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    The graph starts from blocks of neighbours along random hyperplanes, and each round joins neighbours of neighbours;
    saturated lists grow. Its edges at the threshold give components, and so do links found across these. Links are then
    counted exactly within each component, so no link reported is below the threshold, and dense groups need no long
    lists. The share of a few hundred vectors that have all their links, by brute force, decides on further rounds, which
    add blocks along new hyperplanes, and is logged; a RuntimeError tells that ``most_rounds`` were too few. Rows whose
    vector is null, zero, holds null or non-finite components, or whose id is null, link with nothing. Vectors of
    different lengths do not link; each length has a run of its own (embeddings have few). Rows that share an id are
    vectors of their own, with a row each in the result. An empty table gives an empty result.
    """
    rows = stored(unit_rows(table, id_col, vector_col), "rows")
    lengths = [r.n for r in rows.where("n > 0").groupBy("n").count().where("count > 1").orderBy("n").collect()]
    alone = rows.where(~F.col("n").isin(lengths)) if lengths else rows
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for n in lengths:
        out = out.union(links_of_length(rows.where(F.col("n") == n).select("vec_id", "x"), threshold, rounds, least_recall, most_rounds, seed))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
