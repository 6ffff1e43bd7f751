"""SimHash near-dedup: fingerprints within a Hamming radius, found through vantage-point trees over bit blocks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .components import components, label

SEED = 42
#: Most fingerprints that a tree is fitted on (the index only; every fingerprint is routed through it).
SAMPLE = 1 << 17
#: Fingerprints that a task sends through the trees at once.
VISITORS = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is set if over half of the shingles' XXH64 have it. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    return majority(digests(words, shingle))


def digests(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle has are one shingle."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    return int(np.packbits(2 * bits.sum(0, np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks(radius: int) -> list[tuple[np.uint64, int]]:
    """(mask, block radius): two fingerprints within the radius are within the block radius in one of the two halves."""
    half = (1 << 32) - 1
    return [(np.uint64(half), radius // 2), (np.uint64(half << 32), radius // 2)]


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def choose(points: np.ndarray, mask: np.uint64, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage point and bound of a node: of a few tries, the one with the fewest points at the boundary, where a query
    must look on both sides. None where no try leaves a fifth of the points on either side."""
    best = None
    for vantage in rng.choice(points, 6):
        count = np.cumsum(np.bincount(distance(points, vantage, mask), minlength=66)) / len(points)
        for bound in range(radius, 64 - radius):
            if 0.2 <= count[bound] <= 0.8:
                both = count[bound + radius] - count[bound - radius]
                cost = both + abs(count[bound] - 0.5) / 2
                if best is None or cost < best[0]:
                    best = (cost, vantage, bound)
    return best and best[1:]


def grow(points: np.ndarray, mask: np.uint64, radius: int, leaf: int, seed: int) -> list:
    """A tree as nested lists [vantage, bound, near, far]; an int is a leaf's number."""
    rng, leaves = np.random.default_rng(seed), [0]

    def node(x: np.ndarray):
        found = choose(x, mask, radius, rng) if len(x) > leaf else None
        if found is None:
            leaves[0] += 1
            return leaves[0] - 1
        near = distance(x, found[0], mask) <= found[1]
        return [found[0], found[1], node(x[near]), node(x[~near])]

    return [node(points), leaves[0]]


def route(tree, points: np.ndarray, mask: np.uint64, radius: int, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, places of points, whether the leaf is their home). A point visits every leaf that can hold a point within
    the block radius: |d(v,x) - d(v,y)| <= d(x,y), so the far side is left out where d + radius <= bound, and so on."""
    stack = [(tree, np.arange(len(points)) if at is None else at, np.ones(len(points) if at is None else len(at), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        d = distance(points[at], node[0], mask).astype(np.int64)
        near, far = d - radius <= node[1], d + radius > node[1]
        stack += [(node[2], at[near], home[near] & (d[near] <= node[1])), (node[3], at[far], home[far] & (d[far] > node[1]))]


def shard_forest(points: np.ndarray, home: np.ndarray, mask: np.uint64, block_radius: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, least point linked to it) of a shard: a spanning forest of its links between home points and all.
    Large shards are split again by a tree of their own; the forest keeps the output as small as the shard."""
    labels = np.arange(len(points))
    inside = np.flatnonzero(home)
    tree, leaf = 0, 0
    if len(inside) > 512:
        tree = grow(points[inside], mask, block_radius, 256, len(inside))[0]
    for leaf, at, own in route(tree, points, mask, block_radius):
        mine = at[own & home[at]]
        step = max(1, min(64, (1 << 21) // max(1, len(at))))
        for k in range(0, len(mine), step):
            some = mine[k : k + step]
            apart = labels[some][:, None] != labels[at][None]  # what is already one component needs no further links
            i, j = np.nonzero((np.bitwise_count(points[some, None] ^ points[None, at]) <= radius) & apart)
            labels = label(len(points), some[i], at[j], labels)
    linked = np.flatnonzero(labels != np.arange(len(points)))
    return points[linked], points[labels[linked]]


def links(distinct: DataFrame, radius: int = 3, sample: int = SAMPLE, leaf: int = 400) -> DataFrame:
    """(a, b) edges over distinct fingerprints (column fp) whose components are those of all pairs within the radius.

    A tree per bit half is fitted on a bounded sample; each fingerprint has one home shard in each tree and visits the
    shards across a boundary within the block radius. Shards get a row for each visit; pairs are tested exactly.
    """
    n = distinct.count()
    share = min(1.0, sample / max(1, n))
    drawn = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()["fp"].to_numpy(np.int64)
    points = np.sort(drawn).view(np.uint64)
    trees, first = [], 0
    for k, (mask, r) in enumerate(blocks(radius)):
        tree, leaves = grow(points, mask, r, max(32, int(leaf * share)), k) if len(points) else (0, 1)
        trees.append((tree, mask, r, first))
        first += leaves
    starts = np.array([x[3] for x in trees])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch.column("fp").to_numpy(zero_copy_only=False))
            if held and (batch is None or sum(map(len, held)) >= VISITORS):
                x, held = np.concatenate(held).view(np.uint64), []
                for tree, mask, r, start in trees:
                    shards, places, homes = zip(*((np.full(len(at), start + leaf, np.int32), at, home) for leaf, at, home in route(tree, x, mask, r))) if len(x) else ((), (), ())
                    if shards:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(x[np.concatenate(places)].view(np.int64)), pa.array(np.concatenate(homes))], names=["shard", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [x for x in batches if len(x)]):
            return
        shard, fp, home = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("shard", "fp", "home"))
        order = np.lexsort((fp, shard))
        shard, fp, home = shard[order], fp[order].view(np.uint64), home[order]
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for a, b in zip(cut, [*cut[1:], len(shard)]):
            _, mask, r, _ = trees[np.searchsorted(starts, shard[a], "right") - 1]
            x, y = shard_forest(fp[a:b], home[a:b], mask, r, radius)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    visits = distinct.select("fp").mapInArrow(visit, "shard int, fp long, home boolean")
    return visits.repartition("shard").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: 16 hex digits, and the smallest id that links reach.

    Fingerprints link at ``radius`` differing bits or fewer. Equal fingerprints are one node from the start, so groups
    of copies never meet as pairs. Texts without words (null, empty) have fingerprint zero and link like any other.
    Rows with a null id get a fingerprint but lend no id. Repeated rows come out as often as they went in.
    """
    found = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = placed.join(least, "root").select("fp", "component_id")
    return found.join(ids, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without what links to a smaller id: one document of each group stays. Rows with a null id stay; rows that
    share an id stay or go together."""
    name = fresh(docs, "gone_id")
    gone = near_duplicates(docs, id_col, text_col, shingle, radius).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
