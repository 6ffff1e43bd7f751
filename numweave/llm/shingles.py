"""Near duplicates by exact Jaccard similarity of word shingles: SimHash links, and pairs that share a prefix shingle.

SimHash and its vantage-point trees (``simhash.links``) find most near copies cheaply, but a similarity of 0.8 can leave
far more than a few bits different. So its links, verified, are where the exact search starts from: of two texts that
they do not join, those meet that share one of the first shingles of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import fresh, stored
from .components import components

SEED = simhash.SEED
#: Slots of the table that tells common shingles from rare ones, and of one of its blocks. It touches the order of shingles
#: only, so the work and never the result.
SLOTS, SLOT_BLOCK = 1 << 22, 1 << 14
#: Bits of a set's bitmap, which bounds what two sets share.
BITS = 1024
#: Most ids of texts that are broadcast.
FEW = 1 << 20
#: Texts of each prefix shingle that all others there are compared with first.
CENTRES = 3


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending. Words as in SimHash; fewer words than a shingle has are one shingle."""
    return set_and_print(text, shingle)[0]


def set_and_print(text: str | None, shingle: int) -> tuple[np.ndarray, int]:
    """The shingle set, and the SimHash fingerprint of all shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), 0
    hashes = simhash.digests(words, shingle)
    return np.unique(hashes), simhash.majority(hashes)


def node_of(found: np.ndarray) -> int:
    """A shingle set's name, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def bitmap(found: np.ndarray) -> bytes:
    """The places of a set's shingles modulo BITS."""
    out = np.zeros(BITS, bool)
    out[(found % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def prefix_size(n: int, least: float) -> int:
    """Two sets within the similarity share one of so many first shingles, in any one order of all shingles."""
    return n - math.ceil(least * n - 1e-9) + 1


def slot_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of all documents fall into each of SLOTS slots of their hash, in steps of a logarithm: each task
    counts its own, blocks of slots are added up, and a byte a slot is what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for k in range(0, len(batch), 256):
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column("text").slice(k, 256)]
                slots, often = np.unique(np.concatenate(sets) % np.uint64(SLOTS), return_counts=True)
                counts[slots.astype(np.int64)] += often.astype(np.uint32)
        blocks = counts.reshape(-1, SLOT_BLOCK)
        for k in np.flatnonzero(blocks.any(1)).tolist():
            planes = np.ascontiguousarray(blocks[k].view(np.uint8).reshape(-1, 4).T)  # upper bytes are mostly 0, which Spark packs
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([planes.tobytes()])], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, planes in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                totals[k] = totals.get(k, 0) + counts.astype(np.int64)
        steps = [np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(steps, pa.binary())], names=["block", "counts"])

    schema, out = "block int, counts binary", np.zeros(SLOTS, np.uint8)
    got = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    for k, steps in zip(got.column("block").to_pylist(), got.column("counts").to_pylist()):
        out[k * SLOT_BLOCK : (k + 1) * SLOT_BLOCK] = np.frombuffer(steps, np.uint8)
    return out


def prefixes(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, node, fp, n, bits, keys): the set's name, the fingerprint, the set's size and bitmap, and its first
    shingles, those of rarely hit slots first."""
    told = docs.sparkSession.sparkContext.broadcast(slot_counts(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = told.value
        for batch in batches:
            nodes, prints, sizes, bits, keys = [], [], [], [], []
            for x in batch.column("text"):
                found, fp = set_and_print(x.as_py(), shingle)
                nodes.append(node_of(found))
                prints.append(fp)
                sizes.append(len(found))
                bits.append(bitmap(found))
                found = found[np.argsort(often[(found % np.uint64(SLOTS)).astype(np.int64)], kind="stable")]
                keys.append(found[: prefix_size(len(found), least)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "node", "fp", "n", "bits", "keys"])

    return docs.mapInArrow(run, "doc_id long, node long, fp long, n int, bits binary, keys binary")


def dealt(nodes: DataFrame) -> DataFrame:
    """(key, node, root, n, place): a row for each prefix shingle of nodes (columns node, root, n, keys)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, "<i8") for x in batch.column("keys").to_pylist()]
            if not keys:
                continue
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "root", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *map(pa.array, columns), pa.array(place.astype(np.int32))], names=["key", "node", "root", "n", "place"])

    return nodes.select("node", "root", "n", "keys").mapInArrow(deal, "key long, node long, root long, n int, place int")


def reach(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and bitmaps let sets i and j reach the similarity: a bit that only one has is a shingle the other lacks."""
    x, y = bits[i], bits[j]
    both = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return both * (1 + least) >= least * (n[i] + n[j]) - 1e-6


def shared(entries: DataFrame, least: float, centres: int | None) -> DataFrame:
    """Pairs (a, b) of nodes of ``entries`` (see ``dealt``, and ``bits``, the bitmaps or nulls) that share a shingle, can
    reach the similarity by size, by the shingle's places and by bitmaps, and have different roots. With ``centres``, of each shingle only pairs with its first few nodes,
    and a row with its ``key`` alone where that leaves pairs out; without, all pairs."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [x for x in batches if len(x)]):
            return
        key, node, root, n, place = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("key", "node", "root", "n", "place"))
        order = np.lexsort((node, key))
        order = order[np.append(False, key[order][1:] == key[order][:-1]) | np.append(key[order][1:] == key[order][:-1], False)]
        key, node, root, n, place = (x[order] for x in (key, node, root, n, place))
        n, rest = n.astype(np.int64), n.astype(np.int64) - place
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        out, more, size = [], [], 0
        bits = None
        if len(key) and not any(x.column("bits").null_count for x in held):
            bits = np.frombuffer(b"".join(y for x in held for y in x.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]

        def pairs() -> pa.RecordBatch:
            both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
            left = np.array(more, np.int64)
            none = pa.nulls(len(left), pa.int64())
            columns = [pa.concat_arrays([pa.array(both[:, k]), none]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(left)])], names=["a", "b", "key"])

        for a, b in zip(cut, [*cut[1:], len(key)]):
            if (root[a:b] == root[a]).all():
                continue
            step = max(1, (1 << 20) // (b - a))
            last = b - 1 if centres is None else min(b - 1, a + centres)
            for k in range(a, last, step):
                i = np.arange(k, min(k + step, last))
                good = np.arange(a, b)[None] > i[:, None]
                good &= np.minimum(rest[i, None], rest[None, a:b]) * (1 + least) >= least * (n[i, None] + n[None, a:b]) - 1e-6
                good &= root[i, None] != root[None, a:b]
                x, y = np.nonzero(good)
                if bits is not None:
                    near = np.concatenate([np.zeros(0, bool), *(reach(n, bits, i[x[k : k + 50_000]], a + y[k : k + 50_000], least) for k in range(0, len(x), 50_000))])
                    x, y = x[near], y[near]
                out.append(np.stack([node[i[x]], node[a + y]], 1))
                size += len(x)
            if centres is not None and b - a > centres + 1:
                more.append(key[a])
            if size > 1 << 20:
                yield pairs()
                out, more, size = [], [], 0
        if size or more:
            yield pairs()

    return stored(entries.repartition("key").mapInArrow(meet, "a long, b long, key long").distinct(), "pairs")


def possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps let reach the similarity: a bit that only one set has is a shingle that the
    other lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("x", "y"))
            shared = np.minimum(n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(shared * (1 + least) >= least * (n + m) - 1e-6))

    ends = pairs.join(nodes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return stored(ends.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"), "possible")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity. The sets are made again, of the texts of possible pairs
    only."""
    pairs = possible(pairs, nodes, least)
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node"), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "x"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = both >= least * (len(x) + len(y) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    ids = asked.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if asked.count() <= FEW else ids  # few ids: the texts stay where they are
    texts = docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "node long, x binary")
    texts = stored(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = pairs.join(texts.select(F.col("node").alias("a"), "x"), "a").join(texts.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(close, "a long, b long"), "links")


def print_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints (column fp) are equal or linked within the radius, by the trees of
    ``simhash.links``: each node with the first of its fingerprint, and the first ones of linked fingerprints."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "prints")
    same = nodes.join(first, "fp").where("node != lead").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b"))
    near = simhash.links(first.select("fp"), radius)
    near = near.join(first.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return stored(same.union(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct(), "near")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, component_id) of each row with an id: the smallest id that links reach.

    Texts link at a Jaccard similarity of ``least`` or more between their sets of ``shingle`` words. No pair is missed:
    two such sets share a shingle of their prefixes. Equal sets are one node. First nodes meet whose fingerprints are
    within ``radius`` bits; then those that share a prefix shingle and are not yet in one component meet a few there, and
    in the end all. No pair counts that is under ``least``, whatever its fingerprints. Texts without words (null, empty)
    have the empty set and link with each other only. Rows with a null id are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    found = stored(prefixes(docs, shingle, least), "prefixes")
    nodes = stored(found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "nodes")
    links = verified(print_pairs(nodes, radius), docs, nodes, shingle, least)
    rooted = nodes.select("node", "n", "keys").join(stored(components(links), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = shared(dealt(rooted).withColumn("bits", F.lit(None).cast("binary")), least, CENTRES)
    links = stored(links.union(verified(met.where("key IS NULL").select("a", "b"), docs, nodes, shingle, least)), "links")
    roots = stored(components(links), "roots")
    rooted = nodes.select("node", "n", "keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = dealt(rooted).join(met.where("key IS NOT NULL").select("key"), "key", "left_semi").join(nodes.select("node", "bits"), "node")
    more = shared(again, least, None).select("a", "b").join(met, ["a", "b"], "left_anti")
    roots = components(links.union(verified(stored(more, "more"), docs, nodes, shingle, least)))
    placed = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return found.select("doc_id", "node").join(placed.join(least_id, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without what links to a smaller id: one document of each group stays. Rows with a null id stay; rows that
    share an id stay or go together."""
    name = fresh(docs, "gone_id")
    gone = near_duplicates(docs, id_col, text_col, shingle, least).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
