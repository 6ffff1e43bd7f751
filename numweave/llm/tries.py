"""Prefix trie of conversations: nodes by prefix keys, double-array tries for each prefix shard, and the shared upper nodes merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import ordinal
from .common import by_key, stored

#: Nodes above this depth are merged level by level; each node at it is the root of a shard.
SHARD_DEPTH = 6
#: Conversations in a block, whose first one lends the others its first turns, and the bound of how many.
BLOCK, HEADS = 100, 6
KEY = ["k1", "k2", "depth"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def double_array(parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(BASE, CHECK, slot of each node) of a tree. Node 0 is the root, parents come before their children, and siblings
    have different codes. The child with code c of the node in slot s lies in slot BASE[s] + c, and CHECK there is s."""
    n = len(parent)
    size = 2 * n + int(code.max(initial=0)) + 2
    base, check, slot = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(n, np.int64)
    free = np.ones(size, bool)
    free[0] = False
    order = np.lexsort((code[1:], parent[1:])) + 1
    cut = np.flatnonzero(np.append(True, np.diff(parent[order]) != 0)) if n > 1 else np.zeros(0, np.int64)
    first = 1
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), n - 1]):
        kids = order[a:b]
        steps = code[kids] - code[kids[0]]
        while first < size and not free[first]:
            first += 1
        at = first
        while True:
            if at + steps[-1] >= size:
                base, check, free = (np.append(x, np.full(size, fill, x.dtype)) for x, fill in ((base, 0), (check, -1), (free, True)))
                size *= 2
            if free[at + steps].all():
                break
            at += 1
        own = slot[parent[kids[0]]]
        base[own] = at - code[kids[0]]
        slot[kids] = at + steps
        check[slot[kids]] = own
        free[slot[kids]] = False
    return base, check, slot


def levels(check: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of a double array by depth, from the root's children down: those whose CHECK is a slot of the level before."""
    used = np.flatnonzero(check >= 0)
    used = used[np.argsort(check[used], kind="stable")]
    owners = check[used]
    at = np.zeros(1, np.int64)
    while len(at):
        a, b = np.searchsorted(owners, at), np.searchsorted(owners, at, "right")
        n = b - a
        at = used[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if len(at):
            yield at


def subtree_sums(check: np.ndarray, *values: np.ndarray) -> None:
    """Turn the values of slots into the sums over their subtrees, from the lowest level up."""
    for at in reversed(list(levels(check))):
        for x in values:
            np.add.at(x, check[at], x[at])


def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, pos, code, len) of each turn: place in its conversation by turn (null first), role and text; the SHA-256 of role
    and text; code points of the text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = rows.withColumns({"code": F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), "len": F.length("text").cast("long")})
    return ordinal(rows, ["turn", "role", "text"], ("c",), "pos", keep=["c", "code", "len"])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth, code, len, m) of the rebuilt conversations' turns, depth from 1 to m; and (c, m) of all, turnless ones too.

    A conversation takes the first h turns of the first of its block of 100, h from its number's CRC-32, then its own
    without the first h.
    """
    sizes = stored(turns.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS))
    convs = sizes.withColumns({"h": h, "head": F.col("c") - F.col("c") % BLOCK})
    heads = sizes.select(F.col("c").alias("head"), F.col("n").alias("there"))
    convs = convs.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("m", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "convs")
    own = turns.join(convs.select("c", "h", "taken", "m"), "c").where("pos >= h")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "code", "len", "m")
    lent = turns.where((F.col("pos") < HEADS - 1) & (F.col("c") % BLOCK == 0)).withColumnRenamed("c", "head")
    lent = lent.join(convs.select("c", "head", "h", "m"), "head").where("pos < h").select("c", (F.col("pos") + 1).alias("depth"), "code", "len", "m")
    return own.union(lent), convs.select("c", "m")


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds k1, k2, which name the prefix down to each turn, and x1, x2, by which they differ from those of the prefix before.

    A prefix is the set of its (depth, turn) pairs, named by the exclusive or of two 64-bit hashes of each. The running
    values are made within range partitions; what lies before in a conversation is added after, so that a long
    conversation is not one task's.
    """
    rows = rows.withColumns({x: F.xxhash64("code", "depth", F.lit(k)) for k, x in ((1, "x1"), (2, "x2"))}).drop("code")
    dealt = stored(rows.repartitionByRange("c", "depth").withColumn("p", F.spark_partition_id()), "turns")
    inside = W.partitionBy("c", "p").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("c").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("c", "p").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    parts = parts.select("c", "p", F.bit_xor("y1").over(before).alias("b1"), F.bit_xor("y2").over(before).alias("b2")).where("b1 IS NOT NULL")
    whole = dealt.withColumns({"k1": F.bit_xor("x1").over(inside), "k2": F.bit_xor("x2").over(inside)}).join(parts, ["c", "p"], "left")
    added = {f"k{k}": F.col(f"k{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)}
    return stored(whole.withColumns(added).select("c", "depth", "len", "m", "k1", "k2", "x1", "x2"), "keys")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of nodes at which conversations end. Ids come sorted and are hashed as they come, so a
    node takes any number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

        for part in by_runs(batches, KEY):
            now = tuple(part.column(k)[0].as_py() for k in KEY)
            ids = ",".join(map(str, part.column("c").to_pylist())).encode()
            if now == node:
                state.update(b"," + ids)
                continue
            if node is not None:
                yield told()
            node, state = now, hashlib.sha256(ids)
        if node is not None:
            yield told()

    rows = ends.select(*KEY, "c").repartition(*KEY).sortWithinPartitions(*KEY, "c")
    return rows.mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def by_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which the keys are equal; a run of equal keys may come in several."""
    for batch in batches:
        if len(batch):
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.any([np.append(True, c[1:] != c[:-1]) for c in columns], axis=0)).tolist()
            for a, b in zip(new, [*new[1:], len(batch)]):
                yield batch.slice(a, b - a)


def shard_tries(nodes: DataFrame) -> DataFrame:
    """(k1, k2, depth, n_leaves, saved_tokens) of shared nodes (with root a1, a2 of their shard): one double array for each
    shard, over the dense numbers of its turns."""

    def pairs(table: pa.Table, *names: str) -> np.ndarray:
        return np.ascontiguousarray(np.stack([table.column(c).to_numpy() for c in names], 1)).view("V16").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_key(batches, ["a1", "a2"]):
            shard = shard.sort_by("depth")
            n = len(shard)
            _, name = np.unique(np.concatenate([pairs(shard, "k1", "k2"), pairs(shard, "p1", "p2")]), return_inverse=True)
            place = np.zeros(2 * n, np.int64)
            place[name[:n]] = np.arange(n)
            parent = place[name[n:]]
            parent[0] = 0
            _, code = np.unique(pairs(shard, "x1", "x2"), return_inverse=True)
            _, check, slot = double_array(parent, code)
            inner = np.bincount(parent[1:], minlength=n)
            kids, saved = shard.column("n_children").to_numpy(), np.zeros(len(check), np.int64)
            leaves = np.zeros(len(check), np.int64)
            leaves[slot] = kids - inner + (kids == 0)  # children outside the trie have one member each and lead to one leaf
            saved[slot] = shard.column("saved").to_numpy()
            subtree_sums(check, leaves, saved)
            yield pa.RecordBatch.from_arrays([*(shard.column(k).combine_chunks() for k in KEY), pa.array(leaves[slot]), pa.array(saved[slot])], names=[*KEY, "n_leaves", "saved_tokens"])

    columns = ["a1", "a2", *KEY, "p1", "p2", "x1", "x2", "n_children", "saved"]
    rows = nodes.select(*columns).repartition("a1", "a2").sortWithinPartitions("a1", "a2", "depth")
    return rows.mapInArrow(run, "k1 long, k2 long, depth long, n_leaves long, saved_tokens long")


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_depth: int = SHARD_DEPTH,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie
    of the rebuilt conversations (see ``rebuilt``).

    Nodes are counted by their prefix's key, combined map-side, so copies are one node before they meet. From
    ``shard_depth`` on, a node with one member heads a plain chain; the others, below one node at that depth, go to one
    double-array trie, which gives sums over subtrees. Nodes above are summed level by level over all shards. A task
    holds the shared nodes of one shard.

    Null roles and texts are empty; turns with one number, or none, come by role and text; repeated rows are turns of
    their own. Rows without a conversation are left out. No conversations: no rows.
    """
    rows, convs = rebuilt(stored(turn_rows(conversations, conv_col, turn_col, role_col, text_col), "places"))
    keyed = with_keys(rows)
    root = {k: F.lit(0).cast("long").alias(k) for k in ("k1", "k2", "depth", "x1", "x2", "len")}
    nodes = keyed.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), *(F.first(x).alias(x) for x in ("x1", "x2", "len")))
    top = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    nodes = nodes.unionByName(top.select(*root.values(), "n_convs", "conv_id"))
    nodes = stored(nodes.select("*", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved")), "nodes")

    up = (F.col("depth") + 1).alias("depth")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), up, F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0")
    kids = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = ends_digest(keyed.where("depth = m").unionByName(convs.where("m = 0").select("c", *root.values()), allowMissingColumns=True))
    placed = nodes.join(parents, ["p1", "p2", "depth"], "left").join(kids, KEY, "left").join(ends, KEY, "left")
    placed = stored(placed.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))}), "placed")

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    deep = placed.where(F.col("depth") >= shard_depth)
    shared = deep.where("n_convs > 1").join(keyed.where(F.col("depth") == shard_depth).select(F.col("c").alias("conv_id"), F.col("k1").alias("a1"), F.col("k2").alias("a2")), "conv_id")
    lone = deep.where("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    level = stored(lone.unionByName(deep.join(shard_tries(shared), KEY)), "level")
    done = level.select(out)
    for depth in range(shard_depth - 1, -1, -1):
        sums = level.where(F.col("depth") == depth + 1).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("kept"))
        level = placed.where(F.col("depth") == depth).join(sums, ["k1", "k2"], "left")
        level = stored(level.withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.col("saved") + F.coalesce("kept", F.lit(0))}), "level")
        done = done.union(level.select(out))
    return done
