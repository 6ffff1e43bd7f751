"""Connected components of an edge table, by alternating large and small stars, with each task's edges contracted first."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task contracts at once.
BLOCK = 1 << 20


def label(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Least reachable place of each of n places."""
    labels = np.arange(n) if labels is None else labels
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b whose components are those of ``edges``: tasks take their edges as they lie, block by block,
    and tie each node to the least that it reaches within the block. No shuffle; loops and null ends go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) >= BLOCK):
                block, held = held, []
                a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in block]) for c in ("a", "b"))
                names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                least = label(len(names), at[: len(a)], at[len(a) :])
                tied = np.flatnonzero(least != np.arange(len(names)))
                kind = block[0].schema.field("a").type
                yield pa.RecordBatch.from_arrays([pa.array(names[tied], kind), pa.array(names[least[tied]], kind)], names=["a", "b"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.where("a != b").select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def told_apart(edges: DataFrame) -> Row:
    """Count and checksum of a table of edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def star_round(edges: DataFrame) -> DataFrame:
    """One large star and one small star over distinct edges (a, b) with a > b.

    Large: each node hands its larger neighbours to the least node around it. Small: each node and its smaller
    neighbours go to the least of them. Minima are combined map-side; joins are on one node, which AQE can split.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node that it reaches. edges: columns a, b of one type.

    Each round is written to the shared folder, so lineage stays short. Its stars are contracted within each task, which
    only ever gives a node a smaller one: where edges lie in few tasks a round or two are all. Null ends and loops are no
    edges; an empty table gives an empty one. Stops when a round leaves the edges as they were, all stars then.
    """
    edges, before = stored(contract(edges), "edges"), None
    now = told_apart(edges)
    for _ in range(most_rounds):
        if now == before or not now[0]:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges, before = stored(contract(star_round(edges)), "edges"), now
        now = told_apart(edges)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
