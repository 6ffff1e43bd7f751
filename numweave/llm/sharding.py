"""Sharding by a weighted hash tree: region, rack and shard are drawn one after another. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ordinal
from .common import fresh

#: A node: (name, weight, children); a shard's children are its number.
Node = tuple[str, float, "int | list"]
#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def hash_tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Node]:
    """Regions of ``racks`` racks of ``per_rack`` shards each; what is left over makes a region of its own for each shard.

    A node weighs as much as it has shards. Its name says where it stands, not how many there are.
    """
    full = shards // (racks * per_rack)
    region = lambda r: [(f"{r}.{k}", float(per_rack), [(f"{r}.{k}.{s}", 1.0, (r * racks + k) * per_rack + s) for s in range(per_rack)]) for k in range(racks)]
    tree: list[Node] = [(str(r), float(racks * per_rack), region(r)) for r in range(full)]
    for shard in range(full * racks * per_rack, shards):
        tree = grown(tree, shard)
    return tree


def grown(tree: list[Node], shard: int, weight: float = 1.0) -> list[Node]:
    """The tree with one more shard, in a region of its own. All draws among the regions before stay as they are, so rows
    move into the new shard only, and no region, rack or shard hands rows to another that was there before."""
    name = f"s{shard}"
    return [*tree, (name, weight, [(f"{name}.0", weight, [(f"{name}.0.0", weight, shard)])])]


def drawn(key: Column, nodes: Sequence[Node]) -> Column:
    """Index of the node that the key draws: the least -ln(u) / weight, u a number in (0, 1) from the hash of key and name.

    With that law each node is drawn in proportion to its weight, and a change of one weight moves keys into or out of
    that node only. Nodes without weight are never drawn; of equal draws the first wins.
    """
    live = [(k, name, weight) for k, (name, weight, _) in enumerate(nodes) if weight > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    draw = lambda name: (F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(name))), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * DIGITS)
    cells = [F.struct((-F.log(draw(name)) / weight).alias("x"), F.lit(k).alias("k")) for k, name, weight in live]
    return F.array_min(F.array(*cells))["k"]


def shard_of(key: Column, tree: list[Node]) -> Column:
    """The shard (int) that the key comes to, down the levels. Only the draws on its own way are made."""

    def below(nodes: Sequence[Node]) -> Column:
        if all(isinstance(x[2], int) for x in nodes) and len(nodes) == 1:
            return F.lit(nodes[0][2])
        inner = [F.lit(x[2]) if isinstance(x[2], int) else below(x[2]) for x in nodes]
        chosen = drawn(key, nodes)
        return reduce(lambda rest, k: F.when(chosen == k, inner[k]).otherwise(rest), range(len(nodes) - 1), inner[-1])

    return below(tree).cast("int")


def key_of(id_col: str | Column) -> Column:
    """An id in decimal; a null id is the empty key."""
    return F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))


def with_shard(docs: DataFrame, tree: list[Node], id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row: a function of its id and the tree, so no shuffle. A column of that name gives way."""
    return docs.withColumn(name, shard_of(key_of(id_col), tree))


def placements(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    The law is ``key``: id and tree decide, whatever other rows there are. size: UTF-8 bytes and one more; slot: place
    in the shard by id, then text; grown_shard: where the row is with one more shard. A null text is empty; null ids are one key, so
    they share a shard, as do rows that share an id (the law says so); equal texts under several ids spread. Slots come
    from a range shuffle of these narrow rows in which equal keys are dealt out, so no shard and no id is one task's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tree = hash_tree(shards)
    key = key_of(id_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown(tree, shards)).alias("grown_shard"),
    )
    placed = ordinal(rows, ["doc_id", "text_crc32", "size"], ("shard",), "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: list[Node], id_col: str = "doc_id", files: int = 8) -> None:
    """Write ``docs`` as Parquet, a folder ``shard=N`` for each shard with rows, each in up to ``files`` files of like size."""
    name, salt = fresh(docs, "shard"), fresh(docs, "salt")
    rows = with_shard(docs, tree, id_col, name).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    rows.repartition(F.col(name), F.col(salt)).drop(salt).write.partitionBy(name).parquet(path)
