"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_size long, step_group long"
)


def encoder(path: str):
    """Text -> ids of a byte-level BPE file of the tokenizers library, by the ranks file of the same vocabulary beside it."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode(text, allowed_special="all")


class Packer:
    """Packs the pieces of one task. Every full sequence has a tier's size; what is left at the end is cut at powers of two.

    A piece is (length, serial number, doc, start, ids, the document's tokens); a pool holds the pieces of one tier in order.
    """

    def __init__(self, first_id: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tuple(sorted(tiers)), step_tokens
        self.next_id = self.next_group = first_id
        self.open_groups: dict[int, int] = {}  # group -> tokens that it still takes
        self.pools: list[list[tuple]] = [[] for _ in tiers]
        self.tokens = self.serial = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, window = len(ids), self.tiers[-1]
        full = n - n % window
        for at in range(0, full, window):
            self._emit([(window, 0, doc_id, at, ids[at : at + window], n)], window)
        if n > full:
            self._route(n - full, doc_id, full, ids[full:], n)
            self.tokens += n - full

    def _route(self, n: int, *rest) -> None:
        self.serial += 1
        bisect.insort(self.pools[bisect.bisect_left(self.tiers, n)], (n, self.serial, *rest))

    def _emit(self, pieces: list[tuple], size: int) -> None:
        group = next((g for g, room in self.open_groups.items() if room >= size), None)
        if group is None:
            group, self.next_group = self.next_group, self.next_group + 1
            self.open_groups[group] = self.step_tokens
        self.open_groups[group] -= size
        if not self.open_groups[group]:
            del self.open_groups[group]
        offset = 0
        for n, _, doc, start, ids, total in pieces:
            self.out.append((doc, start, n, zlib.crc32(ids.tobytes()), total, self.next_id, offset, size, group))
            offset += n
        self.next_id += 1

    def _fill(self, pieces: list, room: int, most: int) -> int:
        """Fill the room from the tiers up to ``most``: the longest piece that fits, else cut the shortest."""
        while room:
            for pool in self.pools[most::-1] if most >= 0 else ():
                if at := bisect.bisect_right(pool, (room, self.serial + 1)):
                    pieces.append(pool.pop(at - 1))
                    room -= pieces[-1][0]
                    break
            else:
                pool = next((x for x in self.pools[: most + 1] if x), None)
                if pool is None:
                    break
                n, k, doc, start, ids, total = pool.pop(0)
                pieces.append((room, k, doc, start, ids[:room], total))
                self._route(n - room, doc, start + room, ids[room:], total)
                room = 0
        return room

    def pack(self, last: bool = False) -> None:
        """Long tiers first; gaps take shorter tiers. A sequence that stays open waits for more documents, or is cut up."""
        waiting: list[tuple] = []
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.pools[k]:
                pieces = [self.pools[k].pop()]
                room = self._fill(pieces, self.tiers[k] - pieces[0][0], k - 1)
                if self._fill(pieces, room, k):
                    waiting += pieces
                else:
                    self._emit(pieces, self.tiers[k])
        for n, _, *rest in waiting:
            self._route(n, *rest)
        self.tokens = sum(x[0] for x in waiting)
        while last and self.tokens:
            size = min(1 << (self.tokens.bit_length() - 1), self.tiers[-1])
            pieces = []
            self._fill(pieces, size, len(self.tiers) - 1)
            self._emit(pieces, size)
            self.tokens -= size

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(names), names=names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 16_384,
    buffer_tokens: int = 400_000,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    A document (null text: empty) is its ids and ``end_id``. What is longer than the largest tier is cut to full
    windows; the remainder goes to the smallest tier that holds it. Each buffer of documents is packed from the long
    tier down: the longest document opens a sequence, shorter tiers fill its gap, a last document is cut to close it.
    Full sequences have a tier's size; the few left at a task's end are cut at powers of two, so nothing is padded.
    Step groups take sequences of any tier until each holds ``step_tokens``. Tasks pack on their own: no shuffle, and
    a lost task packs the same again. Each input row, repeated ones and null ids included, is packed by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), None
        for batch in batches:
            if packer is None and len(batch):
                packer = Packer(batch.column("p")[0].as_py() << 33, tiers, step_tokens)
            for doc, text in zip(batch.column("d").to_pylist(), batch.column("t")):
                packer.add(doc, np.array(encode(text.as_py() or "") + [end_id], "<u4"))
                if packer.tokens >= buffer_tokens:
                    packer.pack()
                    yield packer.batch()
            if packer and len(packer.out) > 4096:
                yield packer.batch()
        if packer:
            packer.pack(last=True)
            yield packer.batch()

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), F.spark_partition_id().cast("long").alias("p"))
    return rows.mapInArrow(run, SCHEMA)
