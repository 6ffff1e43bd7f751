"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of up to three words, edges the four-word runs that join them, weighted by how often they occur. Each word
of a text starts one edge, cut short where its piece ends; a shorter phrase then occurs as often as the edges that flow
out of its node, and those cut short there, together weigh.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, chunks, stored, utf8
from .components import components

#: Most words of a phrase.
LONGEST = 4
#: Bytes of text that a task encodes at once; a longer text is cut between pieces, where no phrase reaches across.
PART = 4_000_000
#: Words of a part whose edges are sorted at once.
SLICE = 1 << 18
#: Edges of a bucket, about; a pair of words that may have more is dealt out over several.
BUCKET = 1 << 20
#: The lowest bit of a word's code: its piece ends with it.
END = np.uint32(1)
#: Marks in an edge's count: its pair, or its first three words, may lie in several buckets.
SPLIT_PAIR, SPLIT_THREE = np.uint64(1 << 31), np.uint64(1 << 30)
COUNT = np.uint64((1 << 30) - 1)
WORDS = ["lang", "word", "n", "part", "place"]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 in a word, 1 blank, 2 the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[*b".,;:!?", *range(10, 14)]] = 2


def words_of(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, last) of the words of texts given by bytes and offsets; last: the piece ends before the next word."""
    kind = KIND[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[1:-1] = (kind[1:] == 0) != (kind[:-1] == 0)
    edge[at] = edge[0] = edge[-1] = True
    bounds = np.flatnonzero(edge)
    inside = kind[bounds[:-1]] == 0
    starts, ends = bounds[:-1][inside], bounds[1:][inside]
    stops = np.sort(np.concatenate([np.flatnonzero(kind == 2), at]))
    last = np.ones(len(starts), bool)
    if len(starts):
        last[:-1] = np.searchsorted(stops, ends[:-1]) < np.searchsorted(stops, starts[1:], "right")
    return starts, ends, last


def cut_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) with texts of at most about PART bytes: longer ones in parts, cut after the end of a piece."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text").cast(pa.large_binary())).to_numpy(zero_copy_only=False)
        if not len(batch) or np.nanmax(sizes) <= PART:
            yield batch
            continue
        for k, size in enumerate(sizes):
            row = batch.slice(k, 1)
            if not size > PART:
                yield row
                continue
            data = np.frombuffer(row.column("text")[0].as_py().encode(), np.uint8)
            stops = np.append(np.flatnonzero(KIND[data] == 2) + 1, len(data))
            a = 0
            while a < len(data):
                b = int(stops[max(np.searchsorted(stops, a + PART, "right") - 1, np.searchsorted(stops, a, "right"))])
                yield pa.RecordBatch.from_arrays([row.column("lang"), pa.array([data[a:b].tobytes().decode()], batch.column("text").type)], names=["lang", "text"])
                a = b


def encoded(docs: DataFrame) -> DataFrame:
    """(part, codes, words) of docs (lang, text): the words of some texts as numbers, doubled, plus 1 at a piece's end; and
    for each number its language, word and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, chunk in enumerate(chunks(cut_long(batches), "text", PART)):
            text, at = utf8(chunk.column("text").combine_chunks())
            text = LOWER[text]
            starts, ends, last = words_of(text, at)
            langs = pc.dictionary_encode(chunk.column("lang").combine_chunks())
            offsets = np.append(0, np.cumsum(ends - starts))
            column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text[KIND[text] == 0].tobytes()))
            found = pc.dictionary_encode(column)
            lang = langs.indices.to_numpy()[np.searchsorted(at, starts, "right") - 1].astype(np.int64)
            both, number, count = np.unique(lang << 32 | found.indices.to_numpy().astype(np.int64), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # common words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            codes = rank[number] << END | last
            both, count = both[order], count[order]
            rows = pa.StructArray.from_arrays([langs.dictionary.take(pa.array(both >> 32)), found.dictionary.take(pa.array(both & 0xFFFFFFFF)).cast(pa.string()), pa.array(count.astype(np.int64))], names=["lang", "word", "n"])
            words = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([pa.array([first | k]), pa.array([planes(codes)], pa.binary()), words], names=["part", "codes", "words"])

    return docs.mapInArrow(run, "part long, codes binary, words array<struct<lang: string, word: string, n: long>>")


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte: first the lowest bytes of all. The upper ones are mostly 0, which Spark packs."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def numbered(words: DataFrame, least: int) -> DataFrame:
    """(part, place, id, f, lang, word): the rows (lang, word, n, part, place) of words that occur ``least`` times or more, f
    times, with numbers from 1 of their own; lang and word only in one row of each word, the others null."""
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, held = TaskContext.get().partitionId() + 1, None
        for batch in itertools.chain(batches, [None]):
            tables = [pa.table({c: x.column(c) for c in WORDS}) for x in (held, batch) if x is not None and len(x)]
            if not tables:
                continue
            table = pa.concat_tables(tables).combine_chunks()
            new = ~pc.and_(*(pc.equal(table.column(c)[1:], table.column(c)[:-1]) for c in ("lang", "word"))).to_numpy().astype(bool)
            at = np.append(0, np.flatnonzero(new) + 1)
            if batch is not None:  # the last word may go on in the next batch
                held = table.slice(int(at[-1]))
                table, at = table.slice(0, int(at[-1])), at[:-1]
                if not len(at):
                    continue
            f = np.add.reduceat(table.column("n").to_numpy(), at)
            size = np.diff(np.append(at, len(table)))
            often = f >= least
            number = given + parts * np.arange(int(often.sum()))
            given += parts * len(number)
            if given >= 1 << 31:
                raise ValueError("more frequent words than numbers of 31 bits")
            table = table.filter(pa.array(np.repeat(often, size)))
            f, size = f[often], size[often]
            one = np.zeros(len(table), bool)
            one[np.cumsum(size) - size] = True
            names = [pc.if_else(pa.array(one), table.column(c), pa.scalar(None, pa.string())) for c in ("lang", "word")]
            columns = [table.column("part"), table.column("place"), pa.array(np.repeat(number, size).astype(np.int32)), pa.array(np.repeat(f, size)), *names]
            yield from pa.table(columns, names=["part", "place", "id", "f", "lang", "word"]).combine_chunks().to_batches()

    rows = words.select(WORDS).repartition(parts, "lang", "word").sortWithinPartitions("lang", "word")
    return rows.mapInArrow(run, "part long, place int, id int, f long, lang string, word string")


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of numbers."""
    x = x.astype(np.uint64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def edges_of(slot: np.ndarray, last: np.ndarray, starts: int, own: np.ndarray, f: np.ndarray, buckets: int, bucket: int) -> list[np.ndarray]:
    """[bucket, a, b, n] of the distinct edges from the first ``starts`` words, in this order: a holds the first two words,
    b the next two, 0 where the piece or the run of frequent words ends. ``slot`` names words by their places in ``own``
    (ascending numbers) and ``f`` (their counts), 0 no frequent word.

    A pair of words goes to one bucket, by its hash, unless the rarer of the two could give it more than ``bucket``
    edges: then its third words are spread (n has SPLIT_PAIR), and where one of these could have as many, its fourth
    words too (SPLIT_THREE).
    """
    n = len(slot)
    w = np.zeros((LONGEST, n), np.uint32)
    alive = slot > 0
    for k in range(LONGEST):
        w[k, : n - k] = np.where(alive[: n - k], slot[k:], 0)
        alive[: max(0, n - k - 1)] &= ~last[k : max(k, n - 1)] & (slot[k + 1 :] > 0)
        alive[max(0, n - k - 1) :] = False
    w = w[:, :starts]
    w = w[:, w[1] > 0].astype(np.uint64)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a, b = w[0] << half | w[1], w[2] << half | w[3]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    n, a, b = np.diff(np.append(at, len(a))).astype(np.uint64), a[at], b[at]
    of = lambda table, x: table[x.astype(np.int64)]
    pair = np.minimum(of(f, a >> half), of(f, a & low))
    triple = np.minimum(pair, of(f, b >> half))
    a, b = (of(own, x >> half) << half | of(own, x & low) for x in (a, b))
    spread = np.maximum(1, -(-pair // bucket)).astype(np.uint64)
    salt = np.where(triple > bucket, mixed_bits(b), mixed_bits(b >> half)) % spread
    home = (mixed_bits(mixed_bits(a) + salt) % np.uint64(buckets)).astype(np.int64)
    n |= np.where(pair > bucket, SPLIT_PAIR, 0) | np.where(triple > bucket, SPLIT_THREE, 0)
    order = np.argsort(home, kind="stable")
    return [x[order] for x in (home, a, b, n)]


def packed_edges(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Edges in ascending order as bytes: first words by their differences."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    return b"".join(map(planes, (np.diff(a >> half, prepend=np.uint64(0)), a & low, b >> half, b & low, n)))


def unpacked_edges(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, half = len(data) // 5, np.uint64(32)
    first, *rest, n = (unplaned(data[k * size : (k + 1) * size]).astype(np.uint64) for k in range(5))
    return np.cumsum(first) << half | rest[0], rest[1] << half | rest[2], n


def dealt(parts: DataFrame, ids: DataFrame, buckets: int, bucket: int) -> DataFrame:
    """(bucket, edges): the edges of each part, a row for each bucket and slice of the part. Parts and the numbers of their
    words meet by part, one at a time."""

    def run(part: pa.Table, ids: pa.Table) -> pa.Table:
        if not len(part) or not len(ids):
            return pa.table({"bucket": pa.array([], pa.int64()), "edges": pa.array([], pa.binary())})
        place, own, often = (ids.column(c).to_numpy() for c in ("place", "id", "f"))
        order = np.argsort(own)
        place, own, often = place[order], np.append(0, own[order]).astype(np.uint64), np.append(0, often[order])
        codes = unplaned(part.column("codes")[0].as_py())
        slot = np.zeros(max(int((codes >> END).max()), int(place.max())) + 1, np.uint32)
        slot[place] = np.arange(1, len(own), dtype=np.uint32)
        homes, rows = [], []
        for k in range(0, len(codes), SLICE):
            some = codes[k : k + SLICE + LONGEST - 1]
            home, *edges = edges_of(slot[some >> END], (some & END).astype(bool), min(SLICE, len(codes) - k), own, often, buckets, bucket)
            at = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
            homes.append(home[at])
            rows += [packed_edges(*(x[i:j] for x in edges)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(home)])]
        return pa.table({"bucket": np.concatenate(homes), "edges": pa.array(rows, pa.binary())})

    left, right = parts.select("part", "codes").groupBy("part"), ids.select("part", "place", "id", "f").groupBy("part")
    return left.cogroup(right).applyInArrow(run, "bucket long, edges binary")


def flows(edges: DataFrame, least: int) -> DataFrame:
    """(a, b, f) of the phrases of two words or more that occur ``least`` times or more: edges of all parts summed, and the
    flow out of nodes of three and two words. What lies in several buckets comes out of each, and is summed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["bucket"]):
            a, b, n = (np.concatenate(x) for x in zip(*map(unpacked_edges, rows.column("edges").to_pylist())))
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            flags, n = n & ~COUNT, (n & COUNT).astype(np.int64)
            for shift, split in ((64, SPLIT_PAIR), (32, SPLIT_THREE), (0, 0)):
                node = b >> np.uint64(shift) << np.uint64(shift) if shift < 64 else np.zeros_like(b)
                at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (node[1:] != node[:-1])))
                f, x, y = np.add.reduceat(n, at), a[at], node[at]
                good = (f >= least) | ((flags[at] & np.uint64(split)) > 0)
                good &= {64: True, 32: y > 0, 0: (y & np.uint64(0xFFFFFFFF)) > 0}[shift]
                yield pa.RecordBatch.from_arrays([pa.array(v[good].view(np.int64)) for v in (x, y, f)], names=["a", "b", "f"])

    rows = edges.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, f long")
    return rows.groupBy("a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def word(k: int) -> Column:
    """Number of the k-th word of a phrase (a, b); 0 if it has none."""
    return F.shiftrightunsigned("a" if k < 2 else "b", 32 * (1 - k % 2)).bitwiseAND(F.lit(0xFFFFFFFF))


def phrase(words: list[Column]) -> list[Column]:
    """The columns a, b of a phrase of some words."""
    words = [*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))]
    return [F.shiftleft(words[k], 32).bitwiseOR(words[k + 1]) for k in (0, 2)]


def parts_of(candidates: DataFrame) -> DataFrame:
    """(a, b, k, side, x, y): of each candidate (a, b, size) and cut after k words, the two parts' keys."""
    out = None
    for size in range(2, LONGEST + 1):
        words = [word(i) for i in range(size)]
        cells = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *(c.alias(n) for c, n in zip(phrase(words[:k] if side == 0 else words[k:]), "xy"))) for k in range(1, size) for side in (0, 1)]
        rows = candidates.where(F.col("size") == size).select("a", "b", F.inline(F.array(*cells)))
        out = rows if out is None else out.union(rows)
    return out


def scored(grams: DataFrame, single: DataFrame) -> DataFrame:
    """(a, b, l, r, score) of candidates ``grams`` (a, b, f, size) by the lowest-scoring cut; ``single``: (a, b, f) of words."""
    known = grams.select("a", "b", "f").union(single).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("f").alias("g"))
    cuts = parts_of(grams).join(known, ["x", "y"]).groupBy("a", "b", "k").agg(F.max(F.when(F.col("side") == 0, F.col("g"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("g"))).alias("r"))
    cuts = cuts.join(grams.select("a", "b", "f"), ["a", "b"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(10, 0)) * CAST(f AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    lowest = cuts.groupBy("a", "b").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("a", "b", "cut.l", "cut.r", "cut.score")


def inside_longer(grams: DataFrame) -> DataFrame:
    """(a, b, most): the highest count of a candidate one word longer that has the phrase in it. Any longer one holds such
    a one, which occurs no less often."""
    out = None
    for size in range(3, LONGEST + 1):
        words = [word(i) for i in range(size)]
        cells = [F.struct(*(c.alias(n) for c, n in zip(phrase(part), "xy"))) for part in (words[:-1], words[1:])]
        rows = grams.where(F.col("size") == size).select("f", F.inline(F.array(*cells)))
        out = rows if out is None else out.union(rows)
    return out.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max("f").alias("most"))


def unary_paths(grams: DataFrame) -> DataFrame:
    """(a, b, path, words): the compacted path of each frequent edge (phrases of LONGEST words). Two edges are of one path
    if the node between them has no other frequent edge in or out; a path is named by its least edge and has ``words`` words
    from end to end (a ring: as many as edges, and three)."""
    edges = stored(grams.where(F.col("size") == LONGEST).select("a", "b").withColumn("edge", F.monotonically_increasing_id()), "edges")
    words = [word(i) for i in range(LONGEST)]
    node = lambda part: [c.alias(n) for c, n in zip(phrase(part), "xy")]
    into = edges.select("edge", *node(words[1:])).groupBy("x", "y").agg(F.count("*").alias("n"), F.min("edge").alias("from")).where("n = 1")
    out = edges.select("edge", *node(words[:-1])).groupBy("x", "y").agg(F.count("*").alias("n"), F.min("edge").alias("to")).where("n = 1")
    roots = components(into.join(out.drop("n"), ["x", "y"]).select(F.col("from").alias("a"), F.col("to").alias("b")))
    placed = edges.join(roots.withColumnRenamed("node", "edge"), "edge", "left").select("a", "b", F.coalesce("root", "edge").alias("path"))
    return placed.join(placed.groupBy("path").agg((F.count("*") + LONGEST - 1).alias("words")), "path").select("a", "b", "path", "words")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, bucket: int = BUCKET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words) of each language's first ``top`` phrases of two to four words.

    Phrases occur ``least`` times or more. Their score is the lowest, over the cuts in two, of 2000000 a / (l + r),
    floored; those that a longer one accounts for to four fifths are left out. Frequent words get numbers; parts of the
    texts are written as such and each sends its distinct edges, packed, to buckets; these sum them and the flows through
    their nodes. Words that occur less often end a run as a piece does: no candidate holds them. path_words: words of
    the compacted path that a phrase of four words lies on, null for shorter ones.

    Null texts are empty, a null language is ``und``. Repeated rows and ids count as often as they are there. Texts of
    any length are taken whole.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = stored(encoded(rows), "parts")
    words = parts.select("part", F.posexplode("words").alias("place", "w")).select("part", "place", "w.lang", "w.word", "w.n")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ids = stored(numbered(words, least), "ids")
    total = totals.agg(F.sum("n")).first()[0] or 0
    grams = flows(dealt(parts, ids.select("part", "place", "id", "f"), -(-total // bucket) or 1, bucket), least)
    size = F.when(F.col("b") == 0, 2).when(F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)) == 0, 3).otherwise(4)
    grams = stored(grams.withColumn("size", size), "grams")
    names = stored(ids.where("word IS NOT NULL").select(F.col("id").cast("long").alias("id"), "lang", "word", "f"), "names")
    single = names.select(F.shiftleft("id", 32).alias("a"), F.lit(0).cast("long").alias("b"), "f")

    kept = grams.join(inside_longer(grams), ["a", "b"], "left").where("most IS NULL OR 100 * CAST(most AS DECIMAL(19, 0)) < 80 * CAST(f AS DECIMAL(19, 0))")
    kept = kept.join(scored(grams, single), ["a", "b"]).join(unary_paths(grams).select("a", "b", F.col("words").alias("path_words")), ["a", "b"], "left")
    kept = stored(kept.drop("most"), "kept")
    spelt = kept.select("a", "b", F.posexplode(F.array(*(word(k) for k in range(LONGEST)))).alias("k", "id")).where("id > 0").join(names.drop("f"), "id")
    spelt = spelt.groupBy("a", "b").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    found = stored(kept.join(spelt, ["a", "b"]).select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score", "path_words"), "phrases")
    best = lambda *by: W.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    some = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(best("slice"))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= top)
    return some.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "path_words")
