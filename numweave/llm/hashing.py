"""Hashed text features, and linear scorers over them. All passes over bytes are array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, utf8

WORDS, GRAMS, FLAGS = 1 << 17, 1 << 16, 3
SIZE = WORDS + GRAMS + FLAGS
PIECE = 1_000_000
#: Most features of a sample that is brought to the driver, at twelve bytes each.
MOST_FEATURES = 8_000_000
#: Features that a step of the fit takes at once, so that it needs little besides the sample.
PART = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, cut at the offsets."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = edge[0] = edge[-1] = True
    bounds = np.flatnonzero(edge)
    starts = bounds[:-1]
    kept = inside[starts] if len(inside) else np.zeros(0, bool)
    return starts[kept], bounds[1:][kept]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word from differences of one running sum: sum(byte * base ** place) / base ** start."""
    base, inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    powers = np.full(len(text), base)
    powers[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.append(np.uint64(0), np.cumsum(powers * (text.astype(np.uint64) + ODD)))
    down = np.full(len(text), inverse)
    down[:1] = 1
    np.multiply.accumulate(down, out=down)
    out = (sums[ends] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(29)
    out *= ODD
    return out ^ (out >> np.uint64(32))


def features(text: np.ndarray, at: np.ndarray, level: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the rows' words, byte trigrams and repeat flags; and the number of words of each row.

    A row's values of a word sum to count / sqrt(words), or with ``level`` to 1 / sqrt(1 + words / level), however often
    the word comes: a score then rests on which words are there and hardly on the length of the text. The values of a trigram to 10 * share; a flag (the word repeats the
    one before, or the one before that) to 10 * share of words.
    """
    n = len(at) - 1
    low = LOWER[text]
    starts, ends = spans(LETTER[text], at)
    row = np.searchsorted(at, starts, "right") - 1
    count = np.bincount(row, minlength=n)
    hashes = word_hashes(low, starts, ends)
    words = (hashes % np.uint64(WORDS)).astype(np.int64)
    gram_row = np.repeat(np.arange(n), np.maximum(0, np.diff(at) - 2))
    inside = np.ones(len(text), bool)
    for k in (1, 2):
        inside[np.maximum(at[1:] - k, at[:-1])[np.diff(at) > 0]] = False
    place = np.flatnonzero(inside)
    wide = text.astype(np.uint64)
    grams = wide[place] | wide[place + 1] << np.uint64(8) | wide[place + 2] << np.uint64(16)
    grams = WORDS + ((grams * ODD) >> np.uint64(48)).astype(np.int64)
    total = np.maximum(1, np.bincount(gram_row, minlength=n))
    if level:
        there = np.unique(row * WORDS + words)
        word_row, words, worth = there // WORDS, there % WORDS, 1 / np.sqrt(1 + count / level)
    else:
        word_row, worth = row, 1 / np.sqrt(np.maximum(1, count))
    rows, ids, values = [word_row, gram_row], [words, grams], [worth[word_row], 10 / total[gram_row]]
    for k in (1, 2):
        same = np.flatnonzero((hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k])) + k
        rows.append(row[same])
        ids.append(np.full(len(same), WORDS + GRAMS + k))
        values.append(10 / np.maximum(1, count)[row[same]])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values), count


def scored(docs: DataFrame, weights: np.ndarray, bias: np.ndarray, level: float | None = None) -> DataFrame:
    """(doc_id, n_words, logits) of docs (doc_id, text). weights: features by classes; of fixed size, so broadcast."""
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for chunk in chunks(batches, "text", PIECE):
            text, at = utf8(chunk.column("text").combine_chunks())
            row, ids, values, count = features(text, at, level)
            logits = np.stack([np.bincount(row, weights[ids, k] * values, len(at) - 1) + bias[k] for k in range(len(bias))], 1)
            flat = pa.array(np.round(logits, 9).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(bias), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), pa.array(count.astype(np.int64)), lists], names=["doc_id", "n_words", "logits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, logits array<double>")


def gathered(sample: DataFrame, level: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Features of a bounded sample (doc_id, text, target) on the driver: row, feature, value, and the targets.

    Of rows that share an id one counts, so that the sample has no more rows than ids were drawn. Where it has more than
    MOST_FEATURES in all, as with very long texts, a share of it is taken, by a hash of the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", PIECE):
            text, at = utf8(chunk.column("text").combine_chunks())
            row, ids, values, _ = features(text, at, level)
            key, back = np.unique(row * SIZE + ids, return_inverse=True)
            total = np.bincount(back, values, len(key))
            offsets = pa.array(np.searchsorted(key, np.arange(len(at)) * SIZE).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key % SIZE).astype(np.int32), total.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*columns, chunk.column("target").combine_chunks(), chunk.column("doc_id").combine_chunks()], names=["ids", "values", "target", "doc_id"])

    kind = sample.schema["target"].dataType.simpleString()
    one = sample.groupBy("doc_id").agg(F.min(F.struct("text", "target")).alias("row")).select("doc_id", "row.text", "row.target")
    found = stored(one.mapInArrow(run, f"ids array<int>, values array<float>, target {kind}, doc_id long"), "sample")
    size = found.agg(F.sum(F.size("ids"))).first()[0] or 0
    kept = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, MOST_FEATURES / max(1, size)) * (1 << 30))
    got = found.where(kept).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    size = pc.list_value_length(got.column("ids")).to_numpy().astype(np.int64)
    ends = np.cumsum(size[order])
    at = np.empty(len(size), np.int64)
    at[order] = ends - size[order]
    ids, values = np.empty(size.sum(), np.int32), np.empty(size.sum(), np.float32)
    for name, out in (("ids", ids), ("values", values)):
        for k, x in enumerate(got.column(name)):  # straight to its place: the sample is large for the driver
            out[at[k] : at[k] + size[k]] = x.values.to_numpy()
    target = got.column("target").to_pylist()
    del got
    pa.default_memory_pool().release_unused()
    return np.repeat(np.arange(len(size), dtype=np.int32), size[order]), ids, values, [target[k] for k in order.tolist()]


def summed(to: np.ndarray, size: int, values: np.ndarray, worth: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of values * worth[of] by ``to``, for each column of worth, added up in the order of the values."""
    out = np.zeros((worth.shape[1], size))
    for column, total in zip(np.ascontiguousarray(worth.T), out):
        for k in range(0, len(values), PART):
            part = slice(k, k + PART)
            np.add.at(total, to[part], column[of[part]] * values[part])
    return np.ascontiguousarray(out.T)


def fit(row: np.ndarray, ids: np.ndarray, values: np.ndarray, targets: np.ndarray, steps: int = 120, rate: float = 0.5, decay: float = 1e-4, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on class probabilities (rows by classes), by full-batch AdaGrad: weights and bias. Features that
    less than the share ``least`` of the rows have (each row names a feature once) get no weight."""
    n, k = targets.shape
    if least and n:
        often = (np.bincount(ids, minlength=SIZE) >= least * n)[ids]
        row, ids, values = row[often], ids[often], values[often]
    weights, bias = np.zeros((SIZE, k)), np.log(np.maximum(targets.mean(0) if n else np.full(k, 1 / k), 1e-6))
    if not n:
        return weights, bias
    there = np.zeros(SIZE, bool)
    there[ids] = True
    used, slot = np.flatnonzero(there), (np.cumsum(there) - 1).astype(np.int32)[ids]
    w, seen, seen_bias = np.zeros((len(used), k)), np.full((len(used), k), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        logits = summed(row, n, values, w, slot) + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - targets) / n
        grad = summed(slot, len(used), values, off, row) + decay * w
        seen += grad**2
        w -= rate * grad / np.sqrt(seen) * 0.1
        seen_bias += off.sum(0) ** 2
        bias = bias - rate * off.sum(0) / np.sqrt(seen_bias) * 0.1
    weights[used] = w
    return weights, bias
