"""Quality classifier from weak labels: accuracies of overlapping heuristics by EM, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import chunks, stored, utf8

BAD, GOOD, ABSTAIN = 0, 1, 2
#: Heuristic labellers in the order of a pattern's digits. Measure; bad at or over; good at or under (None: never).
LABELLERS = (
    ("symbols", 0.3, 0.05),
    ("capitals", 0.5, 0.2),
    ("repeats", 0.1, 0.03),
    ("shouts", 0.3, 0.05),
    ("bars", 0.3, 0.02),
    ("sameness", 0.8, 0.6),
    ("long_words", 15.0, 10.0),
)
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>", np.uint8))


def measures(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows by labellers: symbols, shouts and bars per word, share of capitals, of words that repeat the one before, of
    words seen before in the text, and mean bytes of a word."""
    n = len(at) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return np.diff(sums[at])

    starts, ends = hashing.spans(~hashing.BLANK[text], at)
    row = np.searchsorted(at, starts, "right") - 1
    words = np.maximum(1, np.bincount(row, minlength=n))
    hashes = hashing.word_hashes(text, starts, ends)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) + 1
    order = np.lexsort((hashes, row))
    new = np.ones(len(row), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    letters = np.maximum(1, per_row(hashing.LETTER[text]))
    out = {
        "symbols": per_row(SYMBOLS[text]) / words,
        "capitals": per_row((text >= 65) & (text <= 90)) / letters,
        "repeats": np.bincount(row[same], minlength=n) / words,
        "shouts": per_row(text == 33) / words,
        "bars": per_row(text == 124) / words,
        "sameness": np.where(words >= 50, 1 - distinct / words, 0.7),
        "long_words": per_row(~hashing.BLANK[text]) / words,
    }
    return np.stack([out[name] for name, *_ in LABELLERS], 1)


def patterns(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The votes of all labellers as one number, base three."""
    found, out = measures(text, at), np.zeros(len(at) - 1, np.int64)
    for k, (_, bad, good) in enumerate(LABELLERS):
        vote = np.where(found[:, k] >= bad, BAD, np.where(found[:, k] <= good, GOOD, ABSTAIN))
        out += vote * 3**k
    return out


def vote(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", hashing.PIECE):
            text, at = utf8(chunk.column("text").combine_chunks())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), pa.array(patterns(text, at))], names=["doc_id", "pattern"])

    return docs.mapInArrow(run, "doc_id long, pattern long")


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of GOOD for each pattern, and each labeller's accuracies: [labeller, BAD or GOOD, vote].

    Bad texts come in kinds that different labellers see, so the hidden class is GOOD or one of as many bad kinds as
    there are labellers; given the class, labellers vote independently and may abstain. Kind k starts from what labeller
    k calls bad (shared out where several do), GOOD from what none does; the accuracies are free from then on. A prior
    halves the false alarms of GOOD: without it, a kind that one labeller alone sees and chance are alike to EM.
    """
    m = len(LABELLERS)
    votes = pattern[:, None] // 3 ** np.arange(m) % 3
    bad = (votes == BAD).astype(np.float64)
    share = np.column_stack([bad.sum(1) == 0, bad / np.maximum(1, bad.sum(1, keepdims=True))])
    chance = np.zeros((m, m + 1, 3))
    for _ in range(rounds):
        weight = share * count[:, None]
        for v in range(3):
            chance[:, :, v] = (votes == v).T.astype(np.float64) @ weight + 0.1
        chance[:, 0, BAD] /= 2
        chance /= chance.sum(2, keepdims=True)
        prior = (weight.sum(0) + 0.1) / (count.sum() + 0.1 * (m + 1))
        logs = np.log(prior) + sum(np.log(chance[k][:, votes[:, k]]).T for k in range(m))
        before, share = share, np.exp(logs - logs.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        if np.abs(share - before).max(initial=0) < 1e-9:
            break
    kinds = prior[1:] / prior[1:].sum()
    return share[:, 0], np.stack([np.tensordot(kinds, chance[:, 1:], (0, 1)), chance[:, 0]], 1)


def fit_scorer(docs: DataFrame, sample: int) -> Judge:
    """EM over all rows of docs (doc_id, text), as the histogram of vote patterns (3 ** labellers at most), and a scorer
    fitted to the posteriors of about ``sample`` rows drawn by a hash of the id."""
    histogram = stored(vote(docs).groupBy("pattern").count(), "patterns").orderBy("pattern").toPandas()
    good, _ = expectation_maximisation(histogram["pattern"].to_numpy(np.int64), histogram["count"].to_numpy(np.float64))
    posterior = dict(zip(histogram["pattern"], good))
    n = int(histogram["count"].sum())
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).where("doc_id IS NOT NULL")

    def with_posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", hashing.PIECE):
            text, at = utf8(chunk.column("text").combine_chunks())
            target = np.array([posterior.get(x, 0.5) for x in patterns(text, at).tolist()])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), chunk.column("text").combine_chunks(), pa.array(target)], names=["doc_id", "text", "target"])

    row, ids, values, target = hashing.gathered(drawn.mapInArrow(with_posterior, "doc_id long, text string, target double"))
    p = np.array(target, np.float64)
    weights, bias = hashing.fit(row, ids, values, np.stack([1 - p, p], 1))
    return Judge((weights[:, 1] - weights[:, 0]).astype(np.float32), float(bias[1] - bias[0]), posterior)


class Judge:
    """The fitted model: what it says about a chunk of texts."""

    def __init__(self, step: np.ndarray, bias: float, posterior: dict[int, float]):
        self.step, self.bias, self.posterior = step, bias, posterior

    def __call__(self, chunk: pa.Table, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, vote pattern and probability of GOOD for each row; no words: 0."""
        text, at = utf8(chunk.column(text_col).combine_chunks())
        row, ids, values, n_words = hashing.features(text, at)
        logit = np.bincount(row, self.step[ids] * values, len(at) - 1) + self.bias
        return n_words.astype(np.int64), patterns(text, at), np.where(n_words > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000) -> DataFrame:
    """(doc_id, n_words, pattern, posterior, score, kept) of each row; kept: the scorer's probability is 0.5 or more.

    The scorer reads every whole text. Null and empty texts, and those without words, are not kept: score 0. Rows that
    share an id are judged one by one; null ids never enter the sample. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_scorer(rows, sample))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", hashing.PIECE):
            n_words, pattern, score = model.value(chunk, "text")
            posterior = np.array([model.value.posterior.get(x, 0.5) for x in pattern.tolist()])
            columns = [n_words, pattern, posterior, np.round(score, 9), score >= 0.5]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), *map(pa.array, columns)], names=["doc_id", "n_words", "pattern", "posterior", "score", "kept"])

    return rows.mapInArrow(judge, "doc_id long, n_words long, pattern long, posterior double, score double, kept boolean")


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, whole and in their own columns; no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_scorer(rows, sample))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col, hashing.PIECE):
            yield from chunk.filter(pa.array(model.value(chunk, text_col)[2] >= 0.5)).to_batches()

    return docs.mapInArrow(keep, docs.schema)
