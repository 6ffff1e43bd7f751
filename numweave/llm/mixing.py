"""Mixing to target weights with soft membership: domain posteriors, and document rates by projected-gradient least squares."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import fresh, stored

#: Domains that the labels table names, in class order, and the weights of their tokens in the mixture.
DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
#: Words of a text that halve the square of its words' weight; least share of the sample that a feature must be in.
LEVEL, LEAST = 200, 0.015
LOG = logging.getLogger(__name__)


def domain() -> Column:
    """Class of a labelled row: toxic before low before clean; null where both labels are missing."""
    named = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1)
    return named.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).cast("int")


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, steps: int) -> DataFrame:
    """(doc_id, tokens, p): words of each row and its class probabilities, by a hashed linear classifier that is fitted to
    about ``sample`` labelled documents, drawn by a hash of the id; their ids, so few, are broadcast. Features count which
    words are there, and only words that a share of the sample has, so that posteriors do not grow with a text's length."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select("doc_id", domain().alias("target")).where("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(F.max("target").alias("target"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30)))
    row, ids, values, target = hashing.gathered(rows.join(F.broadcast(drawn), "doc_id"), LEVEL)
    classes = np.eye(len(DOMAINS))[np.array(target, np.int64)] if target else np.zeros((0, len(DOMAINS)))
    weights, bias = hashing.fit(row, ids, values, classes, steps, rate=2.0, decay=1e-3, least=LEAST)
    scores = hashing.scored(rows, weights, bias, LEVEL)
    raised = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return scores.select("doc_id", F.col("n_words").alias("tokens"), F.transform(raised, lambda x: F.round(x / total, 9)).alias("p"))


def rates_of(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Each document's rate: from 1 along its posteriors by the domains' pulls, projected to zero or more."""
    return np.maximum(0.0, 1.0 - p @ pull)


def solve_rates(members: DataFrame, targets: np.ndarray, most: float = 100.0, most_steps: int = 60, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """The domains' pulls (see ``rates_of``) that give sum(rate * tokens * p) = targets, and what the worst domain misses,
    as a share of all tokens.

    Least squares: of the nonnegative rates that meet the targets these are the nearest to 1, in squares weighted by
    tokens. The gradient of the pulls is what the totals are off; it is taken in the metric of the Gram matrix
    (tokens * p * p') of the documents whose rate is positive, projected to pulls of ``most`` at most, and halved until
    it descends. As the problem is convex that leads to its solution. A domain whose pull comes to stand at ``most``
    misses its target: the rates then balance tokens * (rate - 1) ** 2 / 2 against ``most`` times what is missed, and none
    is over 1 + ``most``. A trial is one pass over (tokens, p) that sums a few numbers for each domain; rates are not
    kept between passes. A RuntimeError tells that the steps were too few.
    """
    pull = np.zeros(len(targets))
    if not len(targets) or not targets.sum() > 0:
        return pull, 0.0
    sums, gram, squares = totals(members, pull)
    for _ in range(most_steps):
        off = sums - targets
        free = ~((pull >= most) & (off > 0) | (pull <= -most) & (off < 0))
        if np.abs(off[free]).max(initial=0) <= tolerance * targets.sum():
            return pull, float(np.abs(off).max() / targets.sum())
        step = np.zeros(len(targets))
        ridge = 1e-9 * max(np.trace(gram), 1e-3 * targets.sum()) * np.eye(len(targets))
        step[free] = np.linalg.solve((gram + ridge)[np.ix_(free, free)], off[free])
        for _ in range(40):
            to = np.clip(pull + step, -most, most)
            now = totals(members, to)
            if now[2] / 2 + targets @ to <= squares / 2 + targets @ pull - 1e-4 * (off @ (to - pull)):
                break
            step /= 2
        pull, (sums, gram, squares) = to, now
    raise RuntimeError(f"the totals did not settle in {most_steps} steps")


def totals(members: DataFrame, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tokens of each domain, the Gram matrix of the documents with positive rates, and tokens * rate ** 2."""
    k = len(pull)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + 1)
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, k)
            tokens, rates = batch.column("tokens").to_numpy(), rates_of(p, pull)
            total[:k] += (rates * tokens) @ p
            total[k:-1] += (p.T @ (p * ((rates > 0) * tokens)[:, None])).ravel()
            total[-1] += (rates * rates) @ tokens
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"d{i}" for i in range(len(total))])

    names = [f"d{i}" for i in range(k + k * k + 1)]
    sums = members.select("tokens", "p").mapInArrow(run, ", ".join(f"{x} double" for x in names))
    found = np.array([x or 0.0 for x in sums.agg(*map(F.sum, names)).first()], np.float64)
    return found[:k], found[k:-1].reshape(k, k), float(found[-1])


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 4000,
    steps: int = 120,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies, missed) of each row.

    ``rate`` is the expected number of times that a document enters the mixture, so that the expected tokens of each
    domain, by the posteriors, have the target weights of all tokens, and the nearest to 1 that has. Where no rates reach
    a target (all posteriors are equal without labels, say) they come near, see ``solve_rates``; ``missed`` is the share
    of all tokens by which the worst domain then misses it, the same in all rows and logged. ``copies`` is the rate rounded up or down by a
    hash of the id: the same in every run. Null and empty texts have 0 tokens and posteriors by the class shares alone.
    Rows that share an id get a rate each. An empty table gives an empty result.
    """
    members = stored(posteriors(docs, labels, id_col, text_col, sample, steps), "members")
    tokens = members.agg(F.sum("tokens")).first()[0] or 0
    wanted = np.array([weights[x] for x in DOMAINS]) / sum(weights[x] for x in DOMAINS)
    pull, missed = solve_rates(members, tokens * wanted)
    LOG.info("pulls %s; the worst domain misses its target by %.2g of all tokens", pull.round(4).tolist(), missed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), *(pa.array(p[:, k]) for k in range(len(DOMAINS))), pa.array(np.round(rates_of(p, pull), 9))], names=["doc_id", "tokens", *(f"p_{x}" for x in DOMAINS), "rate"])

    rated = members.mapInArrow(run, f"doc_id long, tokens long, {', '.join(f'p_{x} double' for x in DOMAINS)}, rate double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")).withColumn("missed", F.lit(missed))


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it, in its own columns. Rows that share an id all
    come as often as the most frequent of them."""
    id_col = options.get("id_col", "doc_id")
    key, times, k = (fresh(docs, x) for x in ("mix_id", "mix_copies", "mix_k"))
    copies = mix(docs, labels, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times))
    rows = docs.join(copies, F.col(id_col).cast("long").eqNullSafe(F.col(key))).where(F.col(times) > 0)
    return rows.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(key, times, k)
