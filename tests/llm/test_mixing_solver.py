"""The rates of the mixture against a plain solver that runs long, where targets can be met and where they cannot."""

import numpy as np
import pyarrow as pa
import pytest

from numweave.llm import mixing


def nearest_rates(p, tokens, targets, rounds=20_000):
    """Nonnegative rates that meet the targets, nearest to 1 in squares weighted by tokens: Dykstra's projections."""
    a, scale = p * np.sqrt(tokens)[:, None], np.sqrt(tokens)
    onto = np.linalg.pinv(a.T @ a)
    z, fix = scale.copy(), np.zeros(len(p))
    for _ in range(rounds):
        flat = z - a @ (onto @ (z @ a - targets))
        new = np.maximum(0, flat + fix)
        fix = flat + fix - new
        if np.abs(new - z).max() < 1e-12:
            break
        z = new
    return z / scale


def members(spark, p, tokens):
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
    return spark.createDataFrame(pa.table({"doc_id": pa.array(np.arange(len(p))), "tokens": pa.array(tokens.astype(np.int64)), "p": lists}))


@pytest.mark.parametrize("targets", [(0.9, 0.05, 0.05), (0.6, 0.2, 0.2), (0.0, 0.0, 1.0), (0.999, 0.0005, 0.0005)])
def test_rates_against_a_plain_solver(spark, targets):
    rng = np.random.default_rng(4)
    p = 0.98 * rng.dirichlet((4, 0.4, 0.6), 120) + 0.02 / 3  # every text has some of each domain: some targets are out of reach
    tokens = rng.integers(1, 400, 120)
    wanted = np.array(targets) * tokens.sum()
    pull, missed = mixing.solve_rates(members(spark, p, tokens), wanted, most=20)
    rates = mixing.rates_of(p, pull)
    off = (rates * tokens) @ p - wanted
    assert missed == pytest.approx(np.abs(off).max() / tokens.sum(), abs=1e-9)
    if targets[0] in (0.9, 0.6):
        assert missed <= 1e-4
        assert np.allclose(rates, nearest_rates(p, tokens.astype(float), wanted), atol=2e-3)
    else:  # the conditions of the best balance between rates near 1 and totals near the targets
        inside = np.abs(pull) < 20
        assert (np.abs(off[inside]) <= 1e-4 * tokens.sum()).all() and (np.sign(pull[~inside]) == np.sign(off[~inside])).all()
        assert missed > 1e-3 and np.abs(pull).max() == 20


def test_posteriors_tell_held_out_classes(spark):
    """Classes by a few telling words among many: half of the texts have labels, the others are judged."""
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    telling = {1: ["spamword", "clickbait", "junkword"], 2: ["vileword", "insultword", "hateword"]}
    rows, truth = [], {}
    for k in range(3000):
        c = rng.choices((0, 1, 2), (8, 1, 1))[0]
        text = rng.choices(words, k=rng.choice((15, 60, 400)))
        for w in rng.sample(telling.get(c, []), 2 if c else 0):
            text.insert(rng.randrange(len(text)), w)
        rows.append((k, " ".join(text)))
        truth[k] = c
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(c != 1), int(c == 2)) for k, c in truth.items() if k % 2], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, {"clean": 0.9, "low": 0.05, "toxic": 0.05}).toPandas()
    held = got[got.doc_id % 2 == 0]
    best = held[["p_clean", "p_low", "p_toxic"]].to_numpy().argmax(1)
    assert (best == held.doc_id.map(truth)).mean() > 0.93
    assert got.missed.iloc[0] <= 1e-3
    clean, toxic = (held[held.doc_id.map(truth) == c] for c in (0, 2))
    assert (clean.copies > 0).mean() > 0.9 and toxic.rate.mean() < 0.8 * clean.rate.mean()
