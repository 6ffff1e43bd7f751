"""Embeddings in groups that fill each other's neighbour lists, against all pairs."""

import numpy as np
import plain

from numweave.llm import embeddings


def held_against_all_pairs(spark, x):
    x = x.astype(np.float32).astype(float)
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    roots = plain.least_reachable(range(len(x)), np.argwhere(np.triu(close, 1)).tolist())
    assert {i: got[i].n_links for i in got} == dict(enumerate((close.sum(1) - 1).tolist()))
    assert {i: got[i].component_id for i in got} == roots


def two_centres(rng, cosine):
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_groups_of_copies_and_tight_groups_meet(spark):
    rng = np.random.default_rng(5)
    copies = np.repeat(np.array(two_centres(rng, 0.96)), 400, 0)
    tight = np.repeat(np.array(two_centres(rng, 0.97)), 400, 0) + 1e-4 * rng.standard_normal((800, 64))
    held_against_all_pairs(spark, np.concatenate([copies, tight, rng.standard_normal((300, 64))]))
