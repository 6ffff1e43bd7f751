"""Embeddings of several lengths, with repeated ids, and in one long chain, against all pairs."""

import numpy as np
import plain
import pytest

from numweave.llm import embeddings


def all_pairs(rows):
    """(id, n_links, component_id) of each row, sorted."""
    n, pairs = [0] * len(rows), []
    for size in {len(v) for _, v in rows}:
        at = [k for k, (_, v) in enumerate(rows) if len(v) == size]
        x = np.array([rows[k][1] for k in at])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for a in range(0, len(at), 2000):
            i, j = np.nonzero(x[a : a + 2000] @ x.T >= 0.95)
            for p, q in zip((i + a).tolist(), j.tolist()):
                if p != q:
                    n[at[p]] += 1
                    pairs.append((at[p], at[q]))
    roots = plain.least_reachable(range(len(rows)), [(min(p), max(p)) for p in pairs])
    least = {}
    for k, r in roots.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], n[k], least[roots[k]]) for k in range(len(rows)))


def found(spark, rows):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = embeddings.near_vectors(frame).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got)


def test_two_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c = rng.standard_normal((3, 24))
    rows = [(1, a), (1, b), (2, a), (3, 2 * b), (3, b), (9, a), (9, a)]
    rows += [(20 + k, a[:10] + 0.02 * rng.standard_normal(10)) for k in range(5)] + [(7, a[:10]), (40, c[:3]), (41, -c[:3])]
    rows += [(100 + k % 40, rng.standard_normal(24)) for k in range(80)]
    assert found(spark, rows) == all_pairs(rows)


@pytest.mark.parametrize("n", [20_000])
def test_a_long_chain(spark, n):
    """Each vector is a small turn from the one before; the chain fills many cells and hardly any two of them meet."""
    rng = np.random.default_rng(7)
    x, out = rng.standard_normal(48), []
    x /= np.linalg.norm(x)
    way = rng.standard_normal(48)
    for _ in range(n):
        way = 0.97 * way + 0.25 * rng.standard_normal(48)
        step = way - (way @ x) * x
        x = np.cos(0.06) * x + np.sin(0.06) * step / np.linalg.norm(step)
        out.append(x)
    rows = [*enumerate(out)]
    assert found(spark, rows) == all_pairs(rows)


def test_large_cells_are_dealt_into_blocks(spark, monkeypatch):
    """A wide blob in one component: bounds settle little, and homes and askers need several blocks each."""
    monkeypatch.setattr(embeddings, "CELL", 32)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(12)
    rows = [(k, centre + 0.22 * np.linalg.norm(centre) / np.sqrt(12) * rng.standard_normal(12)) for k in range(900)]
    rows += [(1000 + k, centre + 0.02 * rng.standard_normal(12)) for k in range(150)]
    assert found(spark, rows) == all_pairs(rows)
