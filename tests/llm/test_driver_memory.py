"""What the pipeline costs its driver: few jobs for components, and a fit that needs little besides its sample."""

import tracemalloc

import numpy as np
import pytest

from numweave.llm import components, hashing


@pytest.mark.parametrize("parts", [1, 3])
def test_components_take_few_jobs(spark, parts):
    rng = np.random.default_rng(1)
    path = rng.permutation(400).tolist()
    edges = [*zip(path, path[1:]), *((1000, 1000 + k) for k in range(1, 50)), (7, 7), (None, 3)]
    tracker, group = spark.sparkContext.statusTracker(), f"components of {parts}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {**{k: 0 for k in range(400)}, **{1000 + k: 1000 for k in range(50)}}
    assert jobs <= 20 * parts


def test_contraction_by_blocks_keeps_components(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 64)
    rng = np.random.default_rng(2)
    edges = rng.integers(0, 900, (700, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    found = components.contract(spark.createDataFrame(edges.tolist(), "a long, b long").repartition(3)).toPandas()
    assert (found.a > found.b).all() and len(found) < len(edges)
    want = components.label(900, edges[:, 0], edges[:, 1])
    assert (components.label(900, found.a.to_numpy(), found.b.to_numpy()) == want).all()


def test_fit_needs_little_besides_its_sample():
    rng = np.random.default_rng(3)
    n, size = 500, 1_000_000
    row = np.sort(rng.integers(0, n, size)).astype(np.int32)
    ids, values = rng.integers(0, 50_000, size).astype(np.int32), rng.random(size).astype(np.float32)
    p = rng.random(n)
    tracemalloc.start()
    try:
        hashing.fit(row, ids, values, np.stack([1 - p, p], 1), steps=2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20 * size
