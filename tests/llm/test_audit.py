"""The audit of the embedding operator counts vectors, not links."""

import numpy as np
import pytest

from numweave.llm import embeddings


def test_lost_pairs_count_beside_a_large_group(spark):
    rng = np.random.default_rng(8)
    group = rng.standard_normal(64) + 1e-3 * rng.standard_normal((100, 64))
    pairs = np.repeat(rng.standard_normal((30, 64)), 2, 0) + 1e-3 * rng.standard_normal((60, 64))
    x = np.concatenate([group, pairs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, i, bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "vec_id long, own long, x binary, w long")
    links = spark.createDataFrame([(i, 99) for i in range(100)], "vec_id long, n_links long")
    assert embeddings.recall(vectors, links, 0.95) == 100 / 160


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "recall", lambda *a: 0.5)
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="0.500"):
        embeddings.near_vectors(frame, most_rounds=2)
