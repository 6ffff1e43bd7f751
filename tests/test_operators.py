import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from numweave.functions import index
from numweave.operators import blocks, dense, graph, order, sparse, spectral, stats, stencil, vector
from numweave.sources import generators as make
from numweave.storage import shared_dir, stored


def to_array(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r)[: len(shape)]] += r.v
    return out


def frame(spark, x):
    x = np.asarray(x, float)
    keys = "i long, j long, v double" if x.ndim == 2 else "i long, v double"
    return spark.createDataFrame([(*map(int, k), float(v)) for k, v in np.ndenumerate(x)], keys)


# ---- places and vectors


@given(st.integers(1, 40), st.integers(1, 12))
@settings(max_examples=30, deadline=None)
def test_grid_and_radix(n, p):
    m, k = index.grid_shape(p)
    assert m * k == p and (p == 1 or m == max(d for d in range(1, p) if p % d == 0))
    assert index.default_radix(n) ** 2 >= n > (index.default_radix(n) // 2) ** 2 * (index.default_radix(n) > 1)


@pytest.mark.parametrize(("n", "p"), [(10, 3), (3, 5), (16, 4), (1, 1)])
def test_block_and_cyclic_parts(spark, n, p):
    rows = spark.range(n).withColumns({"b": index.block_part(F.col("id"), p, n), "c": index.cyclic_part(F.col("id"), p)}).collect()
    want = [k for k, part in enumerate(np.array_split(np.arange(n), p)) for _ in part]
    assert [r.b for r in rows] == want and [r.c for r in rows] == [k % p for k in range(n)]
    starts = spark.range(p).select(index.block_start(F.col("id"), p, n).alias("s"), index.n_local(p, F.col("id"), n).alias("n")).collect()
    assert [r.s for r in starts] == [sum(map(len, np.array_split(np.arange(n), p)[:t])) for t in range(p)]
    assert [r.n for r in starts] == [len(range(t, n, p)) for t in range(p)]


def test_group_cyclic_and_bit_reversal(spark):
    rows = spark.range(16).select(*index.group_cyclic(F.col("id"), 1, 4, 16), index.bit_reverse(F.col("id"), 4)).collect()
    assert [r[0] for r in rows] == [k // 4 for k in range(16)] and [r[1] for r in rows] == [k % 4 for k in range(16)]
    assert [r[2] for r in rows] == [int(f"{k:04b}"[::-1], 2) for k in range(16)]
    cyclic = spark.range(16).select(*index.group_cyclic(F.col("id"), 4, 4, 16)).collect()
    assert [tuple(r) for r in cyclic] == [(k % 4, k // 4) for k in range(16)]


def test_vector_sums(spark):
    x = make.ramp(spark, 1000)
    assert vector.inner_product(x, x).first().value == 333833500
    assert vector.inner_product(x.limit(0), x).first().value == 0
    short = frame(spark, [1, 2])
    assert to_array(vector.axpy(2, short, make.ramp(spark, 3)), 3).tolist() == [3, 6, 3]
    assert vector.max_abs_error(short, make.ramp(spark, 3)).first().value == 3
    assert vector.max_abs_error(make.ramp_complex(spark, 4), make.ramp_complex(spark, 4).withColumn("im", F.lit(0.0)), 4).first().value == 0.25
    assert vector.residual_norm(frame(spark, [[3, 0], [0, 4]]), frame(spark, [[0, 0], [0, 0]])).first().value == 5


def test_validation(spark):
    assert vector.validate_vector(make.ramp(spark, 4), 4).count() == 4
    for bad, n in ((make.ramp(spark, 4), 5), (make.ramp(spark, 3).union(make.ramp(spark, 1)), 4)):
        with pytest.raises(ValueError, match="not a vector"):
            vector.validate_vector(bad, n)
    square = make.matrix(spark, 3, 3, lambda i, j: i + j)
    assert vector.validate_square(square, 3).count() == 9
    with pytest.raises(ValueError, match="outside"):
        vector.validate_square(square, 2)


# ---- orders


@pytest.mark.parametrize("kind", ["uniform", "equal", "three"])
def test_sample_sort(spark, kind):
    n, p = 1000, 4
    values = {"uniform": lambda i: F.rand(3), "equal": lambda i: F.lit(1.0), "three": lambda i: i % 3}[kind]
    x = make.vector(spark, n, values).repartition(3)
    want = sorted(r.v for r in x.collect())
    got = order.sample_sort(x, p).orderBy("part", "pos").collect()
    assert [r.v for r in got] == want
    sizes = [sum(r.part == t for r in got) for t in range(p)]
    assert all(1 <= s <= 2 * n // p + p for s in sizes)
    assert order.unsorted_rows(order.sample_sort(x, p)).count() == 0


def test_sort_lowers_parts_and_takes_empty(spark):
    assert order.part_count(10, 8) == 3 and order.part_count(0, 3) == 1
    assert order.sample_sort(make.ramp(spark, 5), 8).agg(F.countDistinct("part")).first()[0] <= 2
    assert order.sample_sort(make.ramp(spark, 5).limit(0), 3).count() == 0
    bad = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0)], "part int, pos long, v double")
    assert order.unsorted_rows(bad).count() == 1


def test_ordinal_numbers_groups(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 100) for k in range(100)]
    got = order.ordinal(spark.createDataFrame(rows, "g int, x int"), ["x"], ("g",), "k").collect()
    for g in {r.g for r in got}:
        own = sorted((r.k, r.x) for r in got if r.g == g)
        assert [k for k, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    starts = order.bin_starts(spark.createDataFrame(rows, "g int, x int"), "x").orderBy("x").collect()
    assert [r.start for r in starts] == list(range(100))


def test_load_imbalance_and_argmax(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "part int")
    assert tuple(order.load_imbalance(df).first()) == (1, 3, 2.0, 0.5)
    column = spark.createDataFrame([(5, 2.0, 1), (3, -2.0, 1), (9, -2.0, 0)], "i long, v double, part int")
    assert tuple(sparse.argmax_abs(column).first()) == (9, -2.0)
    assert sparse.argmax_abs(column.limit(0)).count() == 0


# ---- statistics


def test_middle_three_and_rates(spark):
    runs = spark.createDataFrame([("a", float(t)) for t in (5, 1, 2, 3, 9)], "g string, t double")
    row = stats.middle_three(runs, ["g"], "t").first()
    assert row.mean == 3.33333333 and row.deviation == pytest.approx(50, abs=1e-5) and not row.ok
    rate = stats.rate_summary(runs, ["g"], "t", 9e6).first()
    assert (rate.least, rate.most) == (1, 9)
    assert stats.rate_summary(runs.withColumn("t", F.lit(0.0)), ["g"], "t", 9e6).first().most is None
    line = spark.createDataFrame([(h, 3.0 * h + 7) for h in range(10)], "h int, t double")
    assert tuple(stats.fit_line(line, "h", "t", 0, 9).first()) == pytest.approx((3, 7))


def test_correlation_and_covariance(spark):
    x = np.random.default_rng(0).random((40, 3))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    assert np.allclose(to_array(stats.correlation_matrix(df, ["a", "b", "c"]), 3, 3), np.corrcoef(x.T))
    assert np.allclose(to_array(stats.covariance_matrix(df, ["a", "b", "c"]), 3, 3), np.cov(x.T))


def test_moments_of_many_columns_with_gaps(spark, monkeypatch):
    """More columns than a block has, means far from 0, and values absent here and there: the pairs of each two columns count."""
    monkeypatch.setattr(stats, "PAIRS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 20)) * rng.uniform(0.1, 9, 20) + 1e7
    x[:, 3] = x[:, 2] * 2 + rng.normal(size=400)
    holes = rng.random(x.shape) < 0.1
    columns = [f"c{k}" for k in range(20)] + ["one", "none", "same"]
    rows = [[None if h else float(v) for v, h in zip(r, gap)] + [5.0 if k == 9 else None, None, 3.0] for k, (r, gap) in enumerate(zip(x, holes))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    y = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for got, of in ((stats.covariance_matrix(df, columns), np.cov), (stats.correlation_matrix(df, columns), np.corrcoef)):
        cells = {(r.i, r.j): r.v for r in got.collect()}
        assert len(cells) == 23 * 23
        for (i, j), v in cells.items():
            both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
            defined = both.sum() > 1 and (of is np.cov or (np.ptp(y[both, i]) > 0 and np.ptp(y[both, j]) > 0))
            assert (v is None) == (not defined)
            if defined:
                assert v == pytest.approx(of(y[both, i], y[both, j])[0, 1], rel=1e-7, abs=1e-9)
    assert [r.v for r in stats.covariance_matrix(df.limit(0), ["c0", "c1"]).collect()] in ([], [None] * 4)


@pytest.mark.parametrize(("few", "slices"), [(4096, 1024), (5, 8), (1, 3)])
def test_order_statistics_by_selection(spark, monkeypatch, few, slices):
    """Every place of groups with steep, equal, huge and single values, and a null group; slices so few that many rounds follow."""
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "SLICES", slices)
    rng = np.random.default_rng(2)
    groups = {None: rng.exponential(size=60) ** 6 * 1e9, 1: rng.integers(0, 3, 40), 2: [7.5], 3: [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300] * 3, 4: [2.0] * 30}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(5, None), (1, None)], "g int, v double").repartition(3)
    wanted = spark.createDataFrame([(g, k) for g in [*groups, 5] for k in (-1, 0, 1, 2, 7, 20, 29, 39, 59, 60)], "g int, place long")
    got = {(r.g, r.place): r.v for r in stats.order_statistics(df, ["g"], "v", wanted).collect()}
    assert got == {(g, k): sorted(map(float, x))[k] for g, x in groups.items() for k in (0, 1, 2, 7, 20, 29, 39, 59) if k < len(x)}
    large, small = (f(df, ["g"], "v").where("n > 0").collect() for f in (stats.median_ci_large, stats.median_ci))
    assert sorted(map(str, large)) == sorted(map(str, small))
    whole = stats.median_ci_large(df.where("g = 1"), [], "v").first()
    assert (whole.n, whole["median"]) == (40, np.median(groups[1]))


# ---- graphs


def chain(spark, n=10):
    part = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 8: 3, 9: 3}
    rows = [(a, b, float(i + 1), part[a]) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))]
    return spark.createDataFrame(rows, "i long, j long, w double, part int")


def test_matching_of_the_chain(spark):
    edges = chain(spark)
    found = graph.match(graph.with_ties(graph.validate_graph(edges), 10)).persist()
    assert sorted(tuple(r) for r in found.collect()) == [(k, k + 1, float(k + 1)) for k in range(0, 10, 2)]
    assert tuple(graph.matching_stats(found, edges).first()) == (5, 25.0, 27.0, 45.0, True)
    assert sorted(tuple(r) for r in graph.matching_parts(found, graph.vertex_parts(edges)).collect()) == [(0, 1, 1), (1, 0, 2), (2, 0, 2), (3, 1, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_greedy_by_weight_and_tie(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b): float(rng.randint(1, 3)) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.4}
    edges = spark.createDataFrame([(*e, w) for (a, b), w in pairs.items() for e in ((a, b), (b, a))], "i long, j long, w double")
    edges = edges.withColumn("part", (F.col("i") % 3).cast("int"))
    used, want = set(), set()
    for a, b in sorted(pairs, key=lambda e: (pairs[e], sum(e) + 28 * (e[0] % 3 == e[1] % 3)), reverse=True):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    ties = graph.with_ties(edges, 14)
    assert {(r.i, r.j) for r in graph.match(ties).collect()} == want


def test_matching_of_long_rising_paths_takes_few_rounds(spark, monkeypatch):
    """A path of rising weights, one with a branch in its middle, and a ring."""
    n, rounds = 5000, []
    pairs = [(k, k + 1, float(k)) for k in range(n)] + [(n // 2, n + 5, 0.5)] + [(10_000 + k, 10_000 + (k + 1) % 301, 7.0 + k) for k in range(301)]
    decided = graph.decided
    monkeypatch.setattr(graph, "decided", lambda x: rounds.append(1) or decided(x))
    edges = spark.createDataFrame([(*e, w) for a, b, w in pairs for e in ((a, b), (b, a))], "i long, j long, w double")
    used, want = set(), set()
    for a, b, w in sorted(pairs, key=lambda e: -e[2]):
        if not {a, b} & used:
            used |= {a, b}
            want.add((min(a, b), max(a, b), w))
    assert {tuple(r) for r in graph.match(graph.with_ties(edges, 20_000)).collect()} == want and len(rounds) <= 3


def test_faulty_graphs(spark):
    bad = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (2, 3, 1.0), (4, 5, 1.0), (5, 4, 2.0)], "i long, j long, w double")
    assert {r.reason for r in graph.faulty_edges(bad).collect()} == {"loop", "weight", "asymmetric"}
    with pytest.raises(ValueError, match="symmetric"):
        graph.validate_graph(bad)
    assert graph.match(graph.with_ties(chain(spark).limit(0), 10)).count() == 0


# ---- dense kernels


def kernel(spark, name, n):
    tables = make.kernel_inputs(spark, name, n)
    shape = lambda x: (n, n) if "j" in x.columns else (n,)
    return tables, {k: to_array(x, *shape(x)) for k, x in tables.items()}


def test_products(spark):
    n, b = 7, 3
    t, x = kernel(spark, "gemm", n)
    assert np.allclose(to_array(blocks.gemm(1.5, t["a"], t["b"], 1.2, t["c"], b), n, n), 1.5 * x["a"] @ x["b"] + 1.2 * x["c"])
    t, x = kernel(spark, "2mm", n)
    assert np.allclose(to_array(blocks.two_mm(1.5, t["a"], t["b"], t["c"], 1.2, t["d"], b), n, n), 1.5 * x["a"] @ x["b"] @ x["c"] + 1.2 * x["d"])
    t, x = kernel(spark, "3mm", n)
    assert np.allclose(to_array(blocks.three_mm(*(t[k] for k in "abcd"), b), n, n), x["a"] @ x["b"] @ x["c"] @ x["d"])


def shuffled_rows(spark, run) -> int:
    """Rows that a piece of work writes to shuffles."""
    jvm, context = spark._jvm, spark.sparkContext
    stages = lambda: context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), None)
    written = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages().apply(k) for k in range(stages().size()))}
    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


def test_products_send_factors_not_products(spark):
    n, b, rng = 96, 4, np.random.default_rng(2)
    x, y = rng.standard_normal((n, n)), rng.standard_normal((n, n))
    one, two = (stored(blocks.to_blocks(frame(spark, z), b)) for z in (x, y))
    got = {}
    sent = shuffled_rows(spark, lambda: got.update(p=stored(blocks.block_product(one, two, b, 2.0))))
    assert np.allclose(to_array(blocks.from_blocks(got["p"], b), n, n), 2 * x @ y)
    assert 0 < sent < 2 * 4 * (n // b) ** 2 + 100


def test_products_of_long_triangular_and_large_matrices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    tall = rng.standard_normal((90, 3))
    t = frame(spark, tall)
    assert np.allclose(to_array(blocks.matmul(blocks.transpose(t), t, 2), 3, 3), tall.T @ tall)
    assert np.allclose(to_array(blocks.matmul(t, blocks.transpose(t), 2), 90, 90), tall @ tall.T)
    low, up = np.tril(rng.standard_normal((21, 21))), np.triu(rng.standard_normal((21, 21)))
    monkeypatch.setattr(blocks, "HELD", 8 * 16)
    monkeypatch.setattr(blocks, "TILE", 8)
    monkeypatch.setattr(blocks, "PACKED", 50)
    a, b = frame(spark, low), frame(spark, up)
    assert np.allclose(to_array(blocks.matmul(a, b, 2), 21, 21), low @ up) and np.allclose(to_array(blocks.matmul(b, a, 2), 21, 21), up @ low)
    assert np.allclose(to_array(blocks.syrk(2, a, 3, b, 2), 21, 21), np.tril(2 * low @ low.T + 3 * up))
    zero = blocks.gemm(2, a.limit(0), b, 3, spark.createDataFrame([(0, 1, 0.0), (5, 5, 2.0), (5, 5, 1.0)], "i long, j long, v double"), 2)
    assert sorted(tuple(r) for r in zero.collect()) == [(0, 1, 0.0), (5, 5, 9.0)]


def test_symmetric_and_triangular_products(spark):
    n, b = 7, 3
    t, x = kernel(spark, "symm", n)
    assert np.allclose(to_array(blocks.symm(1.5, t["a"], t["b"], 1.2, t["c"], b), n, n), 1.5 * x["a"] @ x["b"] + 1.2 * x["c"])
    t, x = kernel(spark, "syrk", n)
    assert np.allclose(to_array(blocks.syrk(1.5, t["a"], 1.2, t["c"], b), n, n), np.tril(1.5 * x["a"] @ x["a"].T + 1.2 * x["c"]))
    t, x = kernel(spark, "syr2k", n)
    assert np.allclose(to_array(blocks.syr2k(1.5, t["a"], t["b"], 1.2, t["c"], b), n, n), np.tril(1.5 * (x["a"] @ x["b"].T + x["b"] @ x["a"].T) + 1.2 * x["c"]))
    t, x = kernel(spark, "trmm", n)
    assert np.allclose(to_array(blocks.trmm(1.5, t["a"], t["b"], b), n, n), 1.5 * x["a"].T @ x["b"])


def test_matrix_vector_kernels(spark):
    n = 7
    t, x = kernel(spark, "atax", n)
    assert np.allclose(to_array(blocks.atax(t["a"], t["x"]), n), x["a"].T @ (x["a"] @ x["x"]))
    t, x = kernel(spark, "mvt", n)
    one, two = blocks.mvt(*(t[k] for k in ("a", "x1", "y1", "x2", "y2")))
    assert np.allclose(to_array(one, n), x["x1"] + x["a"] @ x["y1"]) and np.allclose(to_array(two, n), x["x2"] + x["a"].T @ x["y2"])
    t, x = kernel(spark, "gesummv", n)
    assert np.allclose(to_array(blocks.gesummv(1.5, t["a"], 1.2, t["b"], t["x"]), n), 1.5 * x["a"] @ x["x"] + 1.2 * x["b"] @ x["x"])
    t, x = kernel(spark, "gemver", n)
    got = blocks.gemver(1.5, 1.2, *(t[k] for k in ("a", "u1", "v1", "u2", "v2", "y", "z")))
    b = x["a"] + np.outer(x["u1"], x["v1"]) + np.outer(x["u2"], x["v2"])
    z = 1.2 * b.T @ x["y"] + x["z"]
    assert np.allclose(to_array(got[0], n, n), b) and np.allclose(to_array(got[1], n), z) and np.allclose(to_array(got[2], n), 1.5 * b @ z)


# ---- factorisations


@pytest.mark.parametrize(("n", "block"), [(6, 2), (7, 3), (1, 4)])
def test_lu_of_the_rotated_matrix(spark, n, block):
    factors, pi = dense.lu(make.rotated_lu_matrix(spark, n), n, block)
    want = np.tril(np.full((n, n), 0.5), -1) + np.triu(np.ones((n, n)))
    assert np.allclose(to_array(factors, n, n), want)
    assert [r.pi for r in pi.orderBy("i").collect()] == [(k + 1) % n for k in range(n)]
    assert dense.verify_lu(make.rotated_lu_matrix(spark, n), factors, pi, n, block).first().value < 1e-12


def test_lu_random_and_singular(spark):
    x = np.random.default_rng(1).standard_normal((9, 9))
    factors, pi = dense.lu(frame(spark, x), 9, 4)
    assert np.allclose(to_array(dense.reconstruct_lu(factors, pi, 9, 4), 9, 9), x)
    low, _ = dense.split_lu(factors, 9)
    assert np.abs(to_array(low, 9, 9)).max() <= 1
    x[:, 5] = x[:, 2]
    with pytest.raises(ValueError, match="singular at stage"):
        dense.lu(frame(spark, x), 9, 4)


def arrow_frame(spark, x):
    i, j = np.indices(x.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), "v": x.ravel()}))


def arrow_array(df, *shape):
    got, out = df.toArrow(), np.zeros(shape)
    out[tuple(got.column(c).to_numpy() for c in ("i", "j")[: len(shape)])] = got.column("v").to_numpy()
    return out


@pytest.mark.parametrize("pivoting", ["tournament", "partial"])
def test_lu_pivots_from_many_tasks(spark, monkeypatch, pivoting):
    """Files of few rows each, so that pivots pass two rounds of the tree before the last."""
    n = 96
    x = np.random.default_rng(5).standard_normal((n, n))
    kept = dense.stored
    monkeypatch.setattr(dense, "stored", lambda df, name="step": kept(df.repartition(24, "i") if name == "lu" else df, name))
    monkeypatch.setattr(dense, "ARITY", 3)
    sizes = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        factors, pi = dense.lu(arrow_frame(spark, x), n, 32, pivoting)
        got = arrow_array(factors, n, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = arrow_array(pi.withColumnRenamed("pi", "v"), n).astype(int)
    low = np.tril(got, -1)
    assert sorted(order) == list(range(n))
    assert np.abs((low + np.eye(n)) @ np.triu(got) - x[order]).max() < 1e-12
    assert np.abs(low).max() <= (1 if pivoting == "partial" else 8)
    if pivoting == "partial":
        assert np.allclose(got, dense.pivoted(x)[1]) and (order == dense.pivoted(x)[0]).all()


def test_factors_and_solutions_of_a_thousand_rows(spark):
    """With the threads that numpy takes by itself; blocks that don't divide the side, and a count of them that is no power
    of two."""
    n, block = 1000, 192
    rng = np.random.default_rng(6)
    x, b = rng.standard_normal((n, n)), rng.standard_normal(n)
    a, right = arrow_frame(spark, x).persist(), spark.createDataFrame(pa.table({"i": np.arange(n), "v": b}))
    factors, pi = dense.lu(a, n, block)
    got, order = arrow_array(factors, n, n), arrow_array(pi.withColumnRenamed("pi", "v"), n).astype(int)
    assert np.abs((np.tril(got, -1) + np.eye(n)) @ np.triu(got) - x[order]).max() < 1e-10
    assert np.abs(x @ arrow_array(dense.solve(a, right, n, block), n) - b).max() < 1e-8
    low = np.tril(x) + np.diag(np.full(n, 50.0))
    assert np.abs(low @ arrow_array(dense.trisolv(arrow_frame(spark, low), right, n, block), n) - b).max() < 1e-10
    spd = x @ x.T + np.eye(n)
    r = arrow_array(dense.cholesky(arrow_frame(spark, spd), n, block), n, n)
    assert np.allclose(r, np.linalg.cholesky(spd).T, atol=1e-8)


def test_tiles_that_are_absent(spark):
    """An arrow: all but the first column and the diagonal is 0, and the factor fills what is 0."""
    n = 11
    x = np.diag(np.full(n, 20.0))
    x[0], x[:, 0] = 1, 1
    x[0, 0] = 20
    entries = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(n) if x[i, j]], "i long, j long, v double")
    assert np.allclose(arrow_array(dense.cholesky(entries, n, 3), n, n), np.linalg.cholesky(x).T)
    x = np.diag(np.arange(1.0, n + 1))
    x[n - 1, 0] = 5
    entries = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(n) if x[i, j]], "i long, j long, v double")
    ones = spark.createDataFrame([(k, 1.0) for k in range(n)], "i long, v double")
    assert np.allclose(arrow_array(dense.trisolv(entries, ones, n, 2), n), np.linalg.solve(x, np.ones(n)))
    assert np.allclose(arrow_array(dense.backsolv(vector.transpose(entries), ones, n, 2), n), np.linalg.solve(x.T, np.ones(n)))
    for bad, words in ((entries.where("i != 4"), "singular"), (entries.where("i > 1"), "singular: 1 blocks")):
        with pytest.raises(ValueError, match=words):
            dense.trisolv(bad, ones, n, 2)


def test_cholesky_and_solves(spark):
    n = 8
    a = make.lu_spd_matrix(spark, n, 3)
    x = to_array(a, n, n)
    r = to_array(dense.cholesky(a, n, 3), n, n)
    assert np.allclose(r.T @ r, x) and np.allclose(r, np.triu(r))
    with pytest.raises(ValueError, match="not positive definite"):
        dense.cholesky(frame(spark, -np.eye(3)), 3, 2)
    t, y = kernel(spark, "ludcmp", n)
    assert np.allclose(to_array(dense.solve(t["a"], t["b"], n, 3), n), np.linalg.solve(y["a"], y["b"]))
    t, y = kernel(spark, "trisolv", n)
    assert np.allclose(to_array(dense.trisolv(t["l"], t["b"], n, 3), n), np.linalg.solve(y["l"], y["b"]))
    rows = make.kernel_inputs(spark, "toeplitz", n)["r"]
    c = to_array(rows, n + 1)
    matrix = np.array([[c[abs(i - j)] for j in range(n)] for i in range(n)])
    assert np.allclose(matrix @ to_array(dense.toeplitz_solve(rows, n, 3), n), -c[1:])


def test_qr_and_permutations(spark):
    x = np.random.default_rng(2).standard_normal((50, 4))
    q, r = dense.qr(frame(spark, x).repartition(3), 4)
    q, r = to_array(q, 50, 4), to_array(r, 4, 4)
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(4)) and (np.diag(r) > 0).all() and np.allclose(r, np.triu(r))
    x[:, 3] = x[:, 0]
    with pytest.raises(ValueError, match="dependent"):
        dense.qr(frame(spark, np.round(x) * 0), 4)
    assert dense.compose_swaps([(0, 2), (1, 2)], 3) == [2, 0, 1]


def test_qr_of_nearly_dependent_columns(spark, monkeypatch):
    """Chunks of few rows, so that the tree has several levels; a condition of 1e12."""
    rng = np.random.default_rng(8)
    u, v = np.linalg.qr(rng.standard_normal((700, 6)))[0], np.linalg.qr(rng.standard_normal((6, 6)))[0]
    x = u * np.logspace(0, -12, 6) @ v
    monkeypatch.setattr(dense, "ARITY", 2)
    q, r = dense.qr(arrow_frame(spark, x).repartition(23, "i"), 6)
    q, r = arrow_array(q, 700, 6), arrow_array(r, 6, 6)
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-13 and np.abs(q @ r - x).max() < 1e-13
    assert (np.diag(r) > 0).all() and np.allclose(r, np.triu(r))
    few = rng.standard_normal((3, 3))
    q, r = dense.qr(arrow_frame(spark, few).repartition(3, "i"), 3)
    assert np.allclose(arrow_array(q, 3, 3) @ arrow_array(r, 3, 3), few)
    with pytest.raises(ValueError, match="dependent"):
        dense.qr(arrow_frame(spark, few).limit(0), 3)


# ---- transforms and stencils


@pytest.mark.parametrize("n", [1, 2, 128])
def test_fft_and_back(spark, n):
    x = make.ramp_complex(spark, n).repartition(3)
    values = np.arange(n) + 1j
    y = spectral.fft(x, n)
    got = np.array([r.re + 1j * r.im for r in y.orderBy("i").collect()])
    direct = np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n) @ values
    assert np.allclose(got, direct)
    back = np.array([r.re + 1j * r.im for r in spectral.ifft(y, n).orderBy("i").collect()])
    assert np.allclose(back, values)


def test_fft_contract_and_hook(spark):
    x = make.ramp_complex(spark, 8)
    with pytest.raises(ValueError, match="power of two"):
        spectral.fft(make.ramp_complex(spark, 6), 6)
    with pytest.raises(ValueError, match="each place"):
        spectral.fft(x.where("i != 3"), 8)
    calls = lambda m: np.fft.fft(m, axis=1)
    assert spectral.fft(x, 8, calls).orderBy("i").collect() == spectral.fft(x, 8).orderBy("i").collect()
    keyed = x.withColumn("key", F.col("i") % 2).select("key", (F.col("i") / 2).cast("long").alias("i"), "re", "im")
    got = np.array([r.re + 1j * r.im for r in spectral.fft_grouped(keyed, "key").orderBy("key", "i").collect()])
    assert np.allclose(got, np.concatenate([np.fft.fft(np.arange(k, 8, 2) + 1j) for k in (0, 1)]))


@pytest.mark.parametrize(("n", "steps", "tile", "depth"), [(11, 3, 4, 4), (8, 2, 8, 2), (9, 0, 4, 2), (13, 5, 5, 4)])
def test_jacobi(spark, n, steps, tile, depth):
    a, b = make.jacobi_grid(spark, n)
    x, y = to_array(a, n, n), to_array(b, n, n)
    for _ in range(steps):
        for old, new in ((x, y), (y, x)):
            new[1:-1, 1:-1] = 0.2 * (old[1:-1, 1:-1] + old[1:-1, :-2] + old[1:-1, 2:] + old[2:, 1:-1] + old[:-2, 1:-1])
    assert np.allclose(to_array(stencil.jacobi2d(a, b, n, steps, tile, depth), n, n), x)
    if steps == 2:
        assert np.allclose(to_array(stencil.jacobi_cells(a, b, n, steps), n, n), x)


def test_fft_flop_rate(spark):
    assert math.isclose(spark.range(1).select(stats.fft_flop_rate(F.lit(8), F.lit(1.0))).first()[0], 136e-6)


# ---- what factorisations leave in the shared folder


def folder_bytes(spark, run) -> tuple[int, int]:
    """Bytes that a piece of work leaves in the shared folder, and that its shuffles write."""
    jvm, context = spark._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    size = lambda: at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    stages = lambda: context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), None)
    sent = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages().apply(k) for k in range(stages().size()))}
    there, before = size(), sent()
    run()
    return size() - there, sum(n for stage, n in sent().items() if stage not in before)


def test_cholesky_leaves_its_factor_and_sends_no_tiles(spark):
    n, block = 144, 12
    x = np.random.default_rng(6).standard_normal((n, n))
    a = arrow_frame(spark, x @ x.T + n * np.eye(n))
    got = {}
    left, sent = folder_bytes(spark, lambda: got.update(r=dense.cholesky(a, n, block)))
    assert np.allclose(arrow_array(got["r"], n, n), np.linalg.cholesky(x @ x.T + n * np.eye(n)).T)
    assert left < 2 * 8 * n * n and sent < 4 * 8 * n * n


@pytest.mark.parametrize("pivoting", ["tournament", "partial"])
def test_lu_leaves_its_factors_alone(spark, pivoting):
    n, block = 144, 12
    x = np.random.default_rng(7).standard_normal((n, n))
    got = {}
    left, _ = folder_bytes(spark, lambda: got.update(p=dense.lu(arrow_frame(spark, x), n, block, pivoting)))
    factors, pi = got["p"]
    assert np.allclose(arrow_array(dense.reconstruct_lu(factors, pi, n, block), n, n), x)
    assert left < 3 * 8 * n * n
