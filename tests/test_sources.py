import struct

import numpy as np
import pytest

from numweave.operators import sparse, stats
from numweave.sources import generators, readers, writers

HERE = __file__.rsplit("/", 1)[0] + "/fixtures/"


def triples(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_matrix_market_with_parts(spark):
    a, n = readers.read_matrix_market(spark, HERE + "five.mtx")
    assert n == 5
    assert triples(a.where("part = 0"), "i", "j", "v") == [(0, 1, 3), (1, 0, 4), (1, 1, 1), (2, 1, 5), (2, 2, 9), (3, 0, 6)]
    assert triples(a.where("part = 1"), "i", "j", "v") == [(0, 4, 1), (2, 3, 2), (3, 3, 5), (3, 4, 3), (4, 2, 5), (4, 3, 8), (4, 4, 9)]


def test_matrix_market_pattern_empty_parts_and_errors(spark, tmp_path):
    (tmp_path / "p").write_text("%%MatrixMarket matrix coordinate pattern general\n% c\n3 3 2 3\n0\n0\n2\n2\n1 1\n3 2\n")
    a, n = readers.read_matrix_market(spark, str(tmp_path / "p"))
    assert triples(a, "i", "j", "v", "part") == [(0, 0, 1.0, 1), (2, 1, 1.0, 1)] and n == 3
    (tmp_path / "plain").write_text("2 2 1\n2 1 0.5\n")
    assert triples(readers.read_matrix_market(spark, str(tmp_path / "plain"))[0], "i", "j", "v", "part") == [(1, 0, 0.5, 0)]
    (tmp_path / "bad").write_text("2 3 1\n2 1 0.5\n")
    with pytest.raises(ValueError, match="not square"):
        readers.read_matrix_market(spark, str(tmp_path / "bad"))


def test_matrix_market_of_many_files_is_read_in_order_of_their_names(spark, tmp_path):
    entries = [(k, (7 * k) % 40, k + 0.5, k // 20) for k in range(40)]
    lines = ["% c"] * 70 + ["40 40 40 2", "0", "20", "40"] + [f"{i + 1} {j + 1} {v}" for i, j, v, _ in entries]
    for k in reversed(range(12)):
        (tmp_path / f"part-{k:05d}-x.txt").write_text("".join(x + "\n" for x in lines[10 * k : 10 * k + 10]))
    a, n = readers.read_matrix_market(spark, str(tmp_path))
    assert n == 40 and triples(a, "i", "j", "v", "part") == entries


def test_distributions(spark, tmp_path):
    v, u = (readers.read_vector_distribution(spark, HERE + f"five.{x}") for x in "vu")
    assert triples(v, "i", "part", "local_ind") == [(0, 1, 0), (1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 2)]
    assert triples(u, "i", "part", "local_ind") == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 0, 2), (4, 1, 1)]
    (tmp_path / "x").write_text("2 1\n2 1\n1 1\n")
    with pytest.raises(ValueError, match="line 1"):
        readers.read_vector_distribution(spark, str(tmp_path / "x"))


def test_sparse_product_of_the_file(spark):
    a, n = readers.read_matrix_market(spark, HERE + "five.mtx")
    v, u = (readers.read_vector_distribution(spark, HERE + f"five.{x}") for x in "vu")
    ones = generators.vector(spark, n, lambda i: i * 0 + 1)
    assert triples(sparse.spmv(a, ones), "i", "v") == [(0, 4), (1, 5), (2, 16), (3, 14), (4, 22)]
    assert tuple(sparse.spmv_traffic(a, v, u).first()) == (2, 3)
    rows = sparse.icrs(a)
    for part, inc, col, start in ((0, [1, 2, 1, 3, 1, 1, 3], [1, 0, 1, 1, 2, 0], [0, 1, 3, 5, 6]), (1, [2, 2, 3, 1, 1, 1, 1, 1], [2, 1, 1, 2, 0, 1, 2], [0, 1, 2, 4, 7])):
        own = rows.where(f"part = {part}").orderBy("k").collect()
        assert [r.inc for r in own] == inc and [r.col_local for r in own[:-1]] == col and own[-1].v == 0
        assert [r.start for r in sparse.row_starts(a).where(f"part = {part}").orderBy("row_local").collect()] == start
    assert sparse.spmv(a.limit(0), ones, ones).where("v != 0").count() == 0


def test_dense_binary(spark, tmp_path):
    x = np.arange(16.0).reshape(4, 4) / 3
    (tmp_path / "m").write_bytes(x.astype("<f8").tobytes())
    (tmp_path / "p").write_bytes(struct.pack("<4i", 2, 0, 3, 1))
    assert [r.row for r in readers.read_dense_f64(spark, str(tmp_path / "m"), 4).orderBy("i").collect()] == x.tolist()
    assert triples(readers.read_perm_i32(spark, str(tmp_path / "p")), "i", "pi") == [(0, 2), (1, 0), (2, 3), (3, 1)]


def test_dense_binary_is_written_and_read(spark, tmp_path):
    n = 40
    x = np.random.default_rng(3).standard_normal((n, n))
    x[7] = 0
    a = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(n) if x[i, j]], "i long, j long, v double").repartition(5)
    pi = spark.createDataFrame([(k, (k * 7) % n) for k in range(n)], "i long, pi long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_lu(a, pi, f"file://{tmp_path}", "dense", n)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "lu").iterdir())
    assert len(files) > 1 and b"".join(f.read_bytes() for f in files) == x.astype("<f8").tobytes()
    assert all((np.array(r.row) == x[r.i]).all() for r in readers.read_dense_f64(spark, str(tmp_path / "lu"), n).collect())
    assert triples(readers.read_perm_i32(spark, str(tmp_path / "pi")), "i", "pi") == triples(pi, "i", "pi")
    for bad in (pi, pi.where("i != 3").union(pi.where("i = 9")), pi.where("i > 0")):
        with pytest.raises(Exception, match="holds records already|absent, repeated|is absent"):
            writers.write_perm_i32(bad, str(tmp_path / ("pi" if bad is pi else "other")))
        assert not [f for f in tmp_path.glob("other/*") if f.name.startswith("part-")]
    writers.write_records(pi.limit(0).selectExpr("i", "CAST(NULL AS BINARY) AS data"), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="side"):
        writers.write_lu(a, pi, str(tmp_path / "x"), "dense")


def test_run_times_and_report(spark, tmp_path):
    for name, head, rows in (("a/1", "n,p,time,value", "8,1,{},0"), ("a/2", "n,p,time,value,", "8,2,{},0,"), ("b/1", "n,tsteps,p,time,value", "8,10,1,{},0")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "\n".join(rows.format(t / (2 if name == "a/2" else 1)) for t in range(1, 26)))
    (tmp_path / "a" / "notes.txt").write_text("n,p\n1,2\n")
    runs = readers.read_run_times(spark, str(tmp_path))
    assert runs.count() == 75 and {(r.experiment, r.tsteps) for r in runs.select("experiment", "tsteps").distinct().collect()} == {("a", None), ("b", 10)}
    report = {(r.experiment, r.p): r for r in stats.scaling_report(runs).collect()}
    assert (report["a", 1].time, report["a", 1].lower, report["a", 1].upper, report["a", 2].speedup) == (13, 5, 6, 2)
    formula = stats.median_ci(runs.where("experiment = 'b'"), ["p"], "time", convention="formula").first()
    assert (formula.lower, formula.upper) == (8, 20)
    large = stats.median_ci_large(runs, ["experiment", "p"], "time")
    assert triples(large, *large.columns) == triples(stats.median_ci(runs, ["experiment", "p"], "time"), *large.columns)


def test_long_results_and_scaling(spark, tmp_path):
    (tmp_path / "r").write_text("n,p,name,value\n10000,1,time,294.773755\n10000,2,time,161.810936\n10000,32,time,31.165082")
    rows = stats.pivot_names(readers.read_results_long(spark, str(tmp_path / "r")), ["time"])
    assert [round(r.speedup, 4) for r in stats.speedup(rows, ["n"]).orderBy("p").collect()] == [1, 1.8217, 9.4585]
    assert {r.serial_time for r in stats.weak_scaling(rows.withColumn("e", rows.n * 0), ["e"]).collect()} == {294.773755}
    (tmp_path / "two").write_text("number_of_processors, time\n1, 298.04\n2, 206.92\n")
    assert triples(readers.read_two_columns(spark, str(tmp_path / "two")), "p", "time") == [(1, 298.04), (2, 206.92)]


def test_writers_round_trip(spark, tmp_path):
    a = generators.rotated_lu_matrix(spark, 6)
    pi = spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)], "i long, pi long")
    writers.write_lu(a, pi, str(tmp_path / "lu"))
    assert triples(spark.read.parquet(str(tmp_path / "lu/lu")), "i", "j", "v") == triples(a, "i", "j", "v")
    assert triples(spark.read.parquet(str(tmp_path / "lu/pi")), "i", "pi") == triples(pi, "i", "pi")
    runs = spark.createDataFrame([(8, 1, 0.5, 0.0), (8, 2, 0.25, 0.0)], "n int, p int, time double, value double")
    writers.write_run_times(runs, str(tmp_path / "runs"))
    assert triples(spark.read.csv(str(tmp_path / "runs"), header=True, inferSchema=True), "n", "p", "time") == [(8, 1, 0.5), (8, 2, 0.25)]
    dump = "".join(r.text for r in writers.format_matrix_dump(generators.matrix(spark, 5, 5, lambda i, j: i + j / 10), 5).orderBy("i").collect())
    assert dump.startswith("\n0.00 0.10 ") and dump.count("\n") == 2 and dump.split("\n")[2] == "4.00 4.10 4.20 4.30 4.40 "


def test_run_times_of_one_experiment_are_written_and_read_by_many_tasks(spark, tmp_path):
    runs = spark.range(400).selectExpr("'a b' AS experiment", "CAST(id AS INT) AS n", "CAST(id % 7 AS INT) AS p", "id / 8 AS time").repartition(4)
    writers.write_run_times(runs, str(tmp_path / "runs"), by="experiment")
    assert len(list((tmp_path / "runs").glob("*/*.csv"))) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = readers.read_run_times(spark, str(tmp_path / "runs"))
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert triples(got, "n", "p", "time") == triples(runs, "n", "p", "time") and got.where("tsteps IS NULL AND value IS NULL").count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
