"""Writers: triples, factors, run times by part, and the text dump of a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import div
from ..operators.dense import full_rows
from .binary import write_records


def write_triples(a: DataFrame, path: str, kind: str = "parquet") -> None:
    """Row ranges to files, so that a reader of some rows opens few of them."""
    a.repartitionByRange("i", "j").sortWithinPartitions("i", "j").write.format(kind).option("header", True).save(path)


def write_dense_f64(a: DataFrame, n: int, path: str, columns: int | None = None) -> None:
    """A matrix (i, j, v) of n rows as little-endian doubles by rows, absent entries 0, as ``read_dense_f64`` reads it: n to a
    row, or so many columns."""
    write_records(full_rows(a, n, columns).select("i", F.col("row").alias("data")), path)


def write_perm_i32(pi: DataFrame, path: str) -> None:
    """A permutation (i, pi) as little-endian 32-bit integers, as ``read_perm_i32`` reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("pi").to_numpy().astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([x.tobytes() for x in np.split(numbers, len(numbers))] if len(numbers) else [], pa.binary())], names=["i", "data"])

    write_records(pi.select("i", "pi").mapInArrow(run, "i long, data binary"), path)


def write_lu(factors: DataFrame, pi: DataFrame, path: str, kind: str = "parquet", n: int | None = None) -> None:
    """``path``/lu holds the factors in one matrix, ``path``/pi the permutation. ``kind`` dense: the binary form, for which
    the side n is needed."""
    if kind == "dense":
        if n is None:
            raise ValueError("the dense form needs the matrix's side")
        write_dense_f64(factors, n, f"{path}/lu")
        return write_perm_i32(pi, f"{path}/pi")
    write_triples(factors, f"{path}/lu", kind)
    pi.repartitionByRange("i").sortWithinPartitions("i").write.format(kind).option("header", True).save(f"{path}/pi")


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Texts (column line) in files whose names follow the order, so that the folder reads as one file."""
    lines.orderBy(*order).select("line").write.text(path)


def write_matrix_market(a: DataFrame, parts: int, path: str) -> None:
    """A square matrix (i, j, v, part) as ``read_matrix_market`` reads it: ``n n nz parts``, the parts' starts, entries from 1."""
    found = a.groupBy("part").agg(F.count("*").alias("n"), F.greatest(F.max("i"), F.max("j")).alias("last")).collect()
    starts = [sum(r.n for r in found if r.part < p) for p in range(parts + 1)]
    n = max((r.last for r in found if r.last is not None), default=0) + 1
    head = [f"{n} {n} {starts[-1]} {parts}", *map(str, starts)]
    first = a.sparkSession.createDataFrame([(-1, k, 0, x) for k, x in enumerate(head)], "part int, i long, j long, line string")
    entries = a.select("part", "i", "j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "v").alias("line"))
    write_lines(first.union(entries), ["part", "i", "j"], path)


def write_vector_distribution(owners: DataFrame, parts: int, path: str) -> None:
    """(i, part) for each i of 0 .. n-1 as ``read_vector_distribution`` reads it: ``n parts``, then both from 1."""
    first = owners.agg(F.concat_ws(" ", F.count("*"), F.lit(parts)).alias("line")).select(F.lit(-1).cast("long").alias("i"), "line")
    write_lines(first.union(owners.select("i", F.concat_ws(" ", F.col("i") + 1, F.col("part") + 1))), ["i"], path)


def write_run_times(df: DataFrame, path: str, by: str = "p") -> None:
    """``n,p,time,value`` with a header, in a folder for each value of ``by``: p, or the experiment, as ``read_run_times`` reads
    them. Each task writes a file for each value it meets, so a few values do not mean a few tasks, and nothing is shuffled."""
    kept = [c for c in (*{by: 0}, "n", "tsteps", "p", "time", "value") if c in df.columns]
    df.select(*dict.fromkeys(kept)).write.partitionBy(by).csv(path, header=True)


def format_matrix_dump(a: DataFrame, n: int) -> DataFrame:
    """(i, text): each row's entries with two decimals and a blank, a new line before every 20th entry of the matrix.
    Joined in order of i the texts are the dump. Entries that are absent count as 0."""
    grid = a.sparkSession.range(n * n).select(div(F.col("id"), n).alias("i"), (F.col("id") % n).alias("j"))
    cells = grid.join(a.select("i", "j", "v"), ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    text = F.concat(F.when((F.col("i") * n + F.col("j")) % 20 == 0, "\n").otherwise(""), F.format_string("%.2f ", "v"))
    row = F.array_sort(F.collect_list(F.struct("j", text.alias("t"))))
    return cells.groupBy("i").agg(F.array_join(F.transform(row, lambda x: x["t"]), "").alias("text"))
