"""Readers: matrices with parts, distributions, dense binary, run times. Schemas are stated, never inferred."""

from __future__ import annotations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sparse import local_index_of
from .binary import record_files


def text_lines(spark: SparkSession, path: str) -> RDD:
    """Lines of a file, or of a folder's files in order of their names (a folder is listed in no order)."""
    return spark.sparkContext.textFile(record_files(spark, path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(k, line) of a text file; k counts from 0 over the whole file. Lines keep their order through zipWithIndex, which
    counts partitions first, so no task sees more than its own."""
    return spark.createDataFrame(text_lines(spark, path).zipWithIndex().map(lambda x: (x[1], x[0])), "k long, line string")


def market_head(lines: RDD) -> tuple[list[str], list[int], list[int], int]:
    """(first line's words, sizes, part starts, place of the first entry), from as many first lines as it takes."""
    most = 64
    while True:
        found = lines.take(most)
        at = next((k for k, x in enumerate(found) if x.strip() and not x.lstrip().startswith("%")), None)
        if at is not None:
            numbers = [int(x) for x in found[at].split()]
            starts, first = [0, numbers[2]], at + 1
            if len(numbers) > 3:
                starts = []
                while len(starts) <= numbers[3] and first < len(found):
                    starts += [int(x) for x in found[first].split()]
                    first += 1
            if len(numbers) <= 3 or len(starts) > numbers[3]:
                return found[0].split(), numbers, starts, first
        if len(found) < most:
            raise ValueError("no header" if at is None else "the starts of parts are not complete")
        most *= 4


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((i, j, v, part), n) of a square matrix file, indices from 0.

    Optional banner of five words, comments, then ``m n nz p`` and p + 1 part starts, or ``m n nz`` (all in part 0).
    Entry k is in the part q with start[q] <= k < start[q + 1]; parts may be empty. Entries of a pattern file are 1.
    Symmetric files are not expanded.
    """
    try:
        banner, numbers, starts, first = market_head(text_lines(spark, path))
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from None
    pattern = banner[:1] == ["%%MatrixMarket"] and banner[3:4] == ["pattern"]
    if numbers[0] != numbers[1]:
        raise ValueError(f"{path}: {numbers[0]} by {numbers[1]} is not square")
    lines = numbered_lines(spark, path)
    words = F.split(F.trim("line"), r"\s+")
    rows = lines.where(f"k >= {first} AND line RLIKE '\\\\S'").select((F.col("k") - first).alias("k"), words.alias("w")).where(f"k < {numbers[2]}")
    part = F.size(F.filter(F.array(*map(F.lit, starts[:-1])), lambda s: s <= F.col("k"))) - 1
    value = F.lit(1.0) if pattern else F.get("w", F.lit(2)).cast("double")
    index = lambda c: (F.get("w", F.lit(c)).cast("long") - 1)
    return rows.select(index(0).alias("i"), index(1).alias("j"), value.alias("v"), part.alias("part")), numbers[0]


def read_vector_distribution(spark: SparkSession, path: str) -> DataFrame:
    """(i, part, local_ind): header ``n p``, then ``i part`` from 1 in order of i; another order is an error."""
    lines = numbered_lines(spark, path)
    words = F.split(F.trim("line"), r"\s+")
    rows = lines.where("k > 0 AND line RLIKE '\\\\S'").select("k", (F.get(words, F.lit(0)).cast("long") - 1).alias("i"), (F.get(words, F.lit(1)).cast("int") - 1).alias("part"))
    if bad := rows.where("i != k - 1").limit(1).collect():
        raise ValueError(f"{path}: line {bad[0].k} holds index {bad[0].i + 1}")
    return local_index_of(rows)


def read_dense_f64(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(i, row): little-endian doubles, n to a row, of a file or of a folder's files in order of their names."""
    records = spark.sparkContext.binaryRecords(record_files(spark, path), 8 * n).zipWithIndex()
    return spark.createDataFrame(records.map(lambda x: (x[1], np.frombuffer(x[0], "<f8").tolist())), "i long, row array<double>")


def read_perm_i32(spark: SparkSession, path: str) -> DataFrame:
    """(i, pi): little-endian 32-bit integers, of a file or of a folder's files in order of their names."""
    records = spark.sparkContext.binaryRecords(record_files(spark, path), 4).zipWithIndex()
    return spark.createDataFrame(records.map(lambda x: (x[1], int.from_bytes(x[0], "little", signed=True))), "i long, pi long")


def read_run_times(spark: SparkSession, root: str) -> DataFrame:
    """(experiment, n, tsteps, p, time, value, file) of root/<experiment>/*.csv.

    Files name their columns in a first line: ``tsteps`` may be absent (null), an empty last name is dropped. Where each
    file has its columns is broadcast, a row for each file, so the lines stay where they are read.
    """
    lines = spark.read.text(f"{root}/*/*.csv").select(F.col("_metadata.file_path").alias("file"), "value")
    kinds = (("n", "int"), ("tsteps", "int"), ("p", "int"), ("time", "double"), ("value", "double"))
    names = F.transform(F.split("value", ","), F.trim)
    places = ((F.array_position(names, c) - 1).cast("int").alias(f"at_{c}") for c, _ in kinds)
    experiment = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("experiment")
    heads = lines.where(F.trim(F.substring_index("value", ",", 1)) == "n").select("file", experiment, *places).dropDuplicates(["file"])
    cells = lines.select("file", F.split("value", ",").alias("w")).where(F.get("w", F.lit(0)).try_cast("int").isNotNull()).join(F.broadcast(heads), "file")
    return cells.select("experiment", *(F.get("w", F.col(f"at_{c}")).try_cast(kind).alias(c) for c, kind in kinds), "file")


def read_results_long(spark: SparkSession, path: str) -> DataFrame:
    """(n, p, name, value)."""
    return spark.read.csv(path, header=True, schema="n int, p int, name string, value double", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_two_columns(spark: SparkSession, path: str) -> DataFrame:
    """(p, time) of a two-column file with a header; blanks may follow the comma."""
    return spark.read.csv(path, header=True, schema="p int, time double", ignoreLeadingWhiteSpace=True)
