"""The library's tables (vectors, matrices, graph, signal, grid, runs) as views of the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.index import div
from ..storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_key():
    """A line item's place: order and line number (under 8) in one number."""
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i")


def vector_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quantities, and prices in cents, by place; lines with one place add up."""
    lines = table(spark, sf_dir, "lineitem").groupBy(line_key()).agg(F.sum("l_quantity").alias("x"), F.sum(F.round(F.col("l_extendedprice") * 100)).alias("y"))
    return lines.select("i", F.col("x").alias("v")), lines.select("i", F.col("y").alias("v"))


def supply_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i supplier, j part, v quantity, part = i mod 4)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return lines.withColumn("part", F.pmod("i", F.lit(4)).cast("int"))


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))


def n_suppliers(spark: SparkSession, sf_dir: str) -> int:
    """Suppliers have the keys 0 .. n-1."""
    return table(spark, sf_dir, "supplier").count()


def matrix_side(spark: SparkSession, sf_dir: str) -> int:
    """Side of the dense matrices and grids: the number of suppliers, but no more than the square root of the number of line
    items, so that a matrix has no more cells than its table has rows. Suppliers beyond it are folded onto the others."""
    return min(n_suppliers(spark, sf_dir), math.isqrt(table(spark, sf_dir, "lineitem").count()))


def trade_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by suppliers (see ``matrix_side``): the quantity that i delivers in orders with lines of j, once for each such
    line; absent cells 0; on the diagonal the side besides. Written once, as products read it several times."""
    n = matrix_side(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", (F.col("l_suppkey") % n).alias("i"), F.col("l_quantity").alias("v"))
    cells = a.join(lines.select("l_orderkey", (F.col("l_suppkey") % n).alias("j")), "l_orderkey").where("i != j").groupBy("i", "j").agg(F.sum("v").alias("v"))
    grid = spark.range(n * n).select(div(F.col("id"), n).alias("i"), (F.col("id") % n).alias("j"))
    base = grid.withColumn("v", F.when(F.col("i") == F.col("j"), F.lit(float(n))).otherwise(0.0))
    return stored(cells.select("i", "j", "v").union(base).groupBy("i", "j").agg(F.sum("v").alias("v")), "trade")


def trade_rows(t: DataFrame, row: int) -> DataFrame:
    """Row of a matrix as a vector."""
    return t.where(F.col("i") == row).select(F.col("j").alias("i"), "v")


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, w, part): suppliers that share orders, by the number of pairs of lines; both directions."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = lines.select("l_orderkey", F.col("l_suppkey").alias("i")), lines.select("l_orderkey", F.col("l_suppkey").alias("j"))
    pairs = a.join(b, "l_orderkey").where("i != j").groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))
    return pairs.withColumn("part", F.pmod("i", F.lit(4)).cast("int"))


def hourly_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, re, im): events in each hour since the first, from 0 on; the length is the least power of two, 64 at least,
    that holds the hours to the last event. Hours without events and the rest are 0."""
    hours = table(spark, sf_dir, "events").select(div(F.unix_timestamp("ts"), 3600).alias("h"))
    first, last = (x or 0 for x in hours.agg(F.min("h"), F.max("h")).first())
    counts = hours.groupBy((F.col("h") - first).alias("i")).agg(F.count("*").cast("double").alias("re"))
    places = spark.range(max(64, 1 << (last - first).bit_length())).select(F.col("id").alias("i"))
    return places.join(counts, "i", "left").select("i", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def quantity_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quantities by part and supplier, both modulo the side of the matrices, and the same plus 1."""
    n = matrix_side(spark, sf_dir)
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % n).alias("i"), (F.col("l_suppkey") % n).alias("j"), F.col("l_quantity").alias("v"))
    zeros = spark.range(n * n).select(div(F.col("id"), n).alias("i"), (F.col("id") % n).alias("j"), F.lit(0.0).alias("v"))
    a = cells.union(zeros).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return a, a.withColumn("v", F.col("v") + 1)


def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, n, p, time, i): prices by return flag and line number as if they were repeated runs."""
    p = F.col("l_linenumber").cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("experiment"), (p * 1000).alias("n"), p.alias("p"), F.col("l_extendedprice").alias("time"), line_key())


#: Side of the matrices in SQL.
SIDE = "(SELECT least((SELECT count(*) FROM supplier), CAST(floor(sqrt(count(*))) AS BIGINT)) FROM lineitem)"

#: SQL of the views, for comparison.
SQL = {
    "x": "x AS (SELECT l_orderkey * 8 + l_linenumber AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1)",
    "y": "y AS (SELECT l_orderkey * 8 + l_linenumber AS i, sum(round(l_extendedprice * 100)) AS v FROM lineitem GROUP BY 1)",
    "a": "a AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v, CAST(l_suppkey % 4 AS INTEGER) AS part FROM lineitem GROUP BY ALL)",
    "pv": "pv AS (SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v FROM part)",
    "t": f"""d AS (SELECT {SIDE} AS side), o AS (SELECT l_orderkey, l_suppkey % side AS k, l_quantity AS q FROM lineitem, d), t AS (SELECT i, j, sum(v) AS v FROM (
        SELECT a.k AS i, b.k AS j, a.q AS v FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.k <> b.k
        UNION ALL SELECT a.range, b.range, CASE WHEN a.range = b.range THEN CAST({SIDE} AS DOUBLE) ELSE 0.0 END
        FROM range({SIDE}) a, range({SIDE}) b) GROUP BY i, j)""",
    "g": """g AS (SELECT a.l_suppkey AS i, b.l_suppkey AS j, CAST(count(*) AS DOUBLE) AS w, CAST(a.l_suppkey % 4 AS INTEGER) AS part
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey)""",
    "s": """s AS (WITH e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events), b AS (SELECT min(h) AS a, max(h) AS z FROM e),
        r AS (SELECT unnest(range(greatest(64, CAST(pow(2, ceil(log2(z - a + 1))) AS BIGINT)))) AS i FROM b)
        SELECT r.i, coalesce(c.n, 0.0) AS re FROM r LEFT JOIN (SELECT h - a AS i, CAST(count(*) AS DOUBLE) AS n FROM e, b GROUP BY ALL) c USING (i))""",
    "q": f"""q AS (SELECT i, j, sum(v) AS v FROM (SELECT l_partkey % {SIDE} AS i, l_suppkey % {SIDE} AS j, l_quantity AS v FROM lineitem
        UNION ALL SELECT a.range, b.range, 0.0 FROM range({SIDE}) a, range({SIDE}) b) GROUP BY i, j)""",
    "runs": """runs AS (SELECT l_returnflag AS experiment, CAST(l_linenumber * 1000 AS INTEGER) AS n, CAST(l_linenumber AS INTEGER) AS p,
        l_extendedprice AS time FROM lineitem)""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(SQL[x] for x in names.split())} {body}"
