"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..functions import index as X
from ..operators import blocks as B
from ..operators import dense as D
from ..operators import graph as G
from ..operators import order as O
from ..operators import sparse as S
from ..operators import spectral, stats, stencil
from ..operators import vector as V
from ..sources import readers, writers
from ..sources.writers import format_matrix_dump
from ..storage import shared_dir, stored
from . import views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Side of a block of products in the queries.
BLOCK = 64
#: Side of the trade matrix, in SQL.
SIDE = views.SIDE


def stage(n: int) -> int:
    """Columns that a factorisation takes at a time: four stages, or more for large matrices."""
    return min(256, -(-n // 4))


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(x: Column | str, digits: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + 0.0


def tidy(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in names or ("v",)})


def named(values: dict[str, DataFrame]) -> DataFrame:
    """(name, value) of one-row tables with a column value."""
    return functools.reduce(DataFrame.union, (x.select(F.lit(k).alias("name"), F.col("value").cast("double").alias("value")) for k, x in values.items()))


# ---- repeated runs

REPORT = """, k AS (SELECT *, row_number() OVER (PARTITION BY experiment, p ORDER BY time) - 1 AS r, count(*) OVER (PARTITION BY experiment, p) AS c FROM runs),
    m AS (SELECT experiment, n AS size, p, c AS runs, quantile_cont(time, 0.5) AS time,
        max(CASE WHEN r = greatest(0, floor((c - 1.96 * sqrt(c)) / 2)) THEN time END) AS a,
        max(CASE WHEN r = least(c - 1, ceil((c + 1.96 * sqrt(c)) / 2)) THEN time END) AS b,
        max(CASE WHEN r = least(c - 1, ceil(1 + (c + 1.96 * sqrt(c)) / 2)) THEN time END) AS b2
      FROM k GROUP BY experiment, n, p, c)"""


@query(with_views("runs", REPORT + """SELECT experiment, size, p, runs, round(time, 4) AS time, round(time - a, 4) AS lower, round(b - time, 4) AS upper,
    round(first_value(time) OVER (PARTITION BY experiment ORDER BY p) / time, 6) AS speedup, p AS optimum FROM m"""))  # fmt: skip
def strong_scaling_report(spark, sf_dir):
    report = stats.scaling_report(views.run_times(spark, sf_dir), "strong", large=True)
    return tidy(tidy(report, 4, "time", "lower", "upper"), 6, "speedup")


@query(with_views("runs", REPORT + """SELECT experiment, size, p, runs, round(time, 4) AS time, round(a, 4) AS lower, round(b2, 4) AS upper,
    round(first_value(time) OVER (PARTITION BY experiment ORDER BY size, p), 4) AS serial_time FROM m"""))  # fmt: skip
def weak_scaling_report(spark, sf_dir):
    report = stats.scaling_report(views.run_times(spark, sf_dir), "weak", "formula", large=True)
    return tidy(report, 4, "time", "lower", "upper", "serial_time")


@query("""SELECT l_returnflag AS experiment, l_linenumber AS p, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY ALL""")
def median_by_part(spark, sf_dir):
    runs = views.run_times(spark, sf_dir)
    return tidy(stats.median_by(runs, ["experiment", "p"], "time"), 4, "median")


@query(with_views("runs", """, k AS (SELECT *, row_number() OVER (PARTITION BY experiment, p ORDER BY time) - 1 AS r FROM runs)
    SELECT experiment, CAST(r AS BIGINT) AS r, """ + ", ".join(f"max(CASE WHEN p = {p} THEN time END) AS p{p}" for p in range(1, 8)) + " FROM k GROUP BY experiment, r"))  # fmt: skip
def pivot_runs(spark, sf_dir):
    return stats.pivot_runs(views.run_times(spark, sf_dir), ["experiment"], list(range(1, 8)), large=True)


@query("""SELECT CAST(l_linenumber AS INTEGER) AS n, CAST(l_orderkey % 4 AS INTEGER) AS p, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "qA",
    sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "qN", sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "qR" FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def pivot_names(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    keys = (F.col("l_linenumber").cast("int").alias("n"), (F.col("l_orderkey") % 4).cast("int").alias("p"), F.col("l_returnflag").alias("name"))
    long = lines.groupBy(*keys).agg(F.sum("l_quantity").alias("value"))
    return stats.pivot_names(long.withColumn("name", F.concat(F.lit("q"), "name")), ["qA", "qN", "qR"])


@query("""SELECT l_returnflag AS experiment, round(1e12 / max(l_extendedprice) / 1e6, 6) AS least, round(1e12 / min(l_extendedprice) / 1e6, 6) AS most,
    round(avg(1e12 / l_extendedprice / 1e6), 4) AS mean FROM lineitem GROUP BY 1""")  # fmt: skip
def rate_summary(spark, sf_dir):
    rates = stats.rate_summary(views.run_times(spark, sf_dir), ["experiment"], "time", 1e12)
    return tidy(tidy(rates, 6, "least", "most"), 4, "mean")


@query("""SELECT 'low' AS range, round(regr_slope(l_extendedprice, l_quantity), 4) AS g, round(regr_intercept(l_extendedprice, l_quantity), 3) AS l FROM lineitem WHERE l_quantity BETWEEN 0 AND 20
    UNION ALL SELECT 'high', round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem WHERE l_quantity BETWEEN 20 AND 50""")  # fmt: skip
def fit_line(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    fits = (stats.fit_line(lines, "l_quantity", "l_extendedprice", a, b).select(F.lit(k).alias("range"), "g", "l") for k, a, b in (("low", 0, 20), ("high", 20, 50)))
    return tidy(tidy(functools.reduce(DataFrame.union, fits), 4, "g"), 3, "l")


@query("""WITH f AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 5),
    k AS (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS r FROM lineitem SEMI JOIN f USING (l_orderkey)),
    m AS (SELECT l_orderkey, floor(avg(v) * 1e8) / 1e8 AS mean, min(v) AS a, max(v) AS b FROM k WHERE r BETWEEN 2 AND 4 GROUP BY 1)
    SELECT l_orderkey, round(mean, 4) AS mean, round(greatest(abs(a - mean), abs(b - mean)) / mean * 100, 4) AS deviation, greatest(abs(a - mean), abs(b - mean)) / mean * 100 < 5 AS ok FROM m""")  # fmt: skip
def middle_three(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    five = lines.groupBy("l_orderkey").count().where("count = 5").select("l_orderkey")
    return tidy(stats.middle_three(lines.join(five, "l_orderkey", "left_semi"), ["l_orderkey"], "l_extendedprice"), 4, "mean", "deviation")


SAMPLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pair_sql(f: str, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round({f}({a}, {b}), {digits}) + 0.0 AS v FROM lineitem"
        for i, a in enumerate(SAMPLES)
        for j, b in enumerate(SAMPLES)
    )


@query(pair_sql("corr", 6))
def correlation_matrix(spark, sf_dir):
    return tidy(stats.correlation_matrix(views.table(spark, sf_dir, "lineitem"), SAMPLES), 6)


@query(pair_sql("covar_samp", 3))
def covariance_matrix(spark, sf_dir):
    return tidy(stats.covariance_matrix(views.table(spark, sf_dir, "lineitem"), SAMPLES), 3)


@query("""SELECT CAST(l_linenumber AS INTEGER) AS p, CAST(count(*) AS BIGINT) AS n,
    round((5 * count(*) * log2(count(*)) + 2 * count(*)) / sum(l_quantity) / 1e6, 9) AS rate FROM lineitem GROUP BY 1""")  # fmt: skip
def fft_flop_rate(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("p")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))
    return lines.select("p", "n", rounded(stats.fft_flop_rate(F.col("n"), F.col("s")), 9).alias("rate"))


# ---- vectors and places


@query(with_views("x y a", """SELECT 'inner' AS name, (SELECT sum(x.v * y.v) FROM x JOIN y USING (i)) AS value
    UNION ALL SELECT 'total', (SELECT sum(v) FROM x) UNION ALL SELECT 'norm', (SELECT round(sqrt(sum(v * v)), 4) FROM a)
    UNION ALL SELECT 'residual', (SELECT round(sqrt(sum(power(0.5 * v, 2))), 4) FROM a)
    UNION ALL SELECT 'error', (SELECT max(abs(y.v - x.v)) FROM x JOIN y USING (i))
    UNION ALL SELECT 'relative', (SELECT round(max(abs(y.v - x.v)) / 1000, 4) FROM x JOIN y USING (i))
    UNION ALL SELECT 'checksum', 0.0"""))  # fmt: skip
def vector_sums(spark, sf_dir):
    x, y = views.vector_pair(spark, sf_dir)
    a = views.supply_matrix(spark, sf_dir)
    ones = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.lit(1.0).alias("v"))
    values = {
        "inner": V.inner_product(x, y),
        "total": V.total(x),
        "norm": V.frobenius_norm(a),
        "residual": V.residual_norm(a, V.scale(a, 0.5)),
        "error": V.max_abs_error(x, y),
        "relative": V.max_abs_error(x, y, 1000),
        "checksum": V.checksum_error(S.spmv(a, ones), a),
    }
    return tidy(named(values), 4, "value")


@query(with_views("x y", "SELECT i, y.v + 2 * x.v AS v, y.v * 0.5 AS half FROM x JOIN y USING (i)"))
def axpy(spark, sf_dir):
    x, y = views.vector_pair(spark, sf_dir)
    return V.axpy(2.0, x, y).join(V.scale(y, 0.5).select("i", F.col("v").alias("half")), "i")


P = 12


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT i, CAST(i % {P} AS BIGINT) AS cyclic, CAST(i // {P} AS BIGINT) AS local, CAST((i // {P}) * {P} + i % {P} AS BIGINT) AS global,
      CAST((n + {P} - i % {P} - 1) // {P} AS BIGINT) AS n_local,
      CAST(CASE WHEN i < (n % {P}) * (n // {P} + 1) THEN i // (n // {P} + 1) ELSE n % {P} + (i - (n % {P}) * (n // {P} + 1)) // (n // {P}) END AS BIGINT) AS block,
      CAST(i % 6 AS BIGINT) AS row_part, CAST((i * 7) % 2 AS BIGINT) AS col_part,
      CAST((i % 4096) // 1024 * 4 + (i % 4096) % 4 AS BIGINT) AS group_part, CAST(((i % 4096) % 1024) // 4 AS BIGINT) AS group_local,
      CAST(i // 128 AS BIGINT) AS high, CAST(i % 128 AS BIGINT) AS low,
      CAST((i % 8 & 1) * 4 + (i % 8 & 2) + (i % 8 & 4) // 4 AS BIGINT) AS reversed
    FROM o, n""")  # fmt: skip
def places(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    n, i = orders.count(), F.col("i")
    rows = O.ordinal(orders, ["o_orderkey"], name="i")
    row_part, col_part = X.cyclic_part_2d(i, i * 7, X.grid_shape(P))
    group_part, group_local = X.group_cyclic(i % 4096, 4, 16, 4096)
    part = X.cyclic_part(i, P)
    columns = {"cyclic": part, "local": X.local_index(i, P), "global": X.global_index(X.local_index(i, P), P, part), "n_local": X.n_local(P, part, n), "block": X.block_part(i, P, n), "row_part": row_part, "col_part": col_part, "group_part": group_part, "group_local": group_local, "high": X.bucket_key(i, 128, "div"), "low": X.bucket_key(i, 128, "mod"), "reversed": X.bit_reverse(i % 8, 3)}
    return rows.select("i", *(c.cast("long").alias(k) for k, c in columns.items()))


@query("""WITH c AS (SELECT l_suppkey % 7 AS part, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, round(max(n) / avg(n) - 1, 6) AS imbalance FROM c""")  # fmt: skip
def load_imbalance(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(X.cyclic_part(F.col("l_suppkey"), 7).alias("part"))
    return tidy(tidy(O.load_imbalance(lines), 4, "mean"), 6, "imbalance")


@query("""WITH z AS (SELECT l_orderkey * 8 + l_linenumber AS i, l_quantity AS a, l_discount AS b, l_tax AS c, l_linenumber AS d FROM lineitem)
    SELECT i, round(a * c - b * d, 6) + 0.0 AS re, round(a * d + b * c, 6) + 0.0 AS im, round(a + c, 6) AS sum_re, round(b - d, 6) + 0.0 AS dif_im,
      round(-b, 6) + 0.0 AS con_im, round(cos(a), 6) + 0.0 AS unit_re, round(sin(a), 6) + 0.0 AS unit_im, round(sqrt(a * a + b * b), 6) AS modulus FROM z""")  # fmt: skip
def complex_arithmetic(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    a, b = (F.col("l_quantity"), F.col("l_discount")), (F.col("l_tax"), F.col("l_linenumber").cast("double"))
    product, turn = C.multiply(a, b), C.unit(a[0])
    columns = {"re": product[0], "im": product[1], "sum_re": C.add(a, b)[0], "dif_im": C.subtract(a, b)[1], "con_im": C.conjugate(a)[1], "unit_re": turn[0], "unit_im": turn[1], "modulus": C.modulus(a)}
    return lines.select(views.line_key(), *(rounded(c, 6).alias(k) for k, c in columns.items()))


# ---- sparse matrices


@query(with_views("a pv", "SELECT s_suppkey AS i, coalesce(u.v, 0.0) AS v FROM supplier LEFT JOIN (SELECT a.i, sum(a.v * pv.v) AS v FROM a JOIN pv ON a.j = pv.i GROUP BY a.i) u ON u.i = s_suppkey"))
def spmv(spark, sf_dir):
    return S.spmv(views.supply_matrix(spark, sf_dir), views.part_sizes(spark, sf_dir), views.suppliers(spark, sf_dir))


def distributions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts by key of the parts table in threes and of suppliers in fours."""
    v = views.part_sizes(spark, sf_dir).select("i", (F.col("i") % 3).cast("int").alias("part"))
    u = views.suppliers(spark, sf_dir).select("i", F.pmod(F.col("i") + 1, F.lit(4)).cast("int").alias("part"))
    return S.local_index_of(v), S.local_index_of(u)


OWNERS = """, dv AS (SELECT p_partkey AS i, CAST(p_partkey % 3 AS INTEGER) AS part FROM part),
    du AS (SELECT s_suppkey AS i, CAST((s_suppkey + 1) % 4 AS INTEGER) AS part FROM supplier)"""


@query(with_views("a", OWNERS + """ SELECT (SELECT count(*) FROM (SELECT DISTINCT a.part, a.j, coalesce(dv.part, 0) AS o FROM a LEFT JOIN dv ON dv.i = a.j) WHERE o <> part) AS fan_out,
    (SELECT count(*) FROM (SELECT DISTINCT a.part, a.i, coalesce(du.part, 0) AS o FROM a LEFT JOIN du ON du.i = a.i) WHERE o <> part) AS fan_in"""))  # fmt: skip
def spmv_traffic(spark, sf_dir):
    return S.spmv_traffic(views.supply_matrix(spark, sf_dir), *distributions(spark, sf_dir))


@query(with_views("a pv", OWNERS + """ SELECT du.i, coalesce(u.v, 0.0) AS v, du.part, row_number() OVER (PARTITION BY du.part ORDER BY du.i) - 1 AS local_ind
    FROM du LEFT JOIN (SELECT a.i, sum(a.v * pv.v) AS v FROM a JOIN pv ON a.j = pv.i GROUP BY a.i) u ON u.i = du.i"""))  # fmt: skip
def spmv_parts(spark, sf_dir):
    return S.spmv_parts(views.supply_matrix(spark, sf_dir), views.part_sizes(spark, sf_dir), distributions(spark, sf_dir)[1])


@query(with_views("a", OWNERS + """, n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY i) - 1 AS k FROM dv)
    SELECT c.j, coalesce(n.part, 0) AS owner, coalesce(n.k, -1) AS owner_ind FROM (SELECT DISTINCT j FROM a) c LEFT JOIN n ON n.i = c.j"""))  # fmt: skip
def resolve_owner(spark, sf_dir):
    needed = views.supply_matrix(spark, sf_dir).select("j").distinct()
    return S.resolve_owner(needed, distributions(spark, sf_dir)[0], "j").select("j", "owner", F.coalesce("owner_ind", F.lit(-1)).alias("owner_ind"))


@query(with_views("a", "SELECT part, count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_cols FROM a GROUP BY part"))
def nonempty_rows_cols(spark, sf_dir):
    return S.nonempty_rows_cols(views.supply_matrix(spark, sf_dir))


@query("""WITH c AS (SELECT l_partkey AS i, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT i, n, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c""")  # fmt: skip
def bin_starts(spark, sf_dir):
    return O.bin_starts(views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i")), "i")


COMPACT = """, c AS (SELECT *, dense_rank() OVER (PARTITION BY part ORDER BY i) - 1 AS row_local, dense_rank() OVER (PARTITION BY part ORDER BY j) - 1 AS col_local FROM a)"""


@query(with_views("a", COMPACT + "SELECT * FROM c"))
def compact_indices(spark, sf_dir):
    return S.compact_indices(views.supply_matrix(spark, sf_dir))


@query(with_views("a", COMPACT + """, o AS (SELECT *, row_number() OVER w - 1 AS k, lag(row_local) OVER w AS r, lag(col_local) OVER w AS pc,
        1 + max(col_local) OVER (PARTITION BY part) AS nc, count(*) OVER (PARTITION BY part) AS nn FROM c WINDOW w AS (PARTITION BY part ORDER BY i, j))
    SELECT part, k, i, j, v, row_local, col_local, CAST(CASE WHEN pc IS NULL THEN col_local ELSE col_local - pc + CASE WHEN r <> row_local THEN nc ELSE 0 END END AS BIGINT) AS inc FROM o
    UNION ALL SELECT part, nn, -1, -1, 0.0, -1, -1, nc - col_local FROM o WHERE k = nn - 1"""))  # fmt: skip
def icrs(spark, sf_dir):
    return S.icrs(views.supply_matrix(spark, sf_dir)).fillna(-1, ["i", "j", "row_local", "col_local"])


@query(with_views("a", COMPACT + """, s AS (SELECT part, row_local, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT part, row_local, CAST(coalesce(sum(n) OVER (PARTITION BY part ORDER BY row_local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s
    UNION ALL SELECT part, max(row_local) + 1, CAST(sum(n) AS BIGINT) FROM s GROUP BY part"""))  # fmt: skip
def row_starts(spark, sf_dir):
    return S.row_starts(views.supply_matrix(spark, sf_dir))


# ---- orders


def sort_sql(p: int, body: str) -> str:
    """Regular sampling of order prices, in SQL."""
    start = f"CASE WHEN {{0}} <= nl % {p} THEN {{0}} * (nl // {p} + 1) ELSE {{0}} * (nl // {p}) + nl % {p} END"
    return f"""WITH x AS (SELECT floor(o_totalprice / 1000) AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS g, count(*) OVER () AS n FROM orders),
      b AS (SELECT *, CASE WHEN g < (n % {p}) * (n // {p} + 1) THEN g // (n // {p} + 1) ELSE n % {p} + (g - (n % {p}) * (n // {p} + 1)) // (n // {p}) END AS part FROM x),
      o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY v, g) - 1 AS pos, count(*) OVER (PARTITION BY part) AS nl FROM b),
      sm AS (SELECT o.part, o.pos, o.v, o.g FROM o, range({p}) k WHERE o.pos = {start.format('k.range')}),
      sp AS (SELECT v, g, (row_number() OVER (ORDER BY v, g) - 1) AS r FROM sm),
      cut AS (SELECT v, g, r // {p} AS t FROM sp WHERE r % {p} = 0),
      d AS (SELECT x.v, x.g, CAST((SELECT count(*) FROM cut WHERE t > 0 AND (cut.v < x.v OR (cut.v = x.v AND cut.g <= x.g))) AS INTEGER) AS part FROM x),
      f AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY v, g) - 1 AS pos, v FROM d) {body}"""


def order_prices(spark, sf_dir) -> DataFrame:
    """Prices in thousands: many equal values."""
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"))


@query(sort_sql(8, "SELECT * FROM f"))
def sample_sort(spark, sf_dir):
    return O.sample_sort(order_prices(spark, sf_dir), 8)


@query(sort_sql(8, """SELECT f.part, min(v) AS first, max(v) AS last, count(*) AS n, CAST(0 AS BIGINT) AS unsorted,
    round(sum(CASE WHEN pos < 10 THEN v END), 2) AS head FROM f GROUP BY f.part"""))  # fmt: skip
def check_sorted(spark, sf_dir):
    parts = stored(O.sample_sort(order_prices(spark, sf_dir), 8))
    head = O.head_per_part(parts, 10).groupBy("part").agg(F.round(F.sum("v"), 2).alias("head"))
    bad = O.unsorted_rows(parts).groupBy("part").agg(F.count("*").alias("bad"))
    ends = O.part_ends(parts).join(head, "part").join(bad, "part", "left")
    return ends.select("part", "first", "last", "n", F.coalesce("bad", F.lit(0)).cast("long").alias("unsorted"), "head")


@query(sort_sql(8, "SELECT CAST(part AS INTEGER) AS part, pos, v, g AS i FROM sm"))
def equidistant_samples(spark, sf_dir):
    lines = order_prices(spark, sf_dir)
    n = lines.count()
    placed = O.ordinal(lines, ["i"], name="g").select(X.block_part(F.col("g"), 8, n).cast("int").alias("part"), F.col("g").alias("i"), "v")
    return O.equidistant_samples(O.ordinal(placed, ["v", "i"], ("part",), "pos"), 8).select("part", "pos", "v", "i")


@query("SELECT l_orderkey * 8 + l_linenumber AS i, l_suppkey, row_number() OVER (ORDER BY l_suppkey, l_orderkey * 8 + l_linenumber) - 1 AS pos FROM lineitem")
def stable_sort(spark, sf_dir):
    return O.stable_sort(views.table(spark, sf_dir, "lineitem").select(views.line_key(), "l_suppkey"), ["l_suppkey"], "i").select("i", "l_suppkey", "pos")


@query("SELECT s_acctbal AS v FROM supplier UNION ALL SELECT c_acctbal FROM customer")
def merge_sorted(spark, sf_dir):
    runs = [views.table(spark, sf_dir, t).select(F.col(c).alias("v")).orderBy("v") for t, c in (("supplier", "s_acctbal"), ("customer", "c_acctbal"))]
    return O.merge_sorted(runs, "v")


@query(with_views("a", "SELECT i, v FROM (SELECT part, i, v FROM (SELECT part, i, sum(v) AS v FROM a GROUP BY 1, 2)) ORDER BY abs(v) DESC, part, i LIMIT 1"))
def argmax_abs(spark, sf_dir):
    column = views.supply_matrix(spark, sf_dir).groupBy("part", "i").agg(F.sum("v").alias("v"))
    return S.argmax_abs(column)


# ---- graphs


@query(with_views("g", "SELECT i, count(*) AS n, max(w) AS most FROM g GROUP BY i"))
def degree(spark, sf_dir):
    return G.degree(views.order_graph(spark, sf_dir))


@query(with_views("g", "SELECT (SELECT sum(m) / 2 FROM (SELECT max(w) AS m FROM g GROUP BY i)) AS bound, (SELECT sum(w) / 2 FROM g) AS total"))
def weight_bounds(spark, sf_dir):
    return G.weight_bounds(views.order_graph(spark, sf_dir))


@query(with_views("g", """, f AS (SELECT i, j, CASE WHEN (i + j) % 11 = 0 THEN -w ELSE w END AS w FROM g WHERE NOT (i < j AND (i + j) % 13 = 0))
    SELECT coalesce(f.i, b.j) AS i, coalesce(f.j, b.i) AS j, f.w, b.w AS w_back, CASE WHEN coalesce(f.w, b.w) <= 0 THEN 'weight' ELSE 'asymmetric' END AS reason
    FROM f FULL JOIN f b ON f.i = b.j AND f.j = b.i WHERE coalesce(f.w, b.w) <= 0 OR f.w IS DISTINCT FROM b.w"""))  # fmt: skip
def faulty_edges(spark, sf_dir):
    edges = views.order_graph(spark, sf_dir).where("NOT (i < j AND (i + j) % 13 = 0)")
    return G.faulty_edges(edges.withColumn("w", F.when((F.col("i") + F.col("j")) % 11 == 0, -F.col("w")).otherwise(F.col("w"))))


@query(with_views("g", "SELECT i, j, w, part, CAST(j % 4 AS INTEGER) AS other FROM g WHERE i % 4 <> j % 4"))
def halo_pairs(spark, sf_dir):
    return G.halo_pairs(G.validate_graph(views.order_graph(spark, sf_dir))).select("i", "j", "w", "part", "other")


@query(with_views("g", "SELECT i, j, w, part FROM g WHERE i < j"))
def undirected(spark, sf_dir):
    return G.undirected(views.order_graph(spark, sf_dir))


@query(with_views("g", """SELECT i, arg_max(j, o) AS j, max(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w, i + j + CASE WHEN i % 4 = j % 4 THEN 2000000 ELSE 0 END, j) AS o FROM g) GROUP BY i"""))
def heaviest_edge(spark, sf_dir):
    return G.heaviest_edge(G.with_ties(views.order_graph(spark, sf_dir), 1_000_000))


@query(with_views("g", "SELECT i, j, w FROM g WHERE i % 5 <> 0 AND j % 5 <> 0"))
def live_edges(spark, sf_dir):
    edges = views.order_graph(spark, sf_dir).select("i", "j", "w")
    return G.without_vertices(edges, edges.select("i").distinct().where("i % 5 = 0")).select("i", "j", "w")


MATCH = """, e AS (SELECT i, j, w, row_number() OVER (ORDER BY w DESC, i + j + CASE WHEN i % 4 = j % 4 THEN 2000000 ELSE 0 END DESC, i DESC) AS r FROM g WHERE i < j),
    m AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS w
      UNION ALL SELECT n.r, m.used || [n.i, n.j], n.i, n.j, n.w FROM m, LATERAL (SELECT e.* FROM e WHERE e.r > m.r AND NOT list_contains(m.used, e.i) AND NOT list_contains(m.used, e.j) ORDER BY e.r LIMIT 1) n)"""  # fmt: skip


def matched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    edges = stored(views.order_graph(spark, sf_dir))
    return stored(G.match(G.with_ties(edges, 1_000_000))), edges


@query(with_views("g", MATCH + " SELECT i, j, w FROM m WHERE i IS NOT NULL", recursive=True))
def match(spark, sf_dir):
    return matched(spark, sf_dir)[0]


@query(with_views("g", MATCH + """ SELECT count(*) AS matches, coalesce(sum(w), 0.0) AS weight, (SELECT sum(x) / 2 FROM (SELECT max(w) AS x FROM g GROUP BY i)) AS bound,
    (SELECT sum(w) / 2 FROM g) AS total, true AS ok FROM m WHERE i IS NOT NULL""", recursive=True))  # fmt: skip
def matching_stats(spark, sf_dir):
    return G.matching_stats(*matched(spark, sf_dir))


@query(with_views("g", MATCH + """, s AS (SELECT unnest(list_distinct([i % 4, j % 4])) AS part, i % 4 = j % 4 AS inside FROM m WHERE i IS NOT NULL)
    SELECT CAST(part AS INTEGER) AS part, count(*) FILTER (WHERE inside) AS internal, count(*) FILTER (WHERE NOT inside) AS external FROM s GROUP BY part""", recursive=True))  # fmt: skip
def matching_parts(spark, sf_dir):
    matches, edges = matched(spark, sf_dir)
    return G.matching_parts(matches, G.vertex_parts(edges))


# ---- dense kernels on the trade matrix


def product(a: str, b: str) -> str:
    return f"(SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY a.i, b.j)"


TR = "(SELECT j AS i, i AS j, v FROM t)"
UP = "(SELECT i, j, v FROM t WHERE i <= j UNION ALL SELECT j, i, v FROM t WHERE i < j)"
LOW = "(SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE v END AS v FROM t WHERE i >= j)"


def summed(*terms: tuple[float, str]) -> str:
    return "(SELECT i, j, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT i, j, {f} * v AS v FROM {x}" for f, x in terms) + ") GROUP BY i, j)"


def dense_query(sql: str):
    return query(with_views("t", f"SELECT i, j, v FROM {sql}"))


@dense_query(summed((2, product("t", TR)), (3, "t")))
def gemm(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.gemm(2, t, V.transpose(t), 3, t, BLOCK)


@dense_query(summed((2, product(product("t", TR), "t")), (3, "t")))
def two_mm(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.two_mm(2, t, V.transpose(t), t, 3, t, BLOCK)


SMALL = "(SELECT i, j, floor(v / 100) AS v FROM t)"


@dense_query(product(product(SMALL, SMALL), product(SMALL, SMALL)) + " WHERE v <> 0")
def three_mm(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 100).cast("double"))
    return B.three_mm(t, t, t, t, BLOCK).where("v != 0")


@dense_query(summed((2, product(UP, "t")), (3, "t")))
def symm(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.symm(2, t, t, 3, t, BLOCK)


@dense_query(summed((2, product("t", TR)), (3, "t")) + " WHERE i >= j")
def syrk(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.syrk(2, t, 3, t, BLOCK)


@dense_query(summed((2, product("t", "t")), (2, product(TR, TR)), (3, "t")) + " WHERE i >= j")
def syr2k(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.syr2k(2, t, V.transpose(t), 3, t, BLOCK)


@dense_query(summed((2, product("(SELECT j AS i, i AS j, v FROM " + LOW + ")", "t"))))
def trmm(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.trmm(2, t, t, BLOCK)


@dense_query(TR)
def transpose(spark, sf_dir):
    return V.transpose(views.trade_matrix(spark, sf_dir))


def row_sql(k: int) -> str:
    return f"(SELECT j AS i, v FROM t WHERE i = {k})"


def times(a: str, x: str) -> str:
    return f"(SELECT a.i, sum(a.v * x.v) AS v FROM {a} a JOIN {x} x ON a.j = x.i GROUP BY a.i)"


@query(with_views("t", f"SELECT i, v FROM {times(TR, times('t', row_sql(0)))}"))
def atax(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.atax(t, views.trade_rows(t, 0))


@query(with_views("t", f"SELECT a.i, a.v + b.v AS x1, c.v + d.v AS x2 FROM {row_sql(0)} a JOIN {times('t', row_sql(1))} b USING (i) JOIN {row_sql(2)} c USING (i) JOIN {times(TR, row_sql(3))} d USING (i)"))
def mvt(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    x1, x2 = B.mvt(t, *(views.trade_rows(t, k) for k in (0, 1, 2, 3)))
    return x1.select("i", F.col("v").alias("x1")).join(x2.select("i", F.col("v").alias("x2")), "i")


@query(with_views("t", f"SELECT a.i, 2 * a.v + 3 * b.v AS v FROM {times('t', row_sql(0))} a JOIN {times(TR, row_sql(0))} b USING (i)"))
def gesummv(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    return B.gesummv(2, t, 3, V.transpose(t), views.trade_rows(t, 0))


GEMVER = f""", h AS (SELECT t.i, t.j, t.v + a.v * b.v + c.v * d.v AS v FROM t JOIN {row_sql(0)} a ON a.i = t.i JOIN {row_sql(1)} b ON b.i = t.j JOIN {row_sql(2)} c ON c.i = t.i JOIN {row_sql(3)} d ON d.i = t.j),
    x AS (SELECT z.i, z.v + 2 * p.v AS v FROM {row_sql(5)} z JOIN (SELECT h.j AS i, sum(h.v * y.v) AS v FROM h JOIN {row_sql(4)} y ON y.i = h.i GROUP BY h.j) p USING (i))
    SELECT x.i, round(x.v / 1e6, 4) AS x, round(3 * w.v / 1e16, 4) AS w FROM x JOIN (SELECT h.i, sum(h.v * x.v) AS v FROM h JOIN x ON x.i = h.j GROUP BY h.i) w USING (i)"""  # fmt: skip


@query(with_views("t", GEMVER))
def gemver(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    r = [views.trade_rows(t, k) for k in range(6)]
    _, x, w = B.gemver(3, 2, t, r[0], r[1], r[2], r[3], r[4], r[5])
    return x.select("i", rounded(F.col("v") / 1e6).alias("x")).join(w.select("i", rounded(F.col("v") / 1e16).alias("w")), "i")


@query(with_views("t", f"SELECT t.i, t.j, t.v + a.v * b.v + c.v * d.v AS v FROM t JOIN {row_sql(0)} a ON a.i = t.i JOIN {row_sql(1)} b ON b.i = t.j JOIN {row_sql(2)} c ON c.i = t.i JOIN {row_sql(3)} d ON d.i = t.j"))
def outer_update(spark, sf_dir):
    t = views.trade_matrix(spark, sf_dir)
    r = [views.trade_rows(t, k) for k in range(4)]
    return V.outer_update(t, (r[0], r[1]), (r[2], r[3]))


# ---- factorisations


@query(with_views("t", "SELECT i, j, round(v, 4) AS v FROM t WHERE v <> 0"))
def lu_reconstruct(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    factors, pi = D.lu(views.trade_matrix(spark, sf_dir), n, stage(n))
    return tidy(D.reconstruct_lu(factors, pi, n, BLOCK)).where("v != 0")


#: Gaussian elimination in SQL, a step of the recursion for each column: the pivot is the first of the greatest.
ELIMINATE = """, m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM t GROUP BY i)),
    f AS (SELECT CAST(1 AS BIGINT) AS k, m, list_transform(m, lambda r, x: x - 1) AS pi, len(m) AS n FROM m0
      UNION ALL SELECT k + 1,
          list_transform(s, lambda r, i: CASE WHEN i <= k THEN r ELSE list_transform(r, lambda v, j: CASE WHEN j < k THEN v WHEN j = k THEN v / s[k][k] ELSE v - r[k] / s[k][k] * s[k][j] END) END),
          list_transform(pi, lambda x, i: CASE WHEN i = k THEN pi[p] WHEN i = p THEN pi[k] ELSE x END), n
        FROM (SELECT k, pi, n, p, list_transform(m, lambda r, i: CASE WHEN i = k THEN m[p] WHEN i = p THEN m[k] ELSE r END) AS s
          FROM (SELECT k, m, pi, n, k - 1 + list_position(c, list_max(c)) AS p FROM (SELECT k, m, pi, n, list_transform(m[k:], lambda r: abs(r[k])) AS c FROM f WHERE k <= n))))"""  # fmt: skip
#: Cells of the last step's matrix.
CELLS = "c AS (SELECT i - 1 AS i, pi[i] AS pi, unnest(range(n)) AS j, unnest(r) AS v FROM (SELECT n, pi, unnest(range(1, n + 1)) AS i, unnest(m) AS r FROM f WHERE k = n + 1))"


@query(with_views("t", ELIMINATE + ", " + CELLS + " SELECT i, j, round(v, 4) + 0.0 AS v, pi FROM c WHERE round(v, 4) <> 0", recursive=True))
def lu_factors(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    factors, pi = D.lu(views.trade_matrix(spark, sf_dir), n, stage(n), "partial")
    return tidy(factors).where("v != 0").join(pi, "i").select("i", "j", "v", "pi")


@query(with_views("t", ELIMINATE + ", " + CELLS + """ SELECT count(DISTINCT pi) AS n_pi, CAST(1 AS BIGINT) AS residuals, max(abs(CASE WHEN j < i THEN v ELSE 0 END)) <= 1 AS l_bounded,
    count(DISTINCT i) AS unit, round(sum(CASE WHEN i = j THEN ln(abs(v)) END), 4) AS log_determinant FROM c""", recursive=True))  # fmt: skip
def verify_lu(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    t = stored(views.trade_matrix(spark, sf_dir))
    factors, pi = D.lu(t, n, stage(n), "partial")
    factors = stored(factors)
    low, up = D.split_lu(factors, n)
    norm = D.verify_lu(t, factors, pi, n, BLOCK).agg(F.count_if(F.col("value") < 1e-6).alias("residuals"))
    most = low.agg((F.max(F.abs("v")) <= 1.0).alias("l_bounded"), F.count_if((F.col("i") == F.col("j")) & (F.col("v") == 1.0)).alias("unit"))
    size = up.where("i = j").agg(F.round(F.sum(F.log(F.abs("v"))), 4).alias("log_determinant"))
    return pi.agg(F.countDistinct("pi").alias("n_pi")).join(norm).join(most).join(size)


@query(with_views("t", f"SELECT CAST((i + 1) % {SIDE} AS BIGINT) AS i, j, v FROM t"))
def permuted_rows(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    turn = D.compose_swaps([(0, k) for k in range(1, n)], n)
    pi = spark.createDataFrame(list(enumerate(turn)), "i long, pi long")
    return D.permuted_rows(views.trade_matrix(spark, sf_dir), pi).select("i", "j", "v")


def gram_plus_one(t: DataFrame, n: int) -> DataFrame:
    """Lower triangle of T' T + I."""
    return B.syrk(1.0, V.transpose(t), 1.0, D.identity(t.sparkSession, n), BLOCK)


SPD = "(SELECT i, j, sum(v) AS v FROM (SELECT * FROM " + product(TR, "t") + " UNION ALL SELECT range, range, 1.0 FROM range(" + SIDE + ")) GROUP BY i, j)"


@query(with_views("t", f"SELECT i, j, round(v, 1) AS v FROM {SPD} WHERE v <> 0"))
def cholesky(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    r = stored(D.cholesky(gram_plus_one(views.trade_matrix(spark, sf_dir), n), n, stage(n)))
    return tidy(B.matmul(V.transpose(r), r, BLOCK), 1).where("v != 0")


@query(with_views("t", f""", m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM {SPD} GROUP BY i)),
    f AS (SELECT CAST(1 AS BIGINT) AS k, m, len(m) AS n FROM m0
      UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i < k THEN r
          WHEN i = k THEN list_transform(r, lambda v, j: CASE WHEN j < k THEN 0.0 ELSE v / sqrt(r[k]) END)
          ELSE list_transform(r, lambda v, j: CASE WHEN j < k THEN v ELSE v - m[k][i] * m[k][j] / m[k][k] END) END), n FROM f WHERE k <= n),
    c AS (SELECT i - 1 AS i, unnest(range(n)) AS j, unnest(r) AS v FROM (SELECT n, unnest(range(1, n + 1)) AS i, unnest(m) AS r FROM f WHERE k = n + 1))
    SELECT i, j, round(v, 2) + 0.0 AS v FROM c WHERE j >= i AND round(v, 2) <> 0""", recursive=True))  # fmt: skip
def cholesky_factor(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    return tidy(D.cholesky(gram_plus_one(views.trade_matrix(spark, sf_dir), n), n, stage(n)), 2).where("v != 0")


def lower_triangle(t: DataFrame) -> DataFrame:
    """The matrix's lower triangle with a heavy diagonal."""
    return t.where("i >= j").withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") * 100 + 1).otherwise(F.col("v")))


@query(with_views("t", "SELECT j AS i, round(v, 4) AS v FROM t WHERE i = 0"))
def trisolv(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    t = stored(views.trade_matrix(spark, sf_dir))
    low = lower_triangle(t)
    return tidy(S.spmv(low, D.trisolv(low, views.trade_rows(t, 0), n, stage(n))))


@query(with_views("t", "SELECT j AS i, round(v, 3) AS v FROM t WHERE i = 0"))
def solve(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    t = stored(views.trade_matrix(spark, sf_dir))
    return tidy(S.spmv(t, D.solve(t, views.trade_rows(t, 0), n, stage(n))), 3)


@query(with_views("t", """, l AS (SELECT i, list(CASE WHEN i = j THEN v * 100 + 1 ELSE v END ORDER BY j) AS r FROM t GROUP BY i), b AS (SELECT j AS i, v FROM t WHERE i = 0),
    s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS x
      UNION ALL SELECT k + 1, list_append(x, (b.v - coalesce(list_sum(list_transform(x, lambda v, p: v * r[p])), 0)) / r[k + 1]) FROM s JOIN l ON l.i = k JOIN b ON b.i = k)
    SELECT unnest(range(k)) AS i, round(unnest(x), 8) + 0.0 AS v FROM (SELECT * FROM s ORDER BY k DESC LIMIT 1)""", recursive=True))  # fmt: skip
def trisolv_solution(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    t = views.trade_matrix(spark, sf_dir)
    return tidy(D.trisolv(lower_triangle(t), views.trade_rows(t, 0), n, stage(n)), 8)


@query(with_views("t", ELIMINATE + """, e AS (SELECT m, pi, n FROM f WHERE k = n + 1), b AS (SELECT list(v ORDER BY j) AS b FROM t WHERE i = 1),
    y AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS y
      UNION ALL SELECT k + 1, list_append(y, b[pi[k + 1] + 1] - coalesce(list_sum(list_transform(y, lambda v, p: v * m[k + 1][p])), 0)) FROM y, e, b WHERE k < n),
    x AS (SELECT n AS k, CAST([] AS DOUBLE[]) AS x FROM e
      UNION ALL SELECT x.k - 1, list_prepend((z.y[x.k] - coalesce(list_sum(list_transform(x, lambda v, p: v * m[x.k][x.k + p])), 0)) / m[x.k][x.k], x) FROM x, e, (SELECT y FROM y ORDER BY k DESC LIMIT 1) z WHERE x.k > 0)
    SELECT unnest(range(n)) AS i, round(unnest(x), 6) + 0.0 AS v FROM x, e WHERE k = 0""", recursive=True))  # fmt: skip
def solve_solution(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    t = views.trade_matrix(spark, sf_dir)
    return tidy(D.solve(t, views.trade_rows(t, 1), n, stage(n)), 6)


def decaying_row(t: DataFrame) -> DataFrame:
    """r_0 heavy, r_k the trade of supplier 0 with k: a Toeplitz system of one unknown less."""
    return views.trade_rows(t, 0).withColumn("v", F.when(F.col("i") == 0, F.col("v") * 100 + 1).otherwise(F.col("v")))


@query(with_views("t", "SELECT j - 1 AS i, round(-v, 4) AS v FROM t WHERE i = 0 AND j > 0"))
def toeplitz_solve(spark, sf_dir):
    n = views.matrix_side(spark, sf_dir)
    r = stored(decaying_row(stored(views.trade_matrix(spark, sf_dir))))
    x = D.toeplitz_solve(r, n - 1, stage(n))
    grid = x.select(F.col("i").alias("j"), F.col("v").alias("x")).join(spark.range(n - 1).select(F.col("id").alias("i")))
    terms = grid.withColumn("d", F.abs(F.col("i") - F.col("j"))).join(r.select(F.col("i").alias("d"), "v"), "d")
    return tidy(terms.groupBy("i").agg(F.sum(F.col("x") * F.col("v")).alias("v")))


def tall_columns(spark, sf_dir) -> DataFrame:
    """Orders by three columns: 1, the price in thousands, and the customer's key modulo 97."""
    orders = views.table(spark, sf_dir, "orders")
    cells = F.posexplode(F.array(F.lit(1.0), F.floor(F.col("o_totalprice") / 1000).cast("double"), (F.col("o_custkey") % 97).cast("double"))).alias("j", "v")
    return orders.select(F.col("o_orderkey").alias("i"), cells).withColumn("j", F.col("j").cast("long"))


@query("""WITH o AS (SELECT o_orderkey AS i, floor(o_totalprice / 1000) AS b, CAST(o_custkey % 97 AS DOUBLE) AS c FROM orders),
    g AS (SELECT CAST(count(*) AS DOUBLE) AS aa, sum(b) AS ab, sum(c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM o),
    x AS (SELECT sqrt(aa) AS r00, ab / sqrt(aa) AS r01, ac / sqrt(aa) AS r02, * FROM g), y AS (SELECT sqrt(bb - r01 * r01) AS r11, (bc - r01 * r02) / sqrt(bb - r01 * r01) AS r12, * FROM x),
    z AS (SELECT sqrt(cc - r02 * r02 - r12 * r12) AS r22, * FROM y),
    q AS (SELECT i, 1 / r00 AS q0, (b - r01 / r00) / r11 AS q1, c, z.* FROM o, z)
    SELECT 'q' AS factor, i, unnest([0, 1, 2])::BIGINT AS j, round(unnest([q0, q1, (c - r02 * q0 - r12 * q1) / r22]), 7) + 0.0 AS v FROM q
    UNION ALL SELECT 'r', unnest([0, 0, 0, 1, 1, 2])::BIGINT, unnest([0, 1, 2, 1, 2, 2])::BIGINT, round(unnest([r00, r01, r02, r11, r12, r22]), 5) FROM z""")  # fmt: skip
def qr_factors(spark, sf_dir):
    q, r = D.qr(tall_columns(spark, sf_dir), 3)
    cells = spark.range(3).withColumnRenamed("id", "j").join(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")))
    q = cells.join(q, ["i", "j"], "left").select(F.lit("q").alias("factor"), "i", "j", rounded(F.coalesce("v", F.lit(0.0)), 7).alias("v"))
    return q.union(r.select(F.lit("r"), "i", "j", rounded("v", 5)))


@query("""SELECT o_orderkey AS i, unnest([0, 1, 2])::BIGINT AS j, round(unnest([1.0, floor(o_totalprice / 1000), CAST(o_custkey % 97 AS DOUBLE)]), 4) + 0.0 AS v FROM orders""")
def qr(spark, sf_dir):
    q, r = D.qr(tall_columns(spark, sf_dir), 3)
    entries = q.select("i", F.col("j").alias("k"), F.col("v").alias("q")).join(F.broadcast(r.select(F.col("i").alias("k"), "j", F.col("v").alias("r"))), "k")
    return tidy(entries.groupBy("i", "j").agg(F.sum(F.col("q") * F.col("r")).alias("v")))


# ---- transforms and stencils

DFT = """, f AS (SELECT k.i, sum(s.re * cos(2 * pi() * ((s.i * k.i) % n) / n)) AS re, sum(-s.re * sin(2 * pi() * ((s.i * k.i) % n) / n)) AS im
      FROM s, s AS k, (SELECT count(*) AS n FROM s) GROUP BY k.i)
    SELECT i, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM f"""  # fmt: skip


@query(with_views("s", DFT))
def fft(spark, sf_dir):
    x = stored(views.hourly_signal(spark, sf_dir))
    return tidy(spectral.fft(x, x.count()), 4, "re", "im")


@query(with_views("s", "SELECT i, re, 0.0 AS im, 0.0 AS error FROM s"))
def ifft(spark, sf_dir):
    x = stored(views.hourly_signal(spark, sf_dir))
    n = x.count()
    back = spectral.ifft(stored(spectral.fft(x, n)), n)
    return tidy(back, 4, "re", "im").join(tidy(V.max_abs_error(back, x, n), 4, "value").select(F.col("value").alias("error")))


@query(with_views("s", """, b AS (SELECT i // 64 AS key, i % 64 AS j, re FROM s),
    f AS (SELECT key, k.range AS i, sum(re * cos(2 * pi() * j * k.range / 64)) AS re, sum(-re * sin(2 * pi() * j * k.range / 64)) AS im FROM b, range(64) k GROUP BY key, k.range)
    SELECT CAST(key AS BIGINT) AS key, i, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM f"""))  # fmt: skip
def fft_grouped(spark, sf_dir):
    x = views.hourly_signal(spark, sf_dir).select(X.div(F.col("i"), 64).alias("key"), (F.col("i") % 64).alias("i"), "re", "im")
    return tidy(spectral.fft_grouped(x, "key"), 4, "re", "im")


def jacobi_sql(steps: int) -> str:
    parts, a, b = ["b0 AS (SELECT i, j, v + 1 AS v FROM q)"], "q", "b0"
    for k in range(2 * steps):
        source, target = (a, b) if k % 2 == 0 else (b, a)
        near = " ".join(f"LEFT JOIN {source} n{m} ON n{m}.i = c.i + {x} AND n{m}.j = c.j + {y}" for m, (x, y) in enumerate(((0, 1), (0, -1), (1, 0), (-1, 0))))
        parts.append(f"h{k} AS (SELECT c.i, c.j, CASE WHEN c.i BETWEEN 1 AND {SIDE} - 2 AND c.j BETWEEN 1 AND {SIDE} - 2 THEN 0.2 * (c.v + n0.v + n1.v + n2.v + n3.v) ELSE o.v END AS v FROM {source} c JOIN {target} o USING (i, j) {near})")
        a, b = (a, f"h{k}") if k % 2 == 0 else (f"h{k}", b)
    return with_views("q", f", {', '.join(parts)} SELECT i, j, round(v, 4) AS v FROM {a}")


@query(jacobi_sql(2))
def jacobi2d(spark, sf_dir):
    a, b = views.quantity_grid(spark, sf_dir)
    n = views.matrix_side(spark, sf_dir)
    return tidy(stencil.jacobi2d(a, b, n, 2, tile=max(4, n // 8), depth=2))


@query(jacobi_sql(1))
def jacobi_cells(spark, sf_dir):
    a, b = views.quantity_grid(spark, sf_dir)
    return tidy(stencil.jacobi_cells(a, b, views.matrix_side(spark, sf_dir), 1))


@query(with_views("t", f"""SELECT i, string_agg(CASE WHEN (i * {SIDE} + j) % 20 = 0 THEN chr(10) ELSE '' END || printf('%.2f ', v), '' ORDER BY j) AS text FROM t GROUP BY i"""))
def matrix_dump(spark, sf_dir):
    return format_matrix_dump(views.trade_matrix(spark, sf_dir), views.matrix_side(spark, sf_dir))


# ---- written and read again


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_views("a", "SELECT i, j, v, part FROM a"))
def matrix_market_round_trip(spark, sf_dir):
    path = folder(spark, "market")
    writers.write_matrix_market(views.supply_matrix(spark, sf_dir), 4, path)
    return readers.read_matrix_market(spark, path)[0]


@query(with_views("a", "SELECT i, j, v FROM a"))
def triples_round_trip(spark, sf_dir):
    path = folder(spark, "triples")
    writers.write_triples(views.supply_matrix(spark, sf_dir).select("i", "j", "v"), path, "csv")
    return spark.read.csv(path, header=True, schema="i long, j long, v double")


@query("SELECT s_suppkey AS i, CAST(s_suppkey % 3 AS INTEGER) AS part, s_suppkey // 3 AS local_ind FROM supplier")
def distribution_round_trip(spark, sf_dir):
    path = folder(spark, "distribution")
    writers.write_vector_distribution(views.suppliers(spark, sf_dir).select("i", F.pmod("i", F.lit(3)).cast("int").alias("part")), 3, path)
    return readers.read_vector_distribution(spark, path).select("i", "part", F.col("local_ind").cast("long").alias("local_ind"))


@query(with_views("t", "SELECT i, j, v FROM t"))
def dense_round_trip(spark, sf_dir):
    n, path = views.matrix_side(spark, sf_dir), folder(spark, "dense")
    writers.write_dense_f64(views.trade_matrix(spark, sf_dir), n, path)
    return readers.read_dense_f64(spark, path, n).select("i", F.posexplode("row").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pi FROM supplier")
def perm_round_trip(spark, sf_dir):
    path = folder(spark, "perm")
    rows = O.ordinal(views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"], name="i")
    writers.write_perm_i32(O.ordinal(rows, ["s_acctbal", "s_suppkey"], name="pi").select("i", "pi"), path)
    return readers.read_perm_i32(spark, path)


@query("""SELECT l_returnflag AS experiment, CAST(l_linenumber * 1000 AS INTEGER) AS n, CAST(l_linenumber AS INTEGER) AS p, l_extendedprice AS time FROM lineitem""")
def run_times_round_trip(spark, sf_dir):
    path = folder(spark, "runs")
    writers.write_run_times(views.run_times(spark, sf_dir).drop("i"), path, by="experiment")
    return readers.read_run_times(spark, path).select(F.regexp_replace("experiment", "^experiment=", "").alias("experiment"), "n", "p", "time")


@query("""SELECT CAST(l_linenumber AS INTEGER) AS n, CAST(l_orderkey % 4 AS INTEGER) AS p, l_returnflag AS name, sum(l_quantity) AS value FROM lineitem GROUP BY ALL""")
def results_long_round_trip(spark, sf_dir):
    path, lines = folder(spark, "results"), views.table(spark, sf_dir, "lineitem")
    keys = (F.col("l_linenumber").cast("int").alias("n"), (F.col("l_orderkey") % 4).cast("int").alias("p"), F.col("l_returnflag").alias("name"))
    lines.groupBy(*keys).agg(F.sum("l_quantity").alias("value")).write.csv(path, header=True)
    return readers.read_results_long(spark, path)
