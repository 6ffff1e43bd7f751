"""Statistics over repeated runs: medians with order-statistic intervals, scaling, rates, line fits, correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .order import ordinal

#: Quantiles of the normal distribution at 1 - alpha / 2.
NORMAL = {0.1: 1.645, 0.05: 1.96, 0.01: 2.576}

#: Slices of a range in a round of a selection, and values of a range that are sorted in the end.
SLICES, FEW = 1024, 4096
#: Columns to a side of a block of pairs, and groups in which the tasks' blocks meet first.
PAIRS, MEETINGS = 128, 64


def ranked(df: DataFrame, group: list[str], value: str, name: str = "r", large: bool = False) -> DataFrame:
    """Adds the rank (from 0) of each value in its group of repeated runs. A window holds a group in one task; where
    groups may be large, ranks come from range partitions."""
    if large:
        return ordinal(df, [value], tuple(group), name)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(value)) - 1)


def median_by(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.median(value).alias("median"))


def interval_places(n: Column, convention: str, alpha: float) -> tuple[Column, Column]:
    """Sorted places of the interval's ends, kept within the group. 'fixed25' and 'formula' differ in the upper one."""
    reach = NORMAL[alpha] * F.sqrt(n)
    upper = F.ceil((n + reach) / 2) if convention == "fixed25" else F.ceil(1 + (n + reach) / 2)
    clip = lambda x: F.greatest(F.lit(0), F.least(n - 1, x)).cast("long")
    return clip(F.floor((n - reach) / 2)), clip(upper)


def median_ci(df: DataFrame, group: list[str], value: str, alpha: float = 0.05, convention: str = "fixed25") -> DataFrame:
    """(group, n, median, lower, upper). 'fixed25' gives the distances of the ends from the median, 'formula' the ends.

    The order statistics come from one sorted array a group, so the shuffle is that of the median. Runs of one group are
    few by nature (repeats of one configuration); for unbounded groups use ``median_ci_large``.
    """
    low, high = interval_places(F.col("n"), convention, alpha)
    rows = df.groupBy(*group).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.array_sort(F.collect_list(value)).alias("x"))
    ends = rows.select(*group, "n", "median", F.get("x", low.cast("int")).alias("a"), F.get("x", high.cast("int")).alias("b"))
    return ends.select(*group, "n", "median", *interval_ends(convention))


def order_statistics(df: DataFrame, group: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(group, place, v): the exact values at places of the sorted values of each group, ``wanted`` (group, place), from 0.

    By selection, without sorting: a place starts with its group's range of values and their count; a round counts the
    values of its range in SLICES slices, combined map-side, and goes on with the slice that holds the place. Ranges
    with few values left, or with one value, are settled at the end. Null values don't count; a place beyond its
    group's values gives no row. A round moves counts only; the rows themselves stay where they are.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = rows.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    keys = {g: f"__{k}" for k, g in enumerate(group)}
    named = lambda x: x.withColumnsRenamed(keys)
    same = lambda: [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()] or [F.lit(True)]
    bounds = wanted.select(*group, "place").distinct().join(named(ends), same()).where("place >= 0 AND place < n")
    bounds = stored(bounds.select(*group, "place", "lo", "hi", F.lit(0).cast("long").alias("before"), "n"), "bounds")
    open_ = (F.col("n") > FEW) & (F.col("lo") < F.col("hi"))
    columns = [*group, "place", "lo", "hi", "before", "n"]
    while not bounds.where(open_).isEmpty():
        held = rows.join(named(bounds.where(open_)), same()).where("v BETWEEN lo AND hi")
        slice_ = F.least(F.lit(SLICES - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * SLICES)).alias("slice")
        counts = held.groupBy(*group, "place", "before", slice_).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        below = F.sum("n").over(W.partitionBy(*group, "place").orderBy("slice").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("before", F.col("before") + below - F.col("n")).where("place >= before AND place < before + n")
        bounds = stored(bounds.where(~open_).select(columns).union(counts.select(columns)), "bounds")
    one = bounds.where("lo = hi").select(*group, "place", F.col("lo").alias("v"))
    held = rows.join(named(bounds.where("lo < hi")), same()).where("v BETWEEN lo AND hi")
    placed = held.withColumn("k", F.row_number().over(W.partitionBy(*group, "place").orderBy("v")) - 1 + F.col("before"))
    return one.union(placed.where("k = place").select(*group, "place", "v"))


def median_ci_large(df: DataFrame, group: list[str], value: str, alpha: float = 0.05, convention: str = "fixed25") -> DataFrame:
    """As ``median_ci`` where a group may hold any number of rows: counts first, then the places by selection."""
    low, high = interval_places(F.col("n"), convention, alpha)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"))
    counts = stored(counts.withColumns({"low": low, "high": high, "mid": F.floor((F.col("n") - 1) / 2), "mid2": F.floor(F.col("n") / 2)}), "counts")
    found = order_statistics(df, group, value, counts.select(*group, F.explode(F.array("low", "high", "mid", "mid2")).alias("place")))
    keys = {g: f"__{k}" for k, g in enumerate(group)}
    on = [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()] or [F.lit(True)]
    at = lambda place: F.max(F.when(F.col("place") == F.col(place), F.col("v")))
    rows = counts.join(found.withColumnsRenamed(keys), on).groupBy(*group, "n").agg(((at("mid") + at("mid2")) / 2).alias("median"), at("low").alias("a"), at("high").alias("b"))
    return rows.select(*group, "n", "median", *interval_ends(convention))


def interval_ends(convention: str) -> tuple[Column, Column]:
    if convention == "fixed25":
        return (F.col("median") - F.col("a")).alias("lower"), (F.col("b") - F.col("median")).alias("upper")
    return F.col("a").alias("lower"), F.col("b").alias("upper")


def pivot_runs(df: DataFrame, group: list[str], parts: list[int], large: bool = False) -> DataFrame:
    """Wide table: row r holds the r-th smallest run of every p, in columns p1, p2, ..."""
    rows = ranked(df, [*group, "p"], "time", large=large)
    cells = [F.max(F.when(F.col("p") == p, F.col("time"))).alias(f"p{p}") for p in parts]
    return rows.groupBy(*group, "r").agg(*cells)


def pivot_names(df: DataFrame, names: list[str]) -> DataFrame:
    """(n, p) with a column for each name of a long-form table (n, p, name, value)."""
    return df.groupBy("n", "p").pivot("name", names).agg(F.first("value", ignorenulls=True))


def rate_summary(df: DataFrame, group: list[str], value: str, flops: float) -> DataFrame:
    """(least, most, mean) rate in millions a second; null where the quickest run took no time."""
    rate = lambda t: F.when(t > 0, flops / t / 1e6)
    return df.groupBy(*group).agg(rate(F.max(value)).alias("least"), rate(F.min(value)).alias("most"), F.avg(rate(F.col(value))).alias("mean"))


def fit_line(df: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """Least squares y = g x + l over low <= x <= high: one row (g, l)."""
    return df.where(F.col(x).between(low, high)).agg(F.regr_slope(y, x).alias("g"), F.regr_intercept(y, x).alias("l"))


def middle_three(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Of five runs, without best and worst: mean cut to 8 decimals, greatest deviation in percent, ok if under 5."""
    rows = ranked(df, group, value).where("r BETWEEN 1 AND 3")
    mean = F.floor(F.avg(value) * 1e8) / 1e8
    ends = rows.groupBy(*group).agg(mean.alias("mean"), F.min(value).alias("a"), F.max(value).alias("b"))
    off = F.greatest(F.abs(F.col("a") - F.col("mean")), F.abs(F.col("b") - F.col("mean"))) / F.col("mean") * 100
    return ends.select(*group, "mean", off.alias("deviation"), (off < 5).alias("ok"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(bi, bj, base, data) of blocks of pairs of columns: over the rows that have both values, how many, the sums of either and of
    their squares and products, about ``base``.

    One pass: each task multiplies its rows block by block, about its own first values, which keeps the sums small; the
    tasks' blocks are moved to a common base and added up in two rounds. Nothing grows with the number of rows.
    """
    d, count = len(columns), -(-len(columns) // PAIRS)
    schema = "bi int, bj int, g int, base binary, data binary"

    def sent(found: dict[tuple[int, int], list[np.ndarray]], group: int) -> Iterator[pa.RecordBatch]:
        for (bi, bj), (base, data) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([group], pa.int32()), pa.array([base.tobytes()]), pa.array([data.tobytes()])], names=["bi", "bj", "g", "base", "data"])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        base = None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            there = ~np.isnan(x)
            if base is None:
                base = np.array([x[there[:, k], k][0] if there[:, k].any() else 0.0 for k in range(d)])
            x, there = np.where(there, x - base, 0.0), there.astype(float)
            parts = [slice(k * PAIRS, min(d, (k + 1) * PAIRS)) for k in range(count)]
            for bi, a in enumerate(parts):
                for bj, b in enumerate(parts[: bi + 1]):
                    data = np.stack([there[:, a].T @ there[:, b], x[:, a].T @ there[:, b], there[:, a].T @ x[:, b], x[:, a].T @ x[:, b], (x[:, a] ** 2).T @ there[:, b], there[:, a].T @ x[:, b] ** 2])
                    if (bi, bj) in found:
                        found[bi, bj][1] += data
                    else:
                        found[bi, bj] = [np.concatenate([base[a], base[b]]), data]
        yield from sent(found, TaskContext.get().partitionId() % MEETINGS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for bi, bj, base, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "base", "data"))):
                base, width = np.frombuffer(base), min(d, (bi + 1) * PAIRS) - bi * PAIRS
                data = np.frombuffer(data).reshape(6, width, -1)
                if (bi, bj) not in found:
                    found[bi, bj] = [base, data.copy()]
                    continue
                move = base - found[bi, bj][0]
                u, v = move[:width, None], move[None, width:]
                n, sx, sy, xy, xx, yy = data
                found[bi, bj][1] += [n, sx + n * u, sy + n * v, xy + u * sy + v * sx + n * u * v, xx + 2 * u * sx + n * u * u, yy + 2 * v * sy + n * v * v]
        yield from sent(found, 0)

    rows = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns))).mapInArrow(gram, schema)
    for by in (["bi", "bj", "g"], ["bi", "bj"]):
        rows = rows.repartition(*by).mapInArrow(add, schema)
    return rows


def pair_statistic(df: DataFrame, columns: list[str], statistic) -> DataFrame:
    """(i, j, v) for all pairs of columns, v = statistic(n, sums of x, y, xy, xx, yy) of arrays, from one pass over the rows."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "data"))):
                width = min(len(columns), (bi + 1) * PAIRS) - bi * PAIRS
                v = statistic(*np.frombuffer(data).reshape(6, width, -1))
                i, j = np.indices(v.shape)
                i, j, v = i.ravel() + bi * PAIRS, j.ravel() + bj * PAIRS, v.ravel()
                if bi != bj:
                    i, j, v = np.append(i, j), np.append(j, i), np.append(v, v)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(v, from_pandas=True)], names=["i", "j", "v"])

    return moments(df, columns).mapInArrow(cells, "i long, j long, v double")


def covariances(n, sx, sy, xy, xx, yy):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 1, (xy - sx * sy / n) / (n - 1), np.nan)


def correlations(n, sx, sy, xy, xx, yy):
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt((xx - sx * sx / n) * (yy - sy * sy / n))
        return np.where((n > 1) & (spread > 0), (xy - sx * sy / n) / spread, np.nan)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of columns, over the rows that have both values; null where that is not defined."""
    return pair_statistic(df, columns, correlations)


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance of all pairs of columns, over the rows that have both values; null for one row or none."""
    return pair_statistic(df, columns, covariances)


def fft_flop_rate(n: Column, seconds: Column) -> Column:
    """Millions of operations a second of a transform pair's half: 5 n log2 n + 2 n."""
    return (5 * n * F.log2(n) + 2 * n) / seconds / 1e6


def speedup(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds speedup (time of the smallest p present / time) and optimum (p). Rows are one for each configuration."""
    base = F.first_value("time").over(W.partitionBy(*group).orderBy("p"))
    return df.withColumns({"speedup": base / F.col("time"), "optimum": F.col("p")})


def weak_scaling(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds serial_time: the time of the first (n, p)."""
    return df.withColumn("serial_time", F.first_value("time").over(W.partitionBy(*group).orderBy("n", "p")))


def scaling_report(runs: DataFrame, kind: str = "strong", convention: str = "fixed25", large: bool = False) -> DataFrame:
    """Per (experiment, size, p) of runs (experiment, n, p, time): runs, median time, its interval, and the speed-up
    over the smallest p ('strong') or the serial time of the first size ('weak')."""
    interval = median_ci_large if large else median_ci
    medians = interval(runs.withColumnRenamed("n", "size"), ["experiment", "size", "p"], "time", convention=convention)
    rows = medians.withColumnsRenamed({"n": "runs", "median": "time"})
    if kind == "strong":
        return speedup(rows, ["experiment"])
    return weak_scaling(rows.withColumnRenamed("size", "n"), ["experiment"]).withColumnRenamed("n", "size")
