"""Orders: ordinals without a global window, sorting into even parts, samples, splitters, load balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.index import block_part
from ..storage import stored


def ordinal(df: DataFrame, order: list[str], group: tuple[str, ...] = (), name: str = "ordinal", keep: list[str] | None = None) -> DataFrame:
    """Adds the place (from 0) of each row in the order of its group. ``keep``: the columns that go on, the group's among
    them; all by default.

    One range shuffle; within a partition places are counted by the row id, and each partition adds the rows of its
    group before it. No window holds a whole group. ``order`` should be total for the places to be the same again; where
    it is not, rows with equal keys are dealt out at random, so that a very common value is no task's alone.
    """
    low = (1 << 33) - 1
    keys, columns = [*group, *order], keep or df.columns
    dealt = df.withColumn("__r", F.rand(7)).repartitionByRange(*keys, "__r").sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    dealt = stored(dealt.select(*columns, F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit(low)).alias("__k")), "ordered")
    counts = dealt.groupBy(*group, "__p").agg(F.count("*").alias("__n"), F.min("__k").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__p").alias("__q"), (before - F.col("__first")).alias("__o"))
    on = F.col("__p") == F.col("__q")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return dealt.join(offsets, on).select(*columns, (F.col("__k") + F.col("__o")).alias(name))


def sample_places(n: Column, p: int) -> Column:
    """The p places of equidistant samples in a part of n sorted entries."""
    small, more = F.floor(n / p).cast("long"), F.pmod(n, F.lit(p))
    k = F.sequence(F.lit(0), F.lit(p - 1))
    return F.transform(k, lambda i: F.when(i <= more, i * (small + 1)).otherwise(i * small + more))


def equidistant_samples(parts: DataFrame, p: int) -> DataFrame:
    """Of (part, pos, v, i), sorted within parts: the p regular samples of each part."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    wanted = sizes.select("part", F.explode(sample_places(F.col("n"), p)).alias("pos"))
    return parts.join(wanted, ["part", "pos"]).select("part", "pos", "v", "i")


def splitters(samples: DataFrame, p: int) -> list[tuple[float, int]]:
    """Every p-th of the p * p samples in order of (value, place): p pairs."""
    rows = samples.select("v", "i").orderBy("v", "i").collect()
    return [(rows[t * p][0], rows[t * p][1]) for t in range(p)]


def bucket_of(v: Column, i: Column, bounds: list[tuple[float, int]]) -> Column:
    """The last t with (v, i) at or over splitter t, comparing values and then places."""
    found = F.lit(0)
    for t, (x, k) in enumerate(bounds[1:], 1):
        found = F.when((v > x) | ((v == x) & (i >= k)), t).otherwise(found)
    return found


def part_count(n: int, p: int) -> int:
    """p, lowered until p * p <= n."""
    while p > 1 and p * p > n:
        p -= 1
    return p


def sample_sort(x: DataFrame, p: int) -> DataFrame:
    """(part, pos, v): a vector (i, v) sorted into p parts of even size, equal values split by their places.

    Regular sampling: blocks are sorted, each gives p samples, every p-th of all samples bounds a part. Only the p * p
    samples reach the driver. Empty vectors give no rows.
    """
    n = x.count()
    if not n:
        return x.sparkSession.createDataFrame([], "part int, pos long, v double")
    p = part_count(n, p)
    placed = ordinal(x.select("i", "v"), ["i"], name="g")
    blocks = placed.select(block_part(F.col("g"), p, n).cast("int").alias("part"), F.col("g").alias("i"), "v")
    sorted_ = ordinal(blocks, ["v", "i"], ("part",), "pos")
    bounds = splitters(equidistant_samples(sorted_, p), p)
    dealt = placed.select(bucket_of(F.col("v"), F.col("g"), bounds).cast("int").alias("part"), "v", "g")
    return ordinal(dealt, ["v", "g"], ("part",), "pos").select("part", "pos", "v")


def stable_sort(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Adds ``pos``: the place of each row by the keys, equal keys in their present order (column ``place``)."""
    return ordinal(df, [*keys, place], name="pos")


def merge_sorted(tables: list[DataFrame], key: str) -> DataFrame:
    """One sorted table of several."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out.orderBy(key)


def unsorted_rows(parts: DataFrame) -> DataFrame:
    """Rows of (part, pos, v) whose predecessor in the part is greater: none, if sorted. An equi-join on the place
    before takes the part of a window, so a part needn't fit one task."""
    before = parts.select("part", (F.col("pos") + 1).alias("pos"), F.col("v").alias("before"))
    return parts.join(before, ["part", "pos"]).where("before > v")


def part_ends(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n"))


def head_per_part(parts: DataFrame, k: int = 10) -> DataFrame:
    """The first k rows of each part (columns part, pos, ...)."""
    return parts.where(F.col("pos") < k)


def load_imbalance(df: DataFrame, part: str = "part") -> DataFrame:
    """One row: least, greatest and mean size of the parts, and greatest / mean - 1."""
    sizes = df.groupBy(part).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), (F.max("n") / F.avg("n") - 1).alias("imbalance"))


def bin_starts(keys: DataFrame, key: str) -> DataFrame:
    """(key, n, start): counts of each key and the exclusive running sum in key order. The running sum is over distinct
    keys, in range partitions, each adding what comes before it."""
    counts = keys.groupBy(key).agg(F.count("*").alias("n"))
    low = (1 << 33) - 1
    dealt = counts.repartitionByRange(key).sortWithinPartitions(key).withColumn("__m", F.monotonically_increasing_id())
    dealt = stored(dealt.select(key, "n", F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit(low)).alias("__k")), "bins")
    sums = dealt.groupBy("__p").agg(F.sum("n").alias("s"))
    offsets = sums.select("__p", F.coalesce(F.sum("s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("__p").orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(offsets, "__p").select(key, "n", (F.col("inside") + F.col("o")).cast("long").alias("start"))
