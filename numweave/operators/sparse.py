"""Sparse matrices as triples (i, j, v, part): products, owners, compact local numbering, row starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .order import ordinal


def spmv(a: DataFrame, v: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """u = A v as (i, v). Duplicate triples add up; with ``rows`` (column i) rows without entries give 0.

    An equi-join on the column, then sums by row, combined map-side: a dense row costs one sum a task, and a dense
    column is a skewed join key that AQE splits.
    """
    products = a.select("i", "j", F.col("v").alias("a")).join(v.select(F.col("i").alias("j"), F.col("v").alias("x")), "j")
    u = products.groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("v"))
    if rows is None:
        return u
    return rows.select("i").join(u, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def resolve_owner(rows: DataFrame, dist: DataFrame, index: str = "i") -> DataFrame:
    """Adds (owner, owner_ind) of each needed index from a distribution (i, part, local_ind); without owner: part 0."""
    known = dist.select(F.col("i").alias(index), F.col("part").alias("__part"), F.col("local_ind").alias("owner_ind"))
    out = rows.join(known, index, "left")
    return out.withColumn("owner", F.coalesce("__part", F.lit(0))).drop("__part")


def spmv_traffic(a: DataFrame, dist_v: DataFrame, dist_u: DataFrame) -> DataFrame:
    """One row (fan_out, fan_in): components that a part needs from elsewhere, and partial sums that it sends elsewhere."""
    need = resolve_owner(a.select("part", "j").distinct(), dist_v, "j").where("owner != part")
    give = resolve_owner(a.select("part", "i").distinct(), dist_u, "i").where("owner != part")
    marked = need.select(F.lit(1).alias("o"), F.lit(0).alias("g")).union(give.select(F.lit(0), F.lit(1)))
    return marked.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("fan_out"), F.coalesce(F.sum("g"), F.lit(0)).alias("fan_in"))


def spmv_parts(a: DataFrame, v: DataFrame, dist_u: DataFrame) -> DataFrame:
    """u = A v with the part and local place of each component; components without entries give 0."""
    return spmv(a, v, dist_u).join(dist_u, "i")


def nonempty_rows_cols(a: DataFrame) -> DataFrame:
    """(part, n_rows, n_cols): distinct rows and columns that hold an entry."""
    return a.groupBy("part").agg(F.countDistinct("i").alias("n_rows"), F.countDistinct("j").alias("n_cols"))


def local_numbers(a: DataFrame, index: str, name: str) -> DataFrame:
    """(part, index, name): dense local numbers of a part's rows or columns in increasing order."""
    return ordinal(a.select("part", index).distinct(), [index], ("part",), name)


def compact_indices(a: DataFrame) -> DataFrame:
    """Adds (row_local, col_local) to the triples. Only distinct indices are numbered."""
    return a.join(local_numbers(a, "i", "row_local"), ["part", "i"]).join(local_numbers(a, "j", "col_local"), ["part", "j"])


def icrs(a: DataFrame) -> DataFrame:
    """Incremental compressed rows: (part, k, i, j, v, row_local, col_local, inc), entries in order of (row, column).

    inc is the step to the next local column; on a new row, the part's columns are added. The last entry of each part
    is the dummy of value 0 that closes the final row (i, j, row_local and col_local null). The entry before comes by an
    equi-join on its place.
    """
    numbered = ordinal(compact_indices(a), ["i", "j"], ("part",), "k")
    shape = numbered.groupBy("part").agg((F.max("col_local") + 1).alias("n_cols"), F.count("*").alias("n"))
    before = numbered.select("part", (F.col("k") + 1).alias("k"), F.col("row_local").alias("r"), F.col("col_local").alias("c"))
    step = F.when(F.col("c").isNull(), F.col("col_local")).otherwise(F.col("col_local") - F.col("c") + F.when(F.col("r") != F.col("row_local"), F.col("n_cols")).otherwise(0))
    rows = numbered.join(before, ["part", "k"], "left").join(shape.drop("n"), "part").select("part", "k", "i", "j", "v", "row_local", "col_local", step.cast("long").alias("inc"))
    last = before.join(shape, "part").where("k = n")
    null = F.lit(None).cast("long")
    dummy = last.select("part", "k", null.alias("i"), null.alias("j"), F.lit(0.0).alias("v"), null.alias("row_local"), null.alias("col_local"), (F.col("n_cols") - F.col("c")).cast("long").alias("inc"))
    return rows.unionByName(dummy)


def row_starts(a: DataFrame) -> DataFrame:
    """(part, row_local, start): where each local row starts among the part's entries; one more row holds their number.

    A row starts at the least place of its entries in (row, column) order."""
    entries = stored(ordinal(a.join(local_numbers(a, "i", "row_local"), ["part", "i"]), ["i", "j"], ("part",), "k").select("part", "row_local", "k"), "entries")
    starts = entries.groupBy("part", "row_local").agg(F.min("k").alias("start"))
    ends = entries.groupBy("part").agg((F.max("row_local") + 1).alias("row_local"), F.count("*").alias("start"))
    return starts.unionByName(ends)


def local_index_of(dist: DataFrame) -> DataFrame:
    """(i, part, local_ind): places of a vector's components within their parts, in order of i."""
    return ordinal(dist.select("i", "part"), ["i"], ("part",), "local_ind")


def argmax_abs(column: DataFrame) -> DataFrame:
    """One row (i, v): the entry with the greatest |v|; of equals the one in the lowest part, then the lowest i."""
    part = F.col("part") if "part" in column.columns else F.lit(0)
    best = F.max(F.struct(F.abs("v").alias("a"), (-part).alias("p"), (-F.col("i")).alias("i"), F.col("v").alias("v"))).alias("b")
    return column.agg(best).where("b IS NOT NULL").select((-F.col("b.i")).alias("i"), F.col("b.v").alias("v"))
