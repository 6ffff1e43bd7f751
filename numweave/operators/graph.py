"""Weighted graphs as directed edges (i, j, w), both directions present: checks, bounds, and dominant matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def faulty_edges(edges: DataFrame) -> DataFrame:
    """Rows that break the contract, with the reason: loops, weights not over 0, no equal edge the other way."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w_back"))
    reason = F.when(F.col("i") == F.col("j"), "loop").when(~(F.coalesce("w", "w_back") > 0), "weight").when(~F.col("w").eqNullSafe(F.col("w_back")), "asymmetric")
    return edges.select("i", "j", "w").join(back, ["i", "j"], "full").withColumn("reason", reason).where("reason IS NOT NULL")


def validate_graph(edges: DataFrame) -> DataFrame:
    """The edges, or an error that shows offending rows."""
    if bad := faulty_edges(edges).limit(5).collect():
        raise ValueError(f"not a symmetric graph of positive weights: {bad}")
    return edges


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, i < j."""
    return edges.where("i < j").dropDuplicates(["i", "j"])


def degree(edges: DataFrame) -> DataFrame:
    """(i, n, most): neighbours and heaviest edge of each vertex."""
    return edges.groupBy("i").agg(F.count("*").alias("n"), F.max("w").alias("most"))


def weight_bounds(edges: DataFrame) -> DataFrame:
    """One row: half the sum of each vertex's heaviest edge, and half the sum of all; a matching weighs no more."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return edges.groupBy("i").agg(F.max("w").alias("m"), F.sum("w").alias("s")).agg((zero(F.sum("m")) / 2).alias("bound"), (zero(F.sum("s")) / 2).alias("total"))


def vertex_parts(edges: DataFrame) -> DataFrame:
    """(i, part): the part of a vertex is that of its row; vertices without a row are not named (part 0)."""
    return edges.groupBy("i").agg(F.min("part").alias("part"))


def halo_pairs(edges: DataFrame) -> DataFrame:
    """Edges (i, j, part) whose other direction lies in another part, with that part. Each has exactly one partner."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("part").alias("other"))
    return edges.join(back, ["i", "j"]).where("part != other")


def with_ties(edges: DataFrame, n: int) -> DataFrame:
    """Adds the second weight: i + j, and 2n more inside a part; it makes the order of a vertex's edges strict."""
    tie = F.col("i") + F.col("j")
    if "part" not in edges.columns:
        return edges.withColumn("tie", tie + 2 * n)
    parts = vertex_parts(edges).select(F.col("i").alias("j"), F.col("part").alias("other"))
    joined = edges.join(parts, "j", "left")
    return joined.select(*edges.columns, (tie + F.when(F.col("part") == F.coalesce("other", F.lit(0)), 2 * n).otherwise(0)).alias("tie"))


def heaviest_edge(edges: DataFrame) -> DataFrame:
    """(i, j, w): each vertex's heaviest edge by weight, then tie (columns i, j, w, tie); maxima are combined map-side."""
    best = edges.groupBy("i").agg(F.max(F.struct("w", "tie", "j")).alias("b"))
    return best.select("i", F.col("b.j").alias("j"), F.col("b.w").alias("w"))


def without_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the vertices (column i)."""
    return edges.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti")


def decided(live: DataFrame) -> DataFrame:
    """(i, j, w), i < j: edges that the greedy matching takes, as far as chains decide it. live: (i, j, w, tie), both directions.

    An edge that no neighbour outweighs is taken. One that a single neighbour outweighs is taken if that one is not. So
    such edges form chains, and the chain up to an edge that is taken decides by its length, odd or even; pointers along
    the chains are doubled, so a chain of any length takes as many steps as it has binary digits. Chains that end at an
    edge with several heavier neighbours stay open. A vertex hands on its two heaviest edges only.
    """
    order = F.struct("w", "tie", "j")
    best = live.groupBy("i").agg(F.max(order).alias("b"))
    second = live.join(best, "i").where(F.col("j") != F.col("b.j")).groupBy("i").agg(F.max(order).alias("s"))
    none = F.lit(None).cast("long")
    tops = F.array(F.struct(F.col("b.j").alias("j"), F.col("b.w").alias("w"), F.lit(0).alias("over"), none.alias("via")), F.struct("s.j", "s.w", F.lit(1).alias("over"), F.col("b.j").alias("via")))
    ends = best.join(second, "i", "left").select("i", F.inline(tops)).where("j IS NOT NULL")
    above = F.when(F.col("over") == 1, F.struct(F.least("i", "via").alias("i"), F.greatest("i", "via").alias("j")))
    edges = ends.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("z")).agg(F.max("w").alias("w"), F.count("*").alias("n"), F.sum("over").alias("over"), F.max(above).alias("to"))
    chains = edges.where("n = 2 AND over < 2").select(F.col("a").alias("i"), F.col("z").alias("j"), "w", "to", (F.col("over") == 1).alias("odd"), F.lit(False).alias("open"))
    chains = stored(chains, "chains")
    while not chains.where("to IS NOT NULL AND NOT open").isEmpty():
        going = chains.where("to IS NOT NULL AND NOT open")
        on = chains.select(F.struct("i", "j").alias("to"), F.col("to").alias("further"), F.col("odd").alias("more"), F.col("open").alias("ends"))
        moved = going.join(on, "to", "left").select("i", "j", "w", F.coalesce("further", F.when(F.col("more").isNull(), F.col("to"))).alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.coalesce("ends", F.lit(True)).alias("open"))
        chains = stored(chains.where("to IS NULL OR open").union(moved.select(chains.columns)), "chains")
    return chains.where("to IS NULL AND NOT open AND NOT odd").select("i", "j", "w")


def match(edges: DataFrame) -> DataFrame:
    """Locally dominant matching as (i, j, w), i < j. edges: (i, j, w, tie), both directions.

    In each round the edges that chains decide are taken (``decided``), among them all that are the heaviest at both
    ends, and edges of taken vertices go. Every vertex hands on two maxima, combined map-side, so hubs are harmless. As
    the order by weight and tie is strict, the result is that of taking edges greedily from the heaviest, at least half
    the greatest weight. Rounds don't grow with the length of rising paths. A round writes one table to the shared
    folder, of the edges that live on and those taken, and one for each doubling of its chains.
    """
    live = stored(edges.select("i", "j", "w", "tie"), "live")
    found, n = live.where("false").select("i", "j", "w"), live.count()
    while n:
        taken = decided(live)
        rest = without_vertices(live, taken.select(F.explode(F.array("i", "j")).alias("i"))).select("i", "j", "w", "tie", F.lit(False).alias("taken"))
        both = stored(rest.union(taken.select("i", "j", "w", F.lit(None).cast(live.schema["tie"].dataType), F.lit(True))), "matched")
        n, n_taken = both.agg(F.count_if(~F.col("taken")), F.count_if("taken")).first()
        if n and not n_taken:
            raise ValueError("no edge is the heaviest at both ends: the order isn't strict, or edges lack their other direction")
        found = found.union(both.where("taken").select("i", "j", "w"))
        live = both.where("NOT taken").select("i", "j", "w", "tie")
    return found


def matching_stats(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: matches, their weight, both upper bounds, and whether the weight keeps to them."""
    weight = matches.agg(F.count("*").alias("matches"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"))
    ok = (F.col("weight") <= F.col("bound")) & (F.col("weight") <= F.col("total"))
    return weight.join(weight_bounds(edges)).withColumn("ok", ok)


def matching_parts(matches: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, internal, external): a match inside a part counts once there, one across parts at both."""
    a = parts.select("i", F.col("part").alias("a"))
    b = parts.select(F.col("i").alias("j"), F.col("part").alias("b"))
    ends = matches.join(a, "i", "left").join(b, "j", "left").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    seen = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("part"), (F.col("a") == F.col("b")).alias("inside"))
    return seen.groupBy("part").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
