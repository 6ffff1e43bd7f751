"""Line dedup by the spread of a line over distinct sites. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

BLANKS = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(key, doc, at, site) of each line with a word; key: 64-bit hash of the line without blanks around it."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line != ''")
    return rows.select(F.xxhash64("line").alias("key"), "doc", "at", "site")


def wide_lines(lines: DataFrame, min_sites: int = 10) -> DataFrame:
    """(key, first): lines on ``min_sites`` distinct sites or more, with the smallest document that has them.

    One HyperLogLog sketch per line hash (a few longs each, merged map-side) settles what it can settle for certain; all
    other lines get exact counts: distinct (line, site) pairs are made before anything meets by line alone.

    Certainly under: fewer occurrences than ``min_sites``, or the same site in all of them. Certainly over: an estimate
    of twice ``min_sites``. The sketch has 3.2 registers or more for each site of the threshold, so with fewer sites
    than that at most 0.32 of its m registers are filled, and its estimate, there m * ln(m / empty), is under 1.25 times
    ``min_sites``.
    """
    bits = max(5, math.ceil(math.log2(3.2 * min_sites)))
    rsd = 1.106 / 2 ** (bits / 2 - 0.25)
    site = F.xxhash64("site")
    sketched = lines.groupBy("key").agg(
        F.count("*").alias("n"), F.min(site).alias("low"), F.max(site).alias("high"),
        F.approx_count_distinct("site", rsd).alias("sites"), F.min("doc").alias("first"),
    )
    sketched = stored(sketched.where((F.col("n") >= min_sites) & ((F.col("low") != F.col("high")) | F.lit(min_sites <= 1))).select("key", "sites", "first"), "wide")
    near = sketched.where(F.col("sites") < 2 * min_sites).select("key")
    pairs = lines.select("key", "site").join(near, "key", "left_semi").select(F.struct("key", "site").alias("pair"))
    exact = pairs.groupBy("pair").agg(F.lit(1).alias("one")).groupBy(F.col("pair.key").alias("key")).agg(F.count("*").alias("exact"))
    return stored(sketched.join(exact, "key", "left").where(F.coalesce("exact", "sites") >= min_sites).select("key", "first"), "wide")


def drop_wide_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    counts: bool = True,
) -> DataFrame:
    """``docs`` with wide-spread lines taken out of ``text``, plus ``n_lines`` and ``n_removed`` unless not wanted.

    The document with the smallest id keeps its wide lines, so each of them stays in the corpus. Lines are compared
    without the blanks around them; lines without a word always stay. Null texts stay null with no lines; a null site
    is a site of its own; rows with a null id lose nothing; rows that share an id lose the same lines. All columns stay;
    with counts, columns of those two names give way to them.
    """
    doc, gone = fresh(docs, "lines_doc"), fresh(docs, "lines_gone")
    lines = line_rows(docs, id_col, text_col, site_col)
    wide = wide_lines(lines, min_sites)
    hits = lines.join(wide, "key").where(F.col("doc") != F.col("first")).select("doc", "at")
    lost = hits.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("at").alias(gone))
    rows = docs.join(lost, F.col(id_col) == F.col(doc), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    changed = {text_col: text}
    if counts:
        changed |= {
            "n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long"),
            "n_removed": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"),
        }
    return rows.withColumns(changed).drop(doc, gone)
