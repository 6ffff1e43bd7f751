"""Line dedup: what the sketch alone may settle, and lines whose sites share registers."""

import plain
from pyspark.sql import functions as F

from numweave.llm import lines


def test_few_sites_never_pass_by_the_sketch(spark):
    """Sets of 9 and 10 sites, thousands of them: each line is on one set, and the exact answer is known."""
    sites = spark.range(4000).select(F.col("id").alias("k"), (9 + F.col("id") % 2).alias("n"))
    rows = sites.select("k", "n", F.explode(F.sequence(F.lit(1), "n")).alias("j"))
    table = rows.select(F.xxhash64("k").alias("key"), (F.col("k") * 100 + F.col("j")).alias("doc"), F.concat_ws("/", "k", "j").alias("site"), F.lit(0).alias("at"))
    wide = lines.wide_lines(table, 10)
    want = sites.where("n = 10").select(F.xxhash64("k").alias("key"), (F.col("k") * 100 + 1).alias("first"))
    assert wide.count() == 2000 and wide.exceptAll(want).count() == 0


def test_sites_that_fill_few_registers(spark):
    """Ten sites whose sketch holds least of all that were tried: the estimate is far under ten, the line is wide."""
    trial = spark.range(3_000_000).select(F.col("id").alias("k"), F.concat(F.lit("s"), "id").alias("site"))
    one = trial.withColumn("register", F.shiftrightunsigned(F.xxhash64("site"), 59)).where("register = 3").select("site").orderBy("site").limit(10)
    sites = [r.site for r in one.collect()]
    docs = spark.createDataFrame([(i, f"the same line\nown words {i}", s) for i, s in enumerate(sites)], "doc_id long, text string, source string")
    assert docs.agg(F.approx_count_distinct("source", 0.2325)).first()[0] < 5
    got = {r.doc_id: r.text for r in lines.drop_wide_lines(docs).collect()}
    want = plain.wide_lines([(r.doc_id, r.text, r.source) for r in docs.collect()], 10)
    assert got == {i: t for i, (t, _) in want.items()} and got[1] == "own words 1"
