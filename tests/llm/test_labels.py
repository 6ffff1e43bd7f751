"""The weakly supervised classifier against the labels table, which it never reads."""

import os

import pytest
from pyspark.sql import functions as F

from numweave.llm import classifier

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_kept_documents_are_those_of_good_quality(spark):
    judged = classifier.classify(spark.read.parquet(f"{DATA}/documents.parquet")).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.1
