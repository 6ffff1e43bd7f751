"""The folder that a cluster shares, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is configured a temporary folder is taken, as in tests, but only with a local
    master: executors of a cluster would each write to a disk of their own."""
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        there = context.getCheckpointDir()
        if not there.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = there.get() if there.isDefined() else tempfile.mkdtemp(prefix="numweave-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """The table as it is read from a new folder in the shared one, and that folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read again: later steps start from files that outlive an executor."""
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one, when no table that is still to be read starts from it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
