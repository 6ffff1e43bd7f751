"""A sink for files of fixed-size records in the order of their index: a Spark data source that writes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path, which may be a URI of any kind that Arrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A task's file: its first index, its number of records, where it waits."""

    first: int
    count: int
    name: str


class RecordWriter(DataSourceArrowWriter):
    """Each task writes its records (i, data), which come in order of i, to a file that waits aside. Once all tasks are done, and the
    files follow on one another without a gap, they get names in order; a lost or repeated task leaves nothing behind."""

    def __init__(self, path: str):
        self.path, self.aside = path.rstrip("/"), f"_waiting-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = file_system(self.path)
        system.create_dir(f"{top}/{self.aside}", recursive=True)
        context = TaskContext.get()
        out = Written(-1, 0, f"{self.aside}/{context.partitionId()}-{context.taskAttemptId()}")
        with system.open_output_stream(f"{top}/{out.name}") as file:
            for batch in iterator:
                index = batch.column("i").to_pylist()
                if index and out.first < 0:
                    out.first = index[0]
                if index != list(range(out.first + out.count, out.first + out.count + len(index))):
                    raise ValueError("records are absent, repeated or out of order")
                out.count += len(index)
                for data in batch.column("data"):
                    file.write(data.as_buffer())
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, top = file_system(self.path)
        parts = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first)
        there = 0
        for part in parts:
            if part.first != there:
                self.abort(messages)
                raise ValueError(f"record {there} is absent or repeated")
            there += part.count
        for k, part in enumerate(parts):
            system.move(f"{top}/{part.name}", f"{top}/part-{k:06d}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = file_system(self.path)
        if system.get_file_info(f"{top}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.aside}")


class FixedRecords(DataSource):
    """Format ``fixed_records``: rows (i long, data binary), i from 0 without gaps, in range partitions sorted by i."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        system, top = file_system(self.options["path"])
        if any("/part-" in f.path for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True))):
            if not overwrite:
                raise ValueError(f"{top} holds records already")
            system.delete_dir_contents(top)
        return RecordWriter(self.options["path"])


def write_records(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write (i, data) so that record i lies at i times its size of the folder's files, taken in order of their names. A
    folder that holds records already is an error, or emptied first with mode ``overwrite``."""
    spark = rows.sparkSession
    spark.dataSource.register(FixedRecords)
    rows.select("i", "data").repartitionByRange("i").sortWithinPartitions("i").write.format("fixed_records").mode(mode).save(path)


def record_files(spark: SparkSession, path: str) -> str:
    """The files of a path in order of their names, as Spark's readers of records take them; a file is itself."""
    names = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    return ",".join(names)
