"""A folder's files as a data source: one row for each file, with its text, or why it has none.

The files are listed once, with their sizes, and dealt into partitions of about PART bytes; each is read whole, by the
task of its partition. What can't be read (or is no UTF-8) is a row with an error and no text, not the end of the job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..files import place
from .readers import detect, markdown_samples, plain_text_samples

SCHEMA = "origin_path string, kind string, bytes long, text string, error string"
#: Bytes and files of a partition; files in an Arrow batch are at most BATCH bytes, or one file.
PART, FILES, BATCH = 64 << 20, 2000, 8 << 20


@dataclass
class FilePartition(InputPartition):
    files: list[tuple[str, str, int]]


class WalkReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[FilePartition]:
        """Files with a reader, nothing whose name or folder below the root begins with a dot, in the order of paths."""
        system, path = place(self.root)
        if system.get_file_info(path).type == pafs.FileType.File:
            found = [system.get_file_info(path)]
        else:
            found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        parts, size = [FilePartition([])], 0
        for info in sorted(found, key=lambda i: i.path):
            below = info.path[len(path.rstrip("/")) :]
            source = detect(info.path)
            if info.type == pafs.FileType.Directory or source is None or any(p.startswith(".") for p in below.split("/")):
                continue
            if parts[-1].files and (size + (info.size or 0) > PART or len(parts[-1].files) >= FILES):
                parts.append(FilePartition([]))
                size = 0
            parts[-1].files.append((info.path, source.name, info.size or 0))
            size += info.size or 0
        return parts

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.root)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0
        for path, kind, size in partition.files:
            text = error = None
            try:
                with system.open_input_file(path) as file:
                    text = file.read().decode()
            except UnicodeDecodeError as e:
                error = f"not UTF-8 at byte {e.start}"
            except OSError as e:
                error = type(e).__name__
            rows.append((path, kind, size, text, error))
            held += size
            if held > BATCH:
                yield self.batch(rows, names)
                rows, held = [], 0
        if rows:
            yield self.batch(rows, names)

    @staticmethod
    def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class WalkSource(DataSource):
    """spark.read.format("inkstone_walk").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "inkstone_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options["path"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below a folder (or for one file): origin_path, kind, bytes, text, error."""
    spark.dataSource.register(WalkSource)
    return spark.read.format("inkstone_walk").load(path)


def samples(found: DataFrame, context: str | None = None) -> DataFrame:
    """The samples of `files`: content, source, origin_path, context_tag, position."""
    good = found.where("error is null").select("text", "origin_path", "kind")
    return markdown_samples(good.where("kind = 'markdown'"), context).unionByName(plain_text_samples(good.where("kind = 'plain_text'"), context))


def failures(found: DataFrame) -> DataFrame:
    """The files that could not be read, and why: origin_path, kind, reason."""
    return found.where("error is not null").select("origin_path", "kind", F.col("error").alias("reason"))


def report(found: DataFrame) -> DataFrame:
    """kind, files, failed, bytes."""
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("failed"), F.sum("bytes").alias("bytes"))
