"""Files read by ranges, on any file system that pyarrow knows: headers cost eight bytes a chunk, pixels no more than one piece at a time.

headers(files) reads the headers of the paths of a frame; HeaderSource is the same as a data source:
spark.dataSource.register(HeaderSource); spark.read.format("png_headers").option("paths", json list).load()
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..codecs.png import ReadAt_
from . import images


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the place in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


@contextlib.contextmanager
def opened(path: str) -> Iterator[ReadAt_]:
    """A file as slices that are read when they are asked for."""
    system, place = located(path)
    with system.open_input_file(place) as f:
        yield ReadAt_(lambda offset, length: f.read_at(length, offset), f.size())


def header_at(path: str) -> tuple:
    """(bytes, header...) of a file; one that can't be read has the error InputIo."""
    try:
        with opened(path) as data:
            return len(data), *images.header_row(lambda o, n: data[o : o + n], len(data))
    except OSError as e:
        return None, *[None] * 8, "InputIo", str(e)


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of files. Nothing of them is read."""
    return images.scan(spark, path, glob=glob).select("path", "length")


def headers(paths: DataFrame) -> DataFrame:
    """The rows of a frame with a column path, with encoded_bytes and the header's columns; no more of a file is read than its chunks' heads, palette and transparency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [header_at(p) for p in batch.column("path").to_pylist()]
            sizes = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, *images.header_columns([r[1:] for r in rows])], names=[*batch.schema.names, "encoded_bytes", *images.NAMES])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInArrow(run, f"{fields}, encoded_bytes bigint, {images.HEADER}").withColumn("encoded_bytes", F.coalesce("encoded_bytes", F.lit(0)).cast("bigint"))


class Range(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str], per_task: int) -> None:
        self.paths, self.per_task = paths, per_task

    def partitions(self) -> list[Range]:
        return [Range(self.paths[i : i + self.per_task]) for i in range(0, len(self.paths), self.per_task)] or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for path in partition.paths:
            yield (path, *header_at(path))


class HeaderSource(DataSource):
    """Options: paths, a JSON list of files that every executor sees; perTask, files a task (64)."""

    @classmethod
    def name(cls) -> str:
        return "png_headers"

    def schema(self) -> str:
        return f"path string, encoded_bytes bigint, {images.HEADER}"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(json.loads(self.options["paths"]), int(self.options.get("pertask", "64")))
