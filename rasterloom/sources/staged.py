"""A sink that writes each row's bytes to a file of its own, all or nothing.

Tasks write hidden files beside the destinations; the driver's commit renames them, and an abort deletes them, so a job that fails
leaves every old file as it was. spark.dataSource.register(StagedSink); df.write.format("staged_files").option("path", folder).mode("append").save()

With the option thumbnail (a thumbnail's options as JSON) the rows are planned images, as operators.thumbnail.write() makes them: each is decoded, resampled and encoded into its file
within the write, and no output is ever whole in memory. The first image that fails fails the job, and with it every file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import ImageError
from ..options import ThumbnailOptions, from_dict
from .ranges import located, opened


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]
    bytes_written: int


class Counted:
    """A file that takes cap bytes at most."""

    def __init__(self, file, name: str, cap: int | None) -> None:
        self.file, self.name, self.cap, self.written = file, name, cap, 0

    def write(self, data: bytes) -> None:
        self.written += len(data)
        if self.cap is not None and self.written > self.cap:
            raise ValueError(f"EncodedOutputLimitExceeded: {self.name} has over {self.cap} bytes")
        self.file.write(data)


class StagedWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, cap: int | None, thumbnail: ThumbnailOptions | None = None) -> None:
        self.folder, self.overwrite, self.cap, self.thumbnail = folder, overwrite, cap, thumbnail
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Staged:
        system, folder = located(self.folder)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        total = 0
        try:
            for row in rows:
                name = row["name"]
                if os.path.basename(name) != name or not name or name.startswith("."):
                    raise ValueError(f"{name!r} is no plain file name")
                staged = f"{folder}/.{name}.{self.job}.{uuid.uuid4().hex}"
                files.append((staged, f"{folder}/{name}"))
                with system.open_output_stream(staged) as f:
                    out = Counted(f, name, self.cap)
                    self._fill(out, row.asDict())
                total += out.written
        except BaseException:
            self._drop(files)
            raise
        return Staged(files, total)

    def _fill(self, out: Counted, row: dict) -> None:
        if self.thumbnail is None:
            out.write(bytes(row["bytes"]))
        elif row["error_kind"] is not None:
            raise ImageError(row["error_kind"], row["name"])
        elif row.get("content") is not None:
            self._render(bytes(row["content"]), row, out)
        else:
            with opened(row["path"]) as data:
                self._render(data, row, out)

    def _render(self, data, row: dict, out: Counted) -> None:
        from ..operators.thumbnail import render

        render(data, row["out_width"], row["out_height"], self.thumbnail, row["encoded_cap"] or None, into=out)

    def _drop(self, files: list[tuple[str, str]]) -> None:
        system, _ = located(self.folder)
        for staged, _ in files:
            try:
                system.delete_file(staged)
            except FileNotFoundError:
                pass

    def commit(self, messages: list[Staged | None]) -> None:
        system, _ = located(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [d for _, d in files]
        there = [] if self.overwrite or not names else [i for i in system.get_file_info(names) if i.type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or there:
            self._drop(files)
            raise ValueError("two outputs have one name, or a file exists and overwrite is off")
        for staged, name in files:
            system.move(staged, name)

    def abort(self, messages: list[Staged | None]) -> None:
        # Also what tasks have left whose messages never came.
        system, folder = located(self.folder)
        left = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        self._drop([(i.path, "") for i in left if f".{self.job}." in i.base_name])


class StagedSink(DataSource):
    """Rows (name, bytes), or planned images with thumbnail. Options: path, a folder that driver and executors share; overwrite (true); cap, bytes a file; thumbnail."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "name string, bytes binary"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        cap, made = self.options.get("cap"), self.options.get("thumbnail")
        return StagedWriter(self.options["path"], self.options.get("overwrite", "true").lower() == "true", int(cap) if cap else None, from_dict(json.loads(made)) if made else None)
