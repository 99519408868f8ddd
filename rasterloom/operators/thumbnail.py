"""Thumbnails of whole images: plan in columns, then one Arrow function per admitted image that decodes, resamples and encodes in bands.

Images are frames with a column content, or with a column path only: of the latter only headers are read for a plan, and pixels where they are decoded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import BinaryIO, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import jpeg, png
from ..errors import ImageError
from ..options import JpegOptions, PngOptions, ThumbnailOptions
from ..plans import admission
from ..sources import images as source
from ..sources import ranges
from ..sources.staged import StagedSink
from .area import Ordered, Sparse, bands

OUTPUT = "out_width bigint, out_height bigint, format string, mime_type string, bytes binary, error_kind string, error_detail string, actual bigint, limit bigint"


def plan(images: DataFrame, options: ThumbnailOptions, enforce: bool = True, keep_content: bool = False) -> DataFrame:
    """The plan of each image: header, output size, memory, verdict. Nothing is decoded."""
    by_path = "content" not in images.columns
    found = ranges.headers(images) if by_path else source.inspect(images, options.limits.max_input_bytes, keep_content)
    planned = admission.plan(admission.with_options(found, options), enforce)
    # The byte limit comes before the header, the header before the other limits.
    late = F.col("header_error").isNotNull() & ~F.coalesce(F.col("error_kind") == "LimitExceeded.InputBytes", F.lit(False))
    none = F.lit(None).cast("bigint")
    return planned.withColumns({"error_kind": F.when(late, F.col("header_error")).otherwise(F.col("error_kind")), "actual": F.when(late, none).otherwise(F.col("actual")), "limit": F.when(late, none).otherwise(F.col("limit"))})


def admitted(images: DataFrame, options: ThumbnailOptions) -> DataFrame:
    """The images with their output sizes and limits' verdicts from IHDR alone; content is null where the byte limit is exceeded.

    A header that is unsound elsewhere is told by header_of(), whose error comes before every limit's but that of bytes.
    """
    planned = admission.plan(admission.with_options(source.with_ihdr(images), options), True)
    over = F.coalesce(F.col("error_kind") == "LimitExceeded.InputBytes", F.lit(False))
    return planned.withColumn("content", F.when(~over, F.coalesce("content", F.lit(b""))))


Input = bytes | png.ReadAt_


def header_of(data: Input) -> png.Header:
    return png.read_header(lambda o, n: data[o : o + n], len(data))


class RowSink(Protocol):
    """What output rows are given to, top to bottom, when their sources are complete. An error that it raises ends the job and is its cause."""

    def push(self, rgba: np.ndarray) -> None:
        """A band of rows (n x width x 4)."""

    def finish(self) -> bytes:
        """After the last row; what it returns is the image's bytes."""


def finished(data: Input, ow: int, oh: int, fit: str, h: png.Header | None = None) -> Iterator[np.ndarray]:
    """Bands of output rows of one image, as its rows are decoded."""
    h = h or header_of(data)
    png.check_allowance(h)
    if h.interlaced:
        s = Sparse(fit, h.width, h.height, ow, oh)
        for ys, xs, px in png.decode_passes(data, h):
            s.push(ys, xs, px)
        yield s.close()
    else:
        yield from bands(png.decode_bands(data, h), Ordered(fit, h.width, h.height, ow, oh))


def encoder(h: png.Header, ow: int, oh: int, options: ThumbnailOptions, cap: int | None = None, into: BinaryIO | None = None) -> RowSink:
    if options.output == "png":
        o = options.png or PngOptions()
        return png.Encoder(ow, oh, o, png.auto_color(h) if o.color == "auto" else o.color, cap, into)
    return jpeg.Encoder(ow, oh, options.jpeg or JpegOptions(), cap, into)


def render(data: Input, ow: int, oh: int, options: ThumbnailOptions, cap: int | None = None, h: png.Header | None = None, into: BinaryIO | None = None) -> bytes:
    """One image's output bytes, or with `into` none: they go to that file as they are made. The encoder is made with the first finished rows, so an image that fails before has written nothing."""
    h = h or header_of(data)
    if options.output == "rgba":
        if into is None:
            return b"".join(b.tobytes() for b in finished(data, ow, oh, options.fit, h))
        for band in finished(data, ow, oh, options.fit, h):
            into.write(band.tobytes())
        return b""
    sink = None
    for band in finished(data, ow, oh, options.fit, h):
        sink = sink or encoder(h, ow, oh, options, cap, into)
        sink.push(band)
    assert sink is not None
    return sink.finish()


def thumbnails(images: DataFrame, options: ThumbnailOptions, mode: str = "permissive", sink: Callable[[png.Header, int, int], RowSink] | None = None) -> DataFrame:
    """The rows (without content) with OUTPUT: bytes, or the error of those that give none. mode "failfast" raises instead.

    Plans and limits are columns; content goes through Python once, and not at all beyond the byte limit. Images without a column content are read by ranges from
    their path. Other columns of images stay. sink(header, width, height) makes what the rows are given to instead of the options' encoder.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"no mode {mode}")
    keys = [c for c in images.columns if c != "content"]
    by_path = "content" not in images.columns
    row = F.struct(*[F.col(f"`{k}`") for k in keys] or [F.lit(0)]).alias("_row")
    keyed = images.select(row, "path" if by_path else "content")
    planned = plan(keyed, options).withColumn("content", F.lit(None).cast("binary")) if by_path else admitted(keyed, options).withColumn("path", F.lit(None).cast("string"))
    todo = planned.select("_row", "path", "content", "out_width", "out_height", "encoded_cap", "error_kind", "actual", "limit")
    new = [f.split() for f in OUTPUT.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def made_of(data: Input, h: png.Header, ow: int, oh: int, cap: int) -> bytes:
        if sink is None:
            return render(data, ow, oh, options, cap or None, h)
        own = sink(h, ow, oh)
        for band in finished(data, ow, oh, options.fit, h):
            own.push(band)
        return own.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c, row=row: row.column(c)[0].as_py()
                kind, detail, actual, limit = get("error_kind"), None, get("actual"), get("limit")
                ow, oh, out = get("out_width"), get("out_height"), None
                try:
                    if by_path and kind is None:
                        with ranges.opened(get("path")) as data:
                            out = made_of(data, header_of(data), ow, oh, get("encoded_cap"))
                    elif not by_path and (data := get("content")) is not None:
                        h = header_of(data)
                        if kind is None:
                            out = made_of(data, h, ow, oh, get("encoded_cap"))
                except ImageError as e:
                    kind, detail, actual, limit = e.kind, e.detail, e.actual, e.limit
                except OSError as e:
                    kind, detail = "InputIo", str(e)
                except MemoryError:
                    kind = "AllocationFailed"
                if kind is not None and mode == "failfast":
                    first = row.column("_row")[0].as_py()
                    raise ImageError(kind, f"{next(iter(first.values()))}: {detail or ''}", actual, limit)
                values = (ow, oh, options.output, options.mime_type, out, kind, detail, actual, limit)
                yield pa.RecordBatch.from_arrays([row.column("_row"), *[pa.array([v], kinds[t]) for v, (_, t) in zip(values, new)]], names=["_row", *[n for n, _ in new]])

    made = todo.mapInArrow(run, f"_row {keyed.schema['_row'].dataType.simpleString()}, {OUTPUT}")
    return made.select(*[F.col("_row")[k].alias(k) for k in keys], *[n for n, _ in new])


def write(images: DataFrame, name: Column, options: ThumbnailOptions, folder: str, overwrite: bool = True) -> None:
    """Thumbnails as files of a folder, all or none: every image is decoded, resampled and encoded into its own file while the sink writes it."""
    images.sparkSession.dataSource.register(StagedSink)
    by_path = "content" not in images.columns
    planned = plan(images, options) if by_path else admitted(images, options)
    rows = planned.select(name.alias("name"), "path" if by_path else "content", "out_width", "out_height", "encoded_cap", "error_kind")
    writer = rows.write.format("staged_files").option("path", folder).option("overwrite", str(overwrite).lower())
    writer.option("thumbnail", json.dumps(asdict(options))).mode("append").save()


def decode_rows(images: DataFrame, options: ThumbnailOptions = ThumbnailOptions(), key: str = "path") -> DataFrame:
    """(key, y, rgba) of every row of the images that a plan admits; interlaced images and failures give one row with error_kind."""
    todo = admitted(images, options).select(key, "content", "error_kind")
    type_ = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [key, "y", "rgba", "error_kind"]
            for i in range(batch.num_rows):
                k = batch.column(key).slice(i, 1)
                error, data = batch.column("error_kind")[i].as_py(), batch.column("content")[i].as_py()
                if data is not None:
                    try:
                        h = header_of(data)
                        error = error or ("Unsupported.Interlacing" if h.interlaced else None)
                        if error is None:
                            png.check_allowance(h)
                            for y, band in png.decode_bands(data, h):
                                keys = pa.array([k[0].as_py()] * len(band), k.type)
                                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(y, y + len(band)), pa.int64()), pa.array([r.tobytes() for r in band], pa.binary()), pa.nulls(len(band), pa.string())], names=names)
                    except ImageError as e:
                        error = e.kind
                if error is not None:
                    yield pa.RecordBatch.from_arrays([k, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([error])], names=names)

    return todo.mapInArrow(run, f"`{key}` {type_}, y bigint, rgba binary, error_kind string")


def row_pixels(rows: DataFrame, key: str = "path") -> DataFrame:
    """Row blocks to the pixel relation (image_id, y, x, r, g, b, a)."""
    type_ = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = part.column("rgba").to_pylist()
                width = np.array([len(d) // 4 for d in data], np.int64)
                px = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 4).astype(np.int64)
                row = pa.array(np.repeat(np.arange(len(data)), width))
                x = np.arange(len(px)) - np.repeat(np.cumsum(width) - width, width)
                yield pa.RecordBatch.from_arrays([part.column(key).take(row), part.column("y").take(row), pa.array(x), *[pa.array(np.ascontiguousarray(px[:, i])) for i in range(4)]], names=["image_id", "y", "x", *"rgba"])

    return rows.where("rgba IS NOT NULL").select(key, F.col("y").cast("bigint").alias("y"), "rgba").mapInArrow(run, f"image_id {type_}, y bigint, x bigint, r bigint, g bigint, b bigint, a bigint")


def thumbnail_pixels(done: DataFrame, key: str = "path") -> DataFrame:
    """Raw RGBA thumbnails to (image_id, oy, ox, r, g, b, a)."""
    px = row_pixels(done.where("bytes IS NOT NULL").select(F.struct(F.col(key).alias("k"), "out_width").alias("k"), F.lit(0).alias("y"), F.col("bytes").alias("rgba")), "k")
    w = F.col("image_id.out_width")
    return px.select(F.col("image_id.k").alias("image_id"), F.call_function("div", F.col("x"), w).alias("oy"), (F.col("x") % w).alias("ox"), *"rgba")
