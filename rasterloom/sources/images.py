"""Images as rows: file scans with pushed-down size limits, header inspection, generated test images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import png
from ..errors import ImageError
from ..options import PngOptions

HEADER = "width bigint, height bigint, color_type string, bit_depth bigint, interlaced boolean, raw_trns_length bigint, source_bpp bigint, auto_color string, header_error string, header_detail string"
NAMES = [f.split()[0] for f in HEADER.split(", ")]


def scan(spark: SparkSession, path: str, max_bytes: int | None = None, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files. The length limit reaches the scan, which then reads no larger file."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files if max_bytes is None else files.where(F.col("length") <= max_bytes)


def ihdr(content: Column) -> dict[str, Column]:
    """The fixed places of IHDR as columns, for filters that should not wait for Python. Null where the signature is wrong."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("bigint")
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452") & (F.length(content) >= 33)
    kind = number(26, 1)
    name = F.when(kind == 0, "grayscale").when(kind == 2, "rgb").when(kind == 3, "indexed").when(kind == 4, "grayscale-alpha").when(kind == 6, "rgba")
    ok &= (number(17, 4) < 1 << 31) & (number(21, 4) < 1 << 31)
    fields = {"width": number(17, 4), "height": number(21, 4), "bit_depth": number(25, 1), "color_type": name, "interlaced": number(29, 1) == 1}
    return {k: F.when(ok, v) for k, v in fields.items()}


def with_ihdr(images: DataFrame) -> DataFrame:
    """The rows with what a plan needs of a header, from IHDR's fixed places and so without Python. Null where they hold no IHDR; only a walk through the chunks tells whether the rest is sound."""
    c = ihdr(F.col("content"))
    channels = F.when(c["color_type"] == "rgb", 3).when(c["color_type"] == "grayscale-alpha", 2).when(c["color_type"] == "rgba", 4).otherwise(1)
    packed = (c["color_type"] == "indexed") | ((c["color_type"] == "grayscale") & (c["bit_depth"] < 8))
    bpp = F.when(packed, 1).otherwise(F.call_function("div", channels * c["bit_depth"], F.lit(8))).cast("bigint")
    return images.withColumns({"encoded_bytes": F.coalesce(F.length("content"), F.lit(0)).cast("bigint"), **c, "source_bpp": bpp})


def header_row(read_at: png.ReadAt, size: int) -> tuple:
    try:
        h = png.read_header(read_at, size)
        return h.width, h.height, png.COLOR_NAMES[h.color], h.depth, h.interlaced, h.raw_trns_length, h.planning_bpp, png.auto_color(h), None, None
    except ImageError as e:
        return (*[None] * 8, e.kind, e.detail)


def header_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def inspect(images: DataFrame, max_input_bytes: int | None = None, keep_content: bool = True) -> DataFrame:
    """The rows (any columns with content) with the header's columns; images over the byte limit are not looked into."""
    images = images.withColumn("encoded_bytes", F.coalesce(F.length("content"), F.lit(0)).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = row.column("content")[0].as_buffer()
                size = data.size if data is not None else 0
                if max_input_bytes is not None and size > max_input_bytes:
                    found = (None,) * 10
                else:
                    found = header_row(lambda o, n, d=data: d[o : o + n].to_pybytes() if d is not None else b"", size)
                columns = [c for c, name in zip(row.columns, row.schema.names) if keep_content or name != "content"]
                names = [n for n in row.schema.names if keep_content or n != "content"]
                yield pa.RecordBatch.from_arrays(columns + header_columns([found]), names=names + NAMES)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if keep_content or f.name != "content")
    return images.mapInArrow(run, f"{fields}, {HEADER}")


def chunks(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, length, type) of each chunk up to the first IDAT, headers that fail left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cols = [], ([], [], [])
            for k, data in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = png.read_header(lambda o, n, d=data: d[o : o + n], len(data or b"")).chunks
                except ImageError:
                    continue
                for c in found:
                    keys.append(k)
                    for col, v in zip(cols, c):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[key, "pos", "length", "type"])

    return images.select(key, "content").mapInArrow(run, f"`{key}` {images.schema[key].dataType.simpleString()}, pos bigint, length bigint, type string")


def pattern(kind: str, width: int, height: int) -> np.ndarray:
    """A blank, gradient or noise test frame."""
    if kind == "blank":
        return np.broadcast_to(np.array([32, 96, 160, 255], np.uint8), (height, width, 4)).copy()
    if kind == "gradient":
        x = np.arange(width) * 255 // max(width - 1, 1) if width > 1 else np.zeros(1, int)
        y = np.arange(height) * 255 // max(height - 1, 1) if height > 1 else np.zeros(1, int)
        out = np.full((height, width, 4), 255, np.uint8)
        out[..., 0], out[..., 1] = x[None], y[:, None]
        out[..., 2] = (x[None] + y[:, None]) % 256 // 2
        return out
    if kind == "noise":
        out = np.full((height * width, 4), 255, np.uint8)
        state = 0x9E3779B9
        words = np.empty(height * width, np.uint32)
        for i in range(len(words)):
            state ^= state << 13 & 0xFFFFFFFF
            state ^= state >> 17
            state ^= state << 5 & 0xFFFFFFFF
            words[i] = state
        out[:, :3] = words.view(np.uint8).reshape(-1, 4)[:, :3]
        return out.reshape(height, width, 4)
    raise ValueError(f"no pattern {kind}")


def encode_interlaced(frame: np.ndarray) -> bytes:
    """An Adam7 RGBA PNG of a frame."""
    import struct
    import zlib

    from ..operators.rows import ADAM7

    z, out = zlib.compressobj(6), b""
    for _, x0, y0, dx, dy in ADAM7:
        part = frame[y0::dy, x0::dx]
        if part.size:
            rows = np.ascontiguousarray(part).reshape(len(part), -1)
            out += z.compress(png.filter_rows(rows, np.zeros(rows.shape[1], np.uint8), 4, "adaptive").tobytes())
    out += z.flush()
    head = struct.pack(">IIBBBBB", frame.shape[1], frame.shape[0], 8, 6, 0, 0, 1)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", out) + png.chunk(b"IEND", b"")


def encode_raw(samples: np.ndarray, depth: int, color: int, palette: bytes | None = None, trns: bytes | None = None) -> bytes:
    """A PNG of raw samples (height x width x channels) of any colour type and depth, its rows without filters."""
    import struct
    import zlib

    height, width = samples.shape[:2]
    if depth == 16:
        rows = samples.astype(">u2").reshape(height, -1).view(np.uint8)
    elif depth == 8:
        rows = samples.astype(np.uint8).reshape(height, -1)
    else:
        bits = (samples.reshape(height, -1, 1) >> np.arange(depth)[::-1]) & 1
        rows = np.packbits(bits.astype(np.uint8).reshape(height, -1), axis=1)
    data = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    out = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0))
    for kind, body in ((b"PLTE", palette), (b"tRNS", trns)):
        if body is not None:
            out += png.chunk(kind, body)
    return out + png.chunk(b"IDAT", zlib.compress(data)) + png.chunk(b"IEND", b"")


def corpus(spark: SparkSession, cases: list[tuple[str, int, int, str, bool]]) -> DataFrame:
    """(path, length, content) of generated images; cases are (name, width, height, pattern, interlaced)."""
    rows = spark.createDataFrame(cases, "name string, width int, height int, pattern string, interlaced boolean").repartition(max(1, len(cases)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                frame = pattern(r["pattern"], r["width"], r["height"])
                data = encode_interlaced(frame) if r["interlaced"] else png.encode(frame, PngOptions(compression="fast"))
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["path", "length", "content"])

    return rows.mapInArrow(run, "path string, length bigint, content binary")
