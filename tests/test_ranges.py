"""Images read by ranges, sinks that rows are given to, encoding within a write, and the decoder's allowance."""

import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import raw_png

from rasterloom import api
from rasterloom.codecs import jpeg, png
from rasterloom.errors import ImageError
from rasterloom.operators import thumbnail
from rasterloom.options import ThumbnailOptions
from rasterloom.sources import images, ranges

FIELDS = ["out_width", "out_height", "total_bytes", "error_kind", "actual", "limit", "width", "color_type", "auto_color", "header_error"]


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    made = {
        "noise": png.encode(images.pattern("noise", 120, 90)), "interlaced": images.encode_interlaced(images.pattern("gradient", 57, 29)), "broken": b"no image", "short": png.encode(images.pattern("blank", 9, 9))[:50],
        "wide": raw_png(300, 2, 16, 6, rng.integers(0, 65536, (2, 300, 4))), "palette": raw_png(5, 4, 2, 3, rng.integers(0, 3, (4, 5, 1)), plte=bytes(range(9)), trns=b"\x05"), "gray": raw_png(7, 3, 1, 0, rng.integers(0, 2, (3, 7, 1))),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    return str(tmp_path)


def test_plans_and_thumbnails_by_path_equal_those_of_contents(spark, folder):
    by_path, whole = ranges.files(spark, folder), images.scan(spark, folder)
    assert "content" not in by_path.columns and by_path.count() == 7
    for options in ({"max_width": 20}, {"limits": {"max_width": 100}}, {"limits": {"max_input_bytes": 200}}, {"output": "jpeg", "limits": {"max_working_memory_bytes": 700_000}}):
        a, b = (sorted(map(str, api.plan(df, options, enforce=True).select("path", *FIELDS).collect())) for df in (by_path, whole))
        assert len(a) == 7 and (a == b or "max_input_bytes" in str(options))
        a, b = ({r.path: (r.bytes, r.error_kind, r.actual, r.limit) for r in api.thumbnail(df, options).collect()} for df in (by_path, whole))
        assert a == b and len(a) == 7
    missing = spark.createDataFrame([(f"{folder}/none.png",)], "path string")
    assert api.thumbnail(missing).first().error_kind == "InputIo"


def test_headers_read_heads_only(tmp_path):
    big = raw_png(2000, 2000, 8, 2, np.random.default_rng(1).integers(0, 256, (2000, 2000, 3)), extra=png.chunk(b"tEXt", bytes(100_000)))
    read = []

    def read_at(offset, length):
        read.append(length)
        return big[offset : offset + length]

    assert images.header_row(read_at, len(big))[:3] == (2000, 2000, "rgb")
    assert sum(read) < 100
    # A decode by ranges holds pieces, and gives what a decode of the bytes gives.
    small = raw_png(64, 2000, 8, 2, np.random.default_rng(1).integers(0, 256, (2000, 64, 3)))
    read.clear()
    asked = png.ReadAt_(lambda o, n: (read.append(n), small[o : o + n])[1], len(small))
    o = ThumbnailOptions(max_width=16, output="rgba")
    assert thumbnail.render(asked, 16, 500, o) == thumbnail.render(small, 16, 500, o)
    assert max(read) <= png.PIECE < len(small)
    with pytest.raises(ImageError, match="TruncatedInput"):
        thumbnail.render(png.ReadAt_(lambda o, n: small[o : o + n][:-1], len(small)), 16, 500, o)


def test_chunks_of_image_data_may_be_cut_anywhere():
    frame = images.pattern("noise", 40, 30)
    whole = png.encode(frame)
    h = png.read_header(lambda o, n: whole[o : o + n], len(whole))
    body = b"".join(whole[p + 8 : p + 8 + n] for p, n, k in _chunks(whole) if k == b"IDAT")
    head = whole[: h.first_idat]
    for cuts in ([1, 2, 3], [0, 0, 5], list(range(0, len(body), 7))):
        parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]
        data = head + b"".join(png.chunk(b"IDAT", p) for p in parts) + png.chunk(b"IEND", b"")
        assert (png.decode(data) == frame).all()
    bad = bytearray(head + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b""))
    bad[len(head) + 8 + len(body)] ^= 1
    with pytest.raises(ImageError, match="checksum of IDAT"):
        png.decode(bytes(bad))


def _chunks(data):
    at = 8
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        yield at, n, kind
        at += 12 + n


def test_decoder_allowance(spark):
    limit = 3 * (4 * 4 + 1) + 163_840
    make = lambda n: raw_png(4, 2, 8, 6, np.zeros((2, 4, 4), int), extra=png.chunk(b"tEXt", bytes(n)))
    df = spark.createDataFrame([("fits", make(limit)), ("over", make(limit + 1))], "path string, content binary")
    got = {r.path: (r.error_kind, r.limit) for r in api.thumbnail(df).collect()}
    assert got == {"fits": (None, None), "over": ("DecoderMemoryLimitExceeded", limit)}


def test_encoders_write_into_a_callers_file():
    frame = images.pattern("gradient", 70, 50)
    data = png.encode(frame)
    for output in ("png", "jpeg", "rgba"):
        o = ThumbnailOptions(max_width=35, output=output)
        into = io.BytesIO()
        assert thumbnail.render(data, 35, 25, o, into=into) == b"" and into.getvalue() == thumbnail.render(data, 35, 25, o)
    into = io.BytesIO()
    with pytest.raises(ImageError, match="EncodedOutputLimitExceeded"):
        thumbnail.render(data, 35, 25, ThumbnailOptions(), cap=100, into=into)
    assert len(into.getvalue()) <= 100
    into = io.BytesIO()
    with pytest.raises(ImageError):
        thumbnail.render(data[:200], 35, 25, ThumbnailOptions(), into=into)
    assert into.getvalue() == b""


def test_thumbnails_are_encoded_within_the_write(spark, folder, tmp_path):
    o = ThumbnailOptions(max_width=20)
    good = "path NOT LIKE '%broken%' AND path NOT LIKE '%short%'"
    name = F.element_at(F.split("path", "/"), -1)
    want = {os.path.basename(r.path): bytes(r.bytes) for r in api.thumbnail(images.scan(spark, folder), o).where("bytes IS NOT NULL").collect()}
    for source in (ranges.files(spark, folder), images.scan(spark, folder)):
        out = tmp_path / f"out-{len(source.columns)}"
        thumbnail.write(source.where(good), name, o, str(out))
        assert {f: (out / f).read_bytes() for f in os.listdir(out)} == want
        with pytest.raises(Exception, match="overwrite"):
            thumbnail.write(source.where(good), name, o, str(out), overwrite=False)
        before = sorted(os.listdir(out))
        with pytest.raises(Exception, match="DecodeFailure|TruncatedInput"):
            thumbnail.write(source, name, o, f"file://{out}")
        assert sorted(os.listdir(out)) == before


def test_rows_are_given_to_a_sink(spark):
    class Sums:
        """A sink of one's own: the sum of the samples of each band."""

        def __init__(self, fail=False):
            self.total, self.fail = 0, fail

        def push(self, rgba):
            if self.fail:
                raise ZeroDivisionError("a sink's own error")
            self.total += int(rgba.astype("int64").sum())

        def finish(self):
            return str(self.total).encode()

    df = images.corpus(spark, [("a", 60, 40, "gradient", False), ("b", 60, 40, "noise", True)])
    raw = {r.path: bytes(r.bytes) for r in api.thumbnail(df, {"max_width": 30, "output": "rgba"}).collect()}
    done = thumbnail.thumbnails(df, ThumbnailOptions(max_width=30), sink=lambda h, w, height: Sums())
    assert {r.path: int(r.bytes) for r in done.collect()} == {k: int(np.frombuffer(v, np.uint8).astype(int).sum()) for k, v in raw.items()}
    with pytest.raises(Exception, match="a sink's own error"):
        thumbnail.thumbnails(df, ThumbnailOptions(max_width=30), sink=lambda h, w, height: Sums(fail=True)).collect()


@pytest.mark.parametrize("subsampling", ["4:4:4", "4:2:0"])
def test_jpeg_symbols_of_both_tables_decode_elsewhere(spark, tmp_path, subsampling):
    frame = images.pattern("noise", 96, 64)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(frame, jpeg.JpegOptions(quality=98, subsampling=subsampling)))
    im = spark.read.format("image").load(str(tmp_path)).first().image
    out = np.frombuffer(im.data, np.uint8).reshape(64, 96, 3)[..., ::-1].astype(int)
    luma = np.array([0.299, 0.587, 0.114])
    assert np.abs((out - frame[..., :3]) @ luma).mean() < (2 if subsampling == "4:4:4" else 12)
    assert zlib.crc32(im.data) is not None
