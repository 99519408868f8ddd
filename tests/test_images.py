"""Codecs, resampling and the thumbnail path: literal vectors, round trips, properties and hostile input."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom import api
from rasterloom.codecs import jpeg, png
from rasterloom.errors import ImageError
from rasterloom.operators import area, resample
from rasterloom.operators.rows import ADAM7
from rasterloom.operators.thumbnail import decode_rows, row_pixels
from rasterloom.options import JpegOptions, OptionError, PngOptions, ThumbnailOptions, from_dict, parse_color
from rasterloom.sources import images


def raw_png(width, height, depth, color, samples, interlaced=False, plte=None, trns=None, extra=b"", filters=None):
    """A PNG of raw samples (height x width x channels), row filters 0 unless given."""

    def packed(rows):
        out = []
        for i, r in enumerate(rows):
            if depth == 16:
                body = r.astype(">u2").tobytes()
            elif depth == 8:
                body = r.astype(np.uint8).tobytes()
            else:
                bits = ((r.reshape(-1, 1) >> np.arange(depth)[::-1]) & 1).astype(np.uint8).reshape(-1)
                body = np.packbits(bits).tobytes()
            out.append(body)
        if filters is None:
            return b"".join(b"\0" + b for b in out)
        bpp = max(1, png.CHANNELS[color] * depth // 8)
        rows = np.frombuffer(b"".join(out), np.uint8).reshape(len(out), -1)
        names = ("none", "sub", "up", "average", "paeth")
        done, above = [], np.zeros(rows.shape[1], np.uint8)
        for i, r in enumerate(rows):
            done.append(png.filter_rows(r[None], above, bpp, names[filters[i % len(filters)]]).tobytes())
            above = r
        return b"".join(done)

    if interlaced:
        data = b"".join(packed(samples[y0::dy, x0::dx]) for _, x0, y0, dx, dy in ADAM7 if samples[y0::dy, x0::dx].size)
    else:
        data = packed(samples)
    out = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, int(interlaced))) + extra
    if plte is not None:
        out += png.chunk(b"PLTE", plte)
    if trns is not None:
        out += png.chunk(b"tRNS", trns)
    return out + png.chunk(b"IDAT", zlib.compress(data)) + png.chunk(b"IEND", b"")


def px(*values):
    return np.array(values, np.uint8)


@pytest.mark.parametrize(
    "source, fit, ow, oh, expected",
    [
        ([[(0, 0, 0, 255), (100, 0, 0, 255)], [(0, 100, 0, 255), (100, 100, 100, 255)]], "contain", 1, 1, [[(50, 50, 25, 255)]]),
        ([[(0, 0, 0, 255), (60, 60, 60, 255), (120, 120, 120, 255)]], "contain", 2, 1, [[(20, 20, 20, 255), (100, 100, 100, 255)]]),
        ([[(255, 0, 0, 0), (0, 0, 255, 255)]], "contain", 1, 1, [[(0, 0, 255, 128)]]),
        ([[(255, 0, 0, 0), (0, 255, 0, 0)]], "contain", 1, 1, [[(0, 0, 0, 0)]]),
        ([[(10, 20, 30, 40)]], "contain", 3, 2, [[(10, 20, 30, 40)] * 3] * 2),
        ([[(v, 0, 0, 255) for v in (10, 20, 30, 40)]] * 2, "cover", 2, 2, [[(20, 0, 0, 255), (30, 0, 0, 255)]] * 2),
        ([[(v, 0, 0, 255)] * 2 for v in (10, 20, 30, 40)], "cover", 2, 2, [[(20, 0, 0, 255)] * 2, [(30, 0, 0, 255)] * 2]),
        ([[(v, 0, 0, 255) for v in (0, 40, 80, 120, 160)]] * 2, "cover", 2, 2, [[(60, 0, 0, 255), (100, 0, 0, 255)]] * 2),
    ],
)
def test_literal_vectors(spark, source, fit, ow, oh, expected):
    frame = np.array(source, np.uint8)
    assert (area.resample(frame, fit, ow, oh) == np.array(expected, np.uint8)).all()
    h, w = frame.shape[:2]
    rows = [(1, y, x, *map(int, frame[y, x]), w, h, fit, ow, oh) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long, width long, height long, fit string, out_width long, out_height long")
    for sums in (resample.cell_sums(df), resample.cell_sums_by_rows(df), resample.cell_sums(df, wide=True)):
        out = np.zeros((oh, ow, 4), int)
        for r in resample.pixel_of(sums).collect():
            out[r.oy, r.ox] = r.r, r.g, r.b, r.a
        assert (out == np.array(expected)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 64), st.integers(1, 32), st.integers(1, 32), st.sampled_from(["contain", "cover"]), st.integers(1, 9), st.integers(0, 2**31))
def test_ordered_equals_sparse_and_float(sw, sh, ow, oh, fit, band, seed):
    rng = np.random.default_rng(seed)
    frame = rng.integers(0, 256, (sh, sw, 4), dtype=np.uint8)
    a = area.resample(frame, fit, ow, oh, band)
    s = area.Sparse(fit, sw, sh, ow, oh)
    for y in rng.permutation(sh):
        s.push(np.array([y]), np.arange(sw), frame[y : y + 1])
    assert (a == s.close()).all()
    x, y = area.lines(fit, sw, sh, ow, oh)
    wx, wy = np.zeros((ow, sw)), np.zeros((oh, sh))
    i, o, w = x.overlaps(np.arange(sw))
    wx[o, i] = w
    i, o, w = y.overlaps(np.arange(sh))
    wy[o, i] = w
    p = frame.astype(float)
    alpha = wy @ p[..., 3] @ wx.T
    for c in range(3):
        color = wy @ (p[..., c] * p[..., 3]) @ wx.T
        assert np.abs(np.where(alpha > 0, color / np.maximum(alpha, 1e-9), 0) - a[..., c]).max() <= 1


def test_ordered_rejects_bad_rows():
    o = area.Ordered("contain", 4, 4, 2, 2)
    with pytest.raises(ImageError, match="UnexpectedRow"):
        o.push(1, np.zeros((1, 4, 4), np.uint8))
    with pytest.raises(ImageError, match="InvalidRowLength"):
        o.push(0, np.zeros((1, 3, 4), np.uint8))
    o.push(0, np.zeros((2, 4, 4), np.uint8))
    with pytest.raises(ImageError, match="IncompleteImage"):
        o.close()
    s = area.Sparse("contain", 4, 4, 2, 2)
    with pytest.raises(ImageError, match="InvalidPixelCoordinate"):
        s.push(np.array([4]), np.array([0]), np.zeros((1, 1, 4), np.uint8))
    with pytest.raises(ImageError, match="IncompleteSamples"):
        s.close()
    with pytest.raises(ImageError, match="IntegerOverflow"):
        area.lines("cover", 2**32 - 1, 2**32 - 1, 1, 2)


@pytest.mark.parametrize("color, depth", [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
@pytest.mark.parametrize("interlaced", [False, True])
def test_formats(color, depth, interlaced):
    rng = np.random.default_rng(color * 100 + depth)
    for w, h in ((1, 1), (2, 3), (5, 4), (9, 9), (11, 9)):
        top = (1 << depth) - 1
        s = rng.integers(0, top + 1, (h, w, png.CHANNELS[color]))
        plte = rng.integers(0, 256, 3 * (1 << depth), dtype=np.uint8).tobytes() if color == 3 else None
        trns = {0: struct.pack(">H", int(s[0, 0, 0])), 2: struct.pack(">3H", *map(int, s[0, 0])) if color == 2 else b"", 3: b"\0\x40"[: 1 << depth]}.get(color)
        frame = png.decode(raw_png(w, h, depth, color, s, interlaced, plte, trns, filters=(0, 1, 2, 3, 4)))
        scaled = (s * 255 + top // 2) // top
        if color == 3:
            table = np.concatenate([np.frombuffer(plte, np.uint8).reshape(-1, 3), np.full((1 << depth, 1), 255)], axis=1)
            table[: len(trns), 3] = list(trns)
            expected = table[s[..., 0]]
        else:
            rgb = np.repeat(scaled[..., :1], 3, axis=2) if color in (0, 4) else scaled[..., :3]
            alpha = scaled[..., -1:] if color in (4, 6) else np.where((s == s[0, 0]).all(axis=2, keepdims=True), 0, 255)
            expected = np.concatenate([rgb, alpha], axis=2)
        assert (frame == expected).all()


def test_transparency_compares_raw_samples():
    s = np.array([[[0x0100, 0x0200, 0x0300], [0x0101, 0x0200, 0x0300]]])
    frame = png.decode(raw_png(2, 1, 16, 2, s, trns=struct.pack(">3H", 0x0100, 0x0200, 0x0300)))
    assert (frame == px((1, 2, 3, 0), (1, 2, 3, 255))).all()
    gray = png.decode(raw_png(3, 1, 16, 0, np.array([[[0], [32768], [65535]]]), trns=struct.pack(">H", 32768)))
    assert gray[0, :, 0].tolist() == [0, 128, 255] and gray[0, :, 3].tolist() == [255, 0, 255]


@pytest.mark.parametrize("choice", ["none", "sub", "up", "average", "paeth", "adaptive", "min-entropy", "default"])
@pytest.mark.parametrize("color", ["rgba8", "rgb8", "grayscale-alpha8", "grayscale8"])
def test_png_round_trip(choice, color):
    x = np.random.default_rng(1).integers(0, 256, (33, 21, 4), dtype=np.uint8)
    x[5:20] = x[5]
    for compression in ("none", "fastest", "fast", "balanced", "high"):
        y = png.decode(png.encode(x, PngOptions(color=color, filter=choice, compression=compression)))
    k = png.convert(x, color)
    rgb = np.repeat(k[..., :1], 3, axis=2) if k.shape[2] < 3 else k[..., :3]
    alpha = k[..., -1:] if k.shape[2] in (2, 4) else np.full((33, 21, 1), 255)
    assert (y == np.concatenate([rgb, alpha], axis=2)).all()


def test_luma_and_composite():
    primary = np.array([[(255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (255, 255, 255, 255)]], np.uint8)
    assert png.convert(primary, "grayscale8")[0, :, 0].tolist() == [77, 149, 29, 255]


@pytest.mark.parametrize("subsampling", ["4:4:4", "4:2:2", "4:2:0"])
def test_jpeg_decodes_elsewhere(spark, tmp_path, subsampling):
    y, x = np.mgrid[:61, :77]
    frame = np.stack([x * 3, y * 4, np.full_like(x, 128), np.full_like(x, 255)], axis=2).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(frame, JpegOptions(quality=95, subsampling=subsampling)))
    im = spark.read.format("image").load(str(tmp_path)).first().image
    out = np.frombuffer(im.data, np.uint8).reshape(61, 77, 3)[..., ::-1].astype(int)
    assert np.abs(out - frame[..., :3]).mean() < 1.5 and np.abs(out - frame[..., :3]).max() <= 12


def test_jpeg_restart_markers():
    data = jpeg.encode(np.full((145, 17, 4), 200, np.uint8))
    found = [data[i + 1] for i in range(len(data) - 1) if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7]
    assert found == [0xD0 + i % 8 for i in range(9)]


def test_memory_constants(spark):
    from rasterloom.plans import admission

    cases = [(1000, 500, 100, 50, 4, "rgba", False, "buffered", 216_243), (2048, 2048, 2048, 2048, 4, "png", False, "buffered", 19_605_763), (2048, 2048, 512, 512, 4, "png", False, "buffered", 1_657_411), (2048, 2048, 512, 512, 4, "png", True, "buffered", 22_547_011), (2048, 2048, 512, 512, 4, "png", False, "chunks", 477_187), (2048, 2048, 512, 512, 4, "jpeg", False, "buffered", 5_922_307), (2048, 2048, 512, 512, 4, "jpeg", True, "buffered", 26_811_907)]
    for w, h, bw, bh, bpp, output, sparse, delivery, total in cases:
        image = spark.createDataFrame([(w, h, 1, bpp, sparse)], "width long, height long, encoded_bytes long, source_bpp long, interlaced boolean")
        assert admission.plan(admission.with_options(image, ThumbnailOptions(max_width=bw, max_height=bh, output=output, delivery=delivery))).first().total_bytes == total


def test_limits_equal_pass_and_order(spark):
    image = images.corpus(spark, [("a", 8, 6, "gradient", False)])
    size = image.first().length
    ok = {"max_input_bytes": size, "max_width": 8, "max_height": 6, "max_pixels": 48, "max_output_width": 8, "max_output_height": 6, "max_output_pixels": 48}
    assert api.thumbnail(image, {"limits": ok}).first().error_kind is None
    expected = {"max_input_bytes": "InputBytes", "max_width": "InputWidth", "max_height": "InputHeight", "max_pixels": "InputPixels", "max_output_width": "OutputWidth", "max_output_height": "OutputHeight", "max_output_pixels": "OutputPixels"}
    for name, kind in expected.items():
        r = api.thumbnail(image, {"limits": {**ok, name: ok[name] - 1}}).first()
        assert r.error_kind == f"LimitExceeded.{kind}" and r.actual == r.limit + 1
    # The byte limit comes even before limits that are no limits.
    assert api.thumbnail(image, {"limits": {"max_input_bytes": 0}}).first().error_kind == "LimitExceeded.InputBytes"
    assert api.thumbnail(image, {"limits": {"max_width": 0}}).first().error_kind == "InvalidLimit.max_width"
    assert api.thumbnail(image, {"limits": {"max_working_memory_bytes": 1}}).first().error_kind == "LimitExceeded.WorkingMemory"
    assert api.plan(image, {"limits": {"max_working_memory_bytes": 1}}).first().error_kind is None


def test_hostile_images_are_rows(spark):
    good = png.encode(images.pattern("gradient", 9, 7))
    gray = np.zeros((2, 2, 1), int)
    cases = {
        "empty": (b"", "TruncatedInput"), "null": (None, "TruncatedInput"), "signature": (good[:4], "TruncatedInput"), "text": (b"not a png at all", "DecodeFailure"), "half": (good[:40], "TruncatedInput"),
        "animated": (raw_png(2, 2, 8, 0, gray, extra=png.chunk(b"acTL", bytes(8))), "Unsupported.Animation"),
        "huge": (png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 50000, 50000, 8, 6, 0, 0, 0)) + png.chunk(b"IDAT", b""), "LimitExceeded.InputPixels"),
        "claim": (good[:33] + struct.pack(">I4s", 2**31 - 1, b"tEXt") + good[33:], "TruncatedInput"),
        "trns": (raw_png(2, 2, 8, 2, np.zeros((2, 2, 3), int), trns=bytes(5)), "DecodeFailure"), "range": (raw_png(2, 2, 1, 0, gray, trns=b"\0\2"), "DecodeFailure"),
        "index": (raw_png(2, 2, 8, 3, gray + 5, plte=bytes(9)), "DecodeFailure"), "colours": (raw_png(2, 2, 1, 3, gray, plte=bytes(9)), "DecodeFailure"), "alphas": (raw_png(2, 2, 1, 3, gray, plte=bytes(6), trns=bytes(3)), "DecodeFailure"),
        "depth": (raw_png(2, 2, 4, 2, np.zeros((2, 2, 3), int)), "Unsupported.BitDepth"), "rows": (raw_png(2, 3, 8, 0, gray), "DecodeFailure"), "good": (good, None),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "path string, content binary")
    found = {r.path: r.error_kind for r in api.thumbnail(df).collect()}
    assert found == {k: e for k, (_, e) in cases.items()}
    with pytest.raises(Exception, match="TruncatedInput"):
        api.thumbnail(df.where("path = 'half'"), mode="failfast").collect()


def test_mutations_never_fail_a_job(spark):
    rng = np.random.default_rng(5)
    seeds = [png.encode(images.pattern("noise", 13, 11)), images.encode_interlaced(images.pattern("gradient", 13, 11))]
    rows = []
    for i in range(150):
        data = bytearray(seeds[i % 2])
        for _ in range(rng.integers(1, 6)):
            data[rng.integers(0, len(data))] = rng.integers(0, 256)
        rows.append((str(i), bytes(data[: rng.integers(1, len(data) + 1)])))
    df = spark.createDataFrame(rows, "path string, content binary")
    done = api.thumbnail(df, {"limits": {"max_width": 4096, "max_height": 4096, "max_pixels": 1 << 20, "max_working_memory_bytes": 8 << 20}}).collect()
    assert len(done) == 150 and all((r.bytes is None) == (r.error_kind is not None) for r in done)


def test_chunks_join_to_the_bytes(spark):
    done = api.thumbnail(images.corpus(spark, [("n", 200, 150, "noise", False)]))
    whole = done.first().bytes
    pieces = api.chunks(done).orderBy("chunk_idx").collect()
    assert b"".join(p.bytes for p in pieces) == whole and {len(p.bytes) for p in pieces[:-1]} <= {65536}


def test_interlaced_equals_plain(spark):
    both = images.corpus(spark, [("a", 57, 29, "gradient", False), ("b", 57, 29, "gradient", True)])
    a, b = (bytes(r.bytes) for r in api.thumbnail(both, {"max_width": 13, "output": "rgba"}).orderBy("path").collect())
    assert a == b
    assert {(r.path, r.error_kind) for r in decode_rows(both).select("path", "error_kind").distinct().collect()} == {("a", None), ("b", "Unsupported.Interlacing")}


def test_row_pixels_match_rows(spark):
    df = images.corpus(spark, [("n", 16, 9, "noise", False)])
    frame = images.pattern("noise", 16, 9)
    for r in row_pixels(decode_rows(df)).collect():
        assert (r.r, r.g, r.b, r.a) == tuple(frame[r.y, r.x])


def test_options():
    assert parse_color("#0a141e") == (10, 20, 30)
    assert from_dict({"max_width": 5.0, "jpeg": {"background": [1, 2, 3]}, "output": "jpeg"}).jpeg.background == (1, 2, 3)
    for bad in ({"fit": "stretch"}, {"max_width": 1.5}, {"nope": 1}, {"output": "jpeg", "png": {}}, {"output": "jpeg", "jpeg": {"quality": 0}}, {"jpeg": {"quality": 5}}, {"output": "rgba", "delivery": "chunks"}, {"output": "jpeg", "jpeg": {"background": "red"}}):
        with pytest.raises(OptionError):
            from_dict(bad)


def test_cap_is_enforced():
    with pytest.raises(ImageError, match="EncodedOutputLimitExceeded"):
        e = png.Encoder(64, 64, PngOptions(compression="none"), "rgba8", cap=100)
        e.push(images.pattern("noise", 64, 64))
        e.finish()


def test_header_source_and_staged_sink(spark, tmp_path):
    from rasterloom.sources.ranges import HeaderSource
    from rasterloom.sources.staged import StagedSink

    spark.dataSource.register(HeaderSource)
    spark.dataSource.register(StagedSink)
    for name, size in (("a.png", 20), ("b.png", 30)):
        (tmp_path / name).write_bytes(png.encode(images.pattern("gradient", size, 5)))
    (tmp_path / "c.png").write_bytes(b"x")
    found = spark.read.format("png_headers").option("paths", json.dumps([str(p) for p in sorted(tmp_path.iterdir())])).load()
    assert [(r.width, r.header_error) for r in found.orderBy("path").collect()] == [(20, None), (30, None), (None, "TruncatedInput")]
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.png").write_bytes(b"old")
    rows = spark.createDataFrame([("old.png", b"new"), ("two.png", b"2")], "name string, bytes binary")
    write = lambda df, **o: df.write.format("staged_files").option("path", str(out)).options(**o).mode("append").save()
    with pytest.raises(Exception):
        write(rows.union(spark.createDataFrame([("../evil", b"")], rows.schema)))
    with pytest.raises(Exception):
        write(rows, overwrite="false")
    with pytest.raises(Exception):
        write(rows, cap="2")
    assert sorted(os.listdir(out)) == ["old.png"] and (out / "old.png").read_bytes() == b"old"
    write(rows)
    assert sorted(os.listdir(out)) == ["old.png", "two.png"] and (out / "old.png").read_bytes() == b"new"


def test_file_scan_pushes_the_size_down(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "b.png").write_bytes(b"12345")
    df = images.scan(spark, str(tmp_path), max_bytes=3)
    assert [r.length for r in df.collect()] == [3]
    assert "LessThanOrEqual(length,3)" in df._jdf.queryExecution().executedPlan().toString()


def test_file_stream(spark, tmp_path):
    from rasterloom.streaming.files import image_stream, thumbnail_stream

    (tmp_path / "a.png").write_bytes(png.encode(images.pattern("gradient", 40, 30)))
    (tmp_path / "b.png").write_bytes(b"broken")
    q = thumbnail_stream(image_stream(spark, str(tmp_path)), ThumbnailOptions(max_width=10)).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.out_width, r.error_kind) for r in spark.table("files").where("error_kind IS NULL").collect()) == [(10, None)]
    assert spark.table("files").where("error_kind = 'TruncatedInput'").count() == 1


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert api.thumbnail(none).count() == 0 and api.inspect(none).count() == 0
