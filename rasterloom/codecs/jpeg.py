"""Baseline JPEG encoding in numpy, one restart interval for each row of MCUs.

The quantisation and Huffman tables are those that the JPEG standard prints in its annex K.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np

from ..errors import ImageError
from ..options import JpegOptions
from .png import Output

# Fixed values of the JPEG standard: luminance and chrominance quantisation at quality 50, row-major.
_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
# Codes of each length, for DC. The symbols are 0 to 11 in order.
_DC_LENGTHS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))


def zigzag() -> np.ndarray:
    """Row-major places in zigzag order."""
    places = sorted(((y + x, x if (y + x) % 2 == 0 else y, y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([p for _, _, p in places])


# The AC tables of the JPEG standard (Annex K.3), numbers of codes of each length and symbols in order of code, of luma and of chroma.
_AC_LENGTHS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
_AC_LUMA = bytes.fromhex(
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 "
    "17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 "
    "6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 "
    "b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 "
    "f9 fa"
)
_AC_CHROMA = bytes.fromhex(
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 "
    "e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 "
    "69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 "
    "b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 "
    "f9 fa"
)


def _codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    code, at = 0, 0
    value, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            value[symbols[at]], size[symbols[at]] = code, bits
            code += 1
            at += 1
        code <<= 1
    return value, size


def tables(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (_LUMA, _CHROMA)]


def _dct() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None]
    m = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


ZIGZAG, _DCT = zigzag(), _dct()
_AC = tuple(zip(_AC_LENGTHS, (tuple(_AC_LUMA), tuple(_AC_CHROMA))))
_DC = tuple((lengths, tuple(range(12))) for lengths in _DC_LENGTHS)
_AC_CODE, _DC_CODE = [np.stack(t) for t in zip(*(_codes(*t) for t in _AC))], [_codes(*t) for t in _DC]


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients (rows of blocks x blocks x 64, zigzag) of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    b = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128.0
    c = _DCT @ b @ _DCT.T
    return np.rint(c.reshape(h // 8, w // 8, 64) / table).astype(np.int64)[:, :, ZIGZAG]


def _size(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _entropy(coefficients: np.ndarray, component: np.ndarray) -> bytes:
    """The bits of one restart interval: blocks (n x 64) in order, each of a component 0, 1 or 2."""
    n = len(coefficients)
    dc = coefficients[:, 0].copy()
    for c in range(3):
        own = np.flatnonzero(component == c)
        dc[own[1:]] -= coefficients[own[:-1], 0]
    size = _size(dc)
    chroma = (component > 0).astype(np.int64)
    code = np.where(chroma, _DC_CODE[1][0][size], _DC_CODE[0][0][size])
    bits = np.where(chroma, _DC_CODE[1][1][size], _DC_CODE[0][1][size])
    extra = np.where(dc < 0, dc + (1 << size) - 1, dc)
    order = [np.arange(n) * 256]
    values, lengths = [(code << size) | extra], [bits + size]
    block, place = np.nonzero(coefficients[:, 1:])
    if len(block):
        v = coefficients[block, place + 1]
        before = np.where(np.append(True, block[1:] != block[:-1]), -1, np.append(-1, place[:-1]))
        run = place - before - 1
        zrl = run >> 4
        s = _size(v)
        symbol = ((run & 15) << 4) | s
        e = np.where(v < 0, v + (1 << s) - 1, v)
        order.append(block * 256 + 4 * (place + 1) - 0)
        values.append((_AC_CODE[0][chroma[block], symbol] << s) | e)
        lengths.append(_AC_CODE[1][chroma[block], symbol] + s)
        long = np.flatnonzero(zrl)
        if len(long):
            each = np.repeat(long, zrl[long])
            nth = np.arange(len(each)) - np.repeat(np.cumsum(zrl[long]) - zrl[long], zrl[long])
            order.append(block[each] * 256 + 4 * (place[each] + 1) - 3 + nth)
            values.append(_AC_CODE[0][chroma[block[each]], 0xF0])
            lengths.append(_AC_CODE[1][chroma[block[each]], 0xF0])
    ends = np.flatnonzero(coefficients[:, 63] == 0)
    order.append(ends * 256 + 255)
    values.append(_AC_CODE[0][chroma[ends], 0])
    lengths.append(_AC_CODE[1][chroma[ends], 0])
    by = np.argsort(np.concatenate(order), kind="stable")
    value, length = np.concatenate(values)[by], np.concatenate(lengths)[by]
    owner = np.repeat(np.arange(len(value)), length)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    stream = ((value[owner] >> (length[owner] - 1 - nth)) & 1).astype(np.uint8)
    stream = np.append(stream, np.ones(-len(stream) % 8, np.uint8))
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")


class Encoder:
    """Push bands of RGBA rows top to bottom, then finish. At most two rows of MCUs wait inside. The bytes go to a caller's open file as they are made, or are kept."""

    def __init__(self, width: int, height: int, options: JpegOptions, cap: int | None = None, into: BinaryIO | None = None) -> None:
        if width > 65535 or height > 65535:
            raise ImageError("InvalidJpegOptions", "a side is over 65535")
        self.width, self.height, self.options = width, height, options
        self.hx, self.vy = {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2)}[options.subsampling]
        self.mcu_w, self.mcu_h = 8 * self.hx, 8 * self.vy
        self.mcus = -(-width // self.mcu_w)
        self.tables = tables(options.quality)
        self.waiting = np.zeros((0, width, 3), np.uint8)
        self.rows = self.segment = 0
        self.out = Output(cap, into)
        self._put(self._head())

    def _put(self, data: bytes) -> None:
        self.out.put(data)

    def _head(self) -> bytes:
        part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
        out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        for i, t in enumerate(self.tables):
            out += part(0xDB, bytes([i]) + bytes(t[ZIGZAG].astype(np.uint8)))
        sampling = self.hx << 4 | self.vy
        out += part(0xC0, struct.pack(">BHHB", 8, self.height, self.width, 3) + bytes([1, sampling, 0, 2, 0x11, 1, 3, 0x11, 1]))
        for i, (lengths, symbols) in enumerate(_DC):
            out += part(0xC4, bytes([i, *lengths, *symbols]))
        for i in (0, 1):
            out += part(0xC4, bytes([0x10 | i, *_AC[i][0], *_AC[i][1]]))
        out += part(0xDD, struct.pack(">H", self.mcus))
        return out + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))

    def push(self, rgba: np.ndarray) -> None:
        p = rgba.astype(np.int64)
        a = p[..., 3:]
        rgb = ((p[..., :3] * a + np.array(self.options.background) * (255 - a) + 127) // 255).astype(np.uint8)
        self.rows += len(rgb)
        self.waiting = np.concatenate([self.waiting, rgb])
        while len(self.waiting) >= self.mcu_h:
            self._row(self.waiting[: self.mcu_h])
            self.waiting = self.waiting[self.mcu_h :]

    def _row(self, rgb: np.ndarray) -> None:
        rgb = np.pad(rgb, ((0, self.mcu_h - len(rgb)), (0, self.mcus * self.mcu_w - self.width), (0, 0)), mode="edge").astype(np.float64)
        r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b]
        for i in (1, 2):
            h, w = planes[i].shape
            planes[i] = planes[i].reshape(h // self.vy, self.vy, w // self.hx, self.hx).mean(axis=(1, 3))
        luma = _blocks(planes[0], self.tables[0]).reshape(self.vy, self.mcus, self.hx, 64).transpose(1, 0, 2, 3).reshape(self.mcus, -1, 64)
        parts = [luma] + [_blocks(p, self.tables[1]).reshape(self.mcus, 1, 64) for p in planes[1:]]
        component = np.tile([0] * (self.vy * self.hx) + [1, 2], self.mcus)
        data = _entropy(np.concatenate(parts, axis=1).reshape(-1, 64), component)
        if self.segment:
            data = bytes([0xFF, 0xD0 + (self.segment - 1) % 8]) + data
        self.segment += 1
        self._put(data)

    def finish(self) -> bytes:
        if self.rows != self.height:
            raise ImageError("IncompleteImage", actual=self.rows, limit=self.height)
        if len(self.waiting):
            self._row(self.waiting)
        self._put(b"\xff\xd9")
        return bytes(self.out.kept)


def encode(rgba: np.ndarray, options: JpegOptions = JpegOptions()) -> bytes:
    e = Encoder(rgba.shape[1], rgba.shape[0], options)
    e.push(rgba)
    return e.finish()
