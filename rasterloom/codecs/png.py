"""PNG in numpy: headers, bounded decoding to RGBA rows in bands, and encoding.

Average and Paeth rows depend on the pixel to the left; a band of rows is decoded along its anti-diagonals, on which all pixels are
independent, instead of byte by byte.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from ..errors import ImageError
from ..functions.memory import DECODER_STAGING
from ..operators.rows import ADAM7
from ..options import PNG_COMPRESSION, PngOptions

SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOR_NAMES = {0: "grayscale", 2: "rgb", 3: "indexed", 4: "grayscale-alpha", 6: "rgba"}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
ANIMATION = (b"acTL", b"fcTL", b"fdAT")
BAND = 128
#: Bytes of an IDAT chunk read at a time.
PIECE = 1 << 18

ReadAt = Callable[[int, int], bytes]


@dataclass
class Header:
    width: int
    height: int
    depth: int
    color: int
    interlaced: bool
    raw_trns_length: int | None = None
    palette: bytes | None = None
    trns: bytes | None = None
    first_idat: int = 0
    chunks: list[tuple[int, int, str]] = field(default_factory=list)

    @property
    def bits_per_pixel(self) -> int:
        return CHANNELS[self.color] * self.depth

    @property
    def planning_bpp(self) -> int:
        return 1 if self.color == 3 or (self.color == 0 and self.depth < 8) else CHANNELS[self.color] * self.depth // 8


def read_header(read_at: ReadAt, size: int, content: bool = True) -> Header:
    """Walks the chunks up to the first IDAT, reading eight bytes of each and the contents of IHDR, PLTE and tRNS only.

    read_at(offset, length) returns exactly length bytes. Every chunk, the first IDAT included, must end within size.
    """

    def exact(offset: int, length: int) -> bytes:
        data = read_at(offset, length)
        if len(data) != length:
            raise ImageError("TruncatedInput")
        return data

    if size < 8:
        raise ImageError("TruncatedInput")
    if exact(0, 8) != SIGNATURE:
        raise ImageError("DecodeFailure", "invalid PNG signature")
    at, header, animated, trns_length = 8, None, False, None
    chunks: list[tuple[int, int, str]] = []
    palette = trns = None
    while True:
        if at + 12 > size:
            raise ImageError("TruncatedInput")
        length, kind = struct.unpack(">I4s", exact(at, 8))
        if at + 12 + length > size:
            raise ImageError("TruncatedInput")
        chunks.append((at, length, kind.decode("latin-1")))
        animated |= kind in ANIMATION
        if kind == b"tRNS":
            trns_length = length
        if kind == b"IDAT":
            break
        if header is None:
            if kind != b"IHDR" or length != 13:
                header = False
            else:
                body = exact(at + 8, 17)
                if zlib.crc32(b"IHDR" + body[:13]) != struct.unpack(">I", body[13:])[0]:
                    header = False
                else:
                    header = struct.unpack(">IIBBBBB", body[:13])
        if content and kind in (b"PLTE", b"tRNS") and length <= 768:
            body = exact(at + 8, length)
            if zlib.crc32(kind + body) != struct.unpack(">I", exact(at + 8 + length, 4))[0]:
                raise ImageError("DecodeFailure", f"checksum of {kind.decode()}")
            if kind == b"PLTE":
                palette = body
            else:
                trns = body
        elif content and kind == b"PLTE":
            raise ImageError("DecodeFailure", "palette of more than 256 entries")
        at += 12 + length
    if animated:
        raise ImageError("Unsupported.Animation")
    if not header:
        raise ImageError("DecodeFailure", "no valid IHDR")
    width, height, depth, color, compression, method, interlace = header
    if width == 0 or height == 0:
        raise ImageError("ZeroDimension.width" if width == 0 else "ZeroDimension.height")
    if max(width, height) >= 1 << 31 or compression or method or interlace > 1 or color not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ImageError("DecodeFailure", "invalid IHDR")
    if depth not in DEPTHS[color]:
        raise ImageError("Unsupported.BitDepth")
    if color in (0, 2) and trns_length is not None and trns_length != (2 if color == 0 else 6):
        raise ImageError("DecodeFailure", f"tRNS of {trns_length} bytes")
    return Header(width, height, depth, color, interlace == 1, trns_length, palette, trns, chunks[-1][0], chunks)


def check_allowance(h: Header) -> None:
    """A chunk before the image data may take no more than the plan's decoder memory: three rows and the staging buffer."""
    limit = 3 * (h.width * h.planning_bpp + 1) + DECODER_STAGING
    if any(length > limit for _, length, kind in h.chunks if kind != "IDAT"):
        raise ImageError("DecoderMemoryLimitExceeded", limit=limit)


def auto_color(h: Header) -> str:
    """The smallest lossless output colour that metadata allows."""
    if h.color == 0:
        return "grayscale8" if h.trns is None else "grayscale-alpha8"
    if h.color == 4:
        return "grayscale-alpha8"
    if h.color == 2:
        return "rgb8" if h.trns is None else "rgba8"
    if h.color == 6:
        return "rgba8"
    p = np.frombuffer(h.palette or b"", np.uint8)
    gray = len(p) > 0 and len(p) % 3 == 0 and bool((p.reshape(-1, 3) == p.reshape(-1, 3)[:, :1]).all())
    clear = any(a != 255 for a in h.trns or b"")
    return ("grayscale-alpha8" if clear else "grayscale8") if gray else ("rgba8" if clear else "rgb8")


class ReadAt_:
    """A file that is only read where it is asked for: what read_at(offset, length) gives, as slices. Short reads are errors."""

    def __init__(self, read_at: ReadAt, size: int) -> None:
        self.read_at, self.size = read_at, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        start, stop, _ = at.indices(self.size)
        data = self.read_at(start, stop - start)
        if len(data) != stop - start:
            raise ImageError("TruncatedInput")
        return data


class Inflater:
    """Inflates consecutive IDAT chunks, reading pieces of them and never holding more than asked for: a bomb costs what its image's rows cost."""

    def __init__(self, data: bytes | ReadAt_, first_idat: int) -> None:
        self.data, self.at = data, first_idat
        self.left, self.crc = 0, 0  # of the open chunk
        self.z = zlib.decompressobj()
        self.pending = b""

    def _next(self) -> bool:
        if not self.left:
            if self.at + 12 > len(self.data):
                raise ImageError("TruncatedInput")
            length, kind = struct.unpack(">I4s", self.data[self.at : self.at + 8])
            if kind != b"IDAT":
                return False
            if self.at + 12 + length > len(self.data):
                raise ImageError("TruncatedInput")
            self.at, self.left, self.crc = self.at + 8, length, zlib.crc32(b"IDAT")
        body = self.data[self.at : self.at + min(self.left, PIECE)]
        self.at, self.left, self.crc = self.at + len(body), self.left - len(body), zlib.crc32(body, self.crc)
        if not self.left:
            if self.crc != struct.unpack(">I", self.data[self.at : self.at + 4])[0]:
                raise ImageError("DecodeFailure", "checksum of IDAT")
            self.at += 4
        self.pending = body
        return True

    def take(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            source = self.z.unconsumed_tail or self.pending
            if not source:
                if self.z.eof or not self._next():
                    raise ImageError("TruncatedInput" if not self.z.eof else "DecodeFailure", "too few rows")
                continue
            self.pending = b""
            try:
                got = self.z.decompress(source, n - len(out))
            except zlib.error as e:
                raise ImageError("DecodeFailure", str(e)) from None
            out += got
            if not got and self.z.eof:
                raise ImageError("DecodeFailure", "too few rows")
        return bytes(out)


def _unfilter(raw: np.ndarray, filters: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Rows (n x bytes) of one band, given the row above it."""
    if filters.max(initial=0) > 4:
        raise ImageError("DecodeFailure", "unknown row filter")
    n, size = raw.shape
    if not np.isin(filters, (3, 4)).any():
        out = np.empty_like(raw)
        for i in range(n):
            if filters[i] == 1:
                row = np.zeros(-(-size // bpp) * bpp, np.uint8)
                row[:size] = raw[i]
                out[i] = np.add.accumulate(row.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)[:size]
            elif filters[i] == 2:
                out[i] = raw[i] + above
            else:
                out[i] = raw[i]
            above = out[i]
        return out
    width = -(-size // bpp)
    padded = np.zeros((n, width * bpp), np.int16)
    padded[:, :size] = raw
    # Row q of the band (0 is the row above) holds pixel k - q on diagonal k.
    grid = np.zeros((width + n + 1, n + 1, bpp), np.int16)
    first = np.zeros(width * bpp, np.int16)
    first[:size] = above
    grid[np.arange(width), 0] = first.reshape(width, bpp)
    source = np.zeros((width + n + 1, n + 1, bpp), np.int16)
    q = np.arange(1, n + 1)
    source[np.arange(width)[None, :] + q[:, None], q[:, None]] = padded.reshape(n, width, bpp)
    kind = np.append(0, filters)[:, None]
    sub, up, avg, paeth = (kind == k for k in (1, 2, 3, 4))
    only = filters[0] if (filters == filters[0]).all() else 0
    has_sub, has_up, has_avg, has_paeth = (bool(m.any()) for m in (sub, up, avg, paeth))
    for k in range(1, width + n):
        lo, hi = max(1, k - width + 1), min(n, k) + 1
        # What lies left of a row's first pixel is on a place of the grid that stays 0.
        left, over = grid[k - 1, lo:hi], grid[k - 1, lo - 1 : hi - 1]
        if has_paeth:
            corner = grid[k - 2, lo - 1 : hi - 1] if k > 1 else np.zeros_like(over)
            da, db = over - corner, left - corner
            pa, pb, pc = np.abs(da), np.abs(db), np.abs(da + db)
            add = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, over, corner))
        if only == 0:
            s = slice(lo, hi)
            add = np.where(paeth[s], add, 0) if has_paeth else np.zeros_like(left)
            if has_avg:
                add = np.where(avg[s], (left + over) >> 1, add)
            if has_up:
                add = np.where(up[s], over, add)
            if has_sub:
                add = np.where(sub[s], left, add)
        elif only == 3:
            add = (left + over) >> 1
        np.bitwise_and(source[k, lo:hi] + add, 255, out=grid[k, lo:hi])
    out = grid[np.arange(width)[None, :] + q[:, None], q[:, None]].reshape(n, width * bpp)
    return out[:, :size].astype(np.uint8)


class Normalizer:
    """Raw rows of a format to RGBA rows."""

    def __init__(self, h: Header) -> None:
        self.h = h
        self.key: np.ndarray | None = None
        self.table: np.ndarray | None = None
        trns = h.trns
        if h.color == 0 and trns is not None:
            value = struct.unpack(">H", trns)[0]
            if h.depth < 16 and value >= 1 << h.depth:
                raise ImageError("DecodeFailure", "tRNS sample out of range")
            self.key = np.array([value])
        elif h.color == 2 and trns is not None:
            self.key = np.array(struct.unpack(">3H", trns))
            if h.depth == 8 and (self.key > 255).any():
                raise ImageError("DecodeFailure", "tRNS sample out of range")
        elif h.color == 3:
            if h.palette is None:
                raise ImageError("DecodeFailure", "no palette")
            n = len(h.palette) // 3
            if not n or len(h.palette) % 3 or n > 1 << h.depth or len(trns or b"") > n:
                raise ImageError("DecodeFailure", "invalid palette")
            self.table = np.full((n, 4), 255, np.uint8)
            self.table[:, :3] = np.frombuffer(h.palette, np.uint8).reshape(n, 3)
            self.table[: len(trns or b""), 3] = np.frombuffer(trns or b"", np.uint8)

    def __call__(self, rows: np.ndarray, width: int) -> np.ndarray:
        """n x bytes to n x width x 4."""
        h, n = self.h, len(rows)
        if h.depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : width * h.depth].reshape(n, width, h.depth)
            s = (bits * (1 << np.arange(h.depth)[::-1])).sum(axis=2, dtype=np.int64)[:, :, None]
        elif h.depth == 16:
            s = rows.reshape(n, -1).view(">u2").astype(np.int64).reshape(n, width, -1)
        else:
            s = rows.reshape(n, width, -1)
        if self.table is not None:
            if s.max(initial=0) >= len(self.table):
                raise ImageError("DecodeFailure", "palette index out of range")
            return self.table[s[:, :, 0]]
        if h.depth == 8 and h.color == 6:
            return rows.reshape(n, width, 4)
        top = (1 << h.depth) - 1
        out = np.empty((n, width, 4), np.uint8)
        if h.depth == 8:  # scaling changes nothing
            s = rows.reshape(n, width, -1)
            out[:, :, :3] = s[:, :, :1] if h.color in (0, 4) else s[:, :, :3]
            out[:, :, 3] = s[:, :, -1] if h.color == 4 else 255 if self.key is None else np.where((s == self.key).all(axis=2), 0, 255)
            return out
        if h.color in (0, 4):
            # Direct 16-bit gray + alpha rounds as colour does; plain gray by its own maximum. Both are the same division.
            out[:, :, :3] = ((s[:, :, :1] * 255 + top // 2) // top).astype(np.uint8)
        else:
            out[:, :, :3] = ((s[:, :, :3] * 255 + top // 2) // top).astype(np.uint8)
        if h.color in (4, 6):
            out[:, :, 3] = ((s[:, :, -1] * 255 + top // 2) // top).astype(np.uint8)
        elif self.key is not None:
            out[:, :, 3] = np.where((s == self.key).all(axis=2), 0, 255)
        else:
            out[:, :, 3] = 255
        return out


def _bands(source: Inflater, h: Header, width: int, height: int, normal: Normalizer) -> Iterator[tuple[int, np.ndarray]]:
    size = -(-width * h.bits_per_pixel // 8)
    bpp = max(1, h.bits_per_pixel // 8)
    above = np.zeros(size, np.uint8)
    # Narrow images go in higher bands: a band has as many diagonals as it is wide and high.
    rows = max(1, min(4 * BAND if width <= 256 else BAND, (4 << 20) // (size + 1)))
    for y in range(0, height, rows):
        n = min(rows, height - y)
        block = np.frombuffer(source.take(n * (size + 1)), np.uint8).reshape(n, size + 1)
        band = _unfilter(block[:, 1:], block[:, 0], above, bpp)
        above = band[-1]
        yield y, normal(band, width)


def decode_bands(data: bytes | ReadAt_, h: Header) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, n x width x 4) of a non-interlaced image, top to bottom."""
    yield from _bands(Inflater(data, h.first_idat), h, h.width, h.height, Normalizer(h))


def decode_passes(data: bytes | ReadAt_, h: Header) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ys, xs, n x m x 4) of an interlaced image, band by band of its seven passes."""
    source, normal = Inflater(data, h.first_idat), Normalizer(h)
    for _, x0, y0, dx, dy in ADAM7:
        w, n = -(-(h.width - x0) // dx) if h.width > x0 else 0, -(-(h.height - y0) // dy) if h.height > y0 else 0
        if w and n:
            for y, band in _bands(source, h, w, n, normal):
                yield y0 + dy * np.arange(y, y + len(band)), x0 + dx * np.arange(w), band


def decode(data: bytes, h: Header | None = None) -> np.ndarray:
    """The whole frame (height x width x 4)."""
    h = h or read_header(lambda o, n: data[o : o + n], len(data))
    out = np.empty((h.height, h.width, 4), np.uint8)
    if h.interlaced:
        for ys, xs, px in decode_passes(data, h):
            out[np.ix_(ys, xs)] = px
    else:
        for y, px in decode_bands(data, h):
            out[y : y + len(px)] = px
    return out


# ---- encoding ------------------------------------------------------------------------------------

_COLOR_TYPES = {"grayscale8": (0, 1), "grayscale-alpha8": (4, 2), "rgb8": (2, 3), "rgba8": (6, 4)}


def convert(rgba: np.ndarray, color: str) -> np.ndarray:
    """RGBA to the channels of an output colour."""
    if color == "rgba8":
        return rgba
    if color == "rgb8":
        return rgba[..., :3]
    p = rgba.astype(np.int64)
    gray = ((77 * p[..., 0] + 150 * p[..., 1] + 29 * p[..., 2] + 128) >> 8).astype(np.uint8)[..., None]
    return gray if color == "grayscale8" else np.concatenate([gray, rgba[..., 3:]], axis=-1)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filter_rows(rows: np.ndarray, above: np.ndarray, bpp: int, choice: str) -> np.ndarray:
    """Rows (n x bytes) to n x (1 + bytes) with their filter bytes."""
    x = rows.astype(np.int16)
    up = np.concatenate([above[None].astype(np.int16), x[:-1]])
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, bpp:], corner[:, bpp:] = x[:, :-bpp], up[:, :-bpp]

    def filtered(k: int) -> np.ndarray:
        if k == 0:
            return rows
        if k == 4:
            pa, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        else:
            guess = (left, up, (left + up) >> 1)[k - 1]
        return (x - guess).astype(np.uint8)

    fixed = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    if choice in fixed:
        out[:, 0], out[:, 1:] = fixed[choice], filtered(fixed[choice])
        return out
    each = np.stack([filtered(k) for k in range(5)])
    if choice == "min-entropy":
        cost = np.empty(each.shape[:2])
        for k in range(5):
            for i, row in enumerate(each[k]):
                c = np.bincount(row, minlength=256)
                c = c[c > 0]
                cost[k, i] = -(c * np.log2(c / len(row))).sum()
    else:
        cost = np.abs(each.view(np.int8).astype(np.int64)).sum(axis=2)
    best = cost.argmin(axis=0)
    out[:, 0], out[:, 1:] = best, each[best, np.arange(len(rows))]
    return out


class Output:
    """Where an encoder's bytes go: a caller's file, or a buffer. No more than cap bytes are let through."""

    def __init__(self, cap: int | None, into: BinaryIO | None) -> None:
        self.cap, self.into = cap, into
        self.written, self.kept = 0, bytearray()

    def put(self, data: bytes) -> None:
        if self.cap is not None and self.written + len(data) > self.cap:
            raise ImageError("EncodedOutputLimitExceeded", limit=self.cap)
        self.written += len(data)
        if self.into is None:
            self.kept += data
        else:
            self.into.write(data)


class Encoder:
    """Row-streamed encoding with a byte cap; push bands top to bottom, then finish. The bytes go to a caller's open file as they are made, or are kept."""

    def __init__(self, width: int, height: int, options: PngOptions, color: str, cap: int | None = None, into: BinaryIO | None = None) -> None:
        self.kind, self.channels = _COLOR_TYPES[color]
        self.width, self.height, self.color = width, height, color
        self.choice = "adaptive" if options.filter == "default" else options.filter
        self.z = zlib.compressobj(PNG_COMPRESSION[options.compression])
        self.above = np.zeros(width * self.channels, np.uint8)
        self.rows = 0
        self.out = Output(cap, into)
        self._put(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, self.kind, 0, 0, 0)))

    def _put(self, data: bytes) -> None:
        self.out.put(data)

    def push(self, rgba: np.ndarray) -> None:
        rows = np.ascontiguousarray(convert(rgba, self.color)).reshape(len(rgba), -1)
        data = self.z.compress(filter_rows(rows, self.above, self.channels, self.choice).tobytes())
        self.above = rows[-1]
        self.rows += len(rows)
        if data:
            self._put(chunk(b"IDAT", data))

    def finish(self) -> bytes:
        if self.rows != self.height:
            raise ImageError("IncompleteImage", actual=self.rows, limit=self.height)
        self._put(chunk(b"IDAT", self.z.flush()) + chunk(b"IEND", b""))
        return bytes(self.out.kept)


def encode(rgba: np.ndarray, options: PngOptions = PngOptions(), color: str | None = None) -> bytes:
    e = Encoder(rgba.shape[1], rgba.shape[0], options, color or (options.color if options.color != "auto" else "rgba8"))
    for y in range(0, len(rgba), BAND):
        e.push(rgba[y : y + BAND])
    return e.finish()
