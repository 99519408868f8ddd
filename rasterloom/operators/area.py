"""Exact area resampling of row bands in numpy: the production path of whole images.

A cell's sum is a difference of prefix sums at its two ends. Sums wrap modulo 2^64, which differences undo, as a cell's own
sum always fits; nothing is rounded before the last division.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..errors import ImageError
from .resample import safe_in_bigint


@dataclass(frozen=True)
class Line:
    """One axis of the lattice; see functions.geometry.Axis."""

    n: int
    out: int
    cell: int
    start: int
    stop: int
    span: int

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Source index and rest of each output boundary."""
        z = self.start + np.arange(self.out + 1) * self.span
        return z // self.cell, z % self.cell

    def overlaps(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into places, output cell, weight) of sorted source places."""
        a = np.maximum(places * self.cell, self.start)
        b = np.minimum((places + 1) * self.cell, self.stop)
        first = (a - self.start) // self.span
        count = np.where(a < b, -((self.start - b) // self.span) - first, 0)
        i = np.repeat(np.arange(len(places)), count)
        o = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        return i, o, np.minimum(b[i], self.start + (o + 1) * self.span) - np.maximum(a[i], self.start + o * self.span)


def lines(fit: str, sw: int, sh: int, ow: int, oh: int) -> tuple[Line, Line]:
    x, y = Line(sw, ow, ow, 0, sw * ow, sw), Line(sh, oh, oh, 0, sh * oh, sh)
    if fit == "cover" and sw * oh > sh * ow:
        x = Line(sw, ow, 2 * oh, sw * oh - sh * ow, sw * oh + sh * ow, 2 * sh)
    elif fit == "cover" and sw * oh < sh * ow:
        y = Line(sh, oh, 2 * ow, sh * ow - sw * oh, sh * ow + sw * oh, 2 * sw)
    if not safe_in_bigint(x.span, y.span):
        raise ImageError("IntegerOverflow", "cell sums over 63 bits")
    return x, y


def _premultiplied(band: np.ndarray) -> np.ndarray:
    p = band.astype(np.int64)
    p[..., :3] *= p[..., 3:]
    return p


def finish(sums: np.ndarray, weight: int) -> np.ndarray:
    """Sums (.. x 4: red, green, blue, alpha) to RGBA bytes."""
    a = sums[..., 3:]
    d = np.maximum(a, 1)
    out = np.empty(sums.shape, np.uint8)
    q, r = np.divmod(sums[..., :3], d)
    out[..., :3] = np.where(a > 0, q + (2 * r >= d), 0)
    q, r = np.divmod(a, weight)
    out[..., 3:] = q + (2 * r >= weight)
    return out


class Ordered:
    """Rows in ascending order; finished output bands leave as soon as their last row has come. State: two rows of sums."""

    def __init__(self, fit: str, sw: int, sh: int, ow: int, oh: int) -> None:
        self.x, self.y = lines(fit, sw, sh, ow, oh)
        self.x_at, self.x_rest = self.x.ends()
        self.y_at, self.y_rest = self.y.ends()
        self.before = np.zeros((ow, 4), np.int64)  # whole rows above the band
        self.last: np.ndarray | None = None  # prefix at the last boundary met
        self.next_y = self.next_end = 0

    def push(self, y: int, band: np.ndarray) -> np.ndarray:
        if y != self.next_y or y + len(band) > self.y.n:
            raise ImageError("UnexpectedRow", actual=y, limit=self.next_y)
        if band.shape[1] != self.x.n:
            raise ImageError("InvalidRowLength", actual=4 * band.shape[1], limit=4 * self.x.n)
        across = self._across(band)
        down = self.before + np.concatenate([np.zeros((1, *across.shape[1:]), np.int64), np.cumsum(across, axis=0)])
        self.next_y += len(band)
        # A boundary at the very end of the image belongs to its last band.
        limit = self.next_y + (self.next_y == self.y.n)
        k = np.arange(self.next_end, np.searchsorted(self.y_at, limit, "left"))
        at = self.y_at[k] - y
        ends = down[at] * self.y.cell + across[np.minimum(at, len(across) - 1)] * self.y_rest[k][:, None, None]
        self.before = down[-1]
        self.next_end += len(k)
        if len(k):
            known = ends if self.last is None else np.concatenate([self.last[None], ends])
            self.last = ends[-1]
            return finish(np.diff(known, axis=0), self.x.span * self.y.span)
        return np.zeros((0, self.x.out, 4), np.uint8)

    def _across(self, band: np.ndarray) -> np.ndarray:
        """Sums over x of a band (n x out x 4). Opaque bands sum plain colours, with the factor 255 applied to the few sums."""
        opaque = bool((band[..., 3] == 255).all())
        narrow = self.x.n * 255 * 255 < 2**31
        if opaque:
            p = band[..., :3]
        else:
            p = band.astype(np.int32)
            p[..., :3] *= p[..., 3:]
        total = np.zeros((len(p), self.x.n + 1, p.shape[2]), np.int32 if narrow else np.int64)
        np.cumsum(p, axis=1, dtype=total.dtype, out=total[:, 1:])
        last = np.minimum(self.x_at, self.x.n - 1)
        ends = total[:, self.x_at].astype(np.int64) * self.x.cell + p[:, last].astype(np.int64) * self.x_rest[None, :, None]
        across = np.diff(ends, axis=1)
        if opaque:
            across = np.concatenate([across, np.full((*across.shape[:2], 1), self.x.span)], axis=2) * 255
        return across

    def close(self) -> None:
        if self.next_y != self.y.n:
            raise ImageError("IncompleteImage", actual=self.next_y, limit=self.y.n)


class Sparse:
    """Samples in any order, by lattices of rows and columns. State: sums of the whole output."""

    def __init__(self, fit: str, sw: int, sh: int, ow: int, oh: int) -> None:
        self.x, self.y = lines(fit, sw, sh, ow, oh)
        self.sums = np.zeros((oh, ow, 4), np.int64)
        self.weight = np.zeros((oh, ow), np.int64)
        self.samples = 0

    def push(self, ys: np.ndarray, xs: np.ndarray, pixels: np.ndarray) -> None:
        if len(ys) and (ys.max() >= self.y.n or ys.min() < 0) or len(xs) and (xs.max() >= self.x.n or xs.min() < 0):
            raise ImageError("InvalidPixelCoordinate")
        self.samples += len(ys) * len(xs)
        i, o, w = self.x.overlaps(xs)
        j, u, v = self.y.overlaps(ys)
        if not len(i) or not len(j):
            return
        p = _premultiplied(pixels)
        cols, begin = np.unique(o, return_index=True)
        across = np.add.reduceat(p[:, i] * w[None, :, None], begin, axis=1)
        rows, start = np.unique(u, return_index=True)
        down = np.add.reduceat(across[j] * v[:, None, None], start, axis=0)
        self.sums[np.ix_(rows, cols)] += down
        self.weight[np.ix_(rows, cols)] += np.outer(np.add.reduceat(v, start), np.add.reduceat(w, begin))

    def close(self) -> np.ndarray:
        if self.samples != self.x.n * self.y.n:
            raise ImageError("IncompleteSamples", actual=self.samples, limit=self.x.n * self.y.n)
        full = self.x.span * self.y.span
        if (self.weight != full).any():
            raise ImageError("InvalidCoverage", actual=int(self.weight[self.weight != full][0]), limit=full)
        return finish(self.sums, full)


def resample(frame: np.ndarray, fit: str, ow: int, oh: int, band: int = 128) -> np.ndarray:
    """A whole frame at once, by the ordered path."""
    o = Ordered(fit, frame.shape[1], frame.shape[0], ow, oh)
    out = [o.push(y, frame[y : y + band]) for y in range(0, len(frame), band)]
    o.close()
    return np.concatenate(out)


def bands(source: Iterator[tuple[int, np.ndarray]], ordered: Ordered) -> Iterator[np.ndarray]:
    for y, band in source:
        done = ordered.push(y, band)
        if len(done):
            yield done
    ordered.close()
