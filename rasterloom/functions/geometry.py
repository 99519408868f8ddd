"""Output sizes and the integer lattice between source and output cells, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import ceil_div, div


def contain(sw: Column, sh: Column, bw: Column, bh: Column, upscale: Column) -> tuple[Column, Column]:
    """The largest size of the source's aspect within the box; the free side is rounded down, to 1 at least."""
    bw = F.when(upscale, bw).otherwise(F.least(bw, sw))
    bh = F.when(upscale, bh).otherwise(F.least(bh, sh))
    by_width = bw * sh <= bh * sw
    one = F.lit(1).cast("bigint")
    return F.when(by_width, bw).otherwise(F.greatest(one, div(sw * bh, sh))), F.when(by_width, F.greatest(one, div(sh * bw, sw))).otherwise(bh)


def cover(sw: Column, sh: Column, bw: Column, bh: Column, upscale: Column) -> tuple[Column, Column]:
    """The box, or without upscaling the largest box of its aspect within the source."""
    whole = upscale | ((sw >= bw) & (sh >= bh))
    by_width = sw * bh <= sh * bw
    one = F.lit(1).cast("bigint")
    w = F.when(whole, bw).when(by_width, sw).otherwise(F.greatest(one, div(bw * sh, bh)))
    return w, F.when(whole, bh).when(by_width, F.greatest(one, div(bh * sw, bw))).otherwise(sh)


def output_size(fit: Column, sw: Column, sh: Column, bw: Column, bh: Column, upscale: Column) -> tuple[Column, Column]:
    cw, ch = contain(sw, sh, bw, bh, upscale)
    vw, vh = cover(sw, sh, bw, bh, upscale)
    return F.when(fit == "cover", vw).otherwise(cw), F.when(fit == "cover", vh).otherwise(ch)


@dataclass(frozen=True)
class Axis:
    """Source cell i covers [i * cell, (i + 1) * cell) clipped to [start, stop); output cell o is [start + o * span, start + (o + 1) * span)."""

    cell: Column
    start: Column
    stop: Column
    span: Column

    def overlaps(self, rows: DataFrame, i: str, o: str, w: str) -> DataFrame:
        """The rows by output cell that source cell i overlaps, with columns o and w (the overlap). Rows outside the crop vanish.

        Only explode and arithmetic: a lambda would be interpreted, one source cell at a time.
        """
        a = F.greatest(F.col(i) * self.cell, self.start)
        b = F.least((F.col(i) + 1) * self.cell, self.stop)
        # Where a < b the sequence never counts downwards.
        found = rows.where(a < b).withColumn(o, F.explode(F.sequence(div(a - self.start, self.span), ceil_div(b - self.start, self.span) - 1)))
        return found.withColumn(w, F.least(b, self.start + (F.col(o) + 1) * self.span) - F.greatest(a, self.start + F.col(o) * self.span))


def axes(fit: Column, sw: Column, sh: Column, ow: Column, oh: Column) -> tuple[Axis, Axis]:
    """The x and y axes. A cover crop is centred; doubling that side's lattice keeps half cells whole."""
    zero = F.lit(0).cast("bigint")
    crop_x = (fit == "cover") & (sw * oh > sh * ow)
    crop_y = (fit == "cover") & (sw * oh < sh * ow)
    pick = lambda when, cut, full: F.when(when, cut).otherwise(full)
    x = Axis(pick(crop_x, 2 * oh, ow), pick(crop_x, sw * oh - sh * ow, zero), pick(crop_x, sw * oh + sh * ow, sw * ow), pick(crop_x, 2 * sh, sw))
    y = Axis(pick(crop_y, 2 * ow, oh), pick(crop_y, sh * ow - sw * oh, zero), pick(crop_y, sh * ow + sw * oh, sh * oh), pick(crop_y, 2 * sw, sh))
    return x, y
