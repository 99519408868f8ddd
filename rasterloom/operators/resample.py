"""Exact area resampling of a pixel relation.

A pixel finds the output cells it overlaps by arithmetic on its own coordinates, so the interval join is an explode of one or two
cells a side and nothing is joined; the weighted sums are one hash aggregation with partial sums before its only shuffle. Any
order of input gives the same sums. A cover crop's outer pixels overlap nothing and vanish before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Axis, axes
from ..functions.pixels import div, rounded_div
from .deal import dealt

SUMS = ("w", "sa", "sr", "sg", "sb")


def _type(wide: bool) -> str:
    return "decimal(38,0)" if wide else "bigint"


def safe_in_bigint(span_x: int, span_y: int) -> bool:
    """Whether the largest possible sum fits 63 bits; beyond it sums are decimals."""
    return 255 * 255 * span_x * span_y < 2**63


def axis_overlaps(images: DataFrame) -> DataFrame:
    """(image_id, axis, src, out, w) of images (image_id, width, height, fit, out_width, out_height).

    Images are few bytes and many overlaps: they are dealt out by their values first, as a file may hold them all in one piece.
    """
    sides = axes(F.col("fit"), F.col("width"), F.col("height"), F.col("out_width"), F.col("out_height"))
    kinds = [F.struct(F.lit(name).alias("axis"), F.col(n).alias("n"), *[v.cast("bigint").alias(k) for k, v in vars(side).items()]) for name, n, side in zip("xy", ("width", "height"), sides)]
    each = images.select("image_id", "width", "height", "fit", "out_width", "out_height")
    each = dealt(each).select("image_id", F.inline(F.array(*kinds))).where("n > 0")
    rows = each.withColumn("src", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return Axis(*[F.col(k) for k in ("cell", "start", "stop", "span")]).overlaps(rows, "src", "out", "w").select("image_id", "axis", "src", "out", "w")


def _weighted(weight: Column, wide: bool) -> list[Column]:
    w = weight.cast(_type(wide))
    a = F.col("a").cast("bigint")
    each = {"w": w, "sa": a * w, "sr": F.col("r") * a * w, "sg": F.col("g") * a * w, "sb": F.col("b") * a * w}
    return [F.sum(v).cast(_type(wide)).alias(k) for k, v in each.items()]


def pixel_of(sums: DataFrame) -> DataFrame:
    """Cells (image_id, oy, ox, sums) to straight-alpha pixels; a fully clear cell is 0, 0, 0, 0."""
    color = lambda s: F.when(F.col("sa") == 0, 0).otherwise(rounded_div(F.col(s), F.col("sa"))).cast("bigint")
    return sums.select("image_id", "oy", "ox", color("sr").alias("r"), color("sg").alias("g"), color("sb").alias("b"), rounded_div(F.col("sa"), F.col("w")).cast("bigint").alias("a"))


def cell_sums(pixels: DataFrame, wide: bool = False) -> DataFrame:
    """(image_id, oy, ox, w, sa, sr, sg, sb) of pixels (image_id, y, x, r, g, b, a, width, height, fit, out_width, out_height)."""
    ax, ay = axes(F.col("fit"), F.col("width"), F.col("height"), F.col("out_width"), F.col("out_height"))
    rows = ay.overlaps(ax.overlaps(pixels, "x", "ox", "wx"), "y", "oy", "wy")
    return rows.groupBy("image_id", "oy", "ox").agg(*_weighted(F.col("wx") * F.col("wy"), wide))


def cell_sums_by_rows(pixels: DataFrame, wide: bool = False) -> DataFrame:
    """The same sums by way of rows: over x within each source row first, then over y."""
    ax, ay = axes(F.col("fit"), F.col("width"), F.col("height"), F.col("out_width"), F.col("out_height"))
    rows = ax.overlaps(pixels, "x", "ox", "wx")
    size = ("width", "height", "fit", "out_width", "out_height")
    across = rows.groupBy("image_id", "y", "ox", *size).agg(*_weighted(F.col("wx"), wide))
    down = ay.overlaps(across, "y", "oy", "wy")
    return down.groupBy("image_id", "oy", "ox").agg(*[F.sum(F.col(s) * F.col("wy")).cast(_type(wide)).alias(s) for s in SUMS])


def resample(pixels: DataFrame, wide: bool = False) -> DataFrame:
    return pixel_of(cell_sums(pixels, wide))


def bad_coverage(sums: DataFrame, images: DataFrame) -> DataFrame:
    """Cells whose weights do not cover them: (image_id, oy, ox, expected, actual)."""
    x, y = axes(F.col("fit"), F.col("width"), F.col("height"), F.col("out_width"), F.col("out_height"))
    spans = images.select("image_id", (x.span * y.span).alias("expected"))
    return sums.join(spans, "image_id").where("w <> expected").select("image_id", "oy", "ox", "expected", F.col("w").alias("actual"))


def frames(pixels: DataFrame, width: int) -> DataFrame:
    """Whole RGBA frames (image_id, rgba) of resampled pixels, for images small enough to be one value."""
    byte = lambda c: F.unhex(F.lpad(F.hex(F.col(c)), 2, "0"))
    px = pixels.select("image_id", (F.col("oy") * width + F.col("ox")).alias("i"), F.concat(byte("r"), byte("g"), byte("b"), byte("a")).alias("p"))
    packed = F.array_sort(F.collect_list(F.struct("i", "p")))
    return px.groupBy("image_id").agg(F.aggregate(packed, F.lit(b""), lambda acc, v: F.concat(acc, v["p"])).alias("rgba"))


__all__ = ["axis_overlaps", "bad_coverage", "cell_sums", "cell_sums_by_rows", "div", "frames", "pixel_of", "resample", "safe_in_bigint"]
