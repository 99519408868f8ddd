"""Exact integer arithmetic on samples and pixels, as columns that stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient of whole numbers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def ceil_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded up, of a >= 0 and b > 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    return div(a, b) + F.when(a % b > 0, 1).otherwise(0)


def rounded_div(a: Column, b: Column) -> Column:
    """Quotient rounded half up, from the remainder so that nothing above 2a is ever formed."""
    return div(a, b) + F.when(2 * (a % b) >= b, 1).otherwise(0)


def scale_gray(sample: Column, maximum: Column | int) -> Column:
    """A gray sample of any depth to 0..255."""
    maximum = maximum if isinstance(maximum, Column) else F.lit(maximum)
    return div(sample * 255 + div(maximum, 2), maximum)


def scale_16(sample: Column) -> Column:
    """A 16-bit direct sample to 0..255."""
    return div(sample * 255 + 32767, 65535)


def unpack(byte: Column, bits: Column, index: Column) -> Column:
    """Sample `index` of a row packed in bits of 1, 2 or 4, from the byte that holds it, most significant first."""
    place = 8 - bits - (index * bits) % 8
    return F.call_function("shiftright", byte.cast("int"), place.cast("int")).bitwiseAND((F.call_function("shiftleft", F.lit(1), bits.cast("int")) - 1).cast("int"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return div(77 * r + 150 * g + 29 * b + 128, 256)


def composite(sample: Column, alpha: Column, background: Column | int) -> Column:
    """A straight-alpha sample over an opaque background."""
    background = background if isinstance(background, Column) else F.lit(background)
    return div(sample * alpha + background * (255 - alpha) + 127, 255)


def row_bytes(samples: Column, bits: Column) -> Column:
    return ceil_div(samples * bits, 8)


def planning_bytes_per_pixel(color: Column, depth: Column) -> Column:
    """1 for indexed and packed gray, else channels times bytes."""
    channels = F.when(color == "grayscale", 1).when(color == "grayscale-alpha", 2).when(color == "rgb", 3).when(color == "rgba", 4)
    packed = (color == "indexed") | ((color == "grayscale") & (depth < 8))
    return F.when(packed, 1).otherwise(channels * div(depth, 8)).cast("bigint")


def valid_depth(color: Column, depth: Column) -> Column:
    return (
        F.when(color == "grayscale", depth.isin(1, 2, 4, 8, 16))
        .when(color == "indexed", depth.isin(1, 2, 4, 8))
        .when(color.isin("grayscale-alpha", "rgb", "rgba"), depth.isin(8, 16))
        .otherwise(False)
    )


def auto_color(color: Column, has_trns: Column, palette: Column, palette_alpha: Column) -> Column:
    """The smallest lossless output colour from what the header tells.

    palette: array of (r, g, b) structs; palette_alpha: array of alphas, both null unless indexed.
    """
    gray = F.coalesce((F.size(palette) > 0) & F.forall(palette, lambda c: (c["r"] == c["g"]) & (c["g"] == c["b"])), F.lit(False))
    clear = F.coalesce(F.exists(palette_alpha, lambda a: a != 255), F.lit(False))
    indexed = F.when(gray & ~clear, "grayscale8").when(gray, "grayscale-alpha8").when(clear, "rgba8").otherwise("rgb8")
    return (
        F.when(color == "grayscale", F.when(has_trns, "grayscale-alpha8").otherwise("grayscale8"))
        .when(color == "grayscale-alpha", "grayscale-alpha8")
        .when(color == "rgb", F.when(has_trns, "rgba8").otherwise("rgb8"))
        .when(color == "rgba", "rgba8")
        .when(color == "indexed", indexed)
    )


def mime_type(output: Column) -> Column:
    return F.when(output == "png", "image/png").when(output == "jpeg", "image/jpeg").otherwise("application/octet-stream")


def gradient(x: Column, y: Column, width: Column | int, height: Column | int) -> tuple[Column, Column, Column, Column]:
    """The gradient test pattern."""
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)
    r = F.when(width > 1, div(x * 255, F.greatest(width - 1, F.lit(1)))).otherwise(0)
    g = F.when(height > 1, div(y * 255, F.greatest(height - 1, F.lit(1)))).otherwise(0)
    return r, g, div((r + g) % 256, 2), F.lit(255)
