"""The working-memory cost model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import ceil_div, div

# Fixed values of the cost model, in bytes.
DECODER_STAGING = 163_840
ACCUMULATOR = 80
PNG_ENCODER_STATE = 131_072
ENCODED_HEADROOM = 65_536
JPEG_BLOCK = 420
JPEG_COLUMN = 240

COMPONENTS = (
    "decoder_rows_bytes", "decoder_staging_bytes", "normalized_row_bytes", "horizontal_bytes", "vertical_bytes", "sparse_bytes",
    "output_row_bytes", "output_rgba_bytes", "encoder_state_bytes", "encoded_output_bytes",
)


def encoded_cap(ow: Column, oh: Column, output: Column) -> Column:
    """The most bytes that an encoder may put out; 0 for raw RGBA."""
    filtered = 4 * ow * oh + oh
    png = filtered + div(filtered, 8) + ENCODED_HEADROOM
    jpeg = ceil_div(ow, 8) * ceil_div(oh, 8) * 3 * JPEG_BLOCK + ENCODED_HEADROOM
    return F.when(output == "png", png).when(output == "jpeg", jpeg).otherwise(F.lit(0).cast("bigint"))


def components(sw: Column, ow: Column, oh: Column, bpp: Column, output: Column, sparse: Column, writer: Column, adapter: Column) -> dict[str, Column]:
    """Each component; `sparse` holds one accumulator per output pixel instead of two rows of them."""
    zero = F.lit(0).cast("bigint")
    row = F.when(sparse, zero).otherwise(ACCUMULATOR * ow)
    jpeg_state = 65_536 + JPEG_COLUMN * ow + (ceil_div(ow, 8) * 2 * 3 * JPEG_BLOCK + 65_536)
    return {
        "decoder_rows_bytes": 3 * (sw * bpp + 1),
        "decoder_staging_bytes": F.lit(DECODER_STAGING).cast("bigint"),
        "normalized_row_bytes": 4 * sw,
        "horizontal_bytes": row,
        "vertical_bytes": row,
        "sparse_bytes": F.when(sparse, ACCUMULATOR * ow * oh).otherwise(zero),
        "output_row_bytes": 4 * ow,
        "output_rgba_bytes": F.when(output == "rgba", 4 * ow * oh).otherwise(zero),
        "encoder_state_bytes": F.when(output == "png", F.lit(PNG_ENCODER_STATE).cast("bigint")).when(output == "jpeg", jpeg_state).otherwise(zero),
        "encoded_output_bytes": F.when(writer, adapter).otherwise(encoded_cap(ow, oh, output)),
    }


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in parts.values():
        out = out + c
    return out
