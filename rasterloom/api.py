"""The public verbs: inspect, plan, thumbnail, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import rows, thumbnail as _t
from .options import CHUNK_BYTES, ThumbnailOptions, from_dict
from .sources import images as _images

__all__ = ["CHUNK_BYTES", "ThumbnailOptions", "chunks", "inspect", "plan", "thumbnail"]


def _options(options: ThumbnailOptions | dict | None) -> ThumbnailOptions:
    return options if isinstance(options, ThumbnailOptions) else from_dict(options or {})


def inspect(images: DataFrame, max_input_bytes: int | None = None) -> DataFrame:
    """Headers of images (any columns and content)."""
    return _images.inspect(images, max_input_bytes, keep_content=False)


def plan(images: DataFrame, options: ThumbnailOptions | dict | None = None, enforce: bool = False) -> DataFrame:
    """What a thumbnail would need, and why it would be refused."""
    return _t.plan(images, _options(options), enforce)


def thumbnail(images: DataFrame, options: ThumbnailOptions | dict | None = None, mode: str = "permissive") -> DataFrame:
    """Encoded thumbnails, or each image's error."""
    return _t.thumbnails(images, _options(options), mode)


def chunks(thumbnails: DataFrame, key: str = "path") -> DataFrame:
    """Encoded outputs in pieces of 64 KiB: (image_id, chunk_idx, bytes)."""
    return rows.chunks(thumbnails.where("bytes IS NOT NULL").withColumnRenamed(key, "image_id"))
