"""Streams of image files: each micro-batch is planned and rendered like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.thumbnail import thumbnails
from ..options import ThumbnailOptions

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, folder: str, glob: str = "*.png", max_files: int = 200) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)


def thumbnail_stream(images: DataFrame, options: ThumbnailOptions) -> DataFrame:
    return thumbnails(images, options)
