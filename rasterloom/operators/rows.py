"""Row contracts, Adam7 lattices, and the windows in which rows and bytes leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import ceil_div, div
from ..options import CHUNK_BYTES

# Fixed values of the PNG specification: pass, x start, y start, x step, y step.
ADAM7 = (
    (1, 0, 0, 8, 8),
    (2, 4, 0, 8, 8),
    (3, 0, 4, 4, 8),
    (4, 2, 0, 4, 4),
    (5, 0, 2, 2, 4),
    (6, 1, 0, 2, 2),
    (7, 0, 1, 1, 2),
)


def passes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADAM7, "pass bigint, x0 bigint, y0 bigint, dx bigint, dy bigint")


def pass_count(length: Column, start: Column, step: Column) -> Column:
    """Samples of one axis of a pass."""
    return F.when(length > start, ceil_div(length - start, step)).otherwise(F.lit(0).cast("bigint"))


def pass_sizes(images: DataFrame) -> DataFrame:
    """(image_id, pass, pass_width, pass_height) of the passes that hold samples; the seven constants ride along as an array."""
    table = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("pass", "x0", "y0", "dx", "dy"), p)]) for p in ADAM7])
    rows = images.withColumn("p", F.explode(table))
    rows = rows.withColumns({"pass_width": pass_count(F.col("width"), F.col("p.x0"), F.col("p.dx")), "pass_height": pass_count(F.col("height"), F.col("p.y0"), F.col("p.dy"))})
    return rows.where("pass_width > 0 AND pass_height > 0").select("image_id", "p.*", "pass_width", "pass_height")


def pass_pixels(images: DataFrame) -> DataFrame:
    """(image_id, pass, y, x): the seven disjoint lattices of each image, in no order."""
    rows = pass_sizes(images).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pass_width") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pass_height") - 1)))
    return rows.select("image_id", "pass", (F.col("y0") + F.col("j") * F.col("dy")).alias("y"), (F.col("x0") + F.col("i") * F.col("dx")).alias("x"))


def pass_of(x: Column, y: Column) -> Column:
    """The pass that a pixel belongs to."""
    out = F.when((x % 8 == 0) & (y % 8 == 0), 1)
    for p, x0, y0, dx, dy in ADAM7[1:]:
        out = out.when((x % dx == x0) & (y % dy == y0), p)
    return out.cast("bigint")


def row_faults(rows: DataFrame) -> DataFrame:
    """The first fault of each image whose rows (image_id, arrival, y, n_bytes, width, height) break the contract.

    Rows must come in ascending order without gaps, each with four bytes a pixel, and all of them.
    """
    w = W.partitionBy("image_id").orderBy("arrival")
    seen = rows.withColumns({"expected": F.row_number().over(w).cast("bigint") - 1})
    bad = F.when((F.col("y") != F.col("expected")) | (F.col("expected") >= F.col("height")), "UnexpectedRow").when(F.col("n_bytes") != 4 * F.col("width"), "InvalidRowLength")
    found = seen.withColumn("kind", bad)
    first = F.min_by(F.struct("kind", F.when(F.col("kind") == "UnexpectedRow", F.col("expected")).otherwise(4 * F.col("width")).alias("expected"), F.when(F.col("kind") == "UnexpectedRow", F.col("y")).otherwise(F.col("n_bytes")).alias("actual")), F.when(F.col("kind").isNotNull(), F.col("arrival")))
    out = found.groupBy("image_id").agg(first.alias("f"), F.count("*").alias("n"), F.max("height").alias("height"))
    kind = F.coalesce(F.col("f.kind"), F.when(F.col("n") < F.col("height"), "IncompleteImage"))
    return out.select("image_id", kind.alias("error_kind"), F.when(F.col("f.kind").isNotNull(), F.col("f.expected")).otherwise(F.col("height")).alias("expected"), F.when(F.col("f.kind").isNotNull(), F.col("f.actual")).otherwise(F.col("n")).alias("actual")).where("error_kind IS NOT NULL")


def sample_faults(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Images whose sparse samples lie outside or are too few or too many: (image_id, error_kind, expected, actual)."""
    per = pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.max("x").alias("mx"), F.max("y").alias("my"), F.min("x").alias("lx"), F.min("y").alias("ly"))
    j = images.join(per, "image_id", "left")
    outside = (F.col("mx") >= F.col("width")) | (F.col("my") >= F.col("height")) | (F.col("lx") < 0) | (F.col("ly") < 0)
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    kind = F.when(outside, "InvalidPixelCoordinate").when(n != F.col("width") * F.col("height"), "IncompleteSamples")
    return j.select("image_id", kind.alias("error_kind"), (F.col("width") * F.col("height")).alias("expected"), n.alias("actual")).where("error_kind IS NOT NULL")


def mcu_height(subsampling: Column) -> Column:
    return F.when(subsampling == "4:2:0", 16).otherwise(8).cast("bigint")


def mcu_rows(images: DataFrame) -> DataFrame:
    """(image_id, mcu_row, first_row, n_rows, restart): tumbling windows of 8 or 16 rows, and the marker before each (null before the first)."""
    h = mcu_height(F.col("subsampling"))
    rows = images.withColumn("h", h).withColumn("mcu_row", F.explode(F.sequence(F.lit(0).cast("bigint"), ceil_div(F.col("height"), F.col("h")) - 1)))
    first = F.col("mcu_row") * F.col("h")
    return rows.select("image_id", "mcu_row", first.alias("first_row"), F.least(F.col("h"), F.col("height") - first).alias("n_rows"), F.when(F.col("mcu_row") > 0, (F.col("mcu_row") - 1) % 8).alias("restart"))


def chunk_windows(outputs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(image_id, chunk_idx, start, n_bytes) of outputs (image_id, length): whole windows and a last short one, none for nothing."""
    rows = outputs.where("length > 0").withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), div(F.col("length") - 1, size))))
    start = F.col("chunk_idx") * size
    return rows.select("image_id", "chunk_idx", start.alias("start"), F.least(F.lit(size).cast("bigint"), F.col("length") - start).alias("n_bytes"))


def chunks(outputs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(image_id, chunk_idx, bytes) of encoded outputs (image_id, bytes)."""
    rows = outputs.where("length(bytes) > 0").withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), ((F.length("bytes") - 1) / size).cast("int"))))
    return rows.select("image_id", "chunk_idx", F.substring("bytes", F.col("chunk_idx") * size + 1, F.lit(size)).alias("bytes"))


def chunk_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("image_id").agg(F.sum("n_bytes").cast("bigint").alias("bytes_written"), F.count("*").alias("chunks"), F.min("n_bytes").alias("last_bytes"))
