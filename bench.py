"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

queries: seconds of each (best of two, after a warm-up). images: milliseconds and megapixels a second of single-core thumbnails of the published cases,
decode, resample and encode, as the engine's Arrow function runs them. table: images and megapixels a second of a table of images on all cores.
rss_mb: the most memory that this process and its largest child (the JVM, a Python worker) have held.
"""

from __future__ import annotations

import json
import os
import resource
import sys
import time

import numpy as np
from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "area_contain", "area_cover", "area_two_stage", "area_sparse_unordered", "memory_plan_ordered", "limits_first_violation", "admission_summary",
    "normalize_16bit", "adam7_passes", "chunk_windows", "png_area_contain", "png_area_adam7", "png_rows", "png_roundtrip", "jpeg_encode",
)


def image_times() -> tuple[dict[str, float], dict[str, float]]:
    from rasterloom.codecs import png
    from rasterloom.operators.thumbnail import render
    from rasterloom.options import ThumbnailOptions
    from rasterloom.sources.images import encode_interlaced, pattern

    cases = {
        "blank_2048_to_512_png": ("blank", 2048, 2048, 512, 512, "png", False), "blank_2048_to_512_jpeg": ("blank", 2048, 2048, 512, 512, "jpeg", False),
        "gradient_8192x64_to_512x4_png": ("gradient", 8192, 64, 512, 4, "png", False), "noise_64x8192_to_4x512_png": ("noise", 64, 8192, 4, 512, "png", False),
        "adam7_blank_2048_to_512_png": ("blank", 2048, 2048, 512, 512, "png", True),
    }
    out, speed = {}, {}
    for name, (kind, w, h, ow, oh, output, interlaced) in cases.items():
        frame = pattern(kind, w, h)
        data = encode_interlaced(frame) if interlaced else png.encode(np.ascontiguousarray(frame))
        options = ThumbnailOptions(output=output)
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            render(data, ow, oh, options)
            best = min(best, time.perf_counter() - t)
        out[name] = round(best * 1000, 1)
        speed[name] = round(w * h / best / 1e6, 1)
    return out, speed


def table_speed(spark: SparkSession, n: int = 48, side: int = 1024) -> dict[str, float]:
    from rasterloom.operators.thumbnail import thumbnails
    from rasterloom.options import ThumbnailOptions
    from rasterloom.sources.images import corpus

    images = corpus(spark, [(str(i), side, side, "blank", False) for i in range(n)]).repartition(n).persist()
    images.count()
    best = float("inf")
    for _ in range(2):
        t = time.perf_counter()
        thumbnails(images, ThumbnailOptions(max_width=256)).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t)
    images.unpersist()
    return {"images_per_s": round(n / best, 1), "megapixels_per_s": round(n * side * side / best / 1e6, 1)}


def main() -> int:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rasterloom.queries import QUERIES

    times = {}
    for name in HEADLINE:
        each = []
        for _ in range(3):
            t = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - t)
        times[name] = round(min(each[1:]), 3)
    images, speed = image_times()
    table = table_speed(spark)
    rss = sum(resource.getrusage(who).ru_maxrss for who in (resource.RUSAGE_SELF, resource.RUSAGE_CHILDREN)) // 1024
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "images_ms": images, "images_megapixels_per_s": speed, "table": table, "rss_mb": rss, "cpus": int(CPUS)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
