"""python -m rasterloom INPUT OUTPUT_DIR [options]: thumbnails of a file, folder or glob."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .options import FITS, FORMATS, JPEG_SUBSAMPLING, PNG_COLORS, PNG_COMPRESSION, PNG_FILTERS, OptionError, from_dict, parse_color
from .sources.images import scan
from .sources.staged import StagedSink


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", choices=FORMATS, default="png")
    p.add_argument("--max-width", type=int, default=512)
    p.add_argument("--max-height", type=int, default=512)
    p.add_argument("--fit", choices=FITS, default="contain")
    p.add_argument("--allow-upscale", action="store_true")
    p.add_argument("--memory", type=int, default=32 << 20, help="working memory of one image, in bytes")
    p.add_argument("--png-color", choices=PNG_COLORS)
    p.add_argument("--png-compression", choices=PNG_COMPRESSION)
    p.add_argument("--png-filter", choices=PNG_FILTERS)
    p.add_argument("--jpeg-quality", type=int)
    p.add_argument("--jpeg-background", help="#rrggbb")
    p.add_argument("--jpeg-subsampling", choices=JPEG_SUBSAMPLING)
    return p.parse_args(argv)


def options_of(args: argparse.Namespace) -> dict:
    nested = lambda prefix: {k: v for k, v in ((n.removeprefix(prefix), getattr(args, n)) for n in vars(args) if n.startswith(prefix)) if v is not None}
    png, jpeg = nested("png_"), nested("jpeg_")
    if "background" in jpeg:
        jpeg["background"] = parse_color(jpeg["background"])
    return {
        "output": args.format, "max_width": args.max_width, "max_height": args.max_height, "fit": args.fit, "allow_upscale": args.allow_upscale,
        "limits": {"max_working_memory_bytes": args.memory}, "png": png or None, "jpeg": jpeg or None,
    }


def main(argv: list[str]) -> int:
    args = parse(argv)
    try:
        options = from_dict(options_of(args))
    except OptionError as e:
        print(f"rasterloom: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    spark.dataSource.register(StagedSink)
    done = api.thumbnail(scan(spark, args.input), options).persist()
    suffix = {"png": "png", "jpeg": "jpg", "rgba": "rgba"}[args.format]
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    good = done.where("error_kind IS NULL").select(F.concat(stem, F.lit(f".{suffix}")).alias("name"), "bytes")
    good.write.format("staged_files").option("path", os.path.abspath(args.output)).mode("append").save()
    failed = 0
    for r in done.where("error_kind IS NOT NULL").select("path", "error_kind", "error_detail").toLocalIterator():
        failed += 1
        print(f"rasterloom: {r['path']}: {r['error_kind']} {r['error_detail'] or ''}".rstrip(), file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
