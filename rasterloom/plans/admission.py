"""Plans of requests: output size, memory, and the first check that fails. No pixel is read; this is what EXPLAIN is elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, memory
from ..options import ThumbnailOptions

_LIMITS = ("max_input_bytes", "max_width", "max_height", "max_pixels", "max_output_width", "max_output_height", "max_output_pixels", "max_working_memory_bytes")


def with_options(images: DataFrame, options: ThumbnailOptions) -> DataFrame:
    """The same options for every image, as literal columns."""
    cols = {"max_box_width": options.max_width, "max_box_height": options.max_height}
    out = images.withColumns({k: F.lit(v).cast("bigint") for k, v in cols.items()})
    out = out.withColumns({"fit": F.lit(options.fit), "allow_upscale": F.lit(options.allow_upscale), "output": F.lit(options.output)})
    out = out.withColumns({"writer": F.lit(options.delivery != "buffered"), "adapter_bytes": F.lit(options.adapter_bytes).cast("bigint")})
    return out.withColumns({f"limit_{n}": F.lit(getattr(options.limits, n)).cast("bigint") for n in _LIMITS})


def plan(requests: DataFrame, enforce: bool = True) -> DataFrame:
    """Adds out_width, out_height, the memory components, total_bytes, encoded_cap, within_memory_limit, error_kind, actual, limit.

    requests: width, height, encoded_bytes, source_bpp, interlaced, max_box_width, max_box_height, fit, allow_upscale, output,
    writer, adapter_bytes and limit_* columns. Checks are made in a fixed order and the first that fails is told: the input's
    bytes (before anything else, zero limits included), limits that are zero, the input's width, height and pixels, an empty box, the output's
    width, height and pixels, and with enforce the working memory.
    """
    c = F.col
    ow, oh = geometry.output_size(c("fit"), c("width"), c("height"), c("max_box_width"), c("max_box_height"), c("allow_upscale"))
    ok = (c("width") > 0) & (c("height") > 0) & (c("max_box_width") > 0) & (c("max_box_height") > 0)
    sized = requests.withColumns({"out_width": F.when(ok, ow), "out_height": F.when(ok, oh)})
    parts = memory.components(c("width"), c("out_width"), c("out_height"), c("source_bpp"), c("output"), c("interlaced"), c("writer"), c("adapter_bytes"))
    sized = sized.withColumns(parts)
    sized = sized.withColumns({"total_bytes": memory.total({k: c(k) for k in parts}), "encoded_cap": memory.encoded_cap(c("out_width"), c("out_height"), c("output"))})
    return sized.withColumns(verdict(enforce))


def verdict(enforce: bool) -> dict[str, Column]:
    c = F.col
    none = F.lit(None).cast("bigint")
    over = lambda kind, actual, limit: (actual > c(f"limit_{limit}"), f"LimitExceeded.{kind}", actual, c(f"limit_{limit}"))
    checks: list[tuple[Column, str, Column, Column]] = [over("InputBytes", c("encoded_bytes"), "max_input_bytes")]
    checks += [(c(f"limit_{n}") == 0, f"InvalidLimit.{n}", none, none) for n in _LIMITS]
    checks += [(c(n) == 0, f"ZeroDimension.{n}", none, none) for n in ("width", "height")]
    checks += [over("InputWidth", c("width"), "max_width"), over("InputHeight", c("height"), "max_height"), over("InputPixels", c("width") * c("height"), "max_pixels")]
    checks += [(c(n) == 0, f"ZeroDimension.{n}", none, none) for n in ("max_box_width", "max_box_height")]
    checks += [over("OutputWidth", c("out_width"), "max_output_width"), over("OutputHeight", c("out_height"), "max_output_height")]
    checks += [over("OutputPixels", c("out_width") * c("out_height"), "max_output_pixels")]
    if enforce:
        checks.append(over("WorkingMemory", c("total_bytes"), "max_working_memory_bytes"))

    def pick(values: list[Column], otherwise: Column) -> Column:
        out = F.when(checks[0][0], values[0])
        for (bad, *_), v in zip(checks[1:], values[1:]):
            out = out.when(bad, v)
        return out.otherwise(otherwise)

    return {
        "within_memory_limit": c("total_bytes") <= c("limit_max_working_memory_bytes"),
        "error_kind": pick([F.lit(k) for _, k, _, _ in checks], F.lit(None).cast("string")),
        "actual": pick([a for _, _, a, _ in checks], none),
        "limit": pick([x for _, _, _, x in checks], none),
    }


def admitted(planned: DataFrame) -> DataFrame:
    return planned.where("error_kind IS NULL")


def rejected(planned: DataFrame) -> DataFrame:
    return planned.where("error_kind IS NOT NULL")
