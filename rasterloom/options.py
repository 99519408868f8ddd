"""Request options and limits, validated before a plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields


class OptionError(ValueError):
    """An option that no plan can be made with; `kind` names the error as result rows do."""

    def __init__(self, kind: str, detail: str) -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind = kind
        self.detail = detail


FITS = ("contain", "cover")
FORMATS = ("png", "jpeg", "rgba")
DELIVERIES = ("buffered", "writer", "chunks")
FILTERS = ("area",)
PNG_COLORS = ("rgba8", "rgb8", "grayscale-alpha8", "grayscale8", "auto")
#: zlib levels of the compression names.
PNG_COMPRESSION = {"none": 0, "fastest": 1, "fast": 3, "balanced": 6, "high": 9}
PNG_FILTERS = ("default", "none", "sub", "up", "average", "paeth", "adaptive", "min-entropy")
JPEG_SUBSAMPLING = ("4:4:4", "4:2:2", "4:2:0")
MIME = {"png": "image/png", "jpeg": "image/jpeg", "rgba": "application/octet-stream"}
CHUNK_BYTES = 65536


def _choice(name: str, value: str, allowed: tuple[str, ...] | dict, kind: str = "InvalidOptions") -> None:
    if value not in allowed:
        raise OptionError(kind, f"{name} is {value!r}; expected one of {', '.join(allowed)}")


@dataclass(frozen=True)
class Limits:
    """Bounds in the order in which they are checked. Equal passes, more fails, zero is no bound at all but an error."""

    max_input_bytes: int = 64 << 20
    max_width: int = 100_000
    max_height: int = 100_000
    max_pixels: int = 500_000_000
    max_output_width: int = 8192
    max_output_height: int = 8192
    max_output_pixels: int = 16_777_216
    max_working_memory_bytes: int = 32 << 20

    def first_invalid(self) -> str | None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise OptionError("InvalidOptions", f"limits.{f.name} is no whole number of 0 or more")
        return next((f"limits.{f.name}" for f in fields(self) if getattr(self, f.name) == 0), None)


@dataclass(frozen=True)
class PngOptions:
    color: str = "rgba8"
    compression: str = "balanced"
    filter: str = "default"

    def __post_init__(self) -> None:
        _choice("png.color", self.color, PNG_COLORS, "InvalidPngOptions")
        _choice("png.compression", self.compression, PNG_COMPRESSION, "InvalidPngOptions")
        _choice("png.filter", self.filter, PNG_FILTERS, "InvalidPngOptions")


@dataclass(frozen=True)
class JpegOptions:
    quality: int = 85
    background: tuple[int, int, int] = (255, 255, 255)
    subsampling: str = "4:2:0"

    def __post_init__(self) -> None:
        if not isinstance(self.quality, int) or isinstance(self.quality, bool) or not 1 <= self.quality <= 100:
            raise OptionError("InvalidJpegOptions", "quality must be 1 to 100")
        _choice("jpeg.subsampling", self.subsampling, JPEG_SUBSAMPLING, "InvalidJpegOptions")
        parse_color(self.background)


@dataclass(frozen=True)
class ThumbnailOptions:
    max_width: int = 512
    max_height: int = 512
    fit: str = "contain"
    allow_upscale: bool = False
    output: str = "png"
    filter: str = "area"
    delivery: str = "buffered"
    limits: Limits = field(default_factory=Limits)
    png: PngOptions | None = None
    jpeg: JpegOptions | None = None

    def __post_init__(self) -> None:
        _choice("fit", self.fit, FITS)
        _choice("output", self.output, FORMATS)
        _choice("filter", self.filter, FILTERS)
        _choice("delivery", self.delivery, DELIVERIES, "InvalidOutputDelivery")
        for name in ("max_width", "max_height"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < 1 << 32:
                raise OptionError("InvalidOptions", f"{name} must be a whole number below 2^32")
        if self.png is not None and self.output != "png":
            raise OptionError("InvalidPngOptions", f"png options with {self.output} output")
        if self.jpeg is not None and self.output != "jpeg":
            raise OptionError("InvalidJpegOptions", f"jpeg options with {self.output} output")
        if self.output == "rgba" and self.delivery != "buffered":
            raise OptionError("InvalidOutputDelivery", "raw RGBA is delivered whole")

    @property
    def mime_type(self) -> str:
        return MIME[self.output]

    @property
    def adapter_bytes(self) -> int:
        """What a writer's own buffer adds to the plan."""
        return CHUNK_BYTES if self.delivery == "chunks" else 0


def parse_color(value: str | tuple | list) -> tuple[int, int, int]:
    """#rrggbb, or three whole numbers from 0 to 255."""
    if isinstance(value, str):
        if not re.fullmatch("#[0-9a-fA-F]{6}", value):
            raise OptionError("InvalidJpegOptions", f"{value!r} is not #rrggbb")
        return int(value[1:3], 16), int(value[3:5], 16), int(value[5:7], 16)
    if not isinstance(value, (tuple, list)) or len(value) != 3 or any(not isinstance(v, int) or isinstance(v, bool) or not 0 <= v <= 255 for v in value):
        raise OptionError("InvalidJpegOptions", f"{value!r} is not three numbers from 0 to 255")
    return tuple(value)  # type: ignore[return-value]


_NESTED = {"limits": Limits, "png": PngOptions, "jpeg": JpegOptions}


def from_dict(given: dict) -> ThumbnailOptions:
    """Options from a plain dictionary; unknown names are errors, numbers with no fraction are whole."""

    def build(kind: type, values: dict, where: str):
        known = {f.name for f in fields(kind)}
        if unknown := sorted(set(values) - known):
            raise OptionError("InvalidOptions", f"unknown {where}{unknown[0]}")
        out = {}
        for name, value in values.items():
            if value is None:
                continue
            if kind is ThumbnailOptions and name in _NESTED:
                value = build(_NESTED[name], value, f"{name}.")
            elif name == "background":
                value = parse_color(value)
            elif isinstance(value, float):
                if not value.is_integer() or abs(value) > 2**53 - 1:
                    raise OptionError("InvalidOptions", f"{where}{name} is not a safe whole number")
                value = int(value)
            out[name] = value
        return kind(**out)

    return build(ThumbnailOptions, given, "")
