"""Errors that become a row's error_kind; only the fail-fast mode raises them."""

from __future__ import annotations


class ImageError(Exception):
    """Why one image gives no result. actual and limit are set where a limit is exceeded."""

    def __init__(self, kind: str, detail: str = "", actual: int | None = None, limit: int | None = None) -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail, self.actual, self.limit = kind, detail, actual, limit
