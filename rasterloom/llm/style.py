"""Hashed word bins and style ratios of texts, vectorised over an Arrow array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Words

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"#*$%&<>", b"!", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".,;:?"), 1):
    _CLASS[list(_chars)] = _i
N_STYLE = 10


def style(texts: pa.Array, w: Words) -> np.ndarray:
    """n_texts x N_STYLE ratios: seven byte classes per word, repeats of the word before, distinct words, bytes per word."""
    n = len(texts)
    count = np.maximum(np.diff(w.first), 1).astype(np.float64)
    out = np.zeros((n, N_STYLE))
    at = np.flatnonzero(_CLASS[w.data])
    doc = np.searchsorted(w.bounds, at, "right") - 1
    hits = np.bincount(doc * 8 + _CLASS[w.data[at]], minlength=8 * n)[: 8 * n].reshape(n, 8)
    out[:, :7] = hits[:, 1:] / count[:, None]
    if len(w.hash) > 1:
        same = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        out[:, 7] = np.bincount(w.text[1:][same], minlength=n) / count
        order = np.lexsort((w.hash, w.text))
        h, t = w.hash[order], w.text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        out[:, 8] = np.bincount(t[new], minlength=n) / count
    out[:, 9] = np.bincount(w.text, weights=(w.end - w.start), minlength=n) / count / 10
    return out
