"""Quality scores by votes of the nearest labelled documents in a latent semantic space.

A text is a row of hashed word bins (log counts, weighted by inverse document frequency, length 1) beside byte
frequencies (square roots, length 1) and ratios of style. Its latent vector is its product with the leading right singular
vectors of the sample's matrix, scaled to length 1. Sample vectors and singular vectors are broadcast; their size is bounded by `sample`,
`bins` and `rank`. Every document meets every sample vector in exact blocked cosine products; the k most similar vote with their
similarity (to a power) as weight. Neighbours that tie with the k-th all vote.

The sample has at most `sample` labelled documents, those of least id hash, within the bytes of training_sample(). Everything else covers all rows.

Defined results: null and empty texts, like texts that are alike to no sample vector, score the sample's share of label 1; without labels every score is 0.5;
a document with several labels takes the least; a null id is held in nothing and is scored like any text (held_out null);
repeated rows are each scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, slices, training_sample
from .style import N_STYLE, style

SAMPLE, BINS, RANK, NEIGHBOURS, POWER, CUTOFF = 4000, 4096, 64, 25, 8, 0.3
_STYLE_SCALE = np.array([3, 6, 6, 0.5, 0.2, 2, 0.3, 6, 1, 1])


def features(texts: pa.Array, bins: int, idf: np.ndarray | None) -> np.ndarray:
    """n_texts x (bins + 256 + N_STYLE), each of the three blocks weighted apart; without idf raw bin counts."""
    w = Words(texts)
    n = len(texts)
    count = np.bincount(w.text * bins + (w.hash % np.uint64(bins)).astype(np.int64), minlength=n * bins).reshape(n, bins)
    if idf is None:
        return count
    size = np.diff(w.bounds)
    doc = np.repeat(np.arange(n), size)
    chars = np.sqrt(np.bincount(doc * 256 + w.data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None])
    bag = np.log1p(count).astype(np.float32) * idf
    bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-12)
    look = np.minimum(style(texts, w) * _STYLE_SCALE, 2) * (np.diff(w.first) > 0)[:, None]
    return np.concatenate([0.5 * bag, 0.7 * chars, look], axis=1, dtype=np.float32)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    points: np.ndarray
    label: np.ndarray
    prior: float
    k: int
    power: float
    bins: int

    def latent(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.bins, self.idf) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.label):
            return np.full(len(texts), self.prior)
        cosine = self.latent(texts) @ self.points.T
        k = min(self.k, len(self.label))
        floor = np.partition(cosine, len(self.label) - k, axis=1)[:, len(self.label) - k]
        weight = np.where(cosine >= floor[:, None], np.maximum(cosine, 0), 0).astype(np.float64) ** self.power
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight @ self.label) / np.maximum(total, 1e-9), self.prior).clip(0, 1)


def labelled(documents: DataFrame, labels: DataFrame, held_mod: int, held_rest: int, sample: int) -> list:
    """(id, text, label) of the bounded sample: labelled documents that are not held out, those of least id hash."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod("doc_id", held_mod) != held_rest))
    y = y.groupBy("doc_id").agg(F.min("quality").alias("y"))
    return [(r["doc_id"], r["text"] or "", int(r["y"] == 1)) for r in training_sample(documents, y, sample)]


def fit(rows: list, bins: int = BINS, rank: int = RANK, k: int = NEIGHBOURS, power: float = POWER) -> Model:
    empty = np.zeros((0, 0), np.float32)
    if not rows:
        return Model(np.zeros(bins, np.float32), empty, empty, np.zeros(0), 0.5, k, power, bins)
    label = np.array([r[2] for r in rows], np.float64)
    parts = [pa.array([r[1] for r in rows[i : i + 200]], pa.string()) for i in range(0, len(rows), 200)]
    seen = sum((features(p, bins, None) > 0).sum(axis=0) for p in parts)
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32)
    x = np.concatenate([features(p, bins, idf) for p in parts])
    rng = np.random.default_rng(5)
    rank = min(rank, len(rows))
    q = rng.standard_normal((x.shape[1], min(rank + 16, len(rows)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ vt[:rank].T).astype(np.float32), empty, label, float(label.mean()), k, power, bins)
    model.points = np.concatenate([model.latent(p) for p in parts])
    return model


def score_quality(documents: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled(documents, labels, held_mod, held_rest, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                for i in range(0, part.num_rows, 256):
                    some = part.slice(i, 256)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(model.value.score(some.column("text")), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod("doc_id", held_mod) == held_rest).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
