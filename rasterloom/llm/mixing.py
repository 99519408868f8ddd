"""Mixing documents to target domain weights with soft membership.

Domains are classes of the labelled table: toxic (toxic = 1), low (quality = 0), clean (the rest). A sparse linear classifier on hashed
words and style predicts a document's posterior over the domains. A document's rate is how many times it is drawn; the expected
tokens of domain k are sum(rate * tokens * posterior_k). Rates are fitted to the targets by projected-gradient least squares:
every step takes the gradient of the squared difference between expected and wanted totals, as it is or in the metric of the second moments of the documents whose rate is above zero, whichever leads nearer, and puts
negative rates to zero. A step needs the documents' rates only in sums of one number per domain, so rates are an expression over the written table
of tokens and posteriors and no document's rate leaves its executor. Without a total, the wanted total is what keeps the anchor domain at
its present size.

The classifier is fitted on at most `sample` labelled documents (those of least id hash, within the bytes of training_sample()).

Defined results: null and empty texts have no tokens, posteriors that the classifier gives to nothing, and a rate all the same; without labels every
posterior is uniform; a domain without tokens keeps its target unmet, which is flagged, the others' targets are met; a label row without
toxic or quality counts as 0 and 1; repeated rows are each rated; a null id is rated like any text; an empty table gives an empty result;
other columns are ignored by rates() and kept by apply_rates().
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, give_back, lean, slices, training_sample
from .style import N_STYLE, style

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.94, "low": 0.03, "toxic": 0.03}
SAMPLE, BITS, STEPS, TOLERANCE = 8000, 17, 24, 0.01
_LEVELS = np.array([0.01, 0.03, 0.1, 0.3, 0.6, 1.0, 2.0])


def terms(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term) pairs, each once, in order of text, and words per text. The first terms are levels of style."""
    w = Words(texts)
    look = np.searchsorted(_LEVELS, style(texts, w)) + np.arange(N_STYLE) * 8
    n = len(texts)
    doc = np.concatenate([w.text, np.repeat(np.arange(n), N_STYLE)])
    term = np.concatenate([(w.hash >> np.uint64(64 - bits)).astype(np.int64) | 1 << bits, look.reshape(-1)])
    key = np.unique(doc * (2 << bits) + term)
    return key >> (bits + 1), key & ((2 << bits) - 1), np.diff(w.first)


@dataclass
class Classifier:
    weight: np.ndarray
    bias: np.ndarray
    bits: int

    def posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        doc, term, n = terms(texts, self.bits)
        z = np.stack([np.bincount(doc, weights=self.weight[term, k], minlength=len(texts)) for k in range(self.weight.shape[1])], axis=1) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), n


def labelled(documents: DataFrame, labels: DataFrame, sample: int) -> Iterator[tuple]:
    """(id, text, number of the domain) of the bounded sample."""
    y = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min(F.coalesce("quality", F.lit(1))).alias("q"))
    y = y.select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("y"))
    return ((r["doc_id"], r["text"] or "", r["y"]) for r in training_sample(documents, y, sample))


def fit(rows: Iterable[tuple], bits: int = BITS, epochs: int = 30, sparsity: float = 2e-4) -> Classifier:
    """Multinomial logistic regression by Adagrad with soft thresholding. Only terms of few and several documents count. Of rows no more than 200 texts are held at once."""
    k = len(DOMAINS)
    weight, bias = np.zeros((2 << bits, k)), np.zeros(k)
    docs, ts, labels = [], [], []
    for part in batched(rows, 200):
        d, t, _ = terms(pa.array([r[1] for r in part], pa.string()), bits)
        docs.append((d + len(labels)).astype(np.int32))
        ts.append(t.astype(np.int32))
        labels += [r[2] for r in part]
    if not labels:
        return Classifier(weight, bias, bits)
    doc, term, label = np.concatenate(docs), np.concatenate(ts), np.array(labels)
    del docs, ts
    seen = np.bincount(term, minlength=2 << bits)
    fit_for = (seen >= 4) & ((seen <= 0.2 * len(labels)) | (np.arange(2 << bits) < N_STYLE * 8))
    keep = fit_for[term]
    doc, term = doc[keep], term[keep]
    used, term = np.unique(term, return_inverse=True)
    w = np.zeros((len(used), k))
    squares, bias_squares = np.full_like(w, 1e-2), np.full(k, 1e-2)
    first = np.searchsorted(doc, np.arange(len(labels) + 1))
    order = np.random.default_rng(3).permutation(len(labels))
    for _ in range(epochs):
        for part in np.array_split(order, max(1, len(labels) // 250)):
            sizes = first[part + 1] - first[part]
            own = np.repeat(np.arange(len(part)), sizes)
            mine = term[np.repeat(first[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            z = np.stack([np.bincount(own, weights=w[mine, j], minlength=len(part)) for j in range(k)], axis=1) + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label[part]] -= 1
            p /= len(part)
            touched, inverse = np.unique(mine, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=p[own, j], minlength=len(touched)) for j in range(k)], axis=1)
            squares[touched] += g * g
            rate = 0.1 / np.sqrt(squares[touched])
            new = w[touched] - rate * g
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
            g = p.sum(axis=0)
            bias_squares += g * g
            bias -= 0.1 / np.sqrt(bias_squares) * g
    weight[used] = w
    return Classifier(weight, bias, bits)


def memberships(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens (words) and a posterior per domain, p_<domain>."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled(documents, labels, sample)))
    give_back()  # what fitting took of the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p, n = model.value.posterior(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64))] + [pa.array(p[:, j]) for j in range(p.shape[1])], names=["doc_id", "n_tokens"] + [f"p_{d}" for d in DOMAINS])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "doc_id bigint, n_tokens bigint" + "".join(f", p_{d} double" for d in DOMAINS))


@dataclass
class Fit:
    """rate: an expression over rows of members. wanted: totals of the domains that have a target; expected: totals of all domains at these rates."""

    rate: F.Column
    wanted: dict[str, float]
    expected: dict[str, float]

    def met(self, tolerance: float = TOLERANCE) -> bool:
        """Whether every target is met to a share of all wanted tokens."""
        return all(abs(self.expected[d] - w) <= tolerance * sum(self.wanted.values()) for d, w in self.wanted.items())


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "clean", total: float | None = None, steps: int = STEPS) -> Fit:
    """Rates of the rows of members. Each step is one aggregation of a number per domain and pair of domains.

    A target is a domain's share of the tokens of all domains that have one; it must be above zero, as soft posteriors give every domain some tokens. Domains without one are free.
    """
    if anchor not in targets or min(targets.values()) <= 0 or not set(targets) <= set(DOMAINS):
        raise ValueError("targets must be above zero, of known domains, and hold the anchor")
    names = [d for d in DOMAINS if d in targets]
    p = [F.col(f"p_{d}") for d in names]
    t = F.col("n_tokens")
    k = len(names)

    def rate_of(steps: list[np.ndarray]) -> F.Column:
        """The rate after some steps from 1. One expression whose size doesn't grow with the steps, which are a literal."""
        if not steps:
            return F.lit(1.0)
        taken = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
        return F.aggregate(taken, F.lit(1.0), lambda r, step: F.greatest(F.lit(0.0), r - sum(p[j] * step[j] for j in range(k))))

    def sums(steps: list[np.ndarray], tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, dict[str, float]]]:
        """After the steps and each of the tries: the expected totals, the second moments of the rows whose rate is above zero, and all domains' totals; in one pass."""
        rows = members.select("n_tokens", *[f"p_{d}" for d in DOMAINS], rate_of(steps).alias("_r"))
        rows = rows.select("n_tokens", *[f"p_{d}" for d in DOMAINS], *[F.greatest(F.lit(0.0), F.col("_r") - sum(p[j] * float(x[j]) for j in range(k))).alias(f"_r{c}") for c, x in enumerate(tries)])
        wanted = []
        for c in range(len(tries)):
            r = F.col(f"_r{c}")
            wanted += [F.sum(t * F.col(f"p_{d}") * r).alias(f"e{c}_{d}") for d in DOMAINS]
            wanted += [F.sum(F.when(r > 0, t * p[i] * p[j])).alias(f"g{c}_{i}_{j}") for i in range(k) for j in range(i, k)]
        found = rows.agg(*wanted).first()
        out = []
        for c in range(len(tries)):
            every = {d: found[f"e{c}_{d}"] or 0.0 for d in DOMAINS}
            gram = np.array([[found[f"g{c}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
            out.append((np.array([every[d] for d in names]), gram, every))
        return out

    taken: list[np.ndarray] = []
    best = sums(taken, [np.zeros(k)])[0]
    share = np.array([targets[d] for d in names], float)
    share = share / share.sum()
    a = names.index(anchor)
    want = share * (total if total is not None else best[0][a] / share[a])
    safe = 1 / max(np.linalg.eigvalsh(best[1])[-1], 1e-300)
    scaled, plain = 1.0, 1.0
    for _ in range(steps):
        miss = best[0] - want
        if np.abs(miss).sum() <= 1e-4 * max(want.sum(), 1):
            break
        # The gradient itself, and in the metric of the rows whose rate is above zero, each at a few lengths; the best of all is taken.
        ahead = np.linalg.pinv(best[1], rcond=1e-9, hermitian=True) @ miss
        tries = [(True, z, z * ahead) for z in (scaled, scaled / 4)] + [(False, z, z * safe * miss) for z in (plain / 4, plain, plain * 4)]
        found = sums(taken, [step for _, _, step in tries])
        off = [((now[0] - want) ** 2).sum() for now in found]
        c = int(np.argmin(off))
        if off[c] >= (miss**2).sum():
            scaled, plain = scaled / 16, plain / 16
            continue
        taken.append(tries[c][2])
        best = found[c]
        if tries[c][0]:
            scaled = min(1.0, 2 * tries[c][1])
        else:
            plain = tries[c][1]
    return Fit(rate_of(taken), dict(zip(names, want.tolist())), best[2])


def copies_of(rate: F.Column, key: F.Column, seed: int = 11) -> F.Column:
    """How often a document is drawn: the rate, rounded up or down by a hash of its key so that the mean is the rate."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + u).cast("int")


def rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every document, and on each row whether the targets are met; if not, a warning tells by how much."""
    members = cut(memberships(documents, labels))
    found = fit_rates(members, targets, **options)
    if not found.met():
        warnings.warn(f"mixing targets are not met: wanted {found.wanted}, expected {found.expected}", stacklevel=2)
    return members.withColumn("rate", found.rate).withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"))).withColumn("targets_met", F.lit(found.met()))


def apply_rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """The documents, each as often as its rate says, with their columns. Rows with a null id are drawn by the hash of null."""
    rated = rates(documents, labels, targets, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    joined = documents.join(rated, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")))
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(documents.columns)
