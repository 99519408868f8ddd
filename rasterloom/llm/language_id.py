"""Language of words and texts by a linear-chain conditional random field.

A word's features are its affixes, its character bigrams and trigrams with boundary marks, hashed, and its entry in a lexicon of frequent
training words. Transitions between the labels of neighbouring words are learned with them. Forward-backward gives every word's label posterior,
so a text may switch language within; a text's language is the label with the largest sum of posteriors over its words with letters, and its score that
sum's mean.

Chains are cut into blocks of 32 words whose transfer matrices are multiplied, so whole texts of any length are summed
exactly and many blocks at once.

Training takes the whole texts of at most `sample` documents with a language (those of least id hash, within the bytes of training_sample()), in sequences of at most 64 words; every third
sequence is joined with one of another document, so that transitions see changes of language.

Defined results: null text, and text without a letter, is `und` with score 0; a null id is predicted like any other (held_out null); without training rows
every text is `und`; ties go to the first label in order; repeated rows are each predicted; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix, slices, training_sample, words

SAMPLE, BINS, LEXICON, BLOCK, KEPT = 1200, 1 << 16, 4000, 32, 300_000
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&+=/\\-_~`^@0123456789"
UNKNOWN = "und"


def features_of(words_: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of bare words in lower case, word by word, and how many each has."""
    marked = [f"<{w}>".encode() for w in words_]
    size = np.array([len(m) for m in marked], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(marked) + bytes(8), np.uint8)
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))  # eight bytes from every place

    def numbers(at: np.ndarray, length: int, kind: int) -> np.ndarray:
        packed = (lanes[at] & np.uint64((1 << 8 * length) - 1)) | np.uint64(kind << 56)
        return (mix(packed) & np.uint64(BINS - 1)).astype(np.int64)

    found, owner = [], []
    for k in (2, 3, 4):
        count = np.maximum(size - k + 1, 0)
        own = np.repeat(np.arange(len(size)), count)
        found.append(numbers(start[own] + np.arange(len(own)) - (np.cumsum(count) - count)[own], k, k))
        owner.append(own)
    for k in (3, 5):
        own = np.flatnonzero(size > k)
        found += [numbers(start[own], k, 16 + k), numbers(start[own] + size[own] - k, k, 32 + k)]
        owner += [own, own]
    known = [(i, lexicon[w]) for i, w in enumerate(words_) if w in lexicon]
    if known:
        own, entry = np.array(known, np.int64).T
        found.append(BINS + entry)
        owner.append(own)
    by = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[by], np.bincount(np.concatenate(owner), minlength=len(size))


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    return features_of([word], lexicon)[0].tolist()


def bare(word: str) -> str:
    return word.strip(_STRIP).lower()


def forward_backward(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label posteriors of the words of several chains: emission and the result are words x labels, chain i has the rows first[i] to first[i + 1].

    emission and trans are positive potentials; the label before a chain's first word is uniform.
    """
    n, k = emission.shape
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    offset = np.append(0, np.cumsum(blocks))
    m = int(offset[-1])
    if not m:
        return np.zeros((n, k))
    owner = np.repeat(np.arange(len(count)), blocks)
    start = first[owner] + (np.arange(m) - offset[owner]) * BLOCK
    length = np.minimum(BLOCK, first[owner + 1] - start)
    at = np.minimum(start[:, None] + np.arange(BLOCK), n - 1)
    live = np.arange(BLOCK) < length[:, None]
    e = emission[at]
    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(BLOCK):
        new = (product.reshape(-1, k) @ trans).reshape(m, k, k) * e[:, t, None, :]
        product = np.where(live[:, t, None, None], new, product)
        if t % 4 == 3:
            product /= product.sum(axis=(1, 2), keepdims=True)
    # Along the blocks of all chains at once, those with most blocks first.
    order = np.argsort(-blocks, kind="stable")
    lengths = blocks[order]
    into, after = np.zeros((m, k)), np.zeros((m, k))
    a = np.full((len(count), k), 1.0 / k)
    for j in range(int(lengths[0])):
        act = order[: np.searchsorted(-lengths, -j, "left")]
        own = offset[act] + j
        into[own] = a[act]
        new = np.einsum("ni,nij->nj", a[act], product[own])
        a[act] = new / new.sum(axis=1, keepdims=True)
    b = np.full((len(count), k), 1.0 / k)
    for j in range(int(lengths[0]) - 1, -1, -1):
        act = order[: np.searchsorted(-lengths, -j, "left")]
        own = offset[act] + j
        after[own] = b[act]
        new = np.einsum("nij,nj->ni", product[own], b[act])
        b[act] = new / new.sum(axis=1, keepdims=True)
    alpha = np.empty((BLOCK, m, k))
    state = into
    for t in range(BLOCK):
        new = (state @ trans) * e[:, t]
        new /= new.sum(axis=1, keepdims=True)
        state = np.where(live[:, t, None], new, state)
        alpha[t] = state
    out = np.empty((n, k))
    state = after
    for t in range(BLOCK - 1, -1, -1):
        row = live[:, t]
        both = alpha[t] * state
        out[at[row, t]] = both[row] / both[row].sum(axis=1, keepdims=True)
        new = (e[:, t] * state) @ trans.T
        new /= new.sum(axis=1, keepdims=True)
        state = np.where(row[:, None], new, state)
    return out


@dataclass
class Field:
    labels: list[str]
    weight: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, int]
    seen: dict[str, int] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    used: int = 1

    def _learn(self, new: list[str]) -> None:
        """Emission rows of words not met before; row 0 is that of words without letters."""
        k = len(self.labels)
        if self.table is None or len(self.seen) + len(new) > KEPT:
            self.seen, self.rows, self.table, self.used = {}, {}, np.ones((1024, k)), 1
        fresh: list[str] = []
        for w in new:
            b = bare(w)
            if not b.isalpha() and not any(map(str.isalpha, b)):
                self.seen[w] = 0
                continue
            row = self.rows.get(b)
            if row is None:
                row = self.rows[b] = self.used + len(fresh)
                fresh.append(b)
            self.seen[w] = row
        if not fresh:
            return
        parts = []
        for i in range(0, len(fresh), 20_000):  # their features are held no longer than needed
            flat, sizes = features_of(fresh[i : i + 20_000], self.lexicon)
            parts.append(np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes, axis=0))
        score = np.concatenate(parts)
        score = np.clip(score - score.max(axis=1, keepdims=True), -30, 0)
        end = self.used + len(fresh)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.ones((max(end, 2 * len(self.table)) - len(self.table), k))])
        self.table[self.used : end] = np.exp(score)
        self.used = end

    def posteriors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of all words, whether each has letters, and where each text's words begin."""
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=first[1:])
        flat = [w for x in texts for w in x]
        new = set(flat).difference(self.seen)
        if new or self.table is None:
            self._learn(sorted(new))
            if missing := set(flat).difference(self.seen):  # the store was emptied
                self._learn(sorted(missing))
        row = np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))
        return forward_backward(self.table[row], first, np.exp(self.trans)), row > 0, first

    def predict(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p, letter, first = self.posteriors(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))[letter]
        total = np.stack([np.bincount(owner, weights=p[letter, j], minlength=len(texts)) for j in range(len(self.labels))], axis=1)
        n = total.sum(axis=1)
        best = total.argmax(axis=1)
        score = np.where(n > 0, total[np.arange(len(texts)), best] / np.maximum(n, 1e-12), 0).clip(0, 1)
        return [self.labels[b] if c > 0 else UNKNOWN for b, c in zip(best, n)], score


def fit(rows: list[tuple[list[str], str]], epochs: int = 3, seed: int = 7) -> Field:
    """Trains on (words, language) rows by Adagrad on the conditional likelihood."""
    labels = sorted({y for _, y in rows})
    k = len(labels)
    if not labels:
        return Field([], np.zeros((BINS, 0)), np.zeros((0, 0)), {})
    number = {y: i for i, y in enumerate(labels)}
    times: Counter[str] = Counter()
    sequences: list[tuple[list[str], list[int]]] = []
    for w, y in rows:
        w = [b for b in map(bare, w) if any(map(str.isalpha, b))]
        times.update(w)
        sequences += [(w[i : i + 64], [number[y]] * len(w[i : i + 64])) for i in range(0, len(w), 64)]
    lexicon = {w: i for i, (w, n) in enumerate(sorted(times.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n > 2}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sequences))
    mixed = []
    for i in range(0, len(order), 3):
        group = [sequences[j] for j in order[i : i + 3]]
        if len(group) == 3:
            cut_a, cut_b = len(group[0][0]) // 2, len(group[1][0]) // 2
            group[0] = (group[0][0][:cut_a] + group[1][0][cut_b:], group[0][1][:cut_a] + group[1][1][cut_b:])
        mixed += [g for g in group if g[0]]
    number_of = {w: i for i, w in enumerate(times)}
    flat, sizes = features_of(list(times), lexicon)
    begin = np.cumsum(sizes) - sizes
    weight, trans = np.zeros((BINS + LEXICON, k)), np.zeros((k, k))
    squares, trans_squares = np.full_like(weight, 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        rng.shuffle(mixed)
        for at in range(0, len(mixed), 256):
            batch = sorted(mixed[at : at + 256], key=lambda s: -len(s[0]))
            n, steps = len(batch), len(batch[0][0])
            ids, y, live = np.zeros((n, steps), np.int64), np.zeros((n, steps), np.int64), np.zeros((n, steps), bool)
            for i, (w, own) in enumerate(batch):
                ids[i, : len(w)] = [number_of[x] for x in w]
                y[i, : len(w)] = own
                live[i, : len(w)] = True
            used, inverse = np.unique(ids[live], return_inverse=True)
            rows_of = np.repeat(begin[used] - np.cumsum(sizes[used]) + sizes[used], sizes[used]) + np.arange(sizes[used].sum())
            feats, owner = flat[rows_of], np.repeat(np.arange(len(used)), sizes[used])
            z = np.stack([np.bincount(owner, weights=weight[feats, j], minlength=len(used)) for j in range(k)], axis=1)
            z = np.exp(np.clip(z - z.max(axis=1, keepdims=True), -30, 0))
            e = np.ones((n, steps, k))
            e[live] = z[inverse]
            t = np.exp(trans)
            alpha, beta = np.empty((steps, n, k)), np.empty((steps, n, k))
            state = np.full((n, k), 1.0 / k)
            for s in range(steps):
                new = (state @ t) * e[:, s]
                state = np.where(live[:, s, None], new / new.sum(axis=1, keepdims=True), state)
                alpha[s] = state
            state = np.full((n, k), 1.0 / k)
            for s in range(steps - 1, -1, -1):
                beta[s] = state
                new = (e[:, s] * state) @ t.T
                state = np.where(live[:, s, None], new / new.sum(axis=1, keepdims=True), state)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            g_trans = np.zeros((k, k))
            before = np.full((n, k), 1.0 / k)
            for s in range(steps):
                pair = before[:, :, None] * t * (e[:, s] * beta[s])[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                g_trans += pair[live[:, s]].sum(axis=0)
                before = alpha[s]
            seen = live[:, 1:]
            np.add.at(g_trans, (y[:, :-1][seen], y[:, 1:][seen]), -1)
            # The label before the first word is uniform in what is observed, too.
            np.add.at(g_trans, (slice(None), y[:, 0]), -1.0 / k)
            g = p.transpose(1, 0, 2)[live]
            g[np.arange(len(g)), y[live]] -= 1
            by_word = np.stack([np.bincount(inverse, weights=g[:, j], minlength=len(used)) for j in range(k)], axis=1)
            touched, back = np.unique(feats, return_inverse=True)
            g = np.stack([np.bincount(back, weights=by_word[owner, j], minlength=len(touched)) for j in range(k)], axis=1) / n
            g += 1e-4 * weight[touched]
            squares[touched] += g * g
            weight[touched] -= 0.2 / np.sqrt(squares[touched]) * g
            g_trans = g_trans / n + 1e-4 * trans
            trans_squares += g_trans * g_trans
            trans -= 0.2 / np.sqrt(trans_squares) * g_trans
    return Field(labels, weight, trans, lexicon)


def training_rows(documents: DataFrame, held_mod: int, held_rest: int, sample: int) -> list[tuple[list[str], str]]:
    """The bounded training sample: of the documents that are not held out and have a language, those of least id hash."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", held_mod) != held_rest))
    return [(words(r["text"]), r["y"]) for r in training_sample(rows.select("doc_id", "text", F.col("lang").cast("string").alias("y")), None, sample)]


def predict_languages(documents: DataFrame, held_mod: int = 4, held_rest: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(training_rows(documents, held_mod, held_rest, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 21):
                lang, score = model.value.predict([words(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod("doc_id", held_mod) == held_rest).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def label_words(model: Field, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of one text; words without letters take the label that their neighbours make likeliest."""
    w = words(text)
    if not w or not model.labels:
        return []
    p, _, _ = model.posteriors([w])
    return [(x, model.labels[int(q.argmax())], float(q.max())) for x, q in zip(w, p)]
