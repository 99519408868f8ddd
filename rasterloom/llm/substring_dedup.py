"""Removal of repeated word spans by compacting a De Bruijn graph of the corpus.

The graph's edges are windows (k-mers) of 20 words, its nodes the 19 words that two neighbouring windows share. As the graph of all
windows would be larger than the corpus, only what can repeat enters it: a window belongs to the least-hashed of its
fifteen six-word k-mers, windows of one such k-mer in a row travel as one piece, and pieces whose k-mer is in one
document only are dropped. A k-mer whose pieces are all alike keeps them whole; where they differ (copies begin, end or
part there) each distinct piece is opened up into its windows. Pieces and windows of several documents are the graph's elements.

Of each element all successors and predecessors are counted over the documents that hold it, an end of the repeat being one of its own. Where an element has
one successor and that one has it as only predecessor, the node between them does not branch and both have the same documents. Such paths are compacted by
pointer doubling: each round joins every element's pointer with the pointer of the element it points at, so a path of n elements
takes log2(n) joins. A compacted path is one span in every document that holds it. The source is the document of
least id; a 128-bit cryptographic hash of the words at the source's coordinates is joined to the other documents' spans, and
a span is removed only if the words at its own coordinates hash alike. Repeats within a text are found and compared there.

Defined results: null or empty text has no words and gives the digest of the empty text; a null id ranks
before all others; rows that share an id count as one document, so that none removes from another
by id order, while each removes its own later repeats; an empty table gives an empty result; other columns
are ignored. No cap holds anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, combine, cut, doc_key, drop, from_key, mix, runs, slices

WINDOW, EDGE = 20, 6
_U = np.uint64


class Pieces:
    """The pieces of a slice of texts: windows low..high (first words) of the k-mer at word mid."""

    def __init__(self, texts: pa.Array, window: int, edge: int) -> None:
        self.words = w = Words(texts)
        n = len(w.hash)
        none = np.zeros(0, np.int64)
        self.low = self.high = self.mid = self.text = none
        self.edge = self.piece = none.astype(np.uint64)
        if n < window:
            return
        best = runs(w.hash, edge)
        at = np.arange(len(best))
        # Leftmost least k-mer of each window, by doubling the span looked at.
        span, want, least, where = 1, window - edge + 1, best, at
        while span < want:
            step = min(span, want - span)
            left, right = least[: len(least) - step], least[step:]
            take = right < left
            least, where = np.where(take, right, left), np.where(take, where[step:], where[: len(where) - step])
            span += step
        ok = np.flatnonzero(w.text[: n - window + 1] == w.text[window - 1 :])
        if not len(ok):
            return
        mid, text = where[ok], w.text[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (mid[1:] != mid[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.low = ok[first]
        self.high = ok[np.append(first[1:], len(ok)) - 1]
        self.mid, self.text = mid[first], text[first]
        self.edge = best[self.mid]
        # The first and the last window hold all words of a piece, as it has no more than two windows' words.
        whole = runs(w.again(1), window)
        shape = (self.mid - self.low).astype(np.uint64) * _U(1024) + (self.high - self.low).astype(np.uint64)
        self.piece = combine(combine(whole[self.low], whole[self.high]), mix(shape + _U(1)))


# A place packs a tag of the row (22 bits; tells rows apart that share an id), the k-mer's word (30 bits), words before it (5 bits) and windows less one (6 bits).
def _pack(tag: np.ndarray, mid: np.ndarray, before: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (tag << 41) | (mid << 11) | (before << 6) | length


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """The first row of each distinct tuple of keys, in order of rows."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return np.sort(order[new])


def _pieces_of(window: int, edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Pieces(part.column("text"), window, edge)
                if not len(p.low):
                    continue
                # Of a piece that a text holds several times, the first counts; the others are the text's own business.
                keep = _firsts(p.piece, p.edge, p.text)
                owner = p.text[keep]
                tag = part.column("tag").to_numpy()[owner]
                doc = part.column("d").to_numpy()[owner]
                where = _pack(tag, p.mid[keep] - p.words.first[owner], p.mid[keep] - p.low[keep], p.high[keep] - p.low[keep])
                yield pa.RecordBatch.from_arrays([pa.array(p.edge[keep].view(np.int64)), pa.array(p.piece[keep].view(np.int64)), pa.array(doc), pa.array(where)], names=["edge", "piece", "d", "at"])

    return run


def _windows_of(window: int, edge: int):
    """Windows of the pieces asked for (asked: their places), each of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                edges, whole = runs(w.hash, edge), runs(w.again(1), window)
                asked = part.column("asked")
                row = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                at = asked.flatten().to_numpy()
                order = np.lexsort((at, row))  # by place, so that the first of equal windows stays
                row, at = row[order], at[order]
                mid, before, length = (at >> 11) & (2**30 - 1), (at >> 6) & 31, at & 63
                each = np.repeat(np.arange(len(at)), length + 1)
                step = np.arange(len(each)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
                start = (mid - before)[each] + step
                owner = row[each]
                key, own = edges[w.first[owner] + mid[each]], whole[w.first[owner] + start]
                keep = _firsts(own, key, owner)
                key, own, owner, start = key[keep], own[keep], owner[keep], start[keep]
                none = np.zeros_like(start)
                where = _pack(part.column("tag").to_numpy()[owner], start, none, none)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(part.column("d").to_numpy()[owner]), pa.array(where)], names=["edge", "piece", "d", "at"])

    return run


def _digest(raw: memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, digest) of the spans asked for: the words at the source's coordinates."""
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            raw, at, end = w.joined()
            view = memoryview(raw)
            asked = part.column("asked")
            spans = asked.flatten()
            base = w.first[np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))]
            low = base + spans.field("low").to_numpy()
            high = low + spans.field("n").to_numpy() - 1
            yield pa.RecordBatch.from_arrays([spans.field("path"), pa.array([_digest(view[a:b]) for a, b in zip(at[low].tolist(), end[high].tolist())], pa.binary())], names=["path", "digest"])


def _own_repeats(w: Words, window: int, raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First words of the windows that occur earlier in the same text, compared word by word."""
    n = len(w.hash)
    if n < window:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(w.text[: n - window + 1] == w.text[window - 1 :])
    key, text = runs(w.hash, window)[start], w.text[start]
    order = np.lexsort((start, key, text))
    k, t = key[order], text[order]
    again = np.zeros(len(order), bool)
    again[1:] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    view = memoryview(raw)
    found, before = start[order[again]], start[order[np.flatnonzero(again) - 1]]
    same = [view[a:b] == view[c:d] for a, b, c, d in zip(at[found].tolist(), end[found + window - 1].tolist(), at[before].tolist(), end[before + window - 1].tolist())]
    return found[np.array(same, bool)] if same else found


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                raw, at, end = w.joined()
                view = memoryview(raw)
                cover = np.zeros(len(w.hash) + 1, np.int64)
                own = _own_repeats(w, window, raw, at, end)
                np.add.at(cover, own, 1)
                np.add.at(cover, own + window, -1)
                asked = part.column("gone")
                spans = asked.flatten()
                low = w.first[np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))] + spans.field("low").to_numpy()
                high = low + spans.field("n").to_numpy()
                if len(low):
                    same = np.array([_digest(view[a:b]) == x for a, b, x in zip(at[low].tolist(), end[high - 1].tolist(), spans.field("digest").to_pylist())], bool)
                    np.add.at(cover, low[same], 1)
                    np.add.at(cover, high[same], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept_text, digests = [], []
                for i in range(part.num_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if gone[a:b].any():
                        live = np.flatnonzero(~gone[a:b]) + a
                        text = b" ".join([view[s:e] for s, e in zip(at[live].tolist(), end[live].tolist())])
                    else:
                        text = bytes(view[at[a] : end[b - 1]]) if b > a else b""
                    kept_text.append(text.decode("utf-8", "replace"))
                    digests.append(hashlib.sha256(text).hexdigest())
                n = np.diff(w.first)
                total = np.append(0, np.cumsum(gone))
                removed = total[w.first[1:]] - total[w.first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests, pa.string()), pa.array(kept_text, pa.string())], names=["d", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def compacted(links: DataFrame) -> DataFrame:
    """(v, root) for links (u, v) of paths without branches or cycles: root is the path's first element. Pointer doubling, a join a round."""
    paths = cut(links.select("v", F.col("u").alias("root"), F.lit(False).alias("done")))
    n = paths.count()
    while not (live := paths.where("NOT done")).isEmpty():
        ahead = paths.select(F.col("v").alias("at"), F.col("root").alias("to"))
        moved = live.join(ahead, live["root"] == ahead["at"], "left").select("v", F.coalesce("to", "root").alias("root"), F.col("to").isNull().alias("done"))
        after = cut(paths.where("done").unionByName(moved), n)
        drop(paths)
        paths = after
    return paths.select("v", "root")


def elements(docs: DataFrame, window: int, edge: int) -> DataFrame:
    """(id, d, tag, single, low, high) of the graph's elements in every document: the windows low..high. single: an opened window."""
    pieces = docs.mapInArrow(_pieces_of(window, edge), "edge bigint, piece bigint, d bigint, at bigint")
    met = pieces.groupBy("edge").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("edge")
    hit = cut(pieces.join(met, "edge"))
    kinds = cut(hit.groupBy("edge", "piece").agg(F.min("d").alias("lead"), F.max("d").alias("last")))
    forks = kinds.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1").select("edge", F.lit(True).alias("fork"))
    met = cut(hit.join(kinds.join(forks, "edge", "left"), ["edge", "piece"]).where("fork OR lead < last"))
    drop(hit, kinds)
    hit = met
    at = F.col("at")
    tag = F.shiftright(at, 41)
    asked = hit.where("fork AND d = lead").groupBy("d", tag.alias("tag")).agg(F.collect_list("at").alias("asked"))
    opened = cut(docs.join(asked, ["d", "tag"]).select("d", "tag", "text", "asked").mapInArrow(_windows_of(window, edge), "edge bigint, piece bigint, d bigint, at bigint"))
    seen = opened.groupBy("edge", "piece").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("edge", "piece")
    low = F.shiftright(at, 11).bitwiseAND(2**30 - 1) - F.shiftright(at, 6).bitwiseAND(31)

    def shaped(rows: DataFrame, single: bool) -> DataFrame:
        key = F.xxhash64("edge", "piece", F.lit(single))
        return rows.select(key.alias("id"), "d", tag.alias("tag"), F.lit(single).alias("single"), low.alias("low"), (low + at.bitwiseAND(63)).alias("high"))

    found = cut(shaped(hit.where("lead < last"), False).unionByName(shaped(opened.join(seen, ["edge", "piece"]), True)))
    drop(hit, opened)
    return found


def unbranched(found: DataFrame) -> DataFrame:
    """Links (u, v) over nodes that do not branch: v is what follows u, and u what precedes v, in every document that holds them."""
    order = W.partitionBy("d", "tag", "single").orderBy("low")

    def beside(step, touches: Column) -> Column:
        return F.coalesce(F.when(touches, step("id").over(order)), F.lit(0))  # 0: an end of the repeat

    near = found.select("id", beside(F.lead, F.lead("low").over(order) == F.col("high") + 1).alias("after"), beside(F.lag, F.lag("high").over(order) == F.col("low") - 1).alias("before"))
    nodes = cut(near.groupBy("id").agg(F.min("after").alias("a0"), F.max("after").alias("a1"), F.min("before").alias("b0"), F.max("before").alias("b1")))
    out = nodes.where("a0 = a1 AND a0 <> 0").select(F.col("id").alias("u"), F.col("a0").alias("v"))
    into = nodes.where("b0 = b1 AND b0 <> 0").select(F.col("b0").alias("u"), F.col("id").alias("v"))
    return out.join(into, ["u", "v"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """(d, tag, low, n, digest): spans of n words that a document of smaller id holds too, and the hash of the words there."""
    found = elements(docs, window, edge)
    roots = compacted(unbranched(found))
    whole = found.join(roots, found["id"] == roots["v"], "left").groupBy("d", "tag", F.coalesce("root", "id").alias("path"))
    whole = cut(whole.agg(F.min("low").alias("low"), (F.max("high") - F.min("low") + window).alias("n")))
    drop(found)
    lead = whole.groupBy("path").agg(F.min("d").alias("lead"), F.max("d").alias("last")).where("lead < last").select("path", "lead")
    spans = cut(whole.join(lead, "path"))
    drop(whole)
    asked = spans.where("d = lead").groupBy("d", "tag").agg(F.collect_list(F.struct("path", "low", "n")).alias("asked"))
    source = cut(docs.join(asked, ["d", "tag"]).select("text", "asked").mapInArrow(_sources, "path bigint, digest binary").distinct())
    return spans.where("d > lead").join(source, "path").select("d", "tag", "low", "n", "digest")


def remove_repeats(documents: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: each word covered by a window whose words also start earlier is removed."""
    if not edge <= window <= 20 or window - edge > 14:
        raise ValueError("a packed place holds windows of 20 words at most and 15 k-mers")
    docs = documents.select(doc_key("doc_id").alias("d"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 42).alias("tag"), "text")
    spans = repeated_spans(docs, window, edge).groupBy("d", "tag").agg(F.collect_list(F.struct("low", "n", "digest")).alias("gone"))
    none = F.array().cast("array<struct<low:bigint,n:bigint,digest:binary>>")
    rows = docs.join(spans, ["d", "tag"], "left").select("d", "text", F.coalesce("gone", none).alias("gone"))
    done = rows.mapInArrow(_cut_out(window), "d bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return done.select(from_key("d").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS k, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rn, k, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
v AS (SELECT rn, k, i, list_aggregate(w[i:i+19], 'string_agg', ' ') AS s FROM p),
f AS (SELECT rn, i, k > min(k) OVER (PARTITION BY s) OR row_number() OVER (PARTITION BY s, rn ORDER BY i) > 1 AS again FROM v),
g AS (SELECT DISTINCT rn, unnest(range(i, i + 20)) AS i FROM f WHERE again),
x AS (SELECT d.rn, u.i, d.w[u.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) u),
y AS (SELECT x.rn, count(g.i) AS n_removed, string_agg(x.word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g USING (rn, i) GROUP BY x.rn)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(y.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (rn)"""
