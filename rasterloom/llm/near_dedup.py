"""Near-duplicate classes of documents: DartMinHash signatures, banded joins, exact verification.

A text is the weighted set of its five-word shingles, each weighing as often as it occurs (with weighted=False, 1); a text
of one to four words has one shingle, the whole text. Similarity is the weighted Jaccard similarity: the sum of the lesser over the
sum of the greater weights. Darts are thrown at the plane of element x weight x rank: every
unit cell of (element, weight, rank) holds a Poisson(1) number of darts whose places are hashes of the cell alone,
so two texts that share a region share its darts. Darts outside the text's own region (weight above the element's,
rank above the limit) are dropped, each of the rest hits one of k coordinates by hash, and a coordinate keeps its dart of
least rank. The limit makes about k ln k + 2k darts however large the text, and is doubled for a text
that leaves a coordinate empty. Two signatures agree in a coordinate with probability equal to the similarity.

Candidates share a band of `rows` coordinates. Copies of one word sequence (by 128 bits of a cryptographic hash of the words) are
collapsed first; then each member of a bucket is compared with its first document. While buckets hold several classes, `STARS` rounds
compare each member with one hashed pivot of another class in its bucket; a round's rows are linear in the buckets. Members still
apart after that meet in blocks bounded in texts and bytes, so no candidate link is left out, no bucket of one class is ever paired up, and no pairs of a
group become rows; the blocks of what is left meet each other, which is quadratic in blocks for a group whose members agree in
bands without being similar.
Every link is verified on the whole texts: similarity at or above the threshold.
At 50 bands of 7 a pair at similarity 0.8 is missed with probability 8e-6.

Defined results: null, empty and wordless texts have no shingles and are classes of their own; documents of equal words are
one class; class_id is the least doc_id of the class; rows with a null id take no part, have a null class and
are first; repeated rows are each returned; rows that share an id are one document, so the classes of its texts are one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Words, combine, cut, drop, lean, mix, runs, slices

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 50, 7
#: Rounds of pivots; texts and bytes of text in a block of what they leave.
STARS, BLOCK, BLOCK_BYTES = 2, 256, 1 << 20
_U = np.uint64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_STEP = _U(0xD1B54A32D192ED03)


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hash, text) of each shingle, repeats included, and the words."""
    w = Words(texts)
    n = len(w.hash)
    count = np.diff(w.first)
    full = np.flatnonzero(w.text[: max(0, n - width + 1)] == w.text[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    found, owner = [runs(w.hash, width)[full]], [w.text[full]]
    for k in range(1, width):
        few = np.flatnonzero(count == k)
        if len(few):
            found.append(runs(w.hash, k)[w.first[few]])
            owner.append(few)
    return np.concatenate(found), np.concatenate(owner), w


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) in order of text, with counts."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def elements(hashes: np.ndarray, text: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (element, text) in order of text whose plain Jaccard similarity is the weighted one: the i-th of equal shingles is an element of its own."""
    h, t, count = distinct(hashes, text)
    if not weighted:
        return h, t
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    h, t = np.repeat(h, count), np.repeat(t, count)
    return np.where(nth > 0, combine(h, nth.astype(np.uint64)), h), t


def dart_signatures(hashes: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """Signatures (n_texts x k) of weighted sets given as rows of (element hash, text, weight > 0), grouped by text.

    A value packs a dart's rank (32 bits) and identity (32 bits). Texts without elements keep the largest value throughout.
    """
    empty = np.iinfo(np.uint64).max
    sig = np.full((n_texts, k), empty, np.uint64)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    darts = k * math.log(k) + 2 * k
    limit = np.where(total > 0, darts / np.maximum(total, 1e-300), 0)
    done = np.zeros(n_texts)  # ranks below it have been thrown
    todo = total > 0
    while todo.any():
        rows = np.flatnonzero(todo[text])
        # Unit cells of weight of each element, then of rank from the last limit to this one.
        levels = np.ceil(weight[rows]).astype(np.int64)
        row = np.repeat(rows, levels)
        level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
        seed = mix(hashes[row] + mix(level.astype(np.uint64) * _STEP + _U(7)))
        lo, hi = np.floor(done[text[row]]).astype(np.int64), np.ceil(limit[text[row]]).astype(np.int64)
        made = np.append(0, np.cumsum(hi - lo))
        at = 0
        while at < len(row):  # cells are made in parts, so memory stays bounded
            part = slice(at, max(at + 1, int(np.searchsorted(made, made[at] + (1 << 18), "right")) - 1))
            at = part.stop
            cells = hi[part] - lo[part]
            each = np.repeat(np.arange(len(cells)), cells)
            rank = np.arange(len(each)) - np.repeat(np.cumsum(cells) - cells, cells) + lo[part][each]
            cell = mix(seed[part][each] ^ (rank.astype(np.uint64) * _STEP))
            n = np.searchsorted(_POISSON, (cell >> _U(11)).astype(np.float64) * 2.0**-53)
            dart = np.repeat(np.arange(len(each)), n)
            nth = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
            who = mix(cell[dart] + (nth.astype(np.uint64) + _U(1)) * _STEP)
            place = mix(who ^ _STEP)
            source = each[dart]
            own = text[row[part][source]]
            r = rank[dart] + (place >> _U(32)).astype(np.float64) * 2.0**-32
            depth = level[part][source] + (place & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
            hit = (r < limit[own]) & (r >= done[own]) & (depth < weight[row[part][source]])
            own, r, who = own[hit], r[hit], who[hit]
            slot = own * k + ((who >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
            value = (np.minimum(r * 2.0**18, 2.0**32 - 1).astype(np.uint64) << _U(32)) | (who & _U(0xFFFFFFFF))
            np.minimum.at(sig.reshape(-1), slot, value)
        todo &= (sig == empty).any(axis=1)
        done = np.where(todo, limit, done)
        limit = np.where(todo, limit * 2, limit)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_texts x bands keys: the hash of each band's coordinates."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ parts[:, :, j])
    return key


def _signed(bands: int, rows: int, width: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, t, w = shingles(part.column("text"), width)
                h, t, count = distinct(h, t)
                sig = dart_signatures(h, t, count.astype(np.float64) if weighted else np.ones(len(h)), part.num_rows, bands * rows)
                flat = pa.array(band_keys(sig, bands, rows).reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(w.digests(), pa.binary()), pa.array(np.diff(w.first).astype(np.int64)), lists], names=["d", "own", "n", "keys"])

    return run


def _verified(threshold: float, width: int, weighted: bool):
    """Pairs (a, b, ta, tb) whose shingles have at least the threshold in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ("ta", "tb"), 1 << 21):
                (ha, ta), (hb, tb) = (elements(*shingles(part.column(col), width)[:2], weighted) for col in ("ta", "tb"))
                both = distinct(np.concatenate([ha, hb]), np.concatenate([ta, tb]))
                n = part.num_rows
                union = np.bincount(both[1], minlength=n)
                common = np.bincount(both[1], weights=both[2] - 1, minlength=n)
                ok = np.flatnonzero((union > 0) & (common >= threshold * union - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(ok)), part.column("b").take(pa.array(ok))], names=["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, width: int = SHINGLE, weighted: bool = True) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are similar enough. Both joins read the texts by one exchange."""
    left = docs.select(F.col("d").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("d").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(lean(_verified(threshold, width, weighted)), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for the vertices of edges (a, b): root is the least vertex of the connected component.

    Alternates large-star and small-star steps. Each round's edges are written to the shared folder; they are no more than the round's before.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: each neighbour above u points to u's least neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct(), now[0])
        drop(edges)
        edges = after


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (v, root) after edges (a, b) between roots."""
    new = components(edges)
    moved = new.select(F.col("v").alias("root"), F.col("root").alias("to"))
    return cut(roots.join(moved, "root", "left").select("v", F.coalesce("to", "root").alias("root")).unionByName(new))


def _shingled(width: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, t = elements(*shingles(part.column("text"), width)[:2], weighted)
                offsets = np.searchsorted(t, np.arange(part.num_rows + 1)).astype(np.int32)
                names = ["g", "block", "blocks", "d", "root"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=[*names, "sh"])

    return run


def _linked(threshold: float):
    """Two blocks of texts to links (a, b) of roots that join all classes with a pair similar enough; no more than classes - 1."""

    def sides(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sh = rows.field("sh")
        return rows.field("root").to_numpy(), np.diff(sh.offsets.to_numpy()), sh.flatten().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ra, na, fa), (rb, nb, fb) = sides(batch.column("left")[i].values), sides(batch.column("right")[i].values)
                _, inverse, times = np.unique(np.concatenate([fa, fb]), return_inverse=True, return_counts=True)
                column = np.cumsum(times > 1) - 1  # what one text alone has is common to none
                both = times[inverse] > 1
                ia, ib = both[: len(fa)], both[len(fa) :]
                ca, cb = column[inverse[: len(fa)][ia]], column[inverse[len(fa) :][ib]]
                da, db = np.repeat(np.arange(len(na)), na)[ia], np.repeat(np.arange(len(nb)), nb)[ib]
                common = np.zeros((len(na), len(nb)), np.float32)
                for at in range(0, int((times > 1).sum()), 4096):  # indicator matrices of bounded width
                    x, y = np.zeros((len(na), 4096), np.float32), np.zeros((len(nb), 4096), np.float32)
                    sa, sb = (ca >= at) & (ca < at + 4096), (cb >= at) & (cb < at + 4096)
                    x[da[sa], ca[sa] - at] = 1
                    y[db[sb], cb[sb] - at] = 1
                    common += x @ y.T
                union = na[:, None] + nb[None, :] - common
                p, q = np.nonzero((common >= threshold * union - 1e-6) & (ra[:, None] != rb[None, :]))
                parent: dict[int, int] = {}

                def find(v: int, parent: dict[int, int] = parent) -> int:
                    while parent.setdefault(v, v) != v:
                        parent[v] = parent[parent[v]]
                        v = parent[v]
                    return v

                out = []
                for u, v in {(int(u), int(v)) for u, v in zip(ra[p], rb[q])}:
                    fu, fv = find(u), find(v)
                    if fu != fv:
                        parent[max(fu, fv)] = min(fu, fv)
                        out.append((u, v))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def links_between_classes(open_: DataFrame, texts: DataFrame, threshold: float, width: int, weighted: bool = True, size: int | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) of roots for documents (d, root, r0) whose buckets hold several classes; r0 is a bucket's least root.

    Classes connected by buckets form a group. A group's documents are dealt into blocks of about `size` texts and `limit` bytes of text (a longer text is in a
    block beside others), and each two blocks meet in one row, so no pair becomes a row and no task holds more than two blocks.
    """
    size = size or BLOCK
    groups = components(open_.select(F.col("root").alias("a"), F.col("r0").alias("b"))).select(F.col("v").alias("root_"), F.col("root").alias("g"))
    members = open_.select("d", "root").distinct()
    members = members.join(groups, F.col("root") == F.col("root_"), "left").select("d", "root", F.coalesce("g", "root").alias("g"))
    dealt = cut(members.join(texts, "d").select("d", "root", "g", "text"))
    blocks = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(F.octet_length("text")) / limit)).cast("bigint")
    dealt = dealt.join(dealt.groupBy("g").agg(blocks.alias("blocks")), "g").withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")))
    # By block, so that the blocks of one large group don't meet in one task.
    rows = dealt.select("g", "block", "blocks", "d", "root", "text").repartition("g", "block").mapInArrow(lean(_shingled(width, weighted)), "g bigint, block bigint, blocks bigint, d bigint, root bigint, sh array<bigint>")
    packed = cut(rows.groupBy("g", "block", "blocks").agg(F.collect_list(F.struct("root", "sh")).alias("own")))
    left = packed.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select("g", F.col("other").alias("block"), F.col("own").alias("left"))
    right = packed.select("g", "block", F.col("own").alias("right"))
    return left.join(right, ["g", "block"]).select("left", "right").mapInArrow(lean(_linked(threshold)), "a bigint, b bigint").distinct()


def near_duplicate_classes(documents: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = True, stars: int = STARS) -> DataFrame:
    """doc_id, class_id, is_first (the row's document stands for its class)."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("d"), F.col("text"))
    signed = cut(docs.mapInArrow(lean(_signed(bands, rows, width, weighted)), "d bigint, own binary, n bigint, keys array<bigint>"))
    # Written, so that the joins get plain exchanges, whose hot keys Spark can split.
    first = cut(signed.where("n > 0").groupBy("own").agg(F.min("d").alias("rep")))
    keyed = signed.where("n > 0").select("d", "own").join(first, "own")
    member = cut(keyed.select("d", "rep").distinct())
    reps = signed.join(first, "own").where("n > 0 AND d = rep").select("d", F.explode("keys").alias("key"))
    bucket = reps.groupBy("key").agg(F.min("d").alias("b"), F.max("d").alias("c")).where("b < c").select("key", "b")
    hits = cut(reps.join(bucket, "key").select("key", "d", "b"))
    # The texts that a comparison can ask for, moved once and by the same plan at every size.
    texts = cut(docs.join(hits.select("d").distinct().hint("merge"), "d", "left_semi"))
    star = hits.where("d > b").groupBy(F.col("d").alias("a")).agg(F.min("b").alias("b"))
    # Texts of one id are one document.
    several = member.groupBy("d").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b < c").select("d", "b")
    same = member.join(several, "d").select(F.col("rep").alias("a"), "b")
    roots = cut(components(verify(star, texts, threshold, width, weighted).unionByName(same)))
    left = None
    for turn in range(stars + 1):
        # Members of one bucket in different classes.
        label = hits.select("key", "d").join(roots.withColumnRenamed("v", "d"), "d", "left").select("key", "d", F.coalesce("root", "d").alias("root"))
        mixed = label.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct(F.xxhash64("d", F.lit(turn)), "d", "root")).alias("pivot")).where("r0 < r1")
        open_ = cut(label.join(mixed.select("key", "r0", "pivot"), "key").select("d", "root", "r0", F.col("pivot.d").alias("p"), F.col("pivot.root").alias("pr")).distinct())
        if open_.isEmpty():
            break
        if left is None:
            left = cut(texts.join(open_.select("d").distinct().hint("merge"), "d", "left_semi"))
        if turn == stars:
            edges = cut(links_between_classes(open_.select("d", "root", "r0").distinct(), left, threshold, width, weighted))
        else:
            own = open_.select("d", "root").distinct()
            found = verify(open_.where("root <> pr").select(F.col("d").alias("a"), F.col("p").alias("b")).distinct(), left, threshold, width, weighted)
            edges = found.join(own.select(F.col("d").alias("a"), F.col("root").alias("ra")), "a").join(own.select(F.col("d").alias("b"), F.col("root").alias("rb")), "b")
            edges = cut(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if not edges.isEmpty():
            roots = joined(roots, edges)
    classed = member.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("d", F.coalesce("root", "rep").alias("root"))
    classed = classed.groupBy("d").agg(F.min("root").alias("root"))
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    out = ids.join(classed, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
    return out.withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One row for each class, of its first document (of that id's rows the one of least text, nulls first); rows without an id all stay; the columns stay as they are."""
    follow = near_duplicate_classes(documents, **options).where("NOT is_first").select(F.col("doc_id").alias("_d")).distinct()
    kept = documents.join(follow, documents["doc_id"].cast("bigint") == F.col("_d"), "left_anti")
    again = kept.where("doc_id IS NOT NULL").withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("text")))
    return again.where("_n = 1").select(documents.columns).unionByName(kept.where("doc_id IS NULL"))
