"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and codebooks are fitted by k-means on at most `sample` vectors (those of least id hash). Every vector is indexed: its cell is the
nearest centroid, its code the nearest codeword of each subspace of what is left. The lists of the inverted file lie in shelves: whole cells
next to each other in number up to `shelf` codes, a cell beyond that dealt out over several shelves by hash of id, so a crowded cell is no crowded task. A query goes to
the shelves that hold one of its `probes` share of nearest cells, and there to the lists of those cells only; an asymmetric distance table (query minus centroid against
the codewords) sums up the distance to each code, the best `rerank` codes of a query are kept, and the exact double-precision distance on the
original vectors decides. Queries go in chunks; each meeting of a chunk and a shelf returns its best candidates only.

Vectors of equal content are indexed once, with the k + 1 least ids that hold it: no query can return more of them.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another dimension than most, and rows with a null id take no part, neither as query nor as
candidate; rows that share an id are candidates each, and never of their own id's query; ties go to the smaller id; an
empty table gives an empty result; with fewer candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SAMPLE, SUBSPACES, CODEWORDS, PROBES, RERANK, SHELF, CHUNK = 20_000, 16, 256, 0.6, 300, 16_384, 64


def kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct random points; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    centre = points[rng.permutation(len(points))[:k]].astype(np.float64)
    for _ in range(steps):
        own = nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centre)) for j in range(x.shape[1])], axis=1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centre**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ centre.T).argmin(axis=1)
    return out


@dataclass
class Index:
    """Coarse centroids (cells x d) and codebooks (subspaces x codewords x d / subspaces). The dimension is padded with zeros."""

    coarse: np.ndarray
    books: np.ndarray
    pad: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))) if self.pad else x

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (subspaces bytes) of each vector."""
        x = self.padded(x)
        cell = nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        width = self.books.shape[2]
        return cell, np.stack([nearest(rest[:, s * width : (s + 1) * width], b) for s, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def probed(self, queries: np.ndarray, probes: float) -> np.ndarray:
        """Queries x cells: whether the cell is one of the query's nearest."""
        m = max(1, min(len(self.coarse), int(np.ceil(len(self.coarse) * probes))))
        far = (self.coarse**2).sum(axis=1) - 2 * self.padded(queries) @ self.coarse.T
        wanted = np.zeros(far.shape, bool)
        np.put_along_axis(wanted, np.argpartition(far, m - 1, axis=1)[:, :m], True, axis=1)
        return wanted

    def search(self, queries: np.ndarray, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, probes: float, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the lists of some cells, the keep best (id, squared asymmetric distance) of each query among the cells it probes."""
        q = self.padded(queries)
        wanted = self.probed(queries, probes)
        order = np.argsort(cells, kind="stable")
        ids, cells, codes = ids[order], cells[order], codes[order]
        own, first = np.unique(cells, return_index=True)
        first = np.append(first, len(cells))
        distance = np.full((len(q), len(ids)), np.inf, np.float32)
        width = self.books.shape[2]
        square = (self.books**2).sum(axis=2)
        for c, a, b in zip(own, first[:-1], first[1:]):
            who = np.flatnonzero(wanted[:, c])
            if not len(who):
                continue
            rest = (q[who] - self.coarse[c]).reshape(len(who), len(self.books), width)
            table = square[None] - 2 * np.matmul(rest.transpose(1, 0, 2), self.books.transpose(0, 2, 1)).transpose(1, 0, 2)
            total = (rest**2).sum(axis=(1, 2))[:, None]
            for s in range(len(self.books)):
                total = total + table[:, s][:, codes[a:b, s]]
            distance[who, a:b] = total
        out = []
        for row in distance:
            live = np.flatnonzero(np.isfinite(row))
            if len(live) > keep:
                edge = np.partition(row[live], keep - 1)[keep - 1]
                live = live[row[live] <= edge]
            best = np.lexsort((ids[live], row[live]))[:keep]
            out.append((ids[live[best]], row[live[best]].astype(np.float64)))
        return out


def fit(x: np.ndarray, total: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
    """Cells grow with the square root of the number of vectors, as far as the sample can place them."""
    d = x.shape[1]
    subspaces = min(subspaces, d)
    pad = -d % subspaces
    x = np.pad(x, ((0, 0), (0, pad))).astype(np.float64)
    cells = max(1, min(int(2 * np.sqrt(total)), len(x) // 16 or 1))
    coarse = kmeans(x, cells, 8, 1)
    rest = x - coarse[nearest(x, coarse)]
    width = (d + pad) // subspaces
    found = [kmeans(rest[:, s * width : (s + 1) * width], codewords, 8, 2 + s) for s in range(subspaces)]
    k = max(map(len, found))
    books = np.stack([np.concatenate([b, np.repeat(b[-1:], k - len(b), axis=0)]) for b in found])
    return Index(coarse, books, pad)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): rows that can take part, distinct."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    limit = F.lit(float("inf")).cast("float")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def shelves(sizes: dict[int, int], shelf: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Of each cell the first shelf and how many shelves it has, and the number of shelves. Small cells share one, whose codes are `shelf` at most."""
    out, last, room = {}, -1, 0
    for cell, n in sorted(sizes.items()):
        if n > shelf:
            parts = -(-n // shelf)
            out[cell] = (last + 1, parts)
            last, room = last + parts, 0
        else:
            if n > room:
                last, room = last + 1, shelf
            out[cell] = (last, 1)
            room -= n
    return out, last + 1


def search(table: DataFrame, queries: F.Column, k: int = 10, sample: int = SAMPLE, probes: float = PROBES, rerank: int = RERANK, shelf: int = SHELF) -> DataFrame:
    """query_id, rank, vec_id, score: for the vectors whose `id` satisfies queries, their k nearest found among all others."""
    spark = table.sparkSession
    rows = valid_vectors(table)
    # The limit on the rank alone goes before the shuffle: of a common vector every task sends k + 1 rows at most.
    members = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = cut(members.withColumn("rep", F.min("id").over(W.partitionBy("v"))))
    reps = members.where("n = 1").select("id", "v")
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    chosen = [r["v"] for r in reps.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    index = spark.sparkContext.broadcast(fit(np.array(chosen, np.float64), total))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell, code = index.value.encode(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "code"])

    coded = cut(reps.mapInArrow(encode, "id bigint, cell int, code binary"))
    place, n_shelves = shelves({r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}, shelf)  # a row for each centroid
    # A few shelves are dealt out to several tasks by repeating them for parts of the queries.
    asked = cut(rows.where(queries).distinct())
    n_chunks = max(1, -(-asked.count() // CHUNK))
    turns = max(1, min(n_chunks, 64 // n_shelves))
    deal = max(1, min(n_shelves * turns, 8192))
    where_, parts = F.create_map(*[F.lit(x) for c, (a, _) in place.items() for x in (c, a)]), F.create_map(*[F.lit(x) for c, (_, n) in place.items() for x in (c, n)])
    shelved = coded.withColumn("shelf", (where_[F.col("cell")] + F.pmod(F.xxhash64("id"), parts[F.col("cell")].cast("bigint"))).cast("int"))
    shelved = shelved.groupBy("shelf").agg(F.collect_list(F.struct("id", "cell", "code")).alias("codes"))
    shelved = shelved.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).repartition(deal, "shelf", "turn")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each shelf that holds a cell it probes."""
        spans = np.array([place.get(c, (0, 0)) for c in range(len(index.value.coarse))])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                wanted = index.value.probed(_matrix(part.column("v")), probes) & (spans[:, 1] > 0)
                q, c = np.nonzero(wanted)
                times = spans[c, 1]
                on = np.repeat(spans[c, 0], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                pair = np.unique(np.repeat(q, times) * n_shelves + on)
                who = pa.array(pair // n_shelves)
                yield pa.RecordBatch.from_arrays([part.column("id").take(who), part.column("v").take(who), pa.array((pair % n_shelves).astype(np.int32))], names=["id", "v", "shelf"])

    chunk = F.pmod(F.xxhash64("id", "v"), F.lit(n_chunks)).cast("int")
    chunks = asked.mapInArrow(route, "id bigint, v array<float>, shelf int").groupBy("shelf", chunk.alias("chunk")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    chunks = chunks.withColumn("turn", F.col("chunk") % turns).repartition(deal, "shelf", "turn")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = batch.column("asked")[i].values, batch.column("codes")[i].values
                codes = np.frombuffer(b"".join(c.field("code").to_pylist()), np.uint8).reshape(len(c), -1)
                ids, cells, who = c.field("id").to_numpy(), c.field("cell").to_numpy(), q.field("id").to_numpy()
                vectors = _matrix(q.field("v"))
                for at in range(0, len(who), CHUNK):
                    found = index.value.search(vectors[at : at + CHUNK], ids, cells, codes, probes, rerank)
                    sizes = [len(x[0]) for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(who[at : at + CHUNK], sizes)), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], names=["query_id", "rep", "near"]
                    )

    met = chunks.join(shelved.hint("merge"), ["shelf", "turn"]).select("asked", "codes").mapInArrow(meet, "query_id bigint, rep bigint, near double")
    best = met.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("near", "rep"))).where(F.col("n") <= rerank).select("query_id", "rep")
    square = F.aggregate(F.zip_with("q", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    near = best.join(members.select("rep", "id", "v"), "rep").where("id <> query_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = near.select("query_id", F.col("id").alias("vec_id"), F.sqrt(square).alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    return search(embeddings, F.col("id") % 100 == 0)
