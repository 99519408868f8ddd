"""Shared helpers: shared-folder checkpoints, word splitting and vectorised hashing of Arrow text."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than space and U+0009..U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
_WORD = re.compile(WORD_PATTERN)
# White space to str.split() but not to WORD_PATTERN.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

NULL_ID = -(2**63)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured and executors run in this process (local mode)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return conf or f"{tempfile.gettempdir()}/rasterloom-checkpoints"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def few_files(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in no more partitions than four a core, or one for four shuffle partitions if that is more; of about `rows` small rows, one for 50,000.

    A file costs the same whatever it holds (a local file system even starts a process for its mode), and a task still reads no more than four shuffle partitions at any size.
    """
    spark = df.sparkSession
    most = max(32, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    return df.coalesce(most if rows is None else min(most, 1 + rows // 50_000))


#: For scratch tables on a local file system: without files of checksums, and without a process for each new file's mode, which shares its JVM's memory for a moment. Other file systems ignore them.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    schema = df.schema
    few_files(df, rows).write.options(**PLAIN).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes what cut() wrote for frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns to the system what this process's allocators keep of freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


#: What empties the tables that a worker keeps from task to task because they are costly to fill, by the name of their operator.
TABLES: dict[str, Callable[[], None]] = {}


def only(tables: str) -> None:
    """Empties the tables of all operators but one, of those that this process has."""
    for name, empty in TABLES.items():
        if name != tables:
            empty()


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run, tables: str = "") -> Run:
    """run for mapInArrow, in a worker that gives back freed memory after each batch and at first empties the tables of operators other than `tables`.

    Workers outlive tasks, and what they keep adds to their executor's memory.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(tables)
        give_back()
        yield from run(each(batches))
        give_back()

    return given


def doc_key(col: str) -> F.Column:
    """Orders documents by id; a null id ranks before every other."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NULL_ID))


def from_key(col: str) -> F.Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


#: Bounds of what a classifier is trained on beside its number of documents: bytes of one text, and of all.
TRAIN_TEXT, TRAIN_BYTES = 1 << 20, 32 << 20


def training_sample(rows: DataFrame, labels: DataFrame | None, sample: int, most_text: int = TRAIN_TEXT, most: int = TRAIN_BYTES) -> Iterator[Row]:
    """A bounded sample of rows (doc_id, text, y), in order of id: one row (the least) for each of the `sample` ids of least hash.

    y comes from labels (doc_id, y; a row an id), or from the rows where these are None. Ids are drawn from the labels, twice as many as are wanted, as some may have no text; so no texts move but the sample's.
    Texts of more than most_text bytes are left out, and ids from where the texts would pass `most` bytes. The sample's sizes come to the driver, and then its texts, part by part.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= most_text))
    if labels is None:
        ids, rows = rows.select(F.col("doc_id").alias("_id")).distinct(), rows.select("doc_id", "text", "y")
    else:
        ids, rows = labels.select(F.col("doc_id").alias("_id"), "y"), rows.select("doc_id", "text")
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample if labels is None else 2 * sample)
    met = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min(F.struct("text", "y")).alias("r"))
    picked = cut(met.select(F.col("_id").alias("doc_id"), F.xxhash64("_id").alias("h"), "r.text", "r.y").orderBy("h", "doc_id").limit(sample))
    total, last = 0, None
    for h, i, n in sorted(map(tuple, picked.select("h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).collect())):
        total += n
        if total > most:
            break
        last = h, i
    if last is not None:
        kept = picked.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("doc_id") <= last[1])))
        yield from kept.orderBy("doc_id").select("doc_id", "text", "y").toLocalIterator()


# ---- vectorised hashing -------------------------------------------------------------------------

_U = np.uint64
_STEP = _U(0xD1B54A32D192ED03)
_ODD = _U(0x9E3779B97F4A7C15)
_LANES = 8
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes in order. Mixing at every level keeps sequences apart that sums of powers would confuse."""
    return mix(a * _ODD + (b ^ _STEP))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte span: eight bytes at a time, each mixed into the last; spans beyond 64 bytes by a library hash."""
    size = end - start
    h = mix(size.astype(np.uint64) + _U(seed) * _STEP)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # eight bytes from every place
    rows = np.flatnonzero(size <= 8 * _LANES)
    for j in range(_LANES):
        rows = rows[size[rows] > 8 * j]
        if not len(rows):
            break
        x = lanes[start[rows] + 8 * j] & _MASK[np.minimum(size[rows] - 8 * j, 8)]
        h[rows] = combine(h[rows], x)
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], seed)
    return h


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width values, by doubling; it depends on the values' order and on nothing else."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    n = len(values) - width + 1
    out, done, power, span = None, 0, values, 1
    while span <= width:
        if width & span:
            part = power[done : done + n]
            out = part if out is None else combine(out, part)
            done += span
        if 2 * span <= width:
            power = combine(power[:-span], power[span:])
        span *= 2
    return mix(out + _U(width))


class Words:
    """Hashes of the words of an Arrow string array, all texts in one go."""

    def __init__(self, texts: pa.Array, seed: int = 0) -> None:
        texts = texts.fill_null("") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data, self.bounds = data, offsets
        inside = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = inside.copy()
        ends = inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        #: Of text i: words first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = hash_words(data, self.start, self.end, seed)

    def again(self, seed: int) -> np.ndarray:
        """The words' hashes by another seed."""
        return hash_words(self.data, self.start, self.end, seed)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words, one space after each, and the start and end of each word there."""
        size = self.end - self.start
        to = np.cumsum(size + 1)
        out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
        at = to - size - 1
        live = np.zeros(len(out) + 1, np.int8)
        live[at] += 1
        live[to - 1] -= 1
        out[np.cumsum(live[:-1]) > 0] = self.data[~_SEPARATOR[self.data]]
        return out, at, to - 1

    def digests(self) -> list[bytes]:
        """128 bits of a cryptographic hash of each text's sequence of words."""
        out, at, end = self.joined()
        raw = memoryview(out)
        n = np.diff(self.first)
        low = at[np.minimum(self.first[:-1], max(len(at) - 1, 0))] if len(at) else np.zeros(len(n), np.int64)
        high = end[np.maximum(self.first[1:] - 1, 0)] if len(at) else low
        return [hashlib.blake2b(raw[a:b] if c else b"", digest_size=16).digest() for a, b, c in zip(low.tolist(), high.tolist(), n.tolist())]


def slices(batch: pa.RecordBatch, col: str | tuple[str, ...] = "text", limit: int = 1 << 21):
    """Parts of a batch with about limit bytes of text at most; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    cols = (col,) if isinstance(col, str) else col
    sizes = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in cols))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
