"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file and composed with each text. The normaliser's has the rules of the file's character map as a trie
(the longest rule that matches a place rewrites it, anything else is copied), and the rules on white space: extra spaces, a dummy space
before or after, spaces to U+2581. The pieces' is a trie with a state for each (position, last piece) and an arc for each piece that ends there. The byte fallback's gives a
character without a piece its UTF-8 bytes' pieces. User-defined pieces pass the normaliser as they are. The ids are the output of the shortest path in the tropical semiring.

- Unigram models: an arc weighs minus the piece's score, in single precision as in the model's library, so that ties fall alike.
- BPE models: their greedy merges have no additive piece weights. An arc weighs 0 if its piece may follow the last one and infinity if not:
  a segmentation is what merging gives if and only if merging leaves each of its pieces, and each two neighbours, as they are
  (a merge across a boundary would already happen in the two pieces by themselves). So exactly one path has finite weight, and every
  position has one live state. Which pairs may meet is compiled on demand and kept. User-defined pieces are cut out first and meet any neighbour.

In a BPE model where no piece holds U+2581 after another character, the input is composed run by run, each of spaces and what follows up to the next space; runs seen lately
are kept, in tables of bounded size that a worker empties before a task of another operator. Text is never cut otherwise.

Defined results: null and empty texts have no ids and decode to the empty text; with the identity normaliser U+2581 in a text decodes to a space, as in the model's
library; invalid ids are an error; a null id of a row stays null; repeated rows are each encoded; an empty table gives an empty result; other columns are
ignored by encode_table() and kept by add_ids().
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TABLES, lean, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_FLOAT = struct.Struct("f")
_PART = re.compile(f"{SPACE}*\\w+|[^\\w{SPACE}]+|{SPACE}+")
_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: About the bytes of the table of runs and their parts, and entries of that of pairs of pieces. A full table of runs is kept until the next is full, and entries that are met again move on to it.
KEPT, PAIRS = 48 << 20, 500_000


NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Pieces:
    """What an encoder needs of a model file; its size is that of the file. key tells models apart."""

    names: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    bpe: bool
    prefix: bool
    unknown: int
    extra: bool = False
    suffix: bool = False
    escape: bool = True
    charsmap: bytes = b""
    fallback: bool = True
    unknown_surface: str = " \u2047 "
    key: str = ""


def read_model(spark: SparkSession | None, path: str | bytes = MODEL) -> Pieces:
    """Parses a model file (or its bytes), read through Spark where a session is given and the path has a scheme."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if isinstance(path, bytes):
        data = path
    elif spark is not None and "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    else:
        with open(path, "rb") as f:
            data = f.read()
    model = pb.ModelProto()
    model.ParseFromString(data)
    spec, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    types = tuple(p.type for p in model.pieces)
    if trained.model_type == 2 and UNUSED in types:
        raise ValueError("BPE models with unused pieces are not supported")
    unknown = types.index(UNKNOWN)
    return Pieces(
        tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), types, trained.model_type == 2, spec.add_dummy_prefix, unknown,
        spec.remove_extra_whitespaces, trained.treat_whitespace_as_suffix, spec.escape_whitespaces, bytes(spec.precompiled_charsmap), trained.byte_fallback, trained.unk_surface,
        hashlib.blake2b(data, digest_size=16).hexdigest(),
    )


class Normaliser:
    """The rewriting transducer: the character map's double-array trie, walked lazily, and the rules on white space."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.user = _longest_first([s for s, t in zip(pieces.names, pieces.types) if t == USER])
        self.units: array[int] = array("I")
        self.text = b""
        if pieces.charsmap:
            size = int.from_bytes(pieces.charsmap[:4], "little")
            self.units.frombytes(pieces.charsmap[4 : 4 + size])
            if sys.byteorder == "big":
                self.units.byteswap()
            self.text = pieces.charsmap[4 + size :]
        self.identity = not (pieces.charsmap or pieces.extra or pieces.suffix) and pieces.escape
        self.plain: dict[str, bool] = {}

    def _longest(self, raw: bytes) -> tuple[int, bytes] | None:
        """The longest rule that starts a byte string: its length and what it writes."""
        units, found = self.units, None
        at = _offset(units[0])
        for n, b in enumerate(raw, 1):
            at ^= b
            unit = units[at] if at < len(units) else 0
            if unit & 0x800000FF != b:
                break
            at ^= _offset(unit)
            if unit >> 8 & 1:
                start = units[at] & 0x7FFFFFFF
                found = n, self.text[start : self.text.index(b"\0", start)]
        return found

    def _starts_none(self, c: str) -> bool:
        """Whether no rule begins with a character."""
        ok = self.plain.get(c)
        if ok is None:
            units, at = self.units, _offset(self.units[0])
            ok = False
            for b in c.encode("utf-8", "surrogatepass"):
                at ^= b
                unit = units[at] if at < len(units) else 0
                if unit & 0x800000FF != b:
                    ok = True
                    break
                at ^= _offset(unit)
            if len(self.plain) > PAIRS:
                self.plain.clear()
            self.plain[c] = ok
        return ok

    def _rewritten(self, text: str) -> Iterator[str]:
        """The text as the outputs of rules, copied characters and user-defined pieces."""
        i, n = 0, len(text)
        while i < n:
            if self.user is not None and (m := self.user.match(text, i)):
                yield m[0]
                i = m.end()
            elif not self.units or self._starts_none(text[i]):
                yield text[i]
                i += 1
            else:
                raw = text[i : i + 64].encode("utf-8", "surrogatepass")
                found = self._longest(raw)
                if found is None:
                    yield text[i]
                    i += 1
                else:
                    yield found[1].decode("utf-8", "replace")
                    i += len(raw[: found[0]].decode("utf-8", "surrogatepass"))

    def __call__(self, text: str) -> str:
        p = self.pieces
        space = SPACE if p.escape else " "
        if self.identity:
            return (space if p.prefix and text else "") + text.replace(" ", space)
        out: list[str] = []
        before = p.extra
        for part in self._rewritten(text):
            if before:
                part = part.lstrip(" ")
            if part:
                out.append(part.replace(" ", space))
                before = p.extra and part[-1] == " "
        done = "".join(out)
        if p.extra:
            done = done.rstrip(space)
        if not done:
            return ""
        return space + done if p.prefix and not p.suffix else done + space if p.prefix else done


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


def _longest_first(names: list[str]) -> re.Pattern | None:
    return re.compile("|".join(map(re.escape, sorted(names, key=lambda s: (-len(s), s))))) if names else None


def _single(x: float) -> float:
    return _FLOAT.unpack(_FLOAT.pack(x))[0]


class Kept:
    """Ids of short strings met lately, in a table and the one before it, each of bounded size."""

    def __init__(self) -> None:
        self.now: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def empty(self) -> None:
        self.now, self.old, self.size = {}, {}, 0

    def add(self, text: str, make: Callable[[str], tuple[int, ...]]) -> tuple[int, ...]:
        """The ids of a text that `now` lacks, from the old table or made."""
        ids = self.old.get(text)
        if ids is None:
            ids = make(text)
        if len(text) <= 40:
            if self.size >= KEPT:
                self.old, self.now, self.size = self.now, {}, 0
            self.now[text] = ids
            self.size += 200 + 4 * len(text) + 8 * len(ids)
        return ids


@dataclass
class Transducer:
    pieces: Pieces
    arcs: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        p = self.pieces
        self.normalise = Normaliser(p)
        self.kept = Kept()
        user = {s: i for i, (s, t) in enumerate(zip(p.names, p.types)) if t == USER}
        self.arcs = {s: i for i, (s, t) in enumerate(zip(p.names, p.types)) if t == NORMAL or t == USER and not p.bpe}
        #: User-defined pieces that are cut out before pieces are composed.
        self.cut_out = {s: i for s, i in user.items() if p.bpe}
        self.user = _longest_first(list(self.cut_out))
        self.bytes = {int(s[3:5], 16): i for i, (s, t) in enumerate(zip(p.names, p.types)) if t == BYTE} if p.fallback else {}
        #: The arcs as an automaton that finds all pieces of an input in one walk.
        self.automaton = ahocorasick.Automaton()
        #: Neighbouring characters within pieces. Between any others no piece reaches across.
        self.inner: set[str] = set()
        for s, i in self.arcs.items():
            self.inner.update(s[n - 1 : n + 1] for n in range(1, len(s)))
            if not p.bpe or self.merge(s) == [s]:  # what merging takes on or never reaches is on no path
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.length = [len(s) for s in p.names]
        #: Whether runs can be composed apart. With scores they can't: how sums of single precision round, and so which of two even paths wins, depends on all that went before.
        self.by_runs = p.bpe and not any(SPACE in s.lstrip(SPACE) for s in self.arcs) and not self.cut_out
        normal = [x for x, t in zip(p.scores, p.types) if t == NORMAL]
        best, self.lowest = max(normal, default=0.0), _single(min(normal, default=0.0) - 10)
        #: A user-defined piece weighs less than any path of other pieces over its bytes.
        self.weight = [_single(len(s.encode()) * best - 0.1) if t == USER else x for s, x, t in zip(p.names, p.scores, p.types)]
        self.fits: dict[int, bool] = {}
        byte_of = {int(s[3:5], 16): i for i, (s, t) in enumerate(zip(p.names, p.types)) if t == BYTE}
        raw = {i: bytes([b]) for b, i in byte_of.items()}
        self.output = [raw[i] if i in raw else b"" if t == CONTROL else p.unknown_surface.encode() if t == UNKNOWN else s.replace(SPACE, " ").encode() for i, (s, t) in enumerate(zip(p.names, p.types))]

    def merge(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.arcs.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.pieces.scores[found] > best):
                    best, at = self.pieces.scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        x, y = self.pieces.names[a], self.pieces.names[b]
        if len(self.fits) > PAIRS:
            self.fits.clear()
        ok = self.fits[a * len(self.length) + b] = x[-1] + y[0] not in self.inner or self.merge(x + y) == [x, y]
        return ok

    def path(self, run: str) -> list[int | str]:
        """The shortest path's pieces by number; a character without one stands for itself."""
        return self._path_bpe(run) if self.pieces.bpe else self._path_unigram(run)

    def _path_bpe(self, run: str) -> list[int | str]:
        length, v, get = self.length, len(self.length), self.fits.get
        n = len(run)
        live: list[int] = [-1] * (n + 1)  # the piece that ends the one finite path to a place; -1: a character without a piece
        back = [-1] * (n + 1)
        back[0] = 0
        # Arcs by their ends, the longest first; so the state that an arc leaves is settled when the arc is met.
        for e, t in self.automaton.iter(run):
            e += 1
            if back[e] >= 0:
                continue
            j = e - length[t]
            last = live[j]
            if last >= 0:
                ok = get(last * v + t)
                if ok is None:
                    ok = self._may_follow(last, t)
                if not ok:
                    continue
            live[e], back[e] = t, j
        out: list[int | str] = []
        i = n
        while i:
            t = live[i]
            if t >= 0:
                out.append(t)
                i = back[i]
            else:
                i -= 1
                out.append(run[i])
        out.reverse()
        return out

    def _path_unigram(self, run: str) -> list[int | str]:
        weight, length, n = self.weight, self.length, len(run)
        starts: list[list[int]] = [[] for _ in range(n)]
        for e, t in self.automaton.iter(run):
            starts[e + 1 - length[t]].append(t)
        best: list[float | None] = [0.0] + [None] * n
        back, last = [0] * (n + 1), [-1] * (n + 1)
        for j in range(n):
            here, single = best[j], False
            for t in starts[j]:
                i = j + length[t]
                single |= i == j + 1
                total = _single(here + weight[t])
                if best[i] is None or total > best[i]:
                    best[i], back[i], last[i] = total, j, t
            if not single:
                total = _single(here + self.lowest)
                if best[j + 1] is None or total > best[j + 1]:
                    best[j + 1], back[j + 1], last[j + 1] = total, j, -1
        out: list[int | str] = []
        i = n
        while i:
            out.append(last[i] if last[i] >= 0 else run[back[i] : i])
            i = back[i]
        return out[::-1]

    def part_ids(self, part: str) -> tuple[int, ...]:
        found = self.path(part)
        if str not in set(map(type, found)):
            return tuple(found)
        ids: list[int] = []
        for p in found:
            if isinstance(p, int):
                ids.append(p)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.pieces.unknown)
        return tuple(ids)

    def run_ids(self, run: str) -> tuple[int, ...]:
        """Ids of a run, which is composed part by part where words meet other characters and no piece reaches across."""
        parts = _PART.findall(run) if self.pieces.bpe else ()
        if len(parts) < 2:
            return self.part_ids(run)
        out: tuple[int, ...] = ()
        part = parts[0]
        for following in parts[1:]:
            if part[-1] + following[0] in self.inner:
                part += following
            else:
                out += self._part(part)
                part = following
        return out + self._part(part)

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.kept.now.get(part)
        return self.kept.add(part, self.part_ids) if ids is None else ids

    def empty(self) -> None:
        """Empties the tables, which fill again as they are needed."""
        self.kept.empty()
        self.fits.clear()
        self.normalise.plain.clear()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.by_runs and self.pieces.prefix and self.normalise.identity and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            runs = (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        else:
            text = self.normalise(text)
            runs = _RUN.findall(text) if self.by_runs else [text]
        if self.user is not None:
            return self._merged(chain.from_iterable(self._around(text)))
        found = list(map(self.kept.now.get, runs))
        if None in found:
            add, make = self.kept.add, self.run_ids
            found = [x if x is not None else add(r, make) for x, r in zip(found, runs)]
        return self._merged(chain.from_iterable(found))

    def _around(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids between user-defined pieces and of these."""
        at = 0
        for m in self.user.finditer(text):
            if m.start() > at:
                yield self.run_ids(text[at : m.start()])
            yield (self.cut_out[m[0]],)
            at = m.end()
        if at < len(text):
            yield self.run_ids(text[at:])

    def _merged(self, ids: Iterator[int]) -> list[int]:
        """Without byte pieces a run of unknown characters is one unknown piece."""
        if self.bytes:
            return list(ids)
        unknown = self.pieces.unknown
        out: list[int] = []
        for i in ids:
            if i != unknown or not out or out[-1] != unknown:
                out.append(i)
        return out

    def decode(self, ids: list[int] | None) -> str:
        if not ids:
            return ""
        p = self.pieces
        out = list(map(self.output.__getitem__, ids))
        if p.prefix or p.extra:
            # The first piece that says anything loses its space; where extra spaces go, a piece of nothing but a space counts as saying nothing.
            for n, i in enumerate(ids):
                if p.types[i] == BYTE:
                    break
                spaced = p.types[i] not in (UNKNOWN, CONTROL) and out[n].startswith(b" ")
                if spaced:
                    out[n] = out[n][1:]
                if out[n] or spaced and not p.extra:
                    break
        return b"".join(out).decode("utf-8", "replace")


_built: dict[str, Transducer] = {}


def _empty() -> None:
    for fst in _built.values():
        fst.empty()


TABLES["sentencepiece_fst"] = _empty


def _of(shared: _Shared) -> Transducer:
    """One transducer for each worker and model, told apart by the model file's hash."""
    if shared.key not in _built:
        _built.clear()
        _built[shared.key] = Transducer(shared.box.value)
    return _built[shared.key]


class _Shared:
    def __init__(self, spark: SparkSession, pieces: Pieces) -> None:
        self.box = spark.sparkContext.broadcast(pieces)
        self.key = pieces.key


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


def add_ids(documents: DataFrame, text: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """The documents with n_tokens, ids and, with check, round_trip: the ids decode to the whole text again."""
    spark = documents.sparkSession
    shared = _Shared(spark, read_model(spark, model))
    names = ["n_tokens", "ids"] + ["round_trip"] * check
    if clash := [c for c in documents.columns if c in names]:
        documents = documents.drop(*clash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _of(shared)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = part.column(text).to_pylist()
                ids = [fst.encode(t) for t in texts]
                new = [pa.array([len(x) for x in ids], pa.int64()), _lists(ids)]
                if check:
                    new.append(pa.array([fst.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(part.columns + new, names=part.schema.names + names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(lean(run, "sentencepiece_fst"), f"{fields}, n_tokens bigint, ids array<int>" + ", round_trip boolean" * check)


def decode_ids(tokens: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with text_decoded beside their other columns; null ids decode to the empty text."""
    spark = tokens.sparkSession
    shared = _Shared(spark, read_model(spark, model))
    tokens = tokens.drop("text_decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array([fst.decode(x) for x in part.column(ids).to_pylist()], pa.string())], names=part.schema.names + ["text_decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(lean(run, "sentencepiece_fst"), f"{fields}, text_decoded string")


def encode_table(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip for every whole text."""
    return add_ids(documents.select("doc_id", F.col("text")), model=model).drop("text")
