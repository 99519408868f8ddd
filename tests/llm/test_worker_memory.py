"""What Python workers keep from task to task: tables of bounded bytes, only of the operator that runs, and no freed memory."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece

from rasterloom.llm import common, quality_rules, sentencepiece_fst


def test_tables_of_runs_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_fst, "KEPT", 1 << 20)
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(None))
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    # Runs of 39 characters without pieces, which have four ids each; every text has a run of the one before.
    run = lambda n: "".join(chr(0x20000 + n * 7 % 40000 + i) for i in range(39))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for n in range(20_000):
        ids = fst.encode(f"{run(n)} well, {run(n + 1)}")
        if n % 4000 == 0:
            assert ids == lib.encode(f"{run(n)} well, {run(n + 1)}")
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert grown < 6 << 20  # two tables and the pairs of pieces


def test_tasks_of_other_operators_empty_the_tables(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}, and more", "en") for i in range(8)], "doc_id bigint, text string, lang string").coalesce(1)

    def entries(batches):
        for _ in batches:
            pass
        tables = [x for fst in sentencepiece_fst._built.values() for x in (fst.kept if isinstance(fst.kept, dict) else fst.kept.now, fst.fits)]
        yield pa.RecordBatch.from_pydict({"entries": pa.array([sum(map(len, tables))], pa.int64())})

    # The session's idle workers take turns: 16 jobs of one task meet each of them.
    found = lambda: max(docs.mapInArrow(entries, "entries bigint").collect()[0]["entries"] for _ in range(16))
    sentencepiece_fst.encode_table(docs).collect()
    assert found() > 0
    for _ in range(16):
        quality_rules.measures(docs).collect()
    assert found() == 0


def test_scratch_tables_start_no_process_for_a_file(spark):
    """The file system that starts one for each new file's mode also writes checksums, hidden files beside each."""
    df = spark.range(1000).repartition(4)
    done = common.cut(df)
    assert sorted(r.id for r in done.collect()) == list(range(1000))
    assert not list(Path(done._cut.removeprefix("file://")).glob(".*.crc"))
    common.drop(done)
    assert not Path(done._cut.removeprefix("file://")).exists()


def _held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back():
    pins = []

    def run(batches):
        for batch in batches:
            much = [np.ones(1000) for _ in range(25_000)]  # 200 MB in pieces that the allocator takes for itself
            pins.append(np.ones(1000))  # and one at their end, so that it keeps them when they are free
            del much
            yield batch

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    common.give_back()
    before = _held()
    for _ in common.lean(run)(iter([batch])):
        pass
    assert _held() < before + 50
