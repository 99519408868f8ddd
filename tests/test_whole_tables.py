"""Queries on tables with odd rows, against brute force."""

import pytest
from conftest import SF

from rasterloom.queries import QUERIES


@pytest.mark.parametrize("name", ["axis_overlap", "mcu_rows"])
def test_every_request_has_rows(spark, duck, name):
    images = QUERIES[name](spark, SF).select("image_id").distinct().count()
    assert images == duck.sql("SELECT count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem").fetchall()[0][0]


def test_normalize_gray_packed_unpacks_whole_texts(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    odd = [(1001, None), (1002, ""), (1003, "a"), (1004, "é😀\nß" * 20), (1005, "x" * 63), (1006, "tail " * 30)]
    real.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents.parquet")

    def brute(i, text):
        bits = 1 << (i % 3)
        top = (1 << bits) - 1
        samples = [ord(c) % 256 >> s & top for c in text or "" for s in range(8 - bits, -1, -bits)]
        return i, len(samples), sum((x + 1) * ((v * 255 + top // 2) // top) for x, v in enumerate(samples))

    want = sorted(brute(*r) for r in [*real.collect(), *odd])
    assert sorted(map(tuple, QUERIES["normalize_gray_packed"](spark, str(tmp_path)).collect())) == want


def test_gradient_pattern_covers_every_event(spark, tmp_path):
    spark.range(2549).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for i in range(2549):
        x, y = i % 100, i // 100
        r, g = x * 255 // 99, y * 255 // 25
        want.append((x, y, r, g, (r + g) % 256 // 2, 255))
    got = QUERIES["gradient_pattern"](spark, str(tmp_path)).select("x", "y", "r", "g", "b", "a")
    assert sorted(map(tuple, got.collect())) == sorted(want)
