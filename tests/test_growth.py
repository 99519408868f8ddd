"""Steps whose cost must grow no faster than the input: what their plans and tasks do."""

import pytest
from conftest import SF, same

from rasterloom import queries
from rasterloom.operators import normalize, resample
from rasterloom.queries import QUERIES, SQL


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["axis_overlap", "area_contain", "area_cover_wide", "area_two_stage", "coverage_check"])
def test_overlaps_are_compiled_columns(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Generate explode" in plan and "lambda" not in plan


def test_overlaps_of_images_in_one_piece_are_dealt_out(spark):
    shape = "image_id long, width long, height long, fit string, out_width long, out_height long"
    given = [(i, 1 + i % 7, 1 + i % 5, ("contain", "cover")[i % 2], 1 + i % 4, 1 + i % 3) for i in range(200)] + [(None, 3, 2, "cover", 2, 2), (900, 0, 2, "contain", 1, 1)]
    found = resample.axis_overlaps(spark.createDataFrame(given, shape).coalesce(1))
    assert "RepartitionByExpression" in plan_of(found)
    want = []
    for k, sw, sh, fit, ow, oh in given:
        for axis, n, other, o, oo in (("x", sw, sh, ow, oh), ("y", sh, sw, oh, ow)):
            cut = fit == "cover" and n * oo > other * o
            cell, start, stop, span = (2 * oo, n * oo - other * o, n * oo + other * o, 2 * other) if cut else (o, 0, n * o, n)
            for src in range(n):
                for out in range(o):
                    w = min((src + 1) * cell, stop, start + (out + 1) * span) - max(src * cell, start, start + out * span)
                    if w > 0:
                        want.append((k is None, k, axis, src, out, w))
    assert sorted(((r[0] is None, *r) for r in found.collect()), key=str) == sorted(want, key=str)


def test_texts_in_one_piece_are_dealt_out_and_unpacked_by_compiled_columns(spark):
    plan = plan_of(QUERIES["normalize_gray_packed"](spark, SF))
    assert "RepartitionByExpression" in plan and "lambda" not in plan and "Union" not in plan


def test_packed_rows_end_at_their_width(spark):
    given = [(1, [0b10110001, 0b01000000], 11, 1), (2, [0b10110001], 3, 2), (3, [0xAB, 0xC0], 3, 4), (4, [], 0, 1), (5, None, None, 1)]
    rows = normalize.unpack_rows(spark.createDataFrame(given, "id long, packed array<int>, width long, bits long"), ["id"], "packed", "width", "bits")
    want = [(i, x, packed[x * bits // 8] >> (8 - bits - x * bits % 8) & ((1 << bits) - 1)) for i, packed, width, bits in given for x in range(width or 0)]
    assert sorted(map(tuple, rows.collect())) == want


def test_row_stream_is_fed_by_many_tasks_over_two_batches(spark, duck, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_folder", lambda spark, kind: str(tmp_path / kind))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["stream_rows"](spark, SF)
        assert same(got, duck.sql(SQL["stream_rows"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "rows").glob("part-*"))) > 2
    assert sorted(p.name for p in (tmp_path / "rows-state" / "commits").glob("[0-9]*")) == ["0", "1"]
