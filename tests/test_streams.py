"""Row streams in order and in any order, over micro-batches, against the whole frame."""

import numpy as np
import pytest

from rasterloom.operators import area
from rasterloom.operators.rows import ADAM7
from rasterloom.streaming.rows import resample_rows, resample_runs

SIZE = [("width", 23), ("height", 17), ("fit", "cover"), ("out_width", 6), ("out_height", 7)]
SHAPE = "width long, height long, fit string, out_width long, out_height long"


def streamed(spark, tmp_path, batches, schema, make):
    """What a stream gives of batches, one a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else images that wait keep it busy for ever
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(str(tmp_path / "out")).collect()


def frame_of(rows, image):
    found = sorted((r.oy, r.rgba) for r in rows if r.image_id == image and r.error_kind is None)
    return np.frombuffer(b"".join(d for _, d in found), np.uint8).reshape(-1, 6, 4) if found else None


@pytest.fixture(scope="module")
def frame():
    return np.random.default_rng(7).integers(0, 256, (17, 23, 4), dtype=np.uint8)


def test_runs_in_any_order(spark, tmp_path, frame):
    size = tuple(v for _, v in SIZE)
    runs = []
    for _, x0, y0, dx, dy in ADAM7:
        for y in range(y0, 17, dy):
            if x0 < 23:
                runs.append(("whole", y, x0, dx, frame[y, x0::dx].tobytes(), *size))
    order = np.random.default_rng(8).permutation(len(runs))
    runs = [runs[i] for i in order]
    cut = len(runs) // 2
    other = [("short", 0, 0, 1, frame[0].tobytes(), *size), ("short", None, None, None, None, *size), ("outside", 3, 20, 1, frame[0].tobytes(), *size)]
    got = streamed(spark, tmp_path, [runs[:cut] + other[:1], runs[cut:] + other[1:]], f"image_id string, y long, x long, step long, rgba binary, {SHAPE}", resample_runs)
    assert (frame_of(got, "whole") == area.resample(frame, "cover", 6, 7)).all()
    assert {(r.image_id, r.error_kind) for r in got if r.error_kind} == {("short", "IncompleteSamples"), ("outside", "InvalidPixelCoordinate")}


def test_rows_in_order_and_images_that_end_early(spark, tmp_path, frame):
    size = tuple(v for _, v in SIZE)
    row = lambda image, y: (image, y, None if y is None else frame[y].tobytes(), *size)
    one = [row("whole", y) for y in range(9)] + [row("short", y) for y in range(5)] + [row("jump", 0)]
    two = [row("whole", y) for y in range(9, 17)] + [row("short", None)] + [row("jump", 2)]
    got = streamed(spark, tmp_path, [one, two], f"image_id string, y long, rgba binary, {SHAPE}", resample_rows)
    assert (frame_of(got, "whole") == area.resample(frame, "cover", 6, 7)).all()
    assert {(r.image_id, r.error_kind) for r in got if r.error_kind} == {("short", "IncompleteImage"), ("jump", "UnexpectedRow")}
