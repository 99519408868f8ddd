"""Row streams: scanlines of many images arrive over micro-batches, output rows leave as soon as their sources are complete.

resample_rows() takes rows in order and keeps what the ordered path does: the next row, and two rows of sums. resample_runs() takes runs of samples in any order (interlaced
passes, tiles) and keeps the sums of the whole output, which leaves when every sample has come. Rows out of order, or outside the image, end it with an
error row. A row without y ends its image: if rows are missing, with an error. An image that gets no row for `idle` of processing time is dropped with IncompleteImage.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import ImageError
from ..operators.area import Ordered, Sparse

OUTPUT = "image_id string, oy bigint, rgba binary, error_kind string"
STATE = "ordered binary, out_row bigint, failed boolean"


def _frame(image_id: str, rows: list[tuple[int | None, bytes | None, str | None]]) -> pd.DataFrame:
    return pd.DataFrame({"image_id": [image_id] * len(rows), "oy": pd.array([r[0] for r in rows], "Int64"), "rgba": [r[1] for r in rows], "error_kind": [r[2] for r in rows]})


def _stream(rows: DataFrame, idle: str, order: str, take: Callable[[object, object], tuple[object, list[bytes], bool]], close: Callable[[object], str]) -> DataFrame:
    """rows by image through take(machine or None, row), which returns the machine, finished rows and whether the image is whole. close(machine) names what lacks."""

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (image_id,) = key
        if state.hasTimedOut:
            _, _, ended = state.get
            state.remove()
            if not ended:
                yield _frame(image_id, [(None, None, "IncompleteImage")])
            return
        machine, out_row, ended = None, 0, False
        if state.exists:
            kept, out_row, ended = state.get
            machine = pickle.loads(kept) if kept else None
        given = pd.concat(list(frames)).sort_values(order, kind="stable", na_position="last")
        out: list[tuple[int | None, bytes | None, str | None]] = []
        whole = False
        for r in given.itertuples(index=False):
            if ended or whole:
                break
            try:
                if pd.isna(r.y):
                    ended = True
                    out.append((None, None, close(machine)))
                    break
                machine, done, whole = take(machine, r)
                for row in done:
                    out.append((out_row, row, None))
                    out_row += 1
            except ImageError as e:
                ended = True
                out.append((None, None, e.kind))
        if whole:
            state.remove()
        else:
            state.update((b"" if ended else pickle.dumps(machine), out_row, ended))
            state.setTimeoutDuration(_millis(idle))
        if out:
            yield _frame(image_id, out)

    return rows.groupBy("image_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def resample_rows(rows: DataFrame, idle: str = "1 hour") -> DataFrame:
    """rows: image_id, y, rgba, width, height, fit, out_width, out_height. Output rows and errors, in append mode."""

    def take(ordered: Ordered | None, r) -> tuple[Ordered, list[bytes], bool]:
        ordered = ordered or Ordered(r.fit, int(r.width), int(r.height), int(r.out_width), int(r.out_height))
        if len(r.rgba) != 4 * ordered.x.n:
            raise ImageError("InvalidRowLength")
        done = ordered.push(int(r.y), np.frombuffer(r.rgba, np.uint8).reshape(1, -1, 4))
        return ordered, [d.tobytes() for d in done], ordered.next_y == ordered.y.n

    return _stream(rows, idle, "y", take, lambda machine: "IncompleteImage")


def resample_runs(runs: DataFrame, idle: str = "1 hour") -> DataFrame:
    """runs: image_id, y, x, step, rgba, width, height, fit, out_width, out_height: the samples x, x + step, ... of line y, in any order, each once. Output rows and errors, in append mode."""

    def take(sparse: Sparse | None, r) -> tuple[Sparse, list[bytes], bool]:
        sparse = sparse or Sparse(r.fit, int(r.width), int(r.height), int(r.out_width), int(r.out_height))
        px = np.frombuffer(r.rgba, np.uint8).reshape(1, -1, 4)
        sparse.push(np.array([int(r.y)]), int(r.x) + int(r.step) * np.arange(px.shape[1]), px)
        if sparse.samples < sparse.x.n * sparse.y.n:
            return sparse, [], False
        return sparse, [row.tobytes() for row in sparse.close()], True

    return _stream(runs, idle, "y", take, lambda machine: "IncompleteSamples")


def _millis(text: str) -> int:
    n, unit = text.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)
