"""Sums of tables of numbers that tasks make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _summed(width: int):
    """Rows (idx, vec) to their sums by idx; a task holds its own share of the indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            vecs = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for i, v in zip(batch.column(0).to_pylist(), vecs):
                if i in sums:
                    sums[i] += v
                else:
                    sums[i] = v.copy()
        if sums:
            yield _rows(np.fromiter(sums, np.int32, len(sums)), np.array(list(sums.values())))

    return run


def _rows(idx: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1]), pa.array(vecs.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(idx, pa.int32()), flat], names=["idx", "vec"])


def sums(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: tuple[int, int], block: int = 1) -> np.ndarray:
    """The sum of the arrays of that shape which `work` makes of the rows' batches, one a task. So many rows are sent as one; blocks of zeros aren't sent."""
    blocks, width = -(-shape[0] // block), block * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in work(batches):
            out = np.zeros((blocks, width))
            out.ravel()[: made.size] = made.ravel()
            held = np.flatnonzero(out.any(1))
            if len(held):
                yield _rows(held, out[held])

    schema = "idx int, vec array<double>"
    parts = rows.mapInArrow(run, schema).repartition("idx").mapInArrow(_summed(width), schema)
    out = np.zeros((blocks, width))
    for batch in parts.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy().reshape(-1, width)
    return out.ravel()[: shape[0] * shape[1]].reshape(shape)
