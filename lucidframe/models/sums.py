"""Sums of numpy arrays over a frame, made in Spark: a task's own sums first, then the tasks' sums by name, at last a few arrays on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.shipping import ship

Named = dict[tuple[int, int], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix, a row for each array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], Named]) -> Named:
    """The arrays that `part` makes of each Arrow batch, added up by name: (key, number).

    Each task adds up its batches and sends one array for each name; arrays of a name are then added in one task, which holds
    one of them at a time. How many names there are, and how long arrays are, depends on the model and not on the rows.
    """
    ship(rows.sparkSession)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Named = {}
        for batch in batches:
            for name, values in part(batch).items() if batch.num_rows else ():
                held[name] = held[name] + values if name in held else values
        yield from _rows(held)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Named = {}
        for batch in batches:
            for key, number, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(values)
                held[key, number] = held[key, number] + x if (key, number) in held else x
        yield from _rows(held)

    schema = "key bigint, number bigint, sums binary"
    parts = rows.mapInArrow(own, schema)
    found = parts.repartition(F.col("key"), F.col("number")).mapInArrow(together, schema).collect()
    return {(r["key"], r["number"]): np.frombuffer(r["sums"]) for r in found}


def _rows(held: Named) -> Iterator[pa.RecordBatch]:
    names = sorted(held)
    if names:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.int64()), pa.array([n for _, n in names], pa.int64()), pa.array([np.ascontiguousarray(held[n], np.float64).tobytes() for n in names], pa.binary())], ["key", "number", "sums"])
