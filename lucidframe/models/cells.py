"""Exact nearest neighbours by metric cells: which rows are compared is decided by the triangle inequality.

Pivots are training rows, first in hash order. Every training row belongs to the cell of its nearest pivot; a cell is stored in blocks of
at most BLOCK rows, each with the least and the greatest distance to the pivot. A query's distance to a pivot bounds its distance to
every row of the cell's blocks from both sides. It is compared with the blocks whose upper bounds promise enough neighbours first,
which gives it a radius; and then with those blocks alone whose lower bounds are within the radius. Queries are distinct points, packed in batches for each block they
visit, so that a block is sent once for a batch and no pair of a query and a row is ever a row of a table.

The directory of blocks is what the driver and the tasks hold of the training table: blocks grow with it, so that there are at most
DIRECTORY of them, and rows of one cell, equal ones too, spread over as many blocks as they fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.models.sums import matrix
from lucidframe.shipping import ship

#: Pivots at most, rows of a block at least, blocks at most, queries of a batch.
PIVOTS, BLOCK, DIRECTORY, BATCH = 256, 1024, 50_000, 512
#: Decimal places to which distances are compared, so that the order of summation decides nothing.
PLACES = 10


def distances(a: np.ndarray, b: np.ndarray, order: float) -> np.ndarray:
    """Distances of rows of a to rows of b: the order-th root of the sum of powers; below order 1 the sum itself, which is a metric."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = np.abs(a[:, j, None] - b[None, :, j])
        out += d * d if order == 2 else d if order == 1 else d**order
    return np.sqrt(out) if order == 2 else out ** (1 / order) if order > 1 else out


@dataclass
class Cells:
    """blocks: (cell, part, rows, x, y); what is known of each, in arrays; order, inputs: of the metric."""

    blocks: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    part: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    order: float

    @property
    def inputs(self) -> int:
        return self.pivots.shape[1]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances of points to all rows of each block."""
        d = distances(x, self.pivots, self.order)
        own = d[:, self.cell]
        lower = np.maximum(own - self.high[None], self.low[None] - own)
        # A row of another cell is nearer to its pivot than to the point's nearest one.
        lower = np.maximum(lower, (own - d.min(axis=1, keepdims=True)) / 2)
        return np.maximum(lower, 0.0) * (1 - 1e-9) - 1e-9, (own + self.high[None]) * (1 + 1e-9) + 1e-9


def build(df: DataFrame, x: Column, y: Column, order: float, seed: int, pivots: int = PIVOTS) -> Cells:
    """Cells of the rows of a frame."""
    ship(df.sparkSession)
    rows = df.select(x.alias("x"), y.cast("double").alias("y"))
    n = rows.count()
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.to_json("x")))
    chosen = rows.select("x").distinct().withColumn("key", key).orderBy("key").limit(max(1, min(pivots, int(np.sqrt(n)))))
    points = np.array([r["x"] for r in chosen.collect()], float)
    size = max(BLOCK, -(-n // (DIRECTORY - len(points))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = distances(matrix(part.column(0)), points, order)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own]), part.column(0), part.column(1)], ["cell", "d", "x", "y"])

    placed = rows.mapInArrow(near, "cell int, d double, x array<double>, y double")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row for each pivot
    parts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(c, 1) // size))) for c in range(len(points))]), F.col("cell") + 1)
    # Equal rows must not end in one block: a part of the number of the row, which only deals them, is in the hash.
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("x", "y", F.pmod(F.monotonically_increasing_id(), F.lit(65_536))), parts).cast("int"))
    blocks = dealt.groupBy("cell", "part").applyInArrow(_packed, "cell int, part int, rows int, low double, high double, x binary, y binary").persist()
    about = blocks.select("cell", "part", "rows", "low", "high").toPandas()  # DIRECTORY rows at most, about
    about = about.sort_values(["cell", "part"])
    return Cells(blocks.select("cell", "part", "rows", "x", "y"), points, *(about[c].to_numpy() for c in ("cell", "part", "rows", "low", "high")), order)


def _packed(table: pa.Table) -> pa.Table:
    d = table.column("d").to_numpy()
    x, y = matrix(table.column("x").combine_chunks()), table.column("y").to_numpy()
    packed = {"x": x, "y": y}
    return pa.table({
        "cell": table.column("cell")[:1], "part": table.column("part")[:1], "rows": pa.array([len(d)], pa.int32()), "low": pa.array([d.min()]), "high": pa.array([d.max()]),
        **{k: pa.array([np.ascontiguousarray(v, np.float64).tobytes()], pa.binary()) for k, v in packed.items()},
    })


_VISIT = "cell int, part int, ids binary, points binary"
_FOUND = "id bigint, check bigint, near array<struct<d:double,y:double>>, compared bigint"


def _visits(found: list[tuple[int, np.ndarray]], cells: Cells, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """A row for each block that some points of a batch visit: (block, which points)."""
    columns = [pa.array([int(cells.cell[b]) for b, _ in found], pa.int32()), pa.array([int(cells.part[b]) for b, _ in found], pa.int32())]
    columns += [pa.array([ids[w].tobytes() for _, w in found], pa.binary()), pa.array([x[w].tobytes() for _, w in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["cell", "part", "ids", "points"])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ids = np.column_stack((part.column(0).to_numpy(), part.column(1).to_numpy()))
            yield part, ids, np.ascontiguousarray(matrix(part.column(2)))


def nearest(points: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, check, near: the k nearest (d, y) in order, compared) of (id, check, x) rows, which are distinct.

    Neighbours at equal distances come in the order of their outcomes.
    """
    inputs, order = cells.inputs, cells.order
    k = min(k, int(cells.rows.sum()))
    directory = Cells(None, *(getattr(cells, f) for f in ("pivots", "cell", "part", "rows", "low", "high", "order")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x in _batches(batches):
            lower, _ = directory.bounds(x)
            # Blocks in the order of their lower bounds until they hold k rows.
            seen = np.argsort(lower, axis=1, kind="stable")
            held = np.cumsum(directory.rows[seen], axis=1)
            visited = np.zeros_like(lower, bool)
            np.put_along_axis(visited, seen, held - directory.rows[seen] < k, axis=1)
            yield _visits([(b, np.flatnonzero(visited[:, b])) for b in np.flatnonzero(visited.any(axis=0))], directory, ids, x)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, x in _batches(batches):
            radius = batch.column(3).to_numpy()
            lower, _ = directory.bounds(x)
            seen = np.argsort(lower, axis=1, kind="stable")
            held = np.cumsum(directory.rows[seen], axis=1)
            visited = np.zeros_like(lower, bool)
            np.put_along_axis(visited, seen, held - directory.rows[seen] < k, axis=1)
            visited = ~visited & (lower <= radius[:, None] + 10.0**-PLACES)
            if visited.any():
                yield _visits([(b, np.flatnonzero(visited[:, b])) for b in np.flatnonzero(visited.any(axis=0))], directory, ids, x)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64).reshape(-1, 2), np.frombuffer(row["points"]).reshape(-1, inputs)
                a, y = np.frombuffer(row["x"]).reshape(-1, inputs), np.frombuffer(row["y"])
                d = np.round(distances(x, a, order), PLACES)
                near = []
                for own in d:
                    if len(own) > k:
                        cut = np.partition(own, k - 1)[k - 1]
                        some = np.flatnonzero(own <= cut)
                    else:
                        some = np.arange(len(own))
                    best = some[np.lexsort((y[some], own[some]))[:k]]
                    near.append([{"d": float(own[i]), "y": float(y[i])} for i in best])
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("y", pa.float64())]))), pa.array(np.full(len(ids), len(y)), pa.int64())], ["id", "check", "near", "compared"])

    def looked_up(visits: DataFrame) -> DataFrame:
        return visits.join(cells.blocks, ["cell", "part"]).select("ids", "points", "x", "y").mapInArrow(compare, _FOUND)

    def merged(found: DataFrame) -> DataFrame:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        return found.groupBy("id", "check").agg(best.alias("near"), F.sum("compared").alias("compared"))

    points = points.select("id", "check", "x")
    start = merged(looked_up(points.mapInArrow(first, _VISIT)))
    known = points.join(start.select("id", "check", F.element_at("near", -1)["d"].alias("radius")), ["id", "check"])
    more = looked_up(known.select("id", "check", "x", "radius").mapInArrow(rest, _VISIT))
    return merged(start.unionByName(more))
