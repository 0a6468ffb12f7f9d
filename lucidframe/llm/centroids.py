"""Centroid clustering in whole numbers, by Yinyang grouping.

Components are multiplied by `scale` and rounded down, and centroids are whole numbers too, so distances are exact and results don't depend
on partitioning, batches or the order of rows.

The centroids are cut into groups once, by clustering the first ones. Each vector keeps an upper bound of the distance to its centroid and,
for each group, a lower bound of the distance to the group's other centroids. When centroids move, bounds widen by how far. A round
filters first globally (no group can hold a nearer centroid: the vector isn't even compared with its own), then with the upper
bound made exact, then group by group; the centroids of the groups that survive are compared exactly. Only a vector that moves
changes the sums of two centroids, so a round's update adds up the vectors that moved, on the driver k * dims whole numbers.

Vectors and bounds are written together after each round, and the table before goes, so that a round is one pass over narrow rows without
a shuffle and survives lost executors. What the driver sends and receives is k centroids, whatever the number of vectors.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones are left out; fewer vectors than
k make a centroid each; ties go to the smaller number; centroids without vectors stay where they are; repeated rows count
each, and repeated ids that are among the first centroids are taken in order of their components; null ids hash as an empty text; an
empty table gives an empty result. Components beyond 2^26 after scaling are an error, as distances would overflow. Only the id and
vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidframe.llm.common import discard, has_columns, written
from lucidframe.shipping import ship

#: Centroids in a group, about.
GROUP = 10
#: The largest component after scaling, and the largest for which products of whole vectors are exact in doubles.
LARGEST, EXACT = 1 << 26, 1 << 20


@dataclass
class Clustering:
    """rows: (id, cluster, distance); centroids in their order; compared: the distances worked out in each pass, vectors times k at most."""

    rows: DataFrame
    centroids: list[list[int]]
    compared: list[int] = field(default_factory=list)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x) of the vectors that count, x in whole numbers."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.when((F.size(x) == dims) & finite, x).alias("x")).where("x IS NOT NULL")
    bounded = lambda e: F.when(F.abs(e) * scale <= LARGEST, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).cast("int")
    return rows.select("id", F.transform("x", bounded).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def grouped(centroids: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering among the centroids, from evenly spaced ones."""
    k = len(centroids)
    t = max(1, -(-k // size))
    x = centroids.astype(np.float64)
    middle = x[np.linspace(0, k - 1, t).astype(int)]
    for _ in range(5):
        group = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([x[group == g].mean(axis=0) if (group == g).any() else middle[g] for g in range(t)])
    return np.unique(group, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, by products of doubles where these are exact, else in whole numbers."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) < EXACT and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c.astype(np.int64)):
        d = x.astype(np.int64) - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def above(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are no smaller."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Pass:
    """One assignment: the bounds of a batch of vectors are widened, filtered and mended."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None):
        self.c, self.group = centroids, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        # How far each centroid moved, and the farthest of each group; a little more, so that rounding makes no bound too tight.
        self.drift = None if moved is None else np.sqrt(moved.astype(np.float64)) * (1 + 1e-12)
        self.farthest = None if moved is None else np.array([self.drift[m].max() for m in self.members])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = squared(x, self.c)
        own = d.argmin(axis=1)
        rows = np.arange(len(x))
        upper = above(np.sqrt(d[rows, own]))
        others = np.sqrt(d.astype(np.float64))
        others[rows, own] = np.inf
        lower = np.stack([others[:, m].min(axis=1) for m in self.members], axis=1)
        return own, upper, below(lower), np.full(len(x), len(self.c))

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        before, compared = own, np.zeros(len(x), np.int64)
        own, upper = own.copy(), above(upper.astype(np.float64) + self.drift[own])
        lower = below(lower.astype(np.float64) - self.farthest[None, :])
        maybe = np.flatnonzero(upper >= lower.min(axis=1))  # a tie may go to a smaller number
        if not len(maybe):
            return own, upper, lower, compared
        at = x[maybe]
        exact = np.empty(len(maybe), np.int64)
        for j in np.unique(own[maybe]):
            mine = own[maybe] == j
            exact[mine] = squared(at[mine], self.c[j : j + 1])[:, 0]
        compared[maybe] += 1
        upper[maybe] = above(np.sqrt(exact))
        best, number = exact.copy(), own[maybe].copy()
        open_ = upper[maybe][:, None] >= lower[maybe]
        scanned = {}
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(open_[:, g])
            if not len(rows):
                continue
            d = squared(at[rows], self.c[members])
            compared[maybe[rows]] += len(members)
            scanned[g] = rows, d
            nearest = d.argmin(axis=1)
            least, name = d[np.arange(len(rows)), nearest], members[nearest]
            better = (least < best[rows]) | ((least == best[rows]) & (name < number[rows]))
            best[rows] = np.where(better, least, best[rows])
            number[rows] = np.where(better, name, number[rows])
        own[maybe], upper[maybe] = number, above(np.sqrt(best))
        # A centroid left behind is now one of its group's others.
        left = np.flatnonzero(number != before[maybe])
        was = self.group[before[maybe[left]]]
        lower[maybe[left], was] = np.minimum(lower[maybe[left], was], below(np.sqrt(exact[left])))
        for g, (rows, d) in scanned.items():
            others = np.sqrt(d.astype(np.float64))
            others[self.members[g][None, :] == number[rows][:, None]] = np.inf
            lower[maybe[rows], g] = below(others.min(axis=1))
        return own, upper, lower, compared


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(step: Pass, known: bool):
    """(id, x, own, was, upper, lower, compared) of (id, x) rows, or of rows with bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            if known:
                was = batch.column(2).to_numpy().astype(np.int64)
                own, upper, lower, compared = step.again(x, was, batch.column(4).to_numpy(), _matrix(batch.column(5)))
            else:
                was = np.full(len(x), -1)
                own, upper, lower, compared = step.first(x)
            lists = pa.ListArray.from_arrays(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32), pa.array(lower.ravel(), pa.float32()))
            columns = [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(upper, pa.float32()), lists, pa.array(compared, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "own", "was", "upper", "lower", "compared"])

    return run


def _measured(centroids: np.ndarray):
    """(id, cluster, distance) of assigned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(2).to_numpy(), _matrix(batch.column(1)).astype(np.int64) if batch.num_rows else np.zeros((0, 1), np.int64)
            d = x - centroids[own] if batch.num_rows else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())], ["id", "cluster", "distance"])

    return run


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, values) of a task: for each cluster the vectors and component sums that came, less those that left; for -1 the distances compared."""
    held: dict[int, np.ndarray] = {}
    compared = 0
    for batch in batches:
        compared += int(batch.column(4).to_numpy().sum())
        own, was = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        changed = np.flatnonzero(own != was)
        if not len(changed):
            continue
        x = np.column_stack((np.ones(len(changed), np.int64), _matrix(batch.column(1).take(pa.array(changed)))))
        for sign, names in ((1, own[changed]), (-1, was[changed])):
            for j in np.unique(names[names >= 0]).tolist():
                held[j] = held.get(j, 0) + sign * x[names == j].sum(axis=0)
    rows = [(-1, [compared]), *((j, v.tolist()) for j, v in held.items())]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["cluster", "values"])


def _update(state: DataFrame, totals: list[list[int]]) -> int:
    """Add a pass's changes to the totals of the clusters, and return how many distances it compared: at most k * (dims + 1) numbers reach the driver."""
    parts = state.select("id", "x", "own", "was", "compared").mapInArrow(_changes, "cluster int, values array<bigint>")
    sums = parts.select("cluster", F.posexplode("values").alias("at", "value")).groupBy("cluster", "at").agg(F.sum("value").alias("value"))
    compared = 0
    for row in sums.collect():
        if row["cluster"] < 0:
            compared = row["value"]
        else:
            totals[row["cluster"]][row["at"]] += row["value"]
    return compared


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> Clustering:
    """Cluster the vectors: `rounds` times assign and move, then assign once more."""
    has_columns(df, id_col, vector_col)
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType
    start, path = written(whole_vectors(df, id_col, vector_col, dims, scale), "vectors")
    centroids = first_centroids(start, k, seed)
    if not len(centroids):
        return Clustering(df.sparkSession.createDataFrame([], _RESULT(id_type)), [])
    group = grouped(centroids)
    state_type = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string("x array<int>, own int, was int, upper float, lower array<float>, compared int").fields])
    state, moved, compared = start, None, []
    totals = [[0] * (dims + 1) for _ in centroids]  # vectors of a centroid, and their sums: whole numbers of any size
    for r in range(rounds + 1):
        after, next_path = written(state.mapInArrow(_assign(Pass(centroids, group, moved), r > 0), state_type), "assigned")
        discard(df.sparkSession, path)
        state, path = after, next_path
        compared.append(_update(state, totals))
        if r == rounds:
            break
        before = centroids
        centroids = np.array([[s // t[0] for s in t[1:]] if t[0] else c for t, c in zip(totals, before.tolist())], np.int64)
        moved = ((centroids - before) ** 2).sum(axis=1)
    return Clustering(state.mapInArrow(_measured(centroids), _RESULT(id_type)), centroids.tolist(), compared)


def _RESULT(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def summarise(found: Clustering, id_col: str) -> DataFrame:
    """One row for each vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    held = {r["cluster"]: r["inertia"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows at most
    about = [(j, held[j], sum(held.values()), centroid_digest(c)) for j, c in enumerate(found.centroids) if j in held]
    about = found.rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
