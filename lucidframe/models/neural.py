"""A network with one hidden layer, fitted on all rows by full-gradient L-BFGS.

Equal rows are counted together first, and the distinct ones dealt by a hash of their content into blocks in a fixed order, so that a loss
and its gradient are the same numbers however the table is partitioned. Weights go out with each pass; a block sends back one gradient,
and blocks are added up in the order of their numbers, groups of them in Spark and at most GROUPS sums on the driver. Up to
LOCAL distinct rows the same passes over the same blocks run on the driver, where they take no Spark job each.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION
from lucidframe.models.sums import matrix
from lucidframe.shipping import ship

#: Distinct rows of a block, groups in which blocks' gradients are added up, distinct rows up to which no Spark job is made for a pass.
BLOCK, GROUPS, LOCAL = 8192, 64, 20_000
#: Bytes of groups' sums that a task makes.
ADDED = 1 << 20
#: Passes at most, and the relative gain below which the search ends.
PASSES, GAIN = 500, 1e-9


@dataclass(frozen=True)
class Net:
    """Shapes, the kind of task, weight decay, and the centre and scale of a numeric outcome."""

    inputs: int
    hidden: int
    outputs: int
    kind: str
    decay: float
    centre: float = 0.0
    scale: float = 1.0

    @property
    def size(self) -> int:
        return (self.inputs + 1) * self.hidden + (self.hidden + 1) * self.outputs

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of both layers, biases first."""
        cut = (self.inputs + 1) * self.hidden
        return w[:cut].reshape(self.inputs + 1, self.hidden), w[cut:].reshape(self.hidden + 1, self.outputs)

    def forward(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.parts(w)
        h = 1 / (1 + np.exp(-np.clip(a[0] + x @ a[1:], -500, 500)))
        o = b[0] + h @ b[1:]
        if self.kind == BINARY:
            o = 1 / (1 + np.exp(-np.clip(o, -500, 500)))
        elif self.kind == MULTICLASS:
            e = np.exp(o - o.max(axis=1, keepdims=True))
            o = e / e.sum(axis=1, keepdims=True)
        return h, o

    def loss(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The summed loss of some rows, squared errors or minus log likelihoods, and its gradient behind it; without decay."""
        _, b = self.parts(w)
        h, o = self.forward(w, x)
        if self.kind == REGRESSION:
            t = ((y - self.centre) / self.scale)[:, None]
            value, d = float(count @ ((o - t) ** 2)[:, 0]), 2 * (o - t)
        elif self.kind == BINARY:
            t, p = y[:, None], np.clip(o, 1e-15, 1 - 1e-15)
            value, d = float(-count @ (t * np.log(p) + (1 - t) * np.log(1 - p))[:, 0]), o - t
        else:
            t = np.eye(self.outputs)[y.astype(int)]
            value, d = float(-count @ np.log(np.clip((o * t).sum(axis=1), 1e-15, None))), o - t
        d = d * count[:, None]
        back = (d @ b[1:].T) * h * (1 - h)
        return np.concatenate(([value], back.sum(axis=0), (x.T @ back).ravel(), d.sum(axis=0), (h.T @ d).ravel()))

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        o = self.forward(w, x)[1]
        return o if self.kind == MULTICLASS else o[:, 0] * self.scale + self.centre


def blocks(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """(block, x, y, count): distinct rows as packed arrays, in the order of their content."""
    rows = df.select(x.alias("x"), y.cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"))
    parts = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    return dealt.groupBy("block").applyInArrow(_packed, "block bigint, rows bigint, x binary, y binary, count binary")


def _packed(table: pa.Table) -> pa.Table:
    x, y, count = matrix(table.column("x").combine_chunks()), table.column("y").to_numpy(), table.column("count").to_numpy().astype(float)
    order = np.lexsort((y, *x.T[::-1]))
    found = {"block": table.column("block")[:1], "rows": pa.array([len(y)], pa.int64())}
    return pa.table(found | {k: pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary()) for k, v in (("x", x), ("y", y), ("count", count))})


def _unpacked(row, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"]).reshape(-1, inputs), np.frombuffer(row["y"]), np.frombuffer(row["count"])


Part = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Source:
    """Blocks that are summed over: in Spark, or held where they are few."""

    packed: DataFrame
    inputs: int
    held: list | None = None
    tasks: int | None = None  # of a pass

    def sums(self, part: Part, size: int) -> np.ndarray:
        """The arrays of `size` numbers that part(block, x, y, count) makes of each block, added up in the order of blocks within groups, then of groups."""
        if self.held is not None:
            groups: dict[int, np.ndarray] = {}
            for block in self.held:
                groups[block[0] % GROUPS] = groups.get(block[0] % GROUPS, np.zeros(size)) + part(*block)
            return sum((groups[g] for g in sorted(groups)), np.zeros(size))
        inputs = self.inputs

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = np.ascontiguousarray(part(row["block"], *_unpacked(row, inputs)), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["block", "sums"])

        def together(table: pa.Table) -> pa.Table:
            order, sums, total = np.argsort(table.column("block").to_numpy()), table.column("sums").to_pylist(), np.zeros(size)
            for k in order:
                total = total + np.frombuffer(sums[k])
            return pa.table({"group": table.column("group")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        packed = self.packed.coalesce(self.tasks) if self.tasks else self.packed
        parts = packed.mapInArrow(each, "block bigint, sums binary").withColumn("group", F.pmod("block", F.lit(GROUPS)))
        # Few numbers come from a block, so few tasks add them up: what tasks report to the driver outweighs the sums.
        found = parts.repartition(min(GROUPS, self.tasks or GROUPS, max(1, size * 8 * GROUPS // ADDED)), "group").groupBy("group").applyInArrow(together, "group bigint, sums binary").collect()
        return sum((np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["group"])), np.zeros(size))


@contextlib.contextmanager
def opened(df: DataFrame, x: Column, y: Column, inputs: int) -> Iterator[Source]:
    """The rows as blocks, kept while they are summed over."""
    ship(df.sparkSession)
    packed = blocks(df, x, y).persist()
    try:
        held, tasks = None, 2 * df.sparkSession.sparkContext.defaultParallelism
        if (packed.agg(F.sum("rows")).first()[0] or 0) <= LOCAL:
            held = sorted(((r["block"], *_unpacked(r, inputs)) for r in packed.collect()), key=lambda b: b[0])
        yield Source(packed, inputs, held, tasks)
    finally:
        packed.unpersist()


def evaluate(packed: DataFrame, net: Net, w: np.ndarray) -> np.ndarray:
    """Loss and gradient over all blocks, without decay."""
    return Source(packed, net.inputs).sums(lambda block, x, y, count: net.loss(w, x, y, count), net.size + 1)


def fit(df: DataFrame, x: Column, y: Column, net: Net, seed: int) -> tuple[np.ndarray, dict]:
    """The weights, and how the search went."""
    return fit_several(df, x, y, [(net, seed)])[0]


def fit_several(df: DataFrame, x: Column, y: Column, nets: list[tuple[Net, int]]) -> list[tuple[np.ndarray, dict]]:
    """What fit returns for each net and seed. Their searches go side by side: a pass over the rows serves all that aren't at an end."""
    memory, passes, gain = minimise.__defaults__
    with opened(df, x, y, nets[0][0].inputs) as source:
        searches = [searched(np.random.default_rng(seed).uniform(-0.1, 0.1, net.size), memory, passes, gain) for net, seed in nets]
        asked, found = {k: next(s) for k, s in enumerate(searches)}, {}
        while asked:
            now = [(nets[k][0], w) for k, w in asked.items()]
            ends = np.cumsum([net.size + 1 for net, _ in now])
            sums = source.sums(lambda block, x, y, count, now=now: np.concatenate([net.loss(w, x, y, count) for net, w in now]), int(ends[-1]))
            for (k, w), own in zip(list(asked.items()), np.split(sums, ends[:-1])):
                decay = nets[k][0].decay
                try:
                    asked[k] = searches[k].send((own[0] + decay * float(w @ w), own[1:] + 2 * decay * w))
                except StopIteration as end:
                    best, value, used, ended = end.value
                    found[k] = best, {"loss": value, "passes": used, "converged": ended}
                    del asked[k]
    return [found[k] for k in range(len(nets))]


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, memory: int = 12, passes: int = PASSES, gain: float = GAIN) -> tuple[np.ndarray, float, int, bool]:
    """L-BFGS with a line search that doubles or halves: (weights, value, evaluations, whether the gain ended it)."""
    search = searched(w, memory, passes, gain)
    at = next(search)
    while True:
        try:
            at = search.send(objective(at))
        except StopIteration as end:
            return end.value


def searched(w: np.ndarray, memory: int, passes: int, gain: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float, int, bool]]:
    """The search of minimise: it asks for the value and gradient at some weights, is sent them, and returns what minimise does."""
    value, gradient = yield w
    used, steps, small = 1, [], 0
    while used < passes:
        d = gradient.copy()
        kept = []
        for s, q in reversed(steps):
            a = (s @ d) / (s @ q)
            kept.append(a)
            d -= a * q
        if steps:
            s, q = steps[-1]
            d *= (s @ q) / (q @ q)
        else:
            d /= max(1.0, float(np.linalg.norm(gradient)))
        for (s, q), a in zip(steps, reversed(kept)):
            d += (a - (q @ d) / (s @ q)) * s
        slope = -float(gradient @ d)
        if not slope < 0:
            if not steps:
                return w, value, used, True
            steps = []
            continue
        low, high, length, found = 0.0, np.inf, 1.0, None
        for _ in range(30):  # weak Wolfe conditions by bisection
            next_value, next_gradient = yield w - length * d
            used += 1
            if not next_value <= value + 1e-4 * length * slope:
                high = length
            else:
                found = (length, next_value, next_gradient)
                if -float(next_gradient @ d) >= 0.9 * slope:
                    break
                low = length
            length = (low + high) / 2 if np.isfinite(high) else 2 * length
            if used >= passes:
                break
        if found is None:
            if not steps:
                return w, value, used, True
            steps = []
            continue
        length, next_value, next_gradient = found
        s, q = -length * d, next_gradient - gradient
        if s @ q > 1e-12 * float(q @ q):
            steps = [*steps, (s, q)][-memory:]
        small = small + 1 if value - next_value <= gain * (abs(value) + gain) else 0
        w, value, gradient = w + s, next_value, next_gradient
        if small >= 2:
            return w, value, used, True
    return w, value, used, False
