"""Trees on binned columns: second-order boosting, and single trees pruned by cost and complexity.

Columns are cut once into at most BINS bins, at values near quantiles of all rows. Rows that are then equal are counted together and dealt by a hash of their content into
packed blocks; where every row counts once, tasks add them up by cell of bins instead, and only cells move. A level of a tree is one pass: every block walks its rows down the tree so far and adds up, for each open node, column and bin, a few
sums; the driver sees these histograms, whose size depends on nodes, columns and bins, and picks the splits. Sums are of whole multiples
of a small unit, so they are exact, and a tree is the same however the table is partitioned. Up to LOCAL distinct rows the same passes over
the same blocks run on the driver, where they take no Spark job each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, REGRESSION
from lucidframe.functions.expr import candidate_cuts, counted_cuts
from lucidframe.models.sums import Named, matrix, summed
from lucidframe.shipping import ship

#: Bins of a column, distinct rows of a block, distinct rows up to which no Spark job is made for a pass, trees after which rows' margins are written down again.
BINS, BLOCK, LOCAL, PENDING = 128, 16_384, 200_000, 8
#: Cells whose scores a task keeps in mind; cells whose sums it holds before it sends them on.
KEPT, FULL = 200_000, 200_000


@dataclass
class Tree:
    """Nodes in arrays: column (-1 in a leaf), the last bin that goes left, the least value that doesn't, children, what the node says."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, bin_: int, cut: float) -> tuple[int, int]:
        for name in ("column", "bin", "cut", "left", "right", "value"):
            getattr(self, name).extend([-1, -1] if name == "column" else [0, 0])
        a = len(self.column) - 2
        self.column[node], self.bin[node], self.cut[node], self.left[node], self.right[node] = column, bin_, cut, a, a + 1
        return a, a + 1

    @property
    def leaves(self) -> int:
        return sum(c < 0 for c in self.column)

    def nodes(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of each row, of bins or of values."""
        column, at, left, right = np.array(self.column), np.array(self.bin if binned else self.cut), np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if column[0] >= 0 else np.empty(0, np.int64)
        while len(live):
            own = node[live]
            goes = x[live, column[own]] > at[own]
            node[live] = np.where(goes, right[own], left[own])
            live = live[column[node[live]] >= 0]
        return node

    def says(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.value, float)[self.nodes(x, binned)]

    def compact(self) -> Tree:
        """Without nodes that pruning cut off."""
        out, todo = Tree(), [(0, 0)]
        while todo:
            old, new = todo.pop()
            out.value[new] = self.value[old]
            if self.column[old] >= 0:
                a, b = out.split(new, self.column[old], self.bin[old], self.cut[old])
                todo += [(self.left[old], a), (self.right[old], b)]
        return out


@dataclass
class Rows:
    """Binned rows in blocks: in Spark, or held where passes are local. cuts: the values between a column's bins."""

    cuts: list[np.ndarray]
    n: float
    packed: DataFrame | None
    held: list | None = None
    distinct: int = 0
    cells: bool = False  # y holds sums of outcomes by cell

    def sums(self, part: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Named]) -> Named:
        """The arrays that part(block, bins, y, count, margin) makes of each block, added up by name."""
        if self.held is not None:
            out: Named = {}
            for block in self.held:
                for name, values in part(*block).items():
                    out[name] = out[name] + values if name in out else values
            return out
        inputs = len(self.cuts)

        def batch_part(batch: pa.RecordBatch) -> Named:
            out: Named = {}
            for row in batch.to_pylist():
                for name, values in part(*unpacked(row, inputs)).items():
                    out[name] = out[name] + values if name in out else values
            return out

        return summed(self.packed, batch_part)

    def add(self, margin: Callable[[np.ndarray], np.ndarray]) -> None:
        """Write down what has been added to the rows' margins."""
        if self.held is not None:
            self.held = [(b, x, y, c, m + margin(x)) for b, x, y, c, m in self.held]
            return
        inputs = len(self.cuts)

        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                new = [np.ascontiguousarray(m + margin(x)).tobytes() for _, x, _, _, m in (unpacked(r, inputs) for r in rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.binary())], batch.schema.names)

        context, old = self.packed.sparkSession.sparkContext, self.packed
        more = old.mapInArrow(run, old.schema).persist()
        if context._jsc.sc().getCheckpointDir().isDefined():
            more.unpersist()
            more = more.checkpoint()  # or the plan would grow with every tree
        else:
            more.count()
        old.unpersist()
        self.packed = more

    def release(self) -> None:
        if self.packed is not None:
            self.packed.unpersist()


def unpacked(row: dict, inputs: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    count = np.frombuffer(row["count"])
    return row["block"], np.frombuffer(row["x"], np.uint8).reshape(-1, inputs), np.frombuffer(row["y"]), count, np.frombuffer(row["margin"]).reshape(len(count), -1)


def binned(df: DataFrame, columns: dict[str, Column], y: Column, start: np.ndarray, local: int | None = None) -> Rows:
    """Rows of some columns in bins, with the margins that all begin with. Up to `local` distinct ones (LOCAL) are held on the driver."""
    ship(df.sparkSession)
    cuts = [np.array(c) for c in candidate_cuts(df, columns, [i / BINS for i in range(1, BINS)]).values()]
    begin = np.asarray(start, float)

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            if batch.num_rows:
                place_ = in_bins(cuts, x).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, place_.size + 1, place_.shape[1], dtype=np.int32), pa.array(place_.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["x", "y"])

    def pack(table: pa.Table) -> pa.Table:
        x, own, count = matrix(table.column("x").combine_chunks()), table.column("y").to_numpy(), table.column("count").to_numpy().astype(float)
        order = np.lexsort((own, *x.T[::-1]))
        margin = np.tile(begin, (len(own), 1))
        parts = {"x": x[order].astype(np.uint8), "y": own[order], "count": count[order], "margin": margin}
        return pa.table({"block": table.column("block")[:1], **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in parts.items()}})

    rows = df.select(F.array(*columns.values()).alias("x"), y.cast("double").alias("y")).mapInArrow(place, "x array<int>, y double")
    distinct = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("count")).persist()
    try:
        different, n = distinct.agg(F.count(F.lit(1)), F.sum("count")).first()
        parts = max(1, -(-different // BLOCK))
        dealt = distinct.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
        packed = dealt.groupBy("block").applyInArrow(pack, "block bigint, x binary, y binary, count binary, margin binary").persist()
        if different > (LOCAL if local is None else local):
            packed.count()
            return Rows(cuts, float(n), packed, distinct=different)
        held = sorted((unpacked(r.asDict(), len(cuts)) for r in packed.collect()), key=lambda b: b[0])
        packed.unpersist()
        return Rows(cuts, float(n), None, held, different)
    finally:
        distinct.unpersist()


def in_bins(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """(row, column): how many of a column's cuts lie below a value."""
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])


class Remembered:
    """Scores of rows, each cell of bins scored once: a model of cuts says the same of all that a cell holds. Up to KEPT cells stay in mind.

    scores(bins, some rows of these bins) -> an array by row.
    """

    def __init__(self, cuts: list[np.ndarray], scores: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.cuts, self.scores = cuts, scores
        self.keys, self.known = np.empty(0, np.uint64), None
        sizes = [len(c) + 1 for c in cuts]
        self.digits = np.cumprod([1, *sizes[:-1]], dtype=object)
        self.fits = int(self.digits[-1]) * sizes[-1] < 2**63

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bins = in_bins(self.cuts, x)
        if not self.fits:  # too many cells for a number: equal ones won't be many
            return self.scores(bins, x)
        key, first, back = np.unique(bins.astype(np.uint64) @ self.digits.astype(np.uint64), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != key[inside]
        fresh = self.scores(bins[first[new]], x[first[new]]) if new.any() else self.known[:0]
        out = np.empty((len(key), *fresh.shape[1:]))
        out[new] = fresh
        out[~new] = self.known[at[~new]] if self.known is not None else out[~new]
        if new.any() and len(self.keys) + len(fresh) <= KEPT:
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys)
            self.keys, self.known = keys[order], (fresh if self.known is None else np.concatenate([self.known, fresh]))[order]
        return out[back]


def unit(n: float) -> float:
    """The part of 1 of which sums over n rows are whole multiples below 2^52."""
    return 2.0 ** -max(4, min(26, 48 - int(np.ceil(np.log2(max(n, 2))))))


def _histogram(node: np.ndarray, x: np.ndarray, weights: list[np.ndarray], nodes: int, columns: list[int]) -> list[np.ndarray]:
    """Of each column, (node, bin, weight) sums."""
    out = []
    for j in columns:
        place = node * BINS + x[:, j]
        out.append(np.stack([np.bincount(place, w, nodes * BINS) for w in weights], axis=1).ravel())
    return out


# Boosting


@dataclass
class Boosted:
    """Rounds of trees, one for each output, on top of the margins that all begin with."""

    kind: str
    start: np.ndarray
    rounds: list[list[Tree]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return linked(self.start + added(x, self.rounds, len(self.start), False), self.kind)

    def cuts(self, inputs: int) -> list[np.ndarray]:
        """The values that some tree splits at, of each column."""
        every = [(c, v) for trees in self.rounds for t in trees for c, v in zip(t.column, t.cut) if c >= 0]
        return [np.array(sorted({v for c, v in every if c == j})) for j in range(inputs)]


def added(x: np.ndarray, rounds: list[list[Tree]], outputs: int, binned_: bool = True) -> np.ndarray:
    """What rounds of trees add to the margins of rows."""
    out = np.zeros((len(x), outputs))
    for trees in rounds:
        for k, t in enumerate(trees):
            out[:, k] += t.says(x, binned_)
    return out


def linked(margin: np.ndarray, kind: str) -> np.ndarray:
    if kind == REGRESSION:
        return margin[:, 0]
    if kind == BINARY:
        return 1 / (1 + np.exp(-np.clip(margin[:, 0], -500, 500)))
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each output's margin."""
    p, h = expected(margin, kind)
    return p - outcomes(y, kind, margin.shape[1]), h


def expected(margin: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, output): what outcomes the margins expect, of which gradients are a difference; and second derivatives."""
    p = linked(margin, kind)
    if kind == REGRESSION:
        return p[:, None], np.ones((len(p), 1))
    return (p[:, None], np.maximum(p * (1 - p), 1e-16)[:, None]) if kind == BINARY else (p, np.maximum(2 * p * (1 - p), 1e-16))


def outcomes(y: np.ndarray, kind: str, outputs: int) -> np.ndarray:
    """(row, output): outcomes as numbers, or as one at the class."""
    return y[:, None] if kind in (REGRESSION, BINARY) else np.eye(outputs)[y.astype(int)]


def first_of_equal(x: np.ndarray) -> np.ndarray:
    """Where another cell begins in rows that are in the order of their bins."""
    return np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))) if len(x) else np.empty(0, np.int64)


def by_cell(x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal bins added up."""
    order = np.lexsort(x.T[::-1])
    x, sums = x[order], sums[order]
    first = first_of_equal(x)
    return x[first], np.add.reduceat(sums, first, axis=0) if len(first) else sums


def collapsed(rows: Rows, kind: str, start: np.ndarray) -> Rows:
    """Rows of equal bins as one, y being the sums of their outcomes in units: all that gradients need where every round takes every row."""
    inputs, outputs, step = len(rows.cuts), len(start), unit(rows.n)

    def own(x, y, count):
        first = first_of_equal(x)
        return x[first], np.add.reduceat(np.column_stack([count, np.rint(outcomes(y, kind, outputs) / step) * count[:, None]]), first, axis=0)

    if rows.held is not None:
        found = [own(x, y, c) for _, x, y, c, _ in rows.held]
        x, sums = by_cell(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return Rows(rows.cuts, rows.n, None, [(0, x, *_cell_parts(sums, start))], len(x), True)

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, x, y, count, _ = unpacked(row, inputs)
                yield _cell_batch(*own(x, y, count))

    return _cells(rows.cuts, rows.n, rows.packed.mapInArrow(each, _cell_schema(outputs)), start, LOCAL)


def celled(df: DataFrame, columns: dict[str, Column], y: Column, kind: str, start: np.ndarray, local: int | None = None) -> Rows:
    """What collapsed(binned(...)) is, without moving rows: each task adds up its own by cell. Up to `local` cells (LOCAL) are held on the driver."""
    ship(df.sparkSession)
    found, n = counted_cuts(df, columns, [i / BINS for i in range(1, BINS)])
    cuts, outputs, step, full = [np.array(c) for c in found.values()], len(start), unit(n), FULL

    def own(batches):
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            *x, told = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            sums = np.column_stack([np.ones(len(told)), np.rint(outcomes(told, kind, outputs) / step)])
            parts.append(by_cell(in_bins(cuts, np.column_stack(x)).astype(np.uint8), sums))
            size += len(parts[-1][0])
            if size > 2 * full:
                parts = [by_cell(*map(np.concatenate, zip(*parts)))]
                size = len(parts[0][0])
            if size > full and len(parts) == 1:
                yield _cell_batch(*parts[0])
                parts, size = [], 0
        if parts:
            yield _cell_batch(*by_cell(*map(np.concatenate, zip(*parts))))

    values = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())], y.cast("double").alias("y"))
    return _cells(cuts, float(n), values.mapInArrow(own, _cell_schema(outputs)), start, LOCAL if local is None else local)


def _cell_schema(outputs: int) -> str:
    return "x binary, " + ", ".join(f"s{i} double" for i in range(outputs + 1))


def _cell_batch(x: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), *map(pa.array, sums.T)], ["x", *(f"s{i}" for i in range(sums.shape[1]))])


def _cell_parts(sums: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, count and margin of a block of cells."""
    return np.ascontiguousarray(sums[:, 1:]).ravel(), np.ascontiguousarray(sums[:, 0]), np.tile(start, (len(sums), 1))


def _cells(cuts: list[np.ndarray], n: float, parts: DataFrame, start: np.ndarray, local: int) -> Rows:
    """Cells from what tasks added up, in blocks."""
    inputs, begin, names = len(cuts), np.asarray(start, float), parts.columns[1:]

    def pack(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, inputs)
        order, sums = np.lexsort(x.T[::-1]), np.column_stack([table.column(n).to_numpy() for n in names])
        packed = zip(("x", "y", "count", "margin"), (x[order], *_cell_parts(sums[order], begin)))
        return pa.table({"block": table.column("block")[:1], **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in packed}})

    cells = parts.groupBy("x").agg(*[F.sum(n).alias(n) for n in names]).persist()
    try:
        different = cells.count()
        dealt = cells.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(max(1, -(-different // BLOCK)))))
        packed = dealt.groupBy("block").applyInArrow(pack, "block bigint, x binary, y binary, count binary, margin binary").persist()
        packed.count()
    finally:
        cells.unpersist()
    if different > local:
        return Rows(cuts, n, packed, None, different, True)
    held = sorted((unpacked(r.asDict(), inputs) for r in packed.collect()), key=lambda b: b[0])
    packed.unpersist()
    return Rows(cuts, n, None, held, different, True)


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_splits(sums: np.ndarray, ridge: float, alpha: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column's place, bin) of each node's best split, from (column, node, bin, [g, h]) sums; ties go to the first."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    all_ = sums[0].sum(axis=1)
    right = all_[None, :, None] - left
    worth = lambda s: shrunk(s[..., 0], alpha) ** 2 / np.maximum(s[..., 1] + ridge, 1e-300)
    gain = (worth(left) + worth(right) - worth(all_)[None, :, None]) / 2
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least) & (left[..., 1] > 0) & (right[..., 1] > 0), gain, -np.inf)
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    where = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), where], where // gain.shape[2], where % gain.shape[2]


def kept_rows(block: int, size: int, count: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    """How many of each distinct row's copies a round takes: a share of them, the odd one by a number drawn for the round and the row's place."""
    if share >= 1:
        return count
    drawn = np.random.default_rng([seed, round_, block]).random(size)
    whole = np.floor(count * share)
    return whole + (drawn < count * share - whole)


def boost(rows: Rows, kind: str, start: np.ndarray, q: dict, seed: int) -> Boosted:
    """Rounds of one tree for each output, grown level by level on gradient and curvature histograms. Where rounds take all rows, cells of equal bins stand for them."""
    if q["subsample"] < 1 or rows.cells:
        return _boosted(rows, kind, start, q, seed)
    rows = collapsed(rows, kind, start)
    try:
        return _boosted(rows, kind, start, q, seed)
    finally:
        rows.release()


def _boosted(rows: Rows, kind: str, start: np.ndarray, q: dict, seed: int) -> Boosted:
    found, inputs, outputs = Boosted(kind, start, []), len(rows.cuts), len(start)
    step, pending, cells = unit(rows.n), [], rows.cells
    for r in range(q["nrounds"]):
        order = sorted(range(inputs), key=lambda j: xxhash.xxh64_intdigest(f"{seed}|{r}|{j}"))
        columns = sorted(order[: max(1, int(np.ceil(q["colsample_bytree"] * inputs - 1e-9)))])
        trees, open_ = [Tree() for _ in range(outputs)], [[0] for _ in range(outputs)]
        totals: list[dict[int, np.ndarray]] = [{} for _ in range(outputs)]
        for depth in range(q["max_depth"] + 1):
            last = depth == q["max_depth"]

            def part(block, x, y, count, margin, r=r, trees=trees, open_=open_, columns=columns, pending=tuple(pending)):
                p, h = expected(margin + added(x, pending, outputs), kind)
                w = kept_rows(block, len(count), count, q["subsample"], seed, r)
                told = y.reshape(-1, outputs) if cells else np.rint(outcomes(y, kind, outputs) / step) * w[:, None]
                out = {}
                for k, tree in enumerate(trees):
                    if not open_[k]:
                        continue
                    number = np.full(len(tree.column), -1)
                    number[open_[k]] = np.arange(len(open_[k]))
                    node = number[tree.nodes(x, True)]
                    at = node >= 0
                    weights = [np.rint(p[at, k] / step) * w[at] - told[at, k], np.rint(h[at, k] / step) * w[at]]
                    for j, sums in zip(columns, _histogram(node[at], x[at], weights, len(open_[k]), columns)):
                        out[k, j] = sums
                return out

            if last or not any(open_):
                break
            sums = rows.sums(part)
            for k, tree in enumerate(trees):
                nodes = open_[k]
                if not nodes:
                    continue
                table = np.stack([sums[k, j].reshape(len(nodes), BINS, 2) for j in columns]) * step
                gain, which, bins = best_splits(table, q["reg_lambda"], q["reg_alpha"], q["min_child_weight"])
                children = []
                for i, node in enumerate(nodes):
                    own = table[0, i].sum(axis=0)
                    totals[k].setdefault(node, own)
                    j = columns[which[i]]
                    if gain[i] > 1e-9 and bins[i] < len(rows.cuts[j]):
                        a, b = tree.split(node, j, int(bins[i]), float(rows.cuts[j][bins[i]]))
                        left = table[which[i], i, : bins[i] + 1].sum(axis=0)
                        totals[k][a], totals[k][b] = left, own - left
                        children += [a, b]
                open_[k] = children
        for k, tree in enumerate(trees):
            for node, (g, h) in totals[k].items():
                tree.value[node] = float(-q["eta"] * shrunk(np.array(g), q["reg_alpha"]) / max(h + q["reg_lambda"], 1e-300))
        found.rounds.append(trees)
        pending.append(trees)
        if rows.held is not None or len(pending) >= PENDING:
            done = list(pending)
            rows.add(lambda x, done=done: added(x, done, outputs))
            pending = []
    return found


# Single trees


@dataclass
class Grown:
    """A tree and, of each node, rows, what a leaf there says, its risk, and the impurity its split takes away."""

    tree: Tree
    rows: dict[int, float]
    risk: dict[int, float]


def grow(rows: Rows, kind: str, classes: int, depth: int, minsplit: int) -> Grown:
    """A tree by squared errors, or by Gini impurity, grown as far as depth and rows allow."""
    bucket, step = max(1, round(minsplit / 3)), unit(rows.n)
    tree, open_ = Tree(), [0]
    out = Grown(tree, {}, {})

    def channels(y: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        if kind == REGRESSION:
            return [count, np.rint(y / step) * count, np.rint(y * y / step) * count]
        return [count * (y == c) for c in range(classes)]

    for level in range(depth + 1):

        def part(block, x, y, count, margin, open_=tuple(open_)):
            number = np.full(len(tree.column), -1)
            number[list(open_)] = np.arange(len(open_))
            node = number[tree.nodes(x, True)]
            at = node >= 0
            return {(0, j): s for j, s in enumerate(_histogram(node[at], x[at], channels(y[at], count[at]), len(open_), list(range(len(rows.cuts)))))}

        sums = rows.sums(part)
        table = np.stack([sums[0, j].reshape(len(open_), BINS, -1) for j in range(len(rows.cuts))])
        if kind == REGRESSION:
            table = table * np.array([1.0, step, step])
        total = table[0].sum(axis=1)
        size = lambda s: s[..., 0] if kind == REGRESSION else s.sum(axis=-1)
        # What a split keeps: the squared mean, or the squared shares, times rows; impurity is a constant less this.
        kept = lambda s: (s[..., 1] ** 2 if kind == REGRESSION else (s**2).sum(axis=-1)) / np.maximum(size(s), 1e-300)
        left = np.cumsum(table, axis=2)[:, :, :-1]
        right = total[None, :, None] - left
        gain = np.where((size(left) >= bucket) & (size(right) >= bucket), kept(left) + kept(right) - kept(total)[None, :, None], -np.inf)
        flat = gain.transpose(1, 0, 2).reshape(len(open_), -1)
        where, children = flat.argmax(axis=1), []
        for i, node in enumerate(open_):
            n = float(size(total[i]))
            out.rows[node] = n
            if kind == REGRESSION:
                tree.value[node] = float(total[i, 1] / max(n, 1e-300))
                out.risk[node] = max(float(total[i, 2] - total[i, 1] ** 2 / max(n, 1e-300)), 0.0)
            else:
                tree.value[node] = (total[i] / max(n, 1e-300)).tolist()
                out.risk[node] = n - float(total[i].max())
            j, b = divmod(int(where[i]), gain.shape[2])
            if level < depth and n >= minsplit and flat[i, where[i]] > 1e-9 * max(1.0, abs(float(kept(total)[i]))) and b < len(rows.cuts[j]):
                children += tree.split(node, j, b, float(rows.cuts[j][b]))
        open_ = children
        if not open_:
            break
    return out


def weakest_links(grown: Grown) -> list[tuple[float, Tree]]:
    """(complexity, tree) from the whole tree to its root: at each, the split goes whose removal costs the least risk for each leaf it saves."""
    tree = grown.tree
    column = list(tree.column)
    out = [(0.0, tree.compact())]
    root = max(grown.risk[0], 1e-300)
    while column[0] >= 0:
        leaves, risk = {}, {}

        def look(node: int) -> None:
            todo = [(node, False)]
            while todo:
                k, seen = todo.pop()
                if column[k] < 0:
                    leaves[k], risk[k] = 1, grown.risk[k]
                elif seen:
                    leaves[k], risk[k] = leaves[tree.left[k]] + leaves[tree.right[k]], risk[tree.left[k]] + risk[tree.right[k]]
                else:
                    todo += [(k, True), (tree.left[k], False), (tree.right[k], False)]

        look(0)
        cost = {k: (grown.risk[k] - risk[k]) / (leaves[k] - 1) for k in leaves if column[k] >= 0}
        least = min(cost.values())
        for k, c in cost.items():
            if c <= least + 1e-12 * root:
                column[k] = -1
        cut = Tree(column, tree.bin, tree.cut, tree.left, tree.right, tree.value).compact()
        out.append((max(least, 0.0) / root, cut))
    return out


def pruned(grown: Grown, cp: float) -> Tree:
    """The smallest tree of the sequence whose every split is worth more than cp of the root's risk."""
    best = grown.tree
    for complexity, tree in weakest_links(grown) if cp > 0 else ():
        if complexity <= cp:
            best = tree
    return best
