"""Forests of full depth: every tree takes each row a Poisson number of times, every node draws its columns, and cut points are the best or drawn.

Rows lie binned in blocks (`trees.binned`). Rows of equal bins can't be told apart by any split, so a tree needs only what its weights add up to in
each cell of bins; where every tree takes every row once, blocks hold cells at once (`trees.celled`). Of a table of up to SMALL cells each tree's sums by cell go to one task, which grows it, however many rows the cells hold.
Of others, a node of more than SMALL rows gets its split from histograms that a pass over all blocks adds
up; a pass serves nodes of many trees, as many as PASS bytes of histograms hold. The cells of a smaller node go to one task by (tree, node), which
grows all that is below. Weights are drawn for (seed, tree, block), columns and cuts for a node's place in its tree, and sums are exact; so neither the
partitioning nor SMALL shows in a forest. A model of more than MODEL bytes is refused: it has up to twice as many nodes as rows of the sample divided
by the least node size, for each tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import MULTICLASS, REGRESSION, ContractError
from lucidframe.models.trees import BINS, Rows, Tree, by_cell, first_of_equal, in_bins, unit, unpacked

#: Rows of a node, or cells of a table, that one task grows by itself; bytes of a pass's histograms, and of those that a task holds; bytes of rows that a job sends to tasks, and to each; bytes of a forest; bytes of sums by cell that a task holds.
SMALL, PASS, HELD, SENT, EACH, MODEL, SUMS = 65_536, 1 << 26, 1 << 23, 1 << 35, 1 << 26, 1 << 30, 1 << 26


@dataclass(frozen=True)
class Plan:
    """What decides a forest beside its rows. resample=False takes every row once in every tree."""

    kind: str
    classes: int
    trees: int
    columns: int
    least: int
    share: float
    drawn_cuts: bool
    seed: int
    edges: np.ndarray
    step: float
    resample: bool = True

    @property
    def channels(self) -> int:
        return 2 if self.kind == REGRESSION else self.classes

    @property
    def node_bytes(self) -> int:
        """A node's histograms."""
        return self.columns * BINS * self.channels * 8

    def weights(self, tree: int, block: int, count: np.ndarray) -> np.ndarray:
        """How often a tree takes each distinct row of a block: a Poisson number about share times its copies."""
        if not self.resample:
            return count
        return np.random.default_rng([self.seed, tree, block]).poisson(count * self.share).astype(float)

    def sums(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(row, channel): what rows add to histograms, whole numbers: weights and weighted outcomes, or weights by class."""
        if self.kind == REGRESSION:
            return np.column_stack([w, np.rint(y / self.step) * w])
        return np.where(y[:, None] == np.arange(self.classes), w[:, None], 0.0)

    def adds(self, cells: bool, block: int, first: np.ndarray, y: np.ndarray, count: np.ndarray) -> Callable[[int], np.ndarray]:
        """What a tree's weights add up to in each cell of a block, by tree; cells: y already holds sums by cell, in units."""
        if not cells:
            own = self.sums(y, np.ones(len(y)))
            return lambda tree: np.add.reduceat(own * self.weights(tree, block, count)[:, None], first, axis=0)
        told = y.reshape(len(count), -1) * (1.0 if self.kind == REGRESSION else self.step)
        if self.kind != MULTICLASS:
            told = np.column_stack([count if self.kind == REGRESSION else count - told[:, 0], told])
        return lambda tree: told

    def root_key(self, tree: int) -> np.uint64:
        return mixed(mixed(np.array([self.seed], np.uint64)) + np.uint64(tree))[0]

    def columns_of(self, keys: np.ndarray) -> np.ndarray:
        """The columns that each node may split on, in order."""
        inputs = len(self.edges)
        drawn = mixed(keys[:, None] + np.arange(1, inputs + 1, dtype=np.uint64)[None, :])
        return np.sort(np.argsort(drawn, axis=1, kind="stable")[:, : self.columns], axis=1)

    def sizes(self, sums: np.ndarray) -> np.ndarray:
        return sums[..., 0] if self.kind == REGRESSION else sums.sum(axis=-1)

    def kept(self, sums: np.ndarray) -> np.ndarray:
        """Rows times the squared mean, or times the squared shares: squared errors and Gini impurity are constants less this."""
        top = (sums[..., 1] * self.step) ** 2 if self.kind == REGRESSION else (sums**2).sum(axis=-1)
        return top / np.maximum(self.sizes(sums), 1e-300)

    def says(self, total: np.ndarray) -> np.ndarray:
        """(node, output): means, or shares of classes."""
        n = np.maximum(self.sizes(total), 1e-300)[:, None]
        return total[:, 1:] * self.step / n if self.kind == REGRESSION else total / n


def mixed(x: np.ndarray) -> np.ndarray:
    """Keys of 64 bits turned into unrelated ones (the splitmix finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def child_keys(keys: np.ndarray) -> np.ndarray:
    """(node, side): keys of both children."""
    return mixed(keys[:, None] ^ mixed(np.array([[1, 2]], np.uint64)))


def histograms(plan: Plan, number: np.ndarray, drawn: np.ndarray, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(node, drawn column, bin, channel) sums of rows whose node is number."""
    nodes, slots = drawn.shape
    out = np.empty((nodes, slots, BINS, plan.channels))
    for s in range(slots):
        place = number * BINS + x[np.arange(len(x)), drawn[number, s]]
        for c in range(plan.channels):
            out[:, s, :, c] = np.bincount(place, sums[:, c], nodes * BINS).reshape(nodes, BINS)
    return out


def splits(plan: Plan, keys: np.ndarray, drawn: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(splits at all, column, bin, sums of what goes left) of each node; ties go to the first column and bin."""
    nodes = np.arange(len(sums))
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    base = plan.kept(total)
    gain = np.where((plan.sizes(left) > 0) & (plan.sizes(right) > 0), plan.kept(left) + plan.kept(right) - base[:, None, None], -np.inf)
    if plan.drawn_cuts:
        gain = np.where(np.arange(BINS - 1) == drawn_bins(plan, keys, drawn, plan.sizes(sums) > 0)[..., None], gain, -np.inf)
    flat = gain.reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    slot, bins = best // (BINS - 1), best % (BINS - 1)
    worth = (plan.sizes(total) > plan.least) & (flat[nodes, best] > 1e-9 * np.maximum(1.0, np.abs(base)))
    return worth, drawn[nodes, slot], bins, left[nodes, slot, bins]


def drawn_bins(plan: Plan, keys: np.ndarray, drawn: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """(node, drawn column): of the cuts between the least and the largest bin that has rows, the one nearest to a value drawn evenly among them."""
    low, high = filled.argmax(axis=2), BINS - 2 - filled[..., ::-1].argmax(axis=2)
    high = np.maximum(high, low)
    even = mixed(mixed(keys[:, None] ^ np.uint64(0x5D)) + drawn.astype(np.uint64)) / 2.0**64
    a, b = plan.edges[drawn, low], plan.edges[drawn, high]
    with np.errstate(invalid="ignore"):  # a column without cuts
        value = a + even * (b - a)
    at = np.clip((plan.edges[drawn] <= value[..., None]).sum(axis=2) - 1, low, high)
    after = np.minimum(at + 1, high)
    with np.errstate(invalid="ignore"):
        return np.where(plan.edges[drawn, after] - value < value - plan.edges[drawn, at], after, at)


@dataclass
class Part:
    """Nodes in arrays: column (-1 in a leaf), the last bin that goes left, the left child (the right one follows), what a node says."""

    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def parts(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(np.ascontiguousarray(a).tobytes() for a in (self.column, self.bin, self.left, self.value))

    @classmethod
    def of(cls, column: bytes, bin_: bytes, left: bytes, value: bytes) -> Part:
        return cls(np.frombuffer(column, np.int16), np.frombuffer(bin_, np.uint8), np.frombuffer(left, np.int64), np.frombuffer(value).reshape(len(bin_), -1))


def grown(plan: Plan, key: np.uint64, x: np.ndarray, sums: np.ndarray) -> Part:
    """All that grows from one node's rows, level by level, for all open nodes at once in chunks of HELD bytes of histograms."""
    levels, keys, number, size = [], np.array([key], np.uint64), np.zeros(len(x), np.int64), 1
    chunk = max(1, HELD // plan.node_bytes)
    while len(keys):
        drawn, found = plan.columns_of(keys), []
        for first in range(0, len(keys), chunk):
            own = slice(first, first + chunk)
            rows = slice(*np.searchsorted(number, [first, first + chunk]))  # rows are in the order of their nodes
            table = histograms(plan, number[rows] - first, drawn[own], x[rows], sums[rows])
            found.append((*splits(plan, keys[own], drawn[own], table)[:3], plan.says(table[:, 0].sum(axis=1))))
        worth, column, bins, value = (np.concatenate(a) for a in zip(*found))
        left = np.where(worth, size + 2 * (np.cumsum(worth) - 1), 0)
        levels.append(Part(np.where(worth, column, -1).astype(np.int16), np.where(worth, bins, 0).astype(np.uint8), left, value))
        live = worth[number]
        x, sums, number = x[live], sums[live], number[live]
        goes = x[np.arange(len(x)), column[number]] > bins[number]
        number = 2 * (np.cumsum(worth) - 1)[number] + goes
        order = np.argsort(number, kind="stable")
        x, sums, number = x[order], sums[order], number[order]
        keys = child_keys(keys[worth]).ravel()
        size += len(keys)
    return Part(*(np.concatenate([getattr(p, name) for p in levels]) for name in ("column", "bin", "left", "value")))


@dataclass
class Forest:
    """Trees behind one another in the same arrays, and the values between bins. Scores are means of what the trees say."""

    kind: str
    cuts: list[np.ndarray]
    starts: np.ndarray
    nodes: Part

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(in_bins(self.cuts, x))

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        x = bins
        total, nodes = np.zeros((len(x), self.nodes.value.shape[1])), self.nodes
        for start in self.starts:
            node = np.full(len(x), start)
            live = np.arange(len(x)) if nodes.column[start] >= 0 else np.empty(0, np.int64)
            while len(live):
                at = node[live]
                node[live] = at = nodes.left[at] + (bins[live, nodes.column[at]] > nodes.bin[at])
                live = live[nodes.column[at] >= 0]
            total += nodes.value[node]
        total /= len(self.starts)
        return total[:, 0] if self.kind == REGRESSION else total

    def rows(self) -> Iterator[tuple]:
        """(tree, column, bin, left, value): a tree in a row, as numbers from its own start."""
        ends = [*self.starts[1:], len(self.nodes.column)]
        for t, (a, b) in enumerate(zip(self.starts, ends)):
            own = Part(self.nodes.column[a:b], self.nodes.bin[a:b], self.nodes.left[a:b] - a, self.nodes.value[a:b])
            yield t, *map(bytearray, own.parts())

    @classmethod
    def of(cls, kind: str, cuts: list[np.ndarray], trees: list[Part]) -> Forest:
        sizes = np.array([len(p.column) for p in trees])
        starts = np.cumsum(sizes) - sizes
        left = np.concatenate([p.left + s for p, s in zip(trees, starts)])
        return cls(kind, cuts, starts, Part(*(np.concatenate([getattr(p, n) for p in trees]) for n in ("column", "bin")), left, np.concatenate([p.value for p in trees])))


@dataclass
class Top:
    """The upper nodes of a tree, their keys and totals, and those whose rows go to tasks."""

    tree: Tree
    keys: dict[int, np.uint64]
    says: dict[int, np.ndarray]
    small: list[int]


def plan_of(rows: Rows, kind: str, classes: int, q: dict, seed: int, resample: bool = True) -> Plan:
    edges = np.full((len(rows.cuts), BINS), np.inf)
    for j, c in enumerate(rows.cuts):
        edges[j, : len(c)] = c
    return Plan(kind, classes, q["num.trees"], min(q["mtry"], len(rows.cuts)), q["min.node.size"], q["sample.fraction"], q["splitrule"] == "extratrees", seed, edges, unit(rows.n), resample)


def plant(rows: Rows, plan: Plan) -> Forest:
    """Grow all trees: of few cells each in a task; else upper nodes by passes over all rows, the rest in tasks. Trees that took no row (of very small tables) are left out."""
    if rows.cells and plan.resample:
        raise ContractError("a draw of rows needs rows, not their sums by cell")
    tops = [Top(Tree(), {0: plan.root_key(t)}, {}, []) for t in range(plan.trees)]
    cells = cells_of(rows)
    if cells is None:
        _upper(rows, plan, tops)
        each = max(1, int(SENT // max(1, rows.distinct * (len(rows.cuts) + 8 * plan.channels))))
    else:
        each = max(1, SUMS // (8 * plan.channels * len(cells)))
    found: dict[int, dict[int, Part]] = {t: {} for t in range(plan.trees)}
    used = 0
    for first in range(0, plan.trees, each):
        now = range(first, min(first + each, plan.trees))
        parts = (_lower(rows, plan, tops, now) if cells is None else _whole(rows, plan, cells, now)).persist()
        try:
            used += (parts.agg(F.sum("nodes")).first()[0] or 0) * (11 + 8 * (1 if plan.kind == REGRESSION else plan.classes))
            if used > MODEL:
                raise ContractError(f"a forest of over {MODEL} bytes: take fewer trees or larger nodes")
            for r in parts.collect():
                found[r["tree"]][r["node"]] = Part.of(r["column"], r["bin"], r["left"], r["value"])
        finally:
            parts.unpersist()
    trees = [_joined(top, found.pop(t)) for t, top in enumerate(tops) if found[t] or top.says]
    if not trees:
        raise ContractError("no tree took a row: take more trees or a larger share")
    return Forest.of(plan.kind, rows.cuts, trees)


def cells_of(rows: Rows) -> np.ndarray | None:
    """The distinct bins of all rows, in order; none if there are more than SMALL of them. A task sends one more at most."""
    inputs, most = len(rows.cuts), SMALL

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, inputs), np.uint8)
        for batch in batches:
            for row in batch.to_pylist() if len(held) <= most else ():
                x = unpacked(row, inputs)[1]
                held = np.unique(np.concatenate([held, x[first_of_equal(x)]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in held[: most + 1]], pa.binary())], ["x"])

    found = rows.packed.mapInArrow(own, "x binary").distinct().limit(most + 1).collect()
    return None if len(found) > most else np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in found)), np.uint8).reshape(-1, inputs)


PARTS = "tree int, node int, nodes bigint, column binary, bin binary, left binary, value binary"


def _part_table(tree: int, node: int, found: Part) -> pa.Table:
    return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "nodes": [len(found.column)], **{k: pa.array([v], pa.binary()) for k, v in zip(("column", "bin", "left", "value"), found.parts())}})


def _whole(rows: Rows, plan: Plan, cells: np.ndarray, trees: range) -> DataFrame:
    """What _lower returns, for trees over few cells: a task adds up its blocks' draws by tree and cell, and a tree's sums meet in the task that grows it."""
    inputs, celled, shape = len(rows.cuts), rows.cells, (len(cells), plan.channels)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = {v.tobytes(): i for i, v in enumerate(cells)}, np.zeros((len(trees), *shape))
        for batch in batches:
            for row in batch.to_pylist():
                block, x, y, count, _ = unpacked(row, inputs)
                first = first_of_equal(x)
                at, drew = np.array([number[v.tobytes()] for v in x[first]]), plan.adds(celled, block, first, y, count)
                for k, t in enumerate(trees):
                    held[k, at] += drew(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(trees), pa.int32()), pa.array([v.tobytes() for v in held], pa.binary())], ["tree", "sums"])

    def finish(table: pa.Table) -> pa.Table:
        t, total = table.column("tree")[0].as_py(), np.zeros(shape)
        for v in table.column("sums"):
            total += np.frombuffer(v.as_buffer()).reshape(shape)
        took = plan.sizes(total) > 0
        found = _part_table(t, 0, grown(plan, plan.root_key(t), cells[took], total[took])) if took.any() else None
        return found or _part_table(t, 0, Part(*(np.empty(0),) * 4)).slice(1)

    tasks = rows.packed.sparkSession.sparkContext.defaultParallelism
    # Every task sends all trees' sums, so their number must not grow with the rows.
    sent = rows.packed.coalesce(2 * tasks).mapInArrow(draw, "tree int, sums binary").repartition(min(4 * tasks, len(trees)), "tree")
    return sent.groupBy("tree").applyInArrow(finish, PARTS)


def _upper(rows: Rows, plan: Plan, tops: list[Top]) -> None:
    """Split nodes of more than SMALL rows."""
    celled, open_ = rows.cells, [(t, 0) for t in range(plan.trees)]
    at_once = max(1, PASS // plan.node_bytes)
    while open_:
        now, open_ = open_[:at_once], open_[at_once:]
        of_tree: dict[int, list[int]] = {}
        for t, node in now:
            of_tree.setdefault(t, []).append(node)
        walked = {t: (tops[t].tree, nodes, plan.columns_of(np.array([tops[t].keys[k] for k in nodes], np.uint64))) for t, nodes in of_tree.items()}

        def part(block, x, y, count, margin, walked=walked):
            out, first = {}, first_of_equal(x)
            x, adds = x[first], plan.adds(celled, block, first, y, count)
            for t, (tree, nodes, drawn) in walked.items():
                number = np.full(len(tree.column), -1)
                number[nodes] = np.arange(len(nodes))
                node, drew = number[tree.nodes(x, True)], adds(t)
                at = (node >= 0) & (plan.sizes(drew) > 0)
                sums = histograms(plan, node[at], drawn, x[at], drew[at])
                out |= {(t, k): s.ravel() for k, s in zip(nodes, sums)}
            return out

        sums = rows.sums(part)
        for t, (tree, nodes, drawn) in walked.items():
            top = tops[t]
            table = np.stack([sums[t, k].reshape(plan.columns, BINS, plan.channels) for k in nodes])
            keys = np.array([top.keys[k] for k in nodes], np.uint64)
            worth, column, bins, left = splits(plan, keys, drawn, table)
            total = table[:, 0].sum(axis=1)
            for i, node in enumerate(nodes):
                top.says[node] = plan.says(total[i : i + 1])[0]
                if worth[i]:
                    a, b = tree.split(node, int(column[i]), int(bins[i]), float(plan.edges[column[i], bins[i]]))
                    top.keys[a], top.keys[b] = child_keys(keys[i : i + 1])[0]
                    for child, own in ((a, left[i]), (b, total[i] - left[i])):
                        if plan.sizes(own) > SMALL:
                            open_.append((t, child))
                        else:
                            top.small.append(child)


def _lower(rows: Rows, plan: Plan, tops: list[Top], trees: range) -> DataFrame:
    """(tree, node, nodes, column, bin, left, value): what grows below the small nodes of some trees."""
    inputs, celled = len(rows.cuts), rows.cells
    upper = {t: (tops[t].tree, sorted(tops[t].small), {k: tops[t].keys[k] for k in tops[t].small}) for t in trees if tops[t].small}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, x, y, count, _ = unpacked(row, inputs)
                first = first_of_equal(x)
                x, adds = x[first], plan.adds(celled, block, first, y, count)
                for t, (tree, nodes, _) in upper.items():
                    number = np.full(len(tree.column), -1)
                    number[nodes] = np.arange(len(nodes))
                    node, drew = number[tree.nodes(x, True)], adds(t)
                    at = np.flatnonzero((node >= 0) & (plan.sizes(drew) > 0))
                    at = at[np.argsort(node[at], kind="stable")]
                    ends = np.searchsorted(node[at], np.arange(len(nodes) + 1))
                    own = [at[a:b] for a, b in zip(ends[:-1], ends[1:])]
                    sent = [k for k, rows_ in enumerate(own) if len(rows_)]
                    packed = [pa.array([np.ascontiguousarray(v[own[k]]).tobytes() for k in sent], pa.binary()) for v in (x, drew)]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(sent), pa.int32()), pa.array([nodes[k] for k in sent], pa.int32()), *packed], ["tree", "node", "x", "sums"])

    def finish(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        x, sums = (np.concatenate([np.frombuffer(v, kind) for v in table.column(name).to_pylist()]) for name, kind in (("x", np.uint8), ("sums", float)))
        found = grown(plan, upper[t][2][node], *by_cell(x.reshape(-1, inputs), sums.reshape(-1, plan.channels)))
        return _part_table(t, node, found)

    spark = rows.packed.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(len(trees) * rows.distinct * (inputs + 8 * plan.channels) // EACH))
    sent = rows.packed.mapInArrow(deal, "tree int, node int, x binary, sums binary").repartition(parts, "tree", "node")
    return sent.groupBy("tree", "node").applyInArrow(finish, PARTS)


def _joined(top: Top, below: dict[int, Part]) -> Part:
    """One tree of its upper nodes and what grew below them."""
    tree = top.tree
    outputs = len(next(iter(below.values())).value[0]) if below else len(next(iter(top.says.values()), [0.0]))
    column, bins, left = (np.array(a) for a in (tree.column, tree.bin, tree.left))
    value = np.zeros((len(column), outputs))
    for node, says in top.says.items():
        value[node] = says
    found, size = [], len(column)
    for node, part in sorted(below.items()):
        column[node], bins[node], left[node], value[node] = part.column[0], part.bin[0], size + part.left[0] - 1, part.value[0]
        found.append(Part(part.column[1:], part.bin[1:], part.left[1:] + size - 1, part.value[1:]))
        size += len(part.column) - 1
    every = [Part(column.astype(np.int16), bins.astype(np.uint8), left.astype(np.int64), value), *found]
    return Part(*(np.concatenate([getattr(p, name) for p in every]) for name in ("column", "bin", "left", "value")))
