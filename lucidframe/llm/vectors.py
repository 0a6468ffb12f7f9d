"""Near-duplicate vectors by a forest of random-projection trees with spill.

Equal vectors are one class, so a vector that a third of the table repeats is compared once. `TREES` trees are grown on the
driver from a bounded sample of about `SAMPLE` classes: a node splits its vectors at the median of their projections
on a random direction, and what lies within `SPILL` of the median goes down both sides; a node that is small
(`LEAF`, in terms of the whole table, but not below `LEAST` of the sample), deep, or that a split would hardly thin out,
stays a leaf. The trees, whose size the sample bounds, are broadcast and every class is dropped down every tree.
A leaf with more than `CROWDED` classes grows a tree of its own from about `SAMPLE` of its classes, in a task of its own, and
its classes are dropped down that, dealt out to tasks of about `SAMPLE`; again, until no leaf is crowded that can be split. So
leaves stay as small however large the table, and a vector is compared with as many others.
Classes of a leaf are compared by matrix products in tasks of at most two blocks of `BLOCK` classes, so an overfull leaf is
compared exactly, never cut. A pair that shares several leaves counts in the first. Of each task only counts of links and a
spanning forest come out; components are contracted by large-star and small-star.

No link below the threshold is made, as every pair is verified in double precision. Two vectors at cosine 0.9 are parted by
a split with a probability of about 0.04, so four trees of ten splits lose one such link in a hundred, and far fewer of
closer pairs; the tests measure recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are
components of their own; vectors of different lengths are never linked; rows with a null id take part in links and get the
component of their class, or null; repeated rows are copies of each other; an empty table gives an empty result. Only the
id and vector columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import bounded_broadcast, has_columns, materialize, mix64, shuffled_unit
from lucidframe.llm.components import connected_components
from lucidframe.shipping import ship

COSINE = 0.9
TREES, LEAF, LEAST, DEPTH, BLOCK = 4, 1024, 16, 24, 1024
#: Classes of a leaf from which it is split again.
CROWDED = 4 * LEAF
#: Half the width of the spill, in standard deviations of a random projection of random vectors.
SPILL = 0.2
#: Classes from which the trees are grown, about, and the most bytes of them that reach the driver.
SAMPLE, SAMPLE_BYTES = 20_000, 48 << 20
SEED = 20_260


class Tree:
    """Nodes in arrays: direction, threshold, the children; a leaf has its number in `leaf`. share: the sample's part of all vectors."""

    def __init__(self, sample: np.ndarray, share: float, rng: np.random.Generator, first_leaf: int, size: int | None = None):
        self.direction, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.next_leaf, self.size = first_leaf, size or LEAF
        self.spill = SPILL / np.sqrt(max(1, sample.shape[1]))
        self._grow(sample, np.arange(len(sample)), share, rng, 0)
        self.direction = np.array(self.direction, np.float32).reshape(len(self.leaf), -1)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, share: float, rng: np.random.Generator, depth: int) -> int:
        node = len(self.leaf)
        direction = rng.standard_normal(sample.shape[1]).astype(np.float32)
        direction /= max(float(np.linalg.norm(direction)), 1e-30)
        for held, value in ((self.direction, direction), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            held.append(value)
        if len(rows) / max(share, 1e-30) > self.size and len(rows) > LEAST and depth < DEPTH:
            seen = sample[rows] @ direction
            cut = float(np.median(seen))
            low, high = rows[seen <= cut + self.spill], rows[seen >= cut - self.spill]
            if max(len(low), len(high)) < 0.85 * len(rows):
                self.cut[node] = cut
                self.left[node] = self._grow(sample, low, share, rng, depth + 1)
                self.right[node] = self._grow(sample, high, share, rng, depth + 1)
                return node
        self.leaf[node], self.next_leaf = self.next_leaf, self.next_leaf + 1
        return node

    def drop(self, vectors: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves that the vectors reach."""
        out, todo = [], [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out.append((self.leaf[node], rows))
                continue
            seen = vectors[rows] @ self.direction[node]
            todo.append((self.left[node], rows[seen <= self.cut[node] + self.spill]))
            todo.append((self.right[node], rows[seen >= self.cut[node] - self.spill]))
        return out


def grow_forest(sample: np.ndarray, share: float, trees: int = TREES, seed: int = SEED) -> list[Tree]:
    """Trees whose leaves are numbered through. share: the sample's part of all vectors."""
    out: list[Tree] = []
    for k in range(trees):
        out.append(Tree(sample, share, np.random.default_rng(seed + k), out[-1].next_leaf if out else 0))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _classes(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, code) of all rows, code null where a vector can't be linked; and (code, low, copies, unit, dim) of the classes."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    fine = F.col(f"`{vector_col}`").isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None else (np.array(x, np.float64) + 0.0).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "vector"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fine, vector).alias("vector")).mapInArrow(pack, "id bigint, vector binary")
    rows = materialize(rows.withColumn("code", F.sha2("vector", 256)), "vectors")
    grouped = rows.where("code IS NOT NULL").groupBy("code").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("vector").alias("vector"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, dim = [], []
            for raw in batch.column(3).to_pylist():
                x = np.frombuffer(raw, np.float64)
                x = x / np.abs(x).max()
                unit.append((x / np.sqrt(x @ x)).tobytes())
                dim.append(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(unit, pa.binary()), pa.array(dim, pa.int64())], ["code", "low", "copies", "unit", "dim"])

    classes = materialize(grouped.mapInArrow(scale, "code string, low bigint, copies bigint, unit binary, dim bigint"), "classes")
    return rows.select("id", "code"), classes


def _compare(cosine: float):
    """Of one or two blocks of a leaf: links that count here, and a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        units, copies, side = _matrix(table.column("unit")), table.column("copies").to_numpy(), table.column("side").to_numpy()
        here = table.column("leaf")[0].as_py()
        alone = table.column("first")[0] == table.column("second")[0]
        one, two = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        # A pair counts in the first leaf that both are in: leaves before this one, as a matrix of members.
        before = [[x for x in leaves if x < here] for leaves in table.column("leaves").to_pylist()]
        place = {x: k for k, x in enumerate(sorted({x for leaves in before for x in leaves}))}
        member = np.zeros((len(side), max(1, len(place))), np.float32)
        for r, leaves in enumerate(before):
            member[r, [place[x] for x in leaves]] = 1.0
        links = np.zeros(len(side), np.int64)
        root = np.arange(len(side))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []
        for start in range(0, len(one), 256):
            rows = one[start : start + 256]
            near = units[rows] @ units[two].T >= cosine
            if one is two:
                near &= rows[:, None] != two[None, :]
            near &= (member[rows] @ member[two].T) == 0
            links[rows] += near @ copies[two]
            if one is not two:
                links[two] += copies[rows] @ near
            for i, j in zip(*np.nonzero(near)):
                a, b = find(int(rows[i])), find(int(two[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    forest.append((int(rows[i]), int(two[j])))
        codes = table.column("code")
        hit = np.flatnonzero(links)
        a, b = (np.array([p[k] for p in forest], np.int64) for k in (0, 1))
        return pa.table(
            {
                "code": pa.concat_arrays([codes.take(pa.array(hit)).combine_chunks().cast(pa.string()), codes.take(pa.array(a)).combine_chunks().cast(pa.string())]),
                "links": pa.array([*links[hit].tolist(), *[0] * len(a)], pa.int64()),
                "other": pa.concat_arrays([pa.nulls(len(hit), pa.string()), codes.take(pa.array(b)).combine_chunks().cast(pa.string())]),
            }
        )

    return run


def _dropped(forest) -> callable:
    """Every class once for each leaf that it reaches, with all its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                units = _matrix(part.column(2)).astype(np.float32)
                reached: list[list[int]] = [[] for _ in range(len(units))]
                for tree in forest.value:
                    for leaf, rows in tree.drop(units):
                        for r in rows:
                            reached[r].append(leaf)
                which = np.repeat(np.arange(len(units)), [len(x) for x in reached])
                leaf = pa.array([x for leaves in reached for x in leaves], pa.int64())
                for at in range(0, len(which), 8192):
                    take = pa.array(which[at : at + 8192])
                    leaves = pa.array(reached, pa.list_(pa.int64())).take(take)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), leaf.slice(at, 8192), leaves], ["code", "copies", "unit", "leaf", "leaves"])

    return run


def _leaf_tree(size: int, per_leaf: int):
    """The tree of a crowded leaf, from its sampled classes, as bytes."""

    def run(table: pa.Table) -> pa.Table:
        leaf, rows = table.column("leaf")[0].as_py(), table.column("rows")[0].as_py()
        sample = _matrix(table.column("unit")).astype(np.float32)
        sample = sample[np.lexsort(sample.T[:4])]  # whatever order the rows come in
        tree = Tree(sample, len(sample) / rows, np.random.default_rng([SEED, leaf & 0xFFFFFFFF]), 0, size)
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "part": pa.array([list(range(-(-rows // per_leaf)))], pa.list_(pa.int64()))})

    return run


def _drop_again(table: pa.Table, trees: pa.Table) -> pa.Table:
    """Classes of a crowded leaf once for each leaf of its tree that they reach; the number of such leaves tells a leaf that can't be split."""
    out = {"code": [], "copies": [], "unit": [], "leaf": [], "fixed": []}
    if table.num_rows and trees.num_rows:
        tree = pickle.loads(trees.column("tree")[0].as_py())
        parent = np.uint64(table.column("leaf")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
        for leaf, rows in tree.drop(_matrix(table.column("unit")).astype(np.float32)):
            named = int(mix64(mix64(np.array([parent])) + np.uint64(leaf + 1)).view(np.int64)[0])
            took = table.take(pa.array(rows))
            for c in ("code", "copies", "unit"):
                out[c] += took.column(c).to_pylist()
            out["leaf"] += [named] * len(rows)
            out["fixed"] += [tree.next_leaf == 1] * len(rows)
    return pa.table({c: pa.array(x, kind) for (c, x), kind in zip(out.items(), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()))})


def _split_crowded(dropped: DataFrame) -> DataFrame:
    """(code, copies, unit, leaf, leaves) rows whose leaves are split until none is crowded that can be."""
    kind = "code string, copies bigint, unit binary, leaf bigint, fixed boolean"
    now, again = dropped.select("code", "copies", "unit", "leaf", F.lit(False).alias("fixed")), False
    while True:
        sizes = now.where("NOT fixed").groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED)
        sizes = materialize(sizes, "crowded")
        if sizes.isEmpty():
            break
        again = True
        sizes = bounded_broadcast(sizes)
        crowded = now.where("NOT fixed").join(sizes, "leaf")
        sampled = crowded.where(shuffled_unit("leaf", F.col("code")) * F.col("rows") < SAMPLE)
        trees = sampled.select("leaf", "rows", "unit").groupBy("leaf").applyInArrow(_leaf_tree(LEAF, SAMPLE), "leaf bigint, tree binary, part array<bigint>")
        trees = trees.withColumn("part", F.explode("part"))
        dealt = crowded.withColumn("part", F.pmod(F.xxhash64("code"), F.ceil(F.col("rows") / SAMPLE)))
        split = dealt.groupBy("leaf", "part").cogroup(trees.groupBy("leaf", "part")).applyInArrow(_drop_again, kind)
        rest = now.where("fixed").unionByName(now.where("NOT fixed").join(sizes.select("leaf"), "leaf", "left_anti").select(*now.columns))
        now = materialize(rest.unionByName(split), "leaves")
    if not again:
        return dropped
    leaves = now.groupBy("code").agg(F.collect_list("leaf").alias("leaves"))  # some for each tree
    return materialize(now.drop("fixed").join(leaves, "code"), "leaves")


def leaves_of(classes: DataFrame, trees: int) -> DataFrame:
    """(code, copies, unit, leaf, leaves): the classes of one length once for each leaf that they reach."""
    spark = classes.sparkSession
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.octet_length("unit"))).first()
    size = min(SAMPLE, SAMPLE_BYTES // max(1, width))
    chosen = classes.where(shuffled_unit("forest", F.col("code")) < size / max(1, total)).select("unit").orderBy("unit").toArrow()
    sample = _matrix(chosen.column("unit")).astype(np.float32) if chosen.num_rows else np.zeros((0, width // 8), np.float32)
    forest = spark.sparkContext.broadcast(grow_forest(sample, len(sample) / max(1, total), trees))
    dropped = classes.select("code", "copies", "unit").mapInArrow(_dropped(forest), "code string, copies bigint, unit binary, leaf bigint, leaves array<bigint>")
    return _split_crowded(materialize(dropped, "leaves"))


def _links(classes: DataFrame, cosine: float, trees: int) -> DataFrame:
    """(code, links, other) over all leaves of the classes of one length."""
    dropped = leaves_of(classes, trees)
    counts = dropped.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    counts = bounded_broadcast(materialize(counts, "leaf-sizes"))
    dealt = dropped.join(counts, "leaf").withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("own", "met"), F.greatest("own", "met")
    blocks = dealt.select("leaf", first.alias("first"), second.alias("second"), (F.col("own") != first).cast("int").alias("side"), "code", "copies", "unit", "leaves")
    return blocks.groupBy("leaf", "first", "second").applyInArrow(_compare(cosine), "code string, links bigint, other string")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept."""
    has_columns(df, id_col, vector_col)
    ship(df.sparkSession)
    rows, classes = _classes(df, id_col, vector_col)
    lengths = [r[0] for r in classes.select("dim").distinct().collect()]  # the lengths of vectors, commonly one
    found = None
    for dim in lengths:
        part = _links(classes.where(F.col("dim") == dim), cosine, trees)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "code string, links bigint, other string")
    found = materialize(found, "links")
    low = classes.select(F.col("code").alias("name"), "low")
    edges = found.where("other IS NOT NULL").select("code", "other")
    # Links between classes; a class is named by its smallest id, or, if all its ids are null, left out.
    named = edges.join(low, F.col("code") == F.col("name")).select(F.col("low").alias("u"), "other")
    named = named.join(low, F.col("other") == F.col("name")).select("u", F.col("low").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    labels = bounded_broadcast(connected_components(named))
    links = found.groupBy("code").agg(F.sum("links").alias("linked"))
    # Only classes with links or copies need a join with the rows.
    facts = classes.join(links, "code", "left").where("linked > 0 OR copies > 1").join(labels, F.col("low") == F.col("vertex"), "left")
    facts = facts.select("code", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("total"), F.coalesce("component", "low").alias("component"))
    joined = rows.join(bounded_broadcast(materialize(facts, "facts")), "code", "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("total", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
