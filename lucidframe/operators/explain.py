"""Explanation: associations, permutation importance, partial dependence and accumulated local effects.

A scorer is any function from a frame with the features to a column (regression: the prediction; binary: P(positive);
multiclass: an array of probabilities), so models and plain expressions are explained alike and expressions stay in the JVM.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidframe.contract import HIGHER_IS_BETTER, ContractError, Task, predictor_kind
from lucidframe.functions.expr import col, cut_points, hash_key, is_missing, order_statistics, rate, tie_blocks
from lucidframe.functions.stats import normal_quantile, t_quantile
from lucidframe.operators.metrics import auc, delta, loss_aggregate
from lucidframe.operators.split import reference_sample, strata_key
from lucidframe.shipping import ship

Score = Callable[[DataFrame], DataFrame]


def expression_scorer(make: Callable[[Callable[[str], Column]], Column], name: str = "score") -> Score:
    """A scorer from a column expression over the features."""
    return lambda df: df.withColumn(name, make(col))


# Associations


def _complete(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(~is_missing(df, a) & ~is_missing(df, b))


def _is_number(df: DataFrame, c: str) -> bool:
    return predictor_kind(df.schema[c].dataType) == "numeric"


def rank_correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], tuple[int, float | None]]:
    """Spearman's rho of every pair of columns without nulls, by mean ranks; none if either is constant.

    Every column is ranked once, and all pairs come from one aggregation.
    """
    rows = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    base, cuts = rows, cut_points(rows, rows.columns)
    for i in range(len(columns)):
        rows = rows.join(tie_blocks(base.select(f"v{i}"), f"v{i}", cuts=cuts[i]).select(f"v{i}", F.col("mean_rank").alias(f"r{i}")), f"v{i}")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = rows.agg(F.count(F.lit(1)), *[F.sum(F.col(f"r{i}") * F.col(f"r{j}")) for i, j in pairs]).first()
    n = row[0]
    # Mean ranks have the mean (n + 1) / 2, so products need no centring pass.
    moment = {k: (row[1 + at] or 0.0) - n * ((n + 1) / 2) ** 2 for at, k in enumerate(pairs)}
    out = {}
    for i, j in pairs:
        if i != j:
            scale = max(moment[i, i], 0.0) ** 0.5 * max(moment[j, j], 0.0) ** 0.5
            constant = min(moment[i, i], moment[j, j]) <= 1e-9 * n * max(n, 1) ** 2 / 12
            out[columns[i], columns[j]] = (n, None if n < 2 or constant else moment[i, j] / scale)
    return out


def spearman(df: DataFrame, a: str, b: str, cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """One row: n and rho from mean ranks; null if either is constant. cuts: known cut points of the columns."""
    rows = df.select(col(a).cast("double").alias("a"), col(b).cast("double").alias("b"))
    cuts = cuts or dict(zip((a, b), cut_points(rows, ["a", "b"])))
    ra = tie_blocks(rows.select("a"), "a", cuts=cuts[a]).select("a", F.col("mean_rank").alias("x"))
    rb = tie_blocks(rows.select("b"), "b", cuts=cuts[b]).select("b", F.col("mean_rank").alias("y"))
    middle = (F.count(F.lit(1)) + 1) / 2.0  # of mean ranks, so products need no centring pass
    sums = rows.join(ra, "a").join(rb, "b").agg(F.count(F.lit(1)).alias("n"), middle.alias("m"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    moment = {k: F.col(k) - F.col("n") * F.col("m") * F.col("m") for k in ("xy", "xx", "yy")}
    constant = F.least(moment["xx"], moment["yy"]) <= 1e-9 * F.col("n") * F.col("n") * F.col("n") / 12
    return sums.select("n", F.when((F.col("n") >= 2) & ~constant, moment["xy"] / (F.sqrt(moment["xx"]) * F.sqrt(moment["yy"]))).alias("rho"))


def correlation_ratio(df: DataFrame, number: str, category: str) -> DataFrame:
    """One row: n and the root of the share of variation between categories."""
    groups = df.groupBy(col(category).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(col(number).cast("double")).alias("m"), F.var_pop(col(number).cast("double")).alias("v"))
    totals = groups.agg(F.sum("n").alias("t"), rate(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"))
    between = F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))
    sums = groups.crossJoin(F.broadcast(totals)).agg(F.coalesce(F.max("t"), F.lit(0)).alias("n"), F.sum(between).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    return sums.select("n", F.sqrt(F.try_divide(F.col("b"), F.nullif(F.col("b") + F.col("w"), F.lit(0.0)))).alias("eta"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and V without bias correction; chi-squared as n times (sum of O^2 / (row * column) - 1), which needs full cells only."""
    cells = df.groupBy(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, columns = (cells.groupBy(k).agg(F.sum("o").alias(f"t{k}")) for k in ("a", "b"))
    joined = cells.join(rows, "a").join(columns, "b")
    sums = joined.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ta") * F.col("tb"))).alias("s"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    v = F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / F.nullif(F.least("r", "c") - 1, F.lit(0)))
    return sums.select("n", v.alias("v"))


def association(df: DataFrame, a: str, b: str, cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """One row (feature, other, n, association) on complete pairs; 0 for fewer than three rows or a constant."""
    both = _complete(df, a, b)
    if _is_number(df, a) and _is_number(df, b):
        found, name = spearman(both, a, b, cuts), "rho"
    elif _is_number(df, a) or _is_number(df, b):
        found, name = correlation_ratio(both, *((a, b) if _is_number(df, a) else (b, a))), "eta"
    else:
        found, name = cramers_v(both, a, b), "v"
    value = F.when(F.col("n") >= 3, F.coalesce(F.abs(name), F.lit(0.0))).otherwise(0.0)
    return found.select(F.lit(a).alias("feature"), F.lit(b).alias("other"), "n", value.alias("association"))


def associations(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """All unordered pairs of features."""
    names = list(features or df.columns)
    numbers = [c for c in names if _is_number(df, c)]
    cuts = dict(zip(numbers, cut_points(df, numbers)))  # of all columns in one pass
    pairs = [association(df, a, b, cuts) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        raise ContractError("associations need two features")
    return reduce(DataFrame.unionByName, pairs)


def dependence(df: DataFrame, features: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """For each feature its strongest association, the first partner of equals, and whether it reaches the threshold."""
    found = associations(df, features)
    both = found.select("feature", "other", "association").union(found.select(F.col("other"), F.col("feature"), F.col("association")))
    place = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    order = Window.partitionBy("feature").orderBy(F.desc("association"), place[F.col("other")])
    best = both.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("feature", F.col("other").alias("most_associated"), F.col("association").alias("max_association"), (F.col("association") >= threshold).alias("high_dependence")).orderBy(place[F.col("feature")])


# Permutation importance


def metric_by(scored: DataFrame, task: Task, metric: str, keys: Sequence[str]) -> DataFrame:
    if metric != "auc":
        return scored.groupBy(*keys).agg(loss_aggregate(task, metric, F.col("y"), F.col("score")).alias("value"))
    # Grouped AUC: mean ranks of distinct scores within each (feature, repeat).
    blocks = scored.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    ahead = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.withColumn("r", F.coalesce(F.sum("n").over(ahead), F.lit(0)) + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("pos") * F.col("r")).alias("s"))
    return sums.select(*keys, rate(F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0, F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("value"))


#: Rows of a random block, if values are dealt anew within such blocks only.
DEALT = 512
#: Rows up to which a stratum is permuted in one task, and rows of a part of a larger one.
PART = 32_768
#: A prime that leaves 2 when divided by 3, so that cubing is a bijection of the numbers below it.
PRIME = 2_147_483_579
ROUNDS = 3
#: Strata whose numbers of blocks are broadcast, the largest ones.
LARGE = 10_000


def turn_key(seed: int, group: str, repeat: int) -> str:
    """What a block's number (and stratum) is put behind to make the key of its order."""
    return f"{seed}|{group}|{repeat}|"


def cubes(x: np.ndarray, keys: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """A keyed bijection of the numbers below the prime, for each row of keys: each round adds a key and cubes."""
    p = np.uint64(prime)
    x = x[None, :] + keys[:, :1]
    for k in range(1, keys.shape[1] + 1):
        x = (x * x % p) * x % p
        if k < keys.shape[1]:
            x = x + keys[:, k : k + 1]
    return x


def dealt_orders(size: int, keys: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """(order, place): the places 0, 1, ... of `size` rows in the order of a keyed bijection, for each row of keys."""
    return np.argsort(cubes(np.arange(size, dtype=np.uint64), keys, prime), axis=1).astype(np.int32)


def order_prime(size: int) -> int:
    """Modulus of the orders of so many rows: PRIME for few of them, else the least prime from their number on that leaves 2 when divided by 3."""
    if size > PRIME:
        raise ContractError(f"at most {PRIME} rows of a stratum can be permuted")
    if size <= DEALT:
        return PRIME
    p = size + (2 - size) % 3
    while any(p % d == 0 for d in range(2, math.isqrt(p) + 1)):
        p += 3
    return p


def dealt_ranks(places: np.ndarray, size: int, prime: int, keys: np.ndarray) -> np.ndarray:
    """(order, place): which rank each of some places has in the order of all `size` ones, without sorting them.

    The bijection takes the places to all numbers below the prime but those that the few numbers from `size` on go to.
    """
    x = cubes(places.astype(np.uint64), keys, prime)
    others = np.sort(cubes(np.arange(size, prime, dtype=np.uint64), keys, prime), axis=1)
    return np.stack([v - np.searchsorted(o, v).astype(np.uint64) if len(o) else v for v, o in zip(x, others)]).astype(np.int64)


def order_keys(turns: Sequence[str], called: str) -> np.ndarray:
    """Keys of a block's (or stratum's) orders, a row for each turn."""
    digests = [hashlib.md5(f"{key}{called}".encode()).hexdigest() for key in turns]
    return np.array([[int(d[7 * k : 7 * k + 7], 16) for k in range(ROUNDS)] for d in digests], np.uint64)


def permutation_scores(df: DataFrame, score: Score, task: Task, metric: str, groups: dict[str, Sequence[str]], repeats: int = 20, seed: int = 123, row_id: str = "row_id", within: Sequence[str] | str | None = None, blocks: bool = False) -> DataFrame:
    """(feature, repeat, score, baseline, delta): the metric after the features' values are dealt anew, jointly in a group.

    df: row_id, y and the features. Every (feature, repeat) has a permutation of its own of all rows (of a stratum), all permutations being
    equally likely, so each value goes to one row, any row may get it, repeats are independent and a row may keep its own value, as often
    as chance has it. Strata of up to PART rows are permuted where they lie; of larger ones each value is sent to the part of the
    row that gets it. All are scored there; only sums leave. blocks: permute within random blocks of about DEALT rows of a stratum only,
    which sends no value.
    """
    strata: list[str] = []
    columns = df.columns
    if within is not None:
        df, strata = df.withColumn("__stratum", strata_key(df, [within] if isinstance(within, str) else list(within))), ["__stratum"]
    ship(df.sparkSession)
    if blocks:
        dealt = [dealt_in_place(random_blocks(df, columns, strata, seed, row_id), columns, strata, groups, repeats, seed, whole=False)]
    else:
        dealt = dealt_whole(df, columns, strata, groups, repeats, seed, row_id)
    scored = score(reduce(DataFrame.unionByName, dealt))
    names = list(groups)
    values = metric_by(scored, task, metric, ["__group", "__repeat"])
    values = values.select(F.element_at(F.array(*[F.lit(g) for g in names]), F.col("__group") + 1).alias("feature"), F.col("__repeat").alias("repeat"), "value")
    base = metric_by(score(df.drop(*strata)).withColumn("__all", F.lit(1)), task, metric, ["__all"]).select(F.col("value").alias("baseline"))
    return values.crossJoin(F.broadcast(base)).select("feature", "repeat", F.col("value").alias("score"), "baseline", delta(metric, F.col("value"), F.col("baseline")).alias("delta"))


def dealt_in_place(blocks: DataFrame, columns: Sequence[str], strata: Sequence[str], groups: dict[str, Sequence[str]], repeats: int, seed: int, whole: bool) -> DataFrame:
    """(__group, __repeat, columns): rows of blocks with the group's values permuted within the block. whole: blocks are whole strata."""
    names, place = list(groups), {c: i for i, c in enumerate(columns)}
    turns = [turn_key(seed, g, r) for g in names for r in range(1, repeats + 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, head = batch.column(batch.schema.get_field_index("rows")), batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                size = len(rows[i])
                found = dealt_orders(size, order_keys(turns, head[i]), order_prime(size) if whole else PRIME)
                orders = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel(), pa.int32()), size)
                orders = pa.ListArray.from_arrays(np.arange(0, len(turns) * size + 1, size, dtype=np.int32), orders.flatten())
                yield pa.RecordBatch.from_arrays([rows.slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(turns)], pa.int32()), orders)], ["rows", "orders"])

    # What a block is called in the keys of its orders.
    called = F.concat(F.col("__stratum") if strata else F.lit(""), F.lit("|"), F.col("__block").cast("string"))
    named = blocks.select(called.alias("called"), F.transform("rows", lambda r: r.dropFields("__key")).alias("rows"))
    packed = named.mapInArrow(deal, f"rows {named.schema['rows'].dataType.simpleString()}, orders array<array<int>>")
    # Three nested loops of one generated method: a block's orders, an order's places, and the rows there are only looked up in place.
    dealt = packed.select("rows", F.posexplode("orders").alias("turn", "order")).select("rows", "turn", F.posexplode("order").alias("at", "giver"))
    group, repeat = F.floor(F.col("turn") / repeats).cast("int"), (F.col("turn") % repeats + 1).cast("int")
    moved = {c: [k for k, g in enumerate(names) if c in groups[g]] for c in columns}
    own = lambda c: F.get("rows", F.col("at"))[f"c{place[c]}"]
    given = lambda c: F.get("rows", F.when(group.isin(*moved[c]), F.col("giver")).otherwise(F.col("at")))[f"c{place[c]}"]
    return dealt.select(group.alias("__group"), repeat.alias("__repeat"), *[(given(c) if moved[c] else own(c)).alias(c) for c in columns])


def dealt_whole(df: DataFrame, columns: Sequence[str], strata: Sequence[str], groups: dict[str, Sequence[str]], repeats: int, seed: int, row_id: str) -> list[DataFrame]:
    """Frames (__group, __repeat, columns) that together hold all rows with the group's values permuted within the whole stratum."""
    if strata:
        sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)  # at most one in PART rows
        large = {r["__stratum"]: r["n"] for r in sizes.collect()}
        found = F.broadcast(df.sparkSession.createDataFrame([(s,) for s in large], "__stratum string"))
        small = df.join(found, "__stratum", "left_anti") if large else df
    else:
        n = df.count()
        large, small = ({"": n}, None) if n > PART else ({}, df)
    out = []
    if small is not None:
        key = hash_key(seed, "place", col(row_id)).alias("__key")
        packed = small.select(*strata, F.struct(key, *[col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
        packed = packed.groupBy(*strata).agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") > 0)
        out.append(dealt_in_place(packed.withColumn("__block", F.lit(0)), columns, strata, groups, repeats, seed, whole=True))
    if large:
        out.append(dealt_across(df, large, columns, strata, groups, repeats, seed, row_id))
    return out


def large_parts(df: DataFrame, large: dict[str, int], strata: Sequence[str], seed: int, row_id: str) -> tuple[DataFrame, dict[str, tuple[int, list[int]]]]:
    """Rows of large strata with their part, and of each stratum its first part and where its parts start in hash order, and end."""
    heads, first = [], 0
    for s, n in sorted(large.items()):
        heads.append((s, first, -(-n // PART)))
        first += heads[-1][2]
    digest = hash_key(seed, "place", col(row_id))
    number = lambda at: F.conv(F.substring("__digest", at, 15), 16, 10).cast("long")
    keyed = df.withColumn("__digest", digest).withColumns({"__high": number(1), "__low": number(16)}).drop("__digest")
    if strata:
        found = df.sparkSession.createDataFrame(heads, "__stratum string, __first long, __parts long")
        keyed = keyed.join(F.broadcast(found), "__stratum")
    else:
        keyed = keyed.withColumns({"__stratum": F.lit(""), "__first": F.lit(0).cast("long"), "__parts": F.lit(first).cast("long")})
    # The upper 40 of the digest's first 60 bits, as a share of the parts: parts follow each other in hash order.
    keyed = keyed.withColumn("__part", F.col("__first") + F.shiftright(F.shiftright("__high", 20) * F.col("__parts"), 40)).drop("__first", "__parts")
    counts = {r["__part"]: r["count"] for r in keyed.groupBy("__part").count().collect()}  # one in PART rows
    return keyed, {s: (at, np.cumsum([0, *(counts.get(at + k, 0) for k in range(parts))]).tolist()) for s, at, parts in heads}


def dealt_across(df: DataFrame, large: dict[str, int], columns: Sequence[str], strata: Sequence[str], groups: dict[str, Sequence[str]], repeats: int, seed: int, row_id: str) -> DataFrame:
    """(__group, __repeat, columns): rows of large strata, whose values go from part to part.

    A row's place in hash order and a turn's keys say which place gets its value, so each part sends every part its values for the places there:
    all repeats of a group in one record. A part then holds, for each group, its own rows and exactly one value for each row and repeat.
    """
    names, kinds = list(groups), [df.schema[c].dataType for c in columns]
    moves = [[i for i, c in enumerate(columns) if c in groups[g]] for g in names]
    turns = [[turn_key(seed, g, r) for r in range(1, repeats + 1)] for g in names]
    keyed, heads = large_parts(df, large, strata, seed, row_id)
    parts = sum(len(starts) - 1 for _, starts in heads.values())
    primes = {s: order_prime(n) for s, n in large.items()}
    narrow = max(int(np.diff(starts).max()) for _, starts in heads.values()) <= 65_536  # two bytes hold a place in a part
    packed_place = np.dtype(np.uint16 if narrow else np.uint32)
    lists = [T.StructField(f"c{i}", T.ArrayType(kind)) for i, kind in enumerate(kinds)]
    sent = T.StructType([T.StructField("part", T.LongType()), T.StructField("group", T.IntegerType()), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType()), *lists])
    moved = sorted({i for some in moves for i in some})
    got = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("size", T.IntegerType()), *lists, *[T.StructField(f"g{i}", T.ArrayType(kinds[i])) for i in moved]])

    def send(table: pa.Table) -> pa.Table:
        stratum, part = table.column("__stratum")[0].as_py(), table.column("__part")[0].as_py()
        first, starts = heads[stratum]
        starts = np.array(starts, np.int64)
        hashes = [table.column(c).to_numpy() for c in ("__tie", "__low", "__high")]
        table = table.take(pa.array(np.lexsort(hashes)))
        values = [whole_array(table.column(f"c{i}")) for i in range(len(columns))]
        size, n = table.num_rows, len(starts) - 1
        places = np.arange(size) + starts[part - first]
        tables = []
        for k, some in enumerate(moves):
            ranks = dealt_ranks(places, int(starts[-1]), primes[stratum], order_keys(turns[k], f"{stratum}|0"))
            to = np.searchsorted(starts[1:], ranks, "right").astype(np.uint16 if n <= 65_536 else np.int64)
            at = (ranks - starts[to]).astype(packed_place).ravel()
            order = np.argsort(to.ravel(), kind="stable")  # by part, then repeat
            counts = np.bincount((to.astype(np.int64) * repeats + np.arange(repeats)[:, None]).ravel(), minlength=n * repeats)
            ends = np.concatenate([[0], np.cumsum(counts.reshape(n, repeats).sum(axis=1))]).astype(np.int32)
            giver = pa.array(order % size)
            found = pa.Table.from_arrays([
                pa.array(first + np.arange(n)), pa.array(np.full(n, k, np.int32)), pa.ListArray.from_arrays(np.arange(0, n * repeats + 1, repeats, dtype=np.int32), pa.array(counts.astype(np.int32))),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * packed_place.itemsize), pa.py_buffer(at[order])]), *[pa.ListArray.from_arrays(ends, v.take(giver)) if i in some else pa.nulls(n, pa.list_(v.type)) for i, v in enumerate(values)],
            ], sent.names)
            tables.append(found.filter(pa.array(np.diff(ends) > 0)))  # a part without rows is sent nothing
        # The part's own rows, once for each group, have no places.
        g, ends = len(moves), [0, size]
        rows = [pa.concat_arrays([pa.ListArray.from_arrays(ends, v)] * g) for v in values]
        tables.append(pa.Table.from_arrays([pa.array([part] * g, pa.int64()), pa.array(range(g), pa.int32()), pa.nulls(g, pa.list_(pa.int32())), pa.nulls(g, pa.binary()), *rows], sent.names))
        return pa.concat_tables(tables)

    def receive(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_null(table.column("places")))
        given = table.filter(pc.is_valid(table.column("places"))).combine_chunks()
        k = own.column("group")[0].as_py()
        rows = [whole_array(own.column(f"c{i}")) for i in range(len(columns))]
        size = len(rows[0].flatten())
        counts = whole_array(given.column("counts")).flatten().to_numpy()
        at = np.frombuffer(b"".join(given.column("places").to_pylist()), packed_place)
        target = np.repeat(np.tile(np.arange(repeats, dtype=np.int64), given.num_rows), counts) * size + at
        source = np.full(repeats * size, -1, np.int64)
        source[target] = np.arange(len(target))
        if own.num_rows != 1 or len(target) != len(source) or (source < 0).any():
            raise RuntimeError("a row was given no value, or several")
        values = {i: pa.ListArray.from_arrays([0, len(source)], whole_array(given.column(f"c{i}")).flatten().take(pa.array(source))) for i in moves[k]}
        return pa.Table.from_arrays([pa.array([k], pa.int32()), pa.array([size], pa.int32()), *rows, *[values.get(i, pa.nulls(1, rows[i].type)) for i in moved]], got.names)

    tie = F.xxhash64(*[col(c) for c in columns])  # orders rows of one identity, by content
    rows = keyed.select("__stratum", "__part", "__high", "__low", tie.alias("__tie"), *[col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-parts * len(names) // 4))
    pieces = rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-parts // 4)), "__part").groupBy("__part").applyInArrow(send, sent)
    packed = pieces.repartition(tasks, "part", "group").groupBy("part", "group").applyInArrow(receive, got)
    # Two nested loops: the repeats and the part's places, at which values are only looked up.
    turn = packed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    dealt = turn.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    own = lambda i: F.get(f"c{i}", F.col("at"))
    new = lambda i: F.get(f"g{i}", F.col("repeat") * F.col("size") + F.col("at"))
    value = lambda i: F.when(F.col("group").isin(*[k for k, some in enumerate(moves) if i in some]), new(i)).otherwise(own(i)) if i in moved else own(i)
    return dealt.select(F.col("group").alias("__group"), (F.col("repeat") + 1).alias("__repeat"), *[value(i).alias(c) for i, c in enumerate(columns)])


def whole_array(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def random_blocks(df: DataFrame, columns: Sequence[str], strata: Sequence[str], seed: int, row_id: str) -> DataFrame:
    """(strata, __block, rows): rows as structs c0, c1, ... in hash order, in random blocks of about DEALT rows of a stratum."""
    keyed = df.withColumn("__key", hash_key(seed, "place", col(row_id)))
    if strata:
        # Only strata of more than a block need their number of blocks. Rows meet it by broadcasts: a shuffle by stratum would bring a large one to one task.
        sizes = df.groupBy(*strata).agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("__n")).where("__n > 1").withColumnRenamed("__stratum", "__of").persist()
        try:
            known = {r["__of"]: r["__n"] for r in sizes.orderBy(F.desc("__n"), "__of").limit(LARGE + 1).collect()}
        finally:
            sizes.unpersist()
        found = keyed.sparkSession.createDataFrame(list(known.items())[:LARGE] or [("", 1)], "__of string, __n bigint")
        keyed = keyed.join(F.broadcast(found), F.col("__stratum") == F.col("__of"), "left").drop("__of")
        if len(known) > LARGE:  # none of the others holds more than one in LARGE rows
            light = keyed.where("__n IS NULL").drop("__n").join(sizes, F.col("__stratum") == F.col("__of"), "left").drop("__of")
            keyed = keyed.where("__n IS NOT NULL").unionByName(light)
        keyed = keyed.withColumn("__blocks", F.coalesce("__n", F.lit(1))).drop("__n")
    else:
        keyed = keyed.withColumn("__blocks", F.lit(max(1, -(-df.count() // DEALT))))
    block = F.pmod(F.conv(F.substring("__key", 1, 15), 16, 10).cast("long"), F.col("__blocks")).alias("__block")
    packed = keyed.select(*strata, block, F.struct("__key", *[col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    return packed.groupBy(*strata, "__block").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def importance_summary(scores: DataFrame, order: Sequence[str], confidence: float = 0.95, repeats: int = 100) -> DataFrame:
    """Per feature: mean delta, its error and t interval (null for one repeat), sign stability, mean permuted score. repeats: at most so many."""
    d = F.col("delta")
    found = scores.groupBy("feature").agg(
        F.count(F.lit(1)).alias("repeats"), F.avg(d).alias("importance"), F.stddev_samp(d).alias("sd"), F.avg("score").alias("permuted_score"), F.max("baseline").alias("baseline_score"),
        F.greatest(F.avg((d >= 0).cast("double")), F.avg((d <= 0).cast("double"))).alias("sign_stability"),
    )
    wide = F.create_map(*[F.lit(x) for n in range(2, repeats + 1) for x in (n, t_quantile(0.5 + confidence / 2, n - 1))]) if repeats > 1 else F.create_map(F.lit(0), F.lit(0.0))
    half = wide[F.col("repeats").cast("int")]
    se = F.col("sd") / F.sqrt("repeats")
    place = F.create_map(*[x for i, f in enumerate(order) for x in (F.lit(f), F.lit(i))])
    out = found.withColumn("se", se).withColumn("conf_low", F.col("importance") - half * F.col("se")).withColumn("conf_high", F.col("importance") + half * F.col("se")).drop("sd")
    return out.orderBy(F.desc_nulls_last("importance"), place[F.col("feature")])


def permutation_importance(df: DataFrame, score: Score, task: Task, metric: str, features: Sequence[str], repeats: int = 20, seed: int = 123, row_id: str = "row_id", groups: dict[str, Sequence[str]] | None = None, within=None, confidence: float = 0.95, blocks: bool = False) -> DataFrame:
    """Importance of each feature, features of a group permuted together. blocks: within random blocks only, see permutation_scores."""
    groups = dict(groups or {})
    inside = [f for names in groups.values() for f in names]
    if len(inside) != len(set(inside)):
        raise ContractError("a feature can be in one group only")
    named = {f: [f] for f in features if f not in inside} | groups
    if metric == "auc":
        auc(score(df), "y", "score", strict=True)
    return importance_summary(permutation_scores(df, score, task, metric, named, repeats, seed, row_id, within, blocks), list(named), confidence, repeats)


# Effects


@dataclass
class Effect:
    """A curve and what it rests on."""

    frame: DataFrame
    feature: str
    method: str
    rows: int
    dependence: float | None = None
    warning: str | None = None
    notes: dict = field(default_factory=dict)


def _target(task: Task, klass: str | None) -> Column:
    if task.kind == "multiclass":
        return F.get(F.col("score"), F.lit(task.levels.index(klass or task.levels[0])))
    if task.kind == "binary" and klass is not None and klass != task.positive:
        return 1 - F.col("score")
    return F.col("score")


def numeric_grid(df: DataFrame, feature: str, points: int = 20, quantiles: tuple[float, float] = (0.05, 0.95)) -> list[float]:
    """Equally spaced values between two quantiles; the distinct values if the two are equal."""
    x = F.when(~is_missing(df, feature), col(feature).cast("double"))
    low, high = order_statistics(df, {"x": x}, quantiles)["x"]
    if low is None:
        raise ContractError(f"{feature} has no values")
    if low == high:
        return sorted(r[0] for r in df.where(~is_missing(df, feature)).select(col(feature).cast("double")).distinct().limit(points).collect())
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def categorical_grid(df: DataFrame, feature: str, points: int = 20) -> list[str]:
    """The most frequent levels."""
    text = col(feature).cast("string")
    return [r[0] for r in df.where(~is_missing(df, feature)).groupBy(text.alias("x")).count().orderBy(F.desc("count"), "x").limit(points).collect()]


def partial_dependence(df: DataFrame, score: Score, task: Task, feature: str, points: int = 20, quantiles=(0.05, 0.95), sample_size: int = 1000, seed: int = 123, row_id: str = "row_id", klass: str | None = None, grid: Sequence | None = None) -> Effect:
    """Mean prediction with the feature set to each grid value on a bounded sample; se, normal band and support."""
    rows = reference_sample(df, row_id, sample_size, seed)
    number = _is_number(df, feature)
    grid = list(grid) if grid is not None else numeric_grid(df, feature, points, quantiles) if number else categorical_grid(df, feature, points)
    kind = df.schema[feature].dataType
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("grid_index"), F.lit(v).alias("value")) for i, v in enumerate(grid)])).alias("__grid")
    # A value between integers would be cut by an integer column's type, so numeric features are scored as doubles.
    set_to = F.col("__grid.value").cast("double") if number else F.col("__grid.value").cast(kind)
    spread = rows.select("*", values).withColumn("__own", col(feature)).withColumn(feature, set_to)
    scored = score(spread).withColumn("__p", _target(task, klass))
    curve = scored.groupBy("__grid.grid_index", "__grid.value").agg(F.count(F.lit(1)).alias("n"), F.avg("__p").alias("effect"), F.try_divide(F.stddev_samp("__p"), F.sqrt(F.count(F.lit(1)))).alias("se"), *([_near(grid)] if number else [F.avg((F.col("__own").cast("string") == F.col("__grid.value")).cast("double")).alias("share")]))
    z = normal_quantile(0.975)
    curve = curve.withColumns({"conf_low": F.col("effect") - z * F.col("se"), "conf_high": F.col("effect") + z * F.col("se")})
    curve = curve.withColumn("support", F.coalesce(F.try_divide(F.col("share"), F.nullif(F.max("share").over(Window.partitionBy()), F.lit(0.0))), F.lit(0.0)))
    return Effect(curve.drop("share").orderBy("grid_index"), feature, "pdp", min(sample_size, df.count()))


def _near(grid: Sequence[float]) -> Column:
    """Share of rows within half a typical grid step of the grid value."""
    steps = sorted(b - a for a, b in zip(grid, grid[1:]))
    half = (float(np.median(steps)) if steps else 0.0) / 2
    return F.avg((F.abs(F.col("__own").cast("double") - F.col("__grid.value")) <= half).cast("double")).alias("share")


def ale_boundaries(df: DataFrame, feature: str, points: int = 20) -> list[float]:
    """Distinct interpolated quantiles, one more than there are bins."""
    x = F.when(~is_missing(df, feature), col(feature).cast("double"))
    return sorted({c for c in order_statistics(df, {"x": x}, [i / points for i in range(points + 1)])["x"] if c is not None})


def ale(df: DataFrame, score: Score, task: Task, feature: str, points: int = 20, sample_size: int | None = None, seed: int = 123, row_id: str = "row_id", klass: str | None = None) -> Effect:
    """Accumulated local effects in one pass: every row is scored at both ends of its bin."""
    if not _is_number(df, feature):
        raise ContractError("accumulated local effects need a numeric feature")
    rows = reference_sample(df, row_id, sample_size, seed) if sample_size else df
    rows = rows.where(~is_missing(df, feature))
    cuts = ale_boundaries(rows, feature, points)
    if len(cuts) < 2:
        raise ContractError(f"{feature} does not vary")
    bins = len(cuts) - 1
    place = F.lit(1)
    for b in cuts[1:-1]:  # closed on the left, the last bin on both sides
        place = place + (col(feature).cast("double") >= F.lit(b)).cast("int")
    edges = F.array(*[F.lit(c) for c in cuts])
    placed = rows.withColumn("bin", place)
    # Both ends are scored side by side, so a row's difference needs no shuffle.
    low = score(placed.withColumn(feature, F.get(edges, F.col("bin") - 1))).withColumn("__low", _target(task, klass))
    both = score(low.withColumn(feature, F.get(edges, F.col("bin")))).withColumn("d", _target(task, klass) - F.col("__low"))
    found = {r["bin"]: r for r in both.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("local"), F.try_divide(F.stddev_samp("d"), F.sqrt(F.count(F.lit(1)))).alias("se")).collect()}  # a row for each bin
    counts = [found[k]["n"] if k in found else 0 for k in range(1, bins + 1)]
    local = [found[k]["local"] if k in found else 0.0 for k in range(1, bins + 1)]
    own = [found[k]["se"] if k in found else None for k in range(1, bins + 1)]
    weight = [n / sum(counts) for n in counts]
    summed = np.cumsum(local)
    effect = summed - float(np.dot(summed, weight))
    z = normal_quantile(0.975)
    table = []
    for k, se in enumerate(ale_errors(own, weight)):
        e = float(effect[k])
        table.append((k + 1, (cuts[k] + cuts[k + 1]) / 2, cuts[k], cuts[k + 1], counts[k], weight[k], float(local[k]), own[k], e, se, None if se is None else e - z * se, None if se is None else e + z * se, counts[k] / max(counts)))
    names = "bin int, value double, lower double, upper double, n bigint, weight double, local double, local_se double, effect double, se double, conf_low double, conf_high double, support double"
    return Effect(df.sparkSession.createDataFrame(table, names), feature, "ale", sum(counts), notes={"cuts": cuts, "interval": "bands show variation within bins, not uncertainty of the fit"})


def ale_errors(se: Sequence[float | None], weight: Sequence[float]) -> list[float | None]:
    """Standard errors of centred accumulated effects: rows of (I - 1 w')L scaled by the bins' errors; none if a bin has none."""
    if any(s is None or s != s for s in se):
        return [None] * len(se)
    n = len(se)
    lower = np.tril(np.ones((n, n)))
    centred = (np.eye(n) - np.outer(np.ones(n), np.asarray(weight))) @ lower
    return np.sqrt(((centred * np.asarray(se)) ** 2).sum(axis=1)).tolist()


def explain_effect(df: DataFrame, score: Score, task: Task, feature: str, method: str = "ale", **options) -> Effect:
    """ALE by default, or PDP, with a warning if a PDP's feature depends on others."""
    if method not in ("ale", "pdp"):
        raise ContractError("method must be ale or pdp")
    if method == "ale":
        return ale(df, score, task, feature, **options)
    effect = partial_dependence(df, score, task, feature, **options)
    others = [c for c in df.columns if c not in (feature, "y", options.get("row_id", "row_id")) and predictor_kind(df.schema[c].dataType) != "unsupported"]
    if others:
        strongest = reduce(DataFrame.unionByName, [association(df, feature, o) for o in others]).agg(F.max("association")).first()[0]
        effect.dependence = strongest
        effect.warning = "The feature depends on others: prefer accumulated local effects." if strongest >= 0.7 else None
    return effect


def partial_dependences(df: DataFrame, score: Score, task: Task, features: Sequence[str], **options) -> dict[str, Effect]:
    """Partial dependence of several features, by name in the order given."""
    repeated = [f for i, f in enumerate(features) if f in features[:i]]
    if not features or repeated:
        raise ContractError("name each feature once, and one at least")
    return {f: partial_dependence(df, score, task, f, **options) for f in features}


#: Other names of the effects.
pdp, ale_effect = partial_dependence, ale


def better(metric: str) -> int:
    return -1 if metric in HIGHER_IS_BETTER else 1
