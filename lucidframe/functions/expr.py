"""Columns with the engine's rules for missing values, undefined ratios, hash order and quoting."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Probabilities are kept this far from 0 and 1 before a logarithm.
EPSILON = 1e-15


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return col(name).isNull() | F.isnan(col(name)) if floating else col(name).isNull()


def rate(over: Column, under: Column) -> Column:
    """A ratio as a double; null where it is undefined."""
    return F.try_divide(over.cast("double"), under.cast("double"))


def clamp(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def hash_key(seed: int, salt: str, *columns: Column) -> Column:
    """The key of a repeatable shuffle: md5 of seed, purpose and row identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in columns]))


def hash_rank(df: DataFrame, key: str, name: str, strata: Sequence[str] = ()) -> DataFrame:
    """0-based rank in hash order within each stratum, without sorting a stratum in one task.

    Keys are hexadecimal digests, so their first three digits cut a stratum into 4,096 even parts: ranks are made within
    the parts and each part adds the count of those before it.
    """
    strata, part, before = list(strata), "__part", "__before"
    cut = df.withColumn(part, F.substring(key, 1, 3))
    order = Window.partitionBy(*strata).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if strata else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*strata, part).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn(before, F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*strata, part).orderBy(key)) - 1
    ranked = cut.withColumn(name, own.cast("long")).alias("l").join(offsets.select(*[F.col(s).alias(f"__o_{s}") for s in (*strata, part)], before).alias("o"), on=_equal(strata, part), how="inner")
    return ranked.withColumn(name, F.col(name) + F.col(before)).drop(part, before, *[f"__o_{s}" for s in (*strata, part)])


def _equal(strata: Sequence[str], part: str) -> Column:
    condition = F.col(f"l.{part}") == F.col(f"o.__o_{part}")
    for s in strata:
        condition = condition & F.col(f"l.{s}").eqNullSafe(F.col(f"o.__o_{s}"))
    return condition


def cut_points(df: DataFrame, columns: Sequence[str], parts: int = 64) -> list[list[float]]:
    """Approximate quantiles of some columns in one pass: they spread work and decide no result."""
    if not columns:
        return []
    at = [i / parts for i in range(1, parts)]
    row = df.agg(*[F.percentile_approx(F.when(~is_missing(df, c), col(c)), at, 1000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(x or [])) for x in row]


def candidate_cuts(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float]]:
    """Distinct values near some quantiles of columns, by Spark's sketch in one pass: places where a learner tries to cut, not results."""
    return counted_cuts(df, columns, probs)[0] if columns else {}


def counted_cuts(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> tuple[dict[str, list[float]], int]:
    """What candidate_cuts finds, and how many rows there are."""
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(c.cast("double")), c.cast("double")), list(probs), SKETCH).alias(f"c{i}") for i, c in enumerate(columns.values())], F.count(F.lit(1)).alias("n")).first()
    return {name: sorted(set(row[i] or [])) for i, name in enumerate(columns)}, row["n"]


def tie_blocks(df: DataFrame, value: str, sums: dict[str, Column] | None = None, parts: int = 64, cuts: Sequence[float] | None = None) -> DataFrame:
    """One row for each distinct value: value, n, the sums, before (rows with smaller values) and mean_rank.

    Distinct values are cut into parts by approximate quantiles, which changes no result, so no task sees them all; the
    parts' totals, at most `parts` rows, make the offsets.
    """
    sums = sums or {}
    blocks = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    cuts = cut_points(df, [value], parts)[0] if cuts is None else cuts
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    blocks = blocks.withColumn("__part", F.size(F.filter(edges, lambda c: c < F.col(value))))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("__part").agg(F.sum("n").alias("__n"))
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    own = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.join(F.broadcast(totals), "__part").withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)) + F.col("__offset"))
    return out.withColumn("mean_rank", F.col("before") + (F.col("n") + 1) / 2.0).drop("__part", "__offset")


#: Rows of a bracket that order statistics are picked from; the relative error of the sketch that makes brackets.
PICKED, SKETCH = 1_000_000, 10_000


def order_statistics(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles (at p * (n - 1) from 0) of some columns, null and NaN left out; none for a column without values.

    A sketch brackets each order statistic, one pass counts what lies below a bracket and on its ends and collects what lies
    between, a fraction of 4 / SKETCH of the rows; a bracket that still holds more than PICKED rows is sketched again. No
    task holds all distinct values, and all columns share their passes.
    """
    values = {}
    for k, c in columns.items():
        c = c.cast("double")
        values[k] = F.when(~F.isnan(c), c)
    names = list(values)
    df = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    margin = 2.0 / SKETCH
    near = sorted({min(max(x, 0.0), 1.0) for p in probs for x in (p - margin, p + margin)})
    first = df.agg(*[x for i in range(len(names)) for x in (F.count(f"v{i}"), F.percentile_approx(f"v{i}", near, SKETCH), F.min(f"v{i}"), F.max(f"v{i}"))]).first() if names else ()
    found: dict[str, list[float | None]] = {}
    wanted: dict[tuple[int, int], tuple[float, float]] = {}
    counts = []
    for i in range(len(names)):
        n, sketch, least, most = first[4 * i : 4 * i + 4]
        counts.append(n)
        for p in probs if n else ():
            for rank in {int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1)}:
                low, high = (sketch[near.index(min(max(x, 0.0), 1.0))] for x in (p - margin, p + margin))
                wanted[i, rank] = (least if p <= margin else low, most if p >= 1 - margin else high)
    got: dict[tuple[int, int], float] = {}
    while wanted:
        keys = list(wanted)
        aggregates = []
        for i, rank in keys:
            low, high = wanted[i, rank]
            x = F.col(f"v{i}")
            aggregates += [F.count(F.when(x < low, 1)), F.count(F.when(x == low, 1)), F.count(F.when((x > low) & (x < high), 1)), F.count(F.when(x == high, 1))]
        many = any(4 * counts[i] / SKETCH > PICKED for i, _ in keys)
        if not many:  # the brackets' insides are small
            aggregates += [F.collect_list(F.when((F.col(f"v{i}") > wanted[i, r][0]) & (F.col(f"v{i}") < wanted[i, r][1]), F.col(f"v{i}"))) for i, r in keys]
        row = df.agg(*aggregates).first()
        again: dict[tuple[int, int], tuple[float, float]] = {}
        inside: list[tuple[int, int, int]] = []
        for k, (i, rank) in enumerate(keys):
            below, on_low, between, on_high = row[4 * k : 4 * k + 4]
            low, high = wanted[i, rank]
            at = rank - below
            if at < 0 or (low != high and at >= on_low + between + on_high):  # the sketch was off: widen to that side
                again[i, rank] = (first[4 * i + 2], low) if at < 0 else (high, first[4 * i + 3])
            elif at < on_low or low == high:
                got[i, rank] = low
            elif at >= on_low + between:
                got[i, rank] = high
            elif many:
                inside.append((i, rank, at - on_low))
            else:
                got[i, rank] = sorted(row[4 * len(keys) + k])[at - on_low]
        for i, rank, at in inside:  # one sketch within a bracket at a time; each thins it out by SKETCH / 4
            low, high = wanted[i, rank]
            x = F.col(f"v{i}")
            part = df.where((x > low) & (x < high))
            n = part.count()
            p = at / max(n - 1, 1)
            a, b = part.agg(F.percentile_approx(x, [max(0.0, p - margin), min(1.0, p + margin)], SKETCH)).first()[0]
            c, d = part.agg(F.min(x), F.max(x)).first()
            if 4 * n / SKETCH <= 1 or (a, b) == (c, d):
                got[i, rank] = part.select(x).orderBy(x).offset(at).first()[0]
            else:
                again[i, rank] = (c if p <= margin else a, d if p >= 1 - margin else b)
        wanted = again
    for i, name in enumerate(names):
        n, out = counts[i], []
        for p in probs:
            if not n:
                out.append(None)
                continue
            at = p * (n - 1)
            low, high = got[i, int(at)], got[i, min(int(at) + 1, n - 1)]
            out.append(low + (high - low) * (at - int(at)))
        found[name] = out
    return found


def row_sums(df: DataFrame) -> DataFrame:
    """One row (rows, low, high): how many rows, and the sums of two 60-bit parts of each row's md5, which no order of rows changes."""
    key = F.md5(F.to_json(F.struct(*[col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(key, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("low"), part(17).alias("high"))


def frame_digest(df: DataFrame) -> str:
    """A digest of a frame's columns and rows that doesn't depend on the order of either; repeated rows count."""
    row = row_sums(df).first()
    return hashlib.sha256(repr((sorted(df.dtypes), row["rows"], int(row["low"]), int(row["high"]))).encode()).hexdigest()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded, minus zero made zero: what queries return, so that engines agree."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(col(c), digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else col(c) for c in df.columns])
