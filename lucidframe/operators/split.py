"""Exact, repeatable partitions in hash order: holdout, folds, samples, strata, permutations, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import ContractError
from lucidframe.functions.expr import col, hash_key, hash_rank, is_missing, order_statistics

SALT = "split"


def with_row_id(df: DataFrame, name: str = "row_id", order: Sequence[str] | None = None) -> DataFrame:
    """A row number that depends on the rows alone: their order by all columns, equal rows being interchangeable."""
    order = list(order or df.columns)
    keyed = df.withColumn("__key", F.md5(F.to_json(F.struct(*[col(c) for c in order]), {"ignoreNullFields": "false"})))
    return hash_rank(keyed, "__key", name).drop("__key")


def quota(n: int, fraction: float, least_left: int = 1) -> int:
    """Rows held out of n: rounded half to even, at least one and never all."""
    return max(least_left, min(n - least_left, round(n * fraction)))


def holdout(df: DataFrame, row_id: str, fraction: float = 0.2, seed: int = 123, stratum: str | None = None, flag: str = "held_out") -> DataFrame:
    """The rows with a flag: exactly the asked share, within every class if there is a stratum."""
    keyed = df.withColumn("__key", hash_key(seed, SALT, col(row_id)))
    if stratum is None:
        n = df.count()
        if n < 4:
            raise ContractError("at least four rows are needed for a holdout")
        return hash_rank(keyed, "__key", "__rank").withColumn(flag, F.col("__rank") < quota(n, fraction, 2)).drop("__key", "__rank")
    counts = {r[0]: r[1] for r in df.groupBy(col(stratum)).count().collect()}
    if min(counts.values()) < 2:
        raise ContractError("every class needs at least two rows for a holdout")
    take = F.lit(None).cast("long")
    for level, n in counts.items():
        take = F.when(col(stratum).eqNullSafe(F.lit(level)), quota(n, fraction)).otherwise(take)
    return hash_rank(keyed, "__key", "__rank", [stratum]).withColumn(flag, F.col("__rank") < take).drop("__key", "__rank")


def folds(df: DataFrame, row_id: str, k: int = 5, seed: int = 123, stratum: str | None = None, name: str = "fold") -> DataFrame:
    """Fold numbers 1..K dealt in hash order within classes; K is at most the smallest class, or half the rows."""
    if stratum is None:
        most = df.count() // 2
    else:
        most = min(r[1] for r in df.groupBy(col(stratum)).count().collect())
    k = min(k, most)
    if k < 2:
        raise ContractError("too few rows for two folds")
    keyed = df.withColumn("__key", hash_key(seed, "fold", col(row_id)))
    ranked = hash_rank(keyed, "__key", "__rank", [stratum] if stratum else [])
    return ranked.withColumn(name, (F.pmod(F.col("__rank"), F.lit(k)) + 1).cast("int")).drop("__key", "__rank")


def supplied_folds(df: DataFrame, labels: str, row_id: str, stratum: str | None = None, name: str = "fold") -> DataFrame:
    """Folds from given labels, numbered by first appearance; each needs two rows, and every class on both sides."""
    found = df.groupBy(col(labels).alias("label")).agg(F.min(col(row_id)).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    if len(found) < 2 or any(r["label"] is None for r in found):
        raise ContractError("fold labels must not be missing, and at least two folds are needed")
    if min(r["n"] for r in found) < 2:
        raise ContractError("every fold needs at least two rows")
    if stratum:
        classes = {r[0] for r in df.select(col(stratum)).distinct().collect()}
        by = df.groupBy(col(labels).alias("l"), col(stratum).alias("s")).count().collect()
        for r in found:
            inside = {x["s"] for x in by if x["l"] == r["label"]}
            outside = {x["s"] for x in by if x["l"] != r["label"]}
            if inside != classes or outside != classes:
                raise ContractError(f"fold {r['label']} does not hold every class on both sides")
    number = F.create_map(*[F.lit(x) for i, r in enumerate(found) for x in (r["label"], i + 1)])
    return df.withColumn(name, number[col(labels)].cast("int"))


def reference_sample(df: DataFrame, row_id: str, size: int, seed: int = 123) -> DataFrame:
    """At most `size` rows without replacement, first in hash order."""
    keyed = df.withColumn("__key", hash_key(seed, "sample", col(row_id)))
    return keyed.orderBy("__key").limit(size).drop("__key")


def overlap(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Evaluation rows that stand in training too, missing values being equal."""
    names = [c for c in evaluation.columns if c in training.columns]
    left, right = evaluation.alias("e"), training.select(*[col(c) for c in names]).distinct().alias("t")
    condition = F.lit(True)
    for c in names:
        q = c.replace("`", "``")
        condition = condition & F.col(f"e.`{q}`").eqNullSafe(F.col(f"t.`{q}`"))
    return left.join(right, condition, "left_semi")


def check_overlap(training: DataFrame, evaluation: DataFrame, action: str = "warn") -> int:
    """How many evaluation rows overlap; raises if asked to."""
    if action == "ignore":
        return 0
    n = overlap(training, evaluation).count()
    if n and action == "error":
        raise ContractError(f"{n} evaluation rows are training rows too")
    return n


def strata_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """Strata of a blocked permutation: numbers of more than ten values by quintile, closed on the right; else the values."""
    parts = []
    for c in columns:
        if dict(df.dtypes)[c] not in ("string", "boolean") and df.select(col(c)).distinct().limit(11).count() > 10:
            cuts = sorted(set(order_statistics(df, {c: col(c)}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])[c]))
            inner, bin_ = cuts[1:-1], F.lit(1)
            for b in inner:
                bin_ = bin_ + (col(c) > F.lit(b)).cast("int")
            parts.append(F.when(is_missing(df, c), F.lit("NA")).otherwise(bin_.cast("string")))
        else:
            parts.append(F.coalesce(col(c).cast("string"), F.lit("NA")))
    return F.concat_ws("|", *parts)
