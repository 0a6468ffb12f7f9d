"""Comparing models: prediction pairs, aligned effect curves, rank agreement."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task
from lucidframe.functions.expr import order_statistics
from lucidframe.operators.explain import rank_correlations
from lucidframe.operators.metrics import first_argmax

#: Changes below this are no direction.
ROOT_EPSILON = 2.0**-26

DISTANCES = {
    REGRESSION: "absolute difference of predictions, in the outcome's units",
    BINARY: "absolute difference of positive-class probabilities",
    MULTICLASS: "total variation distance of class probabilities",
}


def distance(task: Task, a: Column, b: Column) -> Column:
    if task.kind != MULTICLASS:
        return F.abs(a - b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def hard_disagreement(task: Task, a: Column, b: Column) -> Column:
    if task.kind == REGRESSION:
        return F.lit(None).cast("double")
    if task.kind == BINARY:
        return ((a >= 0.5) != (b >= 0.5)).cast("double")
    return (first_argmax(a) != first_argmax(b)).cast("double")


def prediction_pairs(df: DataFrame, task: Task, models: Sequence[str]) -> DataFrame:
    """Distances of every unordered pair of models' predictions, and their rank correlation: a row for each pair, from passes that all pairs share."""
    if len(models) < 2:
        raise ContractError("pairs need two models")
    pairs = list(combinations(models, 2))
    distances = {f"{i}": distance(task, F.col(a), F.col(b)) for i, (a, b) in enumerate(pairs)}
    middle = order_statistics(df, distances, (0.5, 0.9))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (a, b) in enumerate(pairs):
        aggregates += [F.avg(hard_disagreement(task, F.col(a), F.col(b))).alias(f"h{i}"), F.avg(distances[f"{i}"]).alias(f"m{i}"), F.max(distances[f"{i}"]).alias(f"x{i}")]
    row = df.agg(*aggregates).first()
    if task.kind == MULTICLASS:
        each = [rank_correlations(df.select(*[F.get(F.col(m), F.lit(k)).alias(m) for m in models]), models) for k in range(len(task.levels))]
        rho = {}
        for p in pairs:
            known = [e[p][1] for e in each if e[p][1] is not None]
            rho[p] = sum(known) / len(known) if known else None
    else:
        rho = {p: r for p, (_, r) in rank_correlations(df, models).items()}
    table = [(a, b, row["n"], row[f"h{i}"], row[f"m{i}"], *middle[f"{i}"], row[f"x{i}"], rho[a, b]) for i, (a, b) in enumerate(pairs)]
    names = "model_a string, model_b string, n bigint, class_disagreement_rate double, mean_prediction_distance double, median_prediction_distance double, p90_prediction_distance double, max_prediction_distance double, prediction_rank_correlation double"
    return df.sparkSession.createDataFrame(table, names).orderBy(F.desc("mean_prediction_distance"), "model_a", "model_b")


def effect_pairs(curves: DataFrame, min_support: float = 0.1) -> DataFrame:
    """Every unordered pair of aligned curves (model_id, grid_index, value, effect, support): gaps and agreement where both have support."""
    c = curves.withColumn("ok", (F.col("support") >= min_support) & F.col("effect").isNotNull())
    a = c.select(F.col("model_id").alias("model_a"), "grid_index", "value", F.col("effect").alias("ea"), F.col("ok").alias("oka"))
    b = c.select(F.col("model_id").alias("model_b"), "grid_index", F.col("effect").alias("eb"), F.col("ok").alias("okb"))
    both = a.join(b, "grid_index").where("model_a < model_b").withColumn("ok", F.col("oka") & F.col("okb"))
    key = ["model_a", "model_b"]
    kept = both.where("ok")
    names = both.select(*key).distinct()
    own = Window.partitionBy(*key)
    gap = F.col("ea") - F.col("eb")
    shaped = kept.withColumn("shape", (F.col("ea") - F.avg("ea").over(own)) - (F.col("eb") - F.avg("eb").over(own)))
    following = own.orderBy("value")
    shaped = shaped.withColumns({"da": F.col("ea") - F.lag("ea").over(following), "db": F.col("eb") - F.lag("eb").over(following)})
    for x, name in (("ea", "ra"), ("eb", "rb")):
        shaped = shaped.withColumn(name, F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, x)) - 1) / 2.0)
    telling = (F.abs("da") > ROOT_EPSILON) | (F.abs("db") > ROOT_EPSILON)
    n, mean = F.count(F.lit(1)), F.avg
    cov = mean(F.col("ra") * F.col("rb")) - mean("ra") * mean("rb")
    var = (mean(F.col("ra") * F.col("ra")) - mean("ra") * mean("ra")) * (mean(F.col("rb") * F.col("rb")) - mean("rb") * mean("rb"))
    found = shaped.groupBy(*key).agg(
        n.alias("n_overlap"), mean(F.abs(gap)).alias("mean_absolute_level_gap"), F.when(n >= 2, F.sqrt(mean(F.col("shape") * F.col("shape")))).alias("centered_shape_rmse"), F.max(F.abs(gap)).alias("max_absolute_gap"),
        F.when(n >= 2, F.try_divide(cov, F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)))).alias("effect_rank_correlation"),
        mean(F.when(telling, (F.signum("da") == F.signum("db")).cast("double"))).alias("direction_agreement"),
    )
    out = names.join(found, key, "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)))
    return out.orderBy(F.desc_nulls_last("centered_shape_rmse"), "model_a", "model_b")


def average_ranks(values: Sequence[float]) -> np.ndarray:
    x = np.asarray(values, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def rank_correlation(a: Sequence[float], b: Sequence[float]) -> float | None:
    """Spearman's of two short lists; none for fewer than two values or a constant."""
    if len(a) < 2 or len(set(a)) < 2 or len(set(b)) < 2:
        return None
    x, y = average_ranks(a), average_ranks(b)
    x, y = x - x.mean(), y - y.mean()
    return float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))


def importance_agreement(importance: dict[str, dict[str, float]], features: Sequence[str]) -> dict:
    """Rank correlations of models' importances, their mean, and each feature's range."""
    names = list(importance)
    pairs = {(a, b): rank_correlation([importance[a][f] for f in features], [importance[b][f] for f in features]) for a, b in combinations(names, 2)}
    known = [v for v in pairs.values() if v is not None]
    ranges = [{"feature": f, "min_importance": min(importance[m][f] for m in names), "max_importance": max(importance[m][f] for m in names), "mean_importance": sum(importance[m][f] for m in names) / len(names)} for f in features]
    ranges = sorted((r | {"importance_range": r["max_importance"] - r["min_importance"]} for r in ranges), key=lambda r: (-r["importance_range"], r["feature"]))
    return {"models": names, "pairs": pairs, "mean_rank_correlation": sum(known) / len(known) if known else None, "ranges": ranges}


def prediction_agreement(df: DataFrame, task: Task, models: Sequence[str]) -> dict:
    """score: mean rank correlation (1 - ambiguity for several classes); ambiguity: disagreement, or spread over deviation."""
    if len(models) < 2:
        return {"score": None, "ambiguity": None}
    if task.kind == MULTICLASS:
        labels = F.array(*[first_argmax(F.col(m)) for m in models])
        ambiguity = df.agg(F.avg((F.size(F.array_distinct(labels)) > 1).cast("double"))).first()[0]
        return {"score": 1 - ambiguity, "ambiguity": ambiguity}
    known = [r for _, r in rank_correlations(df, models).values() if r is not None]
    all_ = F.array(*[F.col(m).cast("double") for m in models])
    if task.kind == BINARY:
        ambiguity = df.agg(F.avg((F.size(F.array_distinct(F.transform(all_, lambda x: x >= 0.5))) > 1).cast("double"))).first()[0]
    else:
        spread = df.agg(F.avg(F.array_max(all_) - F.array_min(all_))).first()[0]
        scale = df.select(F.explode(all_).alias("p")).agg(F.stddev_samp("p")).first()[0]
        ambiguity = spread / scale if scale else 0.0
    return {"score": sum(known) / len(known) if known else None, "ambiguity": ambiguity}
