"""From fold scores to a selected configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.contract import HIGHER_IS_BETTER


def fold_uncertainty(scores: DataFrame, metric: str, key: str = "configuration_id") -> DataFrame:
    """(key, folds, cv_score, cv_sd, cv_se) of (key, score, rows): weighted by rows; an RMSE is pooled on squares and its errors follow by the delta method.

    A fold without a score leaves the whole configuration without one.
    """
    pooled = metric == "rmse"
    part = F.col("score") * F.col("score") if pooled else F.col("score")
    total = Window.partitionBy(key)
    w = F.try_divide(F.col("rows").cast("double"), F.sum("rows").over(total).cast("double"))
    weighted = scores.withColumns({"w": w, "x": part}).withColumn("m", F.sum(F.col("w") * F.col("x")).over(total))
    squares = weighted.groupBy(key).agg(
        F.count(F.lit(1)).alias("folds"), F.count("score").alias("scored"), F.max("m").alias("m"), F.sum(F.col("w") * F.col("w")).alias("ww"),
        F.sum(F.col("w") * (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("v"),
    )
    whole = F.col("scored") == F.col("folds")
    sd = F.when((F.col("folds") >= 2) & (F.col("ww") < 1), F.sqrt(F.greatest(F.lit(0.0), F.col("v")) / (1 - F.col("ww"))))
    se = sd * F.sqrt("ww")
    score = F.sqrt("m") if pooled else F.col("m")
    scale = F.when(score == 0, 0.0).otherwise(1 / (2 * F.nullif(score, F.lit(0.0)))) if pooled else F.lit(1.0)
    return squares.select(key, "folds", F.when(whole, score).alias("cv_score"), F.when(whole, sd * scale).alias("cv_sd"), F.when(whole, se * scale).alias("cv_se"))


def select_best(candidates: DataFrame, metric: str) -> DataFrame:
    """The best score, the first of equals in plan order."""
    sign = -1.0 if metric in HIGHER_IS_BETTER else 1.0
    return candidates.where(F.col("cv_score").isNotNull()).orderBy(F.col("cv_score") * sign, "plan_order").limit(1)


def select_one_se(candidates: DataFrame) -> DataFrame:
    """Among scores within one error of the best: the simplest family, its least flexible setting, then the score.

    candidates: configuration_id, family, simplicity_rank, complexity_proxy, cv_score, cv_se, plan_order; losses only.
    """
    best = candidates.where("cv_score IS NOT NULL").orderBy("cv_score", "plan_order").limit(1)
    limit = best.select((F.col("cv_score") + F.coalesce("cv_se", F.lit(0.0))).alias("limit"))
    eligible = candidates.crossJoin(F.broadcast(limit)).where(F.col("cv_score") <= F.col("limit"))
    simplest = eligible.withColumn("p", F.min("simplicity_rank").over(Window.partitionBy())).where("simplicity_rank = p")
    own = Window.partitionBy("family").orderBy("complexity_proxy", "cv_score", "configuration_id")
    first = simplest.withColumn("r", F.row_number().over(own)).where("r = 1")
    return first.orderBy("cv_score", "family", "configuration_id").limit(1).drop("p", "r", "limit")


def one_se(candidates: Sequence[dict]) -> dict:
    """The same rule on the driver, for a plan's few rows."""
    known = [c for c in candidates if c["cv_score"] is not None]
    best = min(known, key=lambda c: c["cv_score"])
    limit = best["cv_score"] + (best["cv_se"] or 0.0)
    near = [c for c in known if c["cv_score"] <= limit]
    near = [c for c in near if c["simplicity_rank"] == min(x["simplicity_rank"] for x in near)]
    firsts = [min((c for c in near if c["family"] == f), key=lambda c: (c["complexity_proxy"], c["cv_score"], c["configuration_id"])) for f in dict.fromkeys(c["family"] for c in near)]
    return min(firsts, key=lambda c: (c["cv_score"], c["family"], c["configuration_id"]))
