"""Held-out metrics as aggregations, and the tables made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, HIGHER_IS_BETTER, METRICS, REGRESSION, Task
from lucidframe.functions.expr import clamp, order_statistics, rate, tie_blocks

#: The formula of each metric, over evaluation rows with outcome y and score p, and which way is better.
DEFINITIONS = {
    "rmse": "sqrt(mean((p - y)^2)); less is better.",
    "mae": "mean(|p - y|); less is better.",
    "r_squared": "1 - sum((p - y)^2) / sum((y - mean(y))^2); more is better, 0 is the mean's.",
    "log_loss": "mean(-log(p of the class that came)), p kept 1e-15 from 0 and 1; less is better.",
    "brier_score": "mean((p - y)^2) for two classes, summed over classes for more; less is better.",
    "calibration_error": "mean over groups of |mean p - share of positives|, weighted by rows; less is better.",
    "accuracy": "share of rows whose called class came; more is better.",
    "balanced_accuracy": "mean of both classes' shares called right, null without one of them; more is better.",
    "roc_auc": "share of positive-negative pairs in which the positive has the higher p, ties half; more is better.",
    "macro_recall": "mean of all classes' shares called right, null without one of them; more is better.",
}


def metric_definitions(task: Task) -> dict[str, str]:
    names = list(METRICS[task.kind])
    if task.kind != REGRESSION:
        names.insert(2, "calibration_error")
    return {n: DEFINITIONS[n] for n in names}


def regression_aggregates(y: Column, p: Column) -> dict[str, Column]:
    error = p - y
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r_squared": F.lit(1.0) - F.try_divide(F.sum(error * error), F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))),
    }


def binary_aggregates(y: Column, p: Column) -> dict[str, Column]:
    """All but the AUC. Probabilities are clamped first; one of exactly one half is positive."""
    q, hit = clamp(p), None
    said = (q >= 0.5).cast("int")
    hit = (said == y).cast("double")
    recall = [F.avg(F.when(y == k, hit)) for k in (0, 1)]
    return {
        "log_loss": F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))),
        "brier_score": F.avg((q - y) * (q - y)),
        "accuracy": F.avg(hit),
        "balanced_accuracy": (recall[0] + recall[1]) / 2,
    }


def first_argmax(p: Column) -> Column:
    """0-based place of the first greatest probability."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def multiclass_aggregates(y: Column, p: Column, classes: int) -> dict[str, Column]:
    own = F.get(p, y)
    hit = (first_argmax(p) == y).cast("double")
    squares = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x) - own * own + (own - 1) * (own - 1)
    recalls = [F.avg(F.when(y == k, hit)) for k in range(classes)]
    return {
        "log_loss": F.avg(-F.log(clamp(own))),
        "brier_score": F.avg(squares),
        "accuracy": F.avg(hit),
        "macro_recall": sum(recalls[1:], recalls[0]) / classes,
    }


def auc(df: DataFrame, y: str, score: str, strict: bool = False) -> DataFrame:
    """One row: positives, negatives and roc_auc, from distinct scores with mean ranks; null for one class, or an error."""
    blocks = tie_blocks(df.select(F.col(y).alias("y"), F.col(score).alias("score")), "score", {"pos": F.col("y")})
    found = blocks.agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), F.sum(F.col("pos") * F.col("mean_rank")).alias("ranks"))
    area = rate(F.col("ranks") - F.col("positives") * (F.col("positives") + 1) / 2.0, F.col("positives") * F.col("negatives"))
    found = found.select("positives", "negatives", area.alias("roc_auc"))
    if strict and found.first()["roc_auc"] is None:
        raise ValueError("the area under the curve needs both classes")
    return found


def aggregates(task: Task, y: Column, p: Column) -> dict[str, Column]:
    """The metrics of a task that are plain aggregates: all but the AUC."""
    if task.kind == REGRESSION:
        return regression_aggregates(y, p)
    return binary_aggregates(y, p) if task.kind == BINARY else multiclass_aggregates(y, p, len(task.levels))


def evaluate(df: DataFrame, task: Task, y: str = "y", score: str = "score") -> DataFrame:
    """One row with all metrics of the task. score: a prediction, P(positive), or an array in level order."""
    actual, p = F.col(y), F.col(score)
    out = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in aggregates(task, actual, p).items()])
    return out.crossJoin(auc(df, y, score).select("roc_auc")) if task.kind == BINARY else out


def loss_aggregate(task: Task, metric: str, y: Column, p: Column) -> Column:
    """A metric of importance scoring; its Brier score takes raw probabilities. The AUC has its own path."""
    if task.kind == REGRESSION:
        return regression_aggregates(y, p)[metric]
    if task.kind == BINARY:
        if metric == "brier":
            return F.avg((p - y) * (p - y))
        return {"logloss": binary_aggregates(y, p)["log_loss"], "accuracy": F.avg(((p >= 0.5).cast("int") == y).cast("double"))}[metric]
    named = multiclass_aggregates(y, p, len(task.levels))
    return {"logloss": named["log_loss"], "brier": named["brier_score"], "accuracy": named["accuracy"]}[metric]


def delta(metric: str, permuted: Column, baseline: Column) -> Column:
    """How much worse: losses rise, accuracy and AUC fall."""
    return baseline - permuted if metric in HIGHER_IS_BETTER else permuted - baseline


def leaderboard(scores: DataFrame, primary: str, baseline_id: str = "baseline") -> DataFrame:
    """(model_id, metrics) rows with rank (least of equals), winner and improvement over the baseline's primary metric."""
    sign = -1.0 if primary in HIGHER_IS_BETTER else 1.0
    base = scores.where(F.col("model_id") == baseline_id).select(F.col(primary).alias("__base"))
    ranked = scores.withColumn("rank", F.rank().over(Window.orderBy((F.col(primary) * sign).asc_nulls_last())))
    better = F.try_divide((F.col("__base") - F.col(primary)) * sign, F.nullif(F.abs("__base"), F.lit(0.0)))
    joined = ranked.crossJoin(F.broadcast(base)).withColumn("improvement", better).drop("__base")
    return joined.withColumn("winner", F.row_number().over(Window.orderBy("rank", "model_id")) == 1).orderBy("rank", "model_id")


def confusion(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Counts over all pairs of labels that occur on either side, zeros included."""
    rows = df.select(F.col(observed).cast("string").alias("observed"), F.col(predicted).cast("string").alias("predicted"))
    counts = rows.groupBy("observed", "predicted").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.select("observed").distinct().crossJoin(counts.select("predicted").distinct())
    return cells.join(counts, ["observed", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def error_summary(df: DataFrame, y: str, score: str) -> DataFrame:
    error = F.col(score) - F.col(y)
    middle, high = order_statistics(df, {"e": F.abs(error)}, (0.5, 0.9))["e"]
    return df.agg(F.avg(error).alias("mean_error"), F.lit(middle).cast("double").alias("median_absolute_error"), F.lit(high).cast("double").alias("p90_absolute_error"))


def prediction_table(df: DataFrame, task: Task, row_id: str = "row_id", y: str = "y", score: str = "score") -> DataFrame:
    """Row by row: observed, predicted and the error, or whether the class is right."""
    if task.kind == REGRESSION:
        return df.select(row_id, F.col(y).alias("observed"), F.col(score).alias("predicted"), (F.col(y) - F.col(score)).alias("error"))
    names = F.array(*[F.lit(x) for x in task.levels])
    if task.kind == BINARY:
        other = next(x for x in task.levels if x != task.positive)
        said = F.when(F.col(score) >= 0.5, task.positive).otherwise(other)
        seen = F.when(F.col(y) == 1, task.positive).otherwise(other)
    else:
        said, seen = F.get(names, first_argmax(F.col(score))), F.get(names, F.col(y))
    return df.select(row_id, seen.alias("observed"), said.alias("predicted"), F.col(score).alias("probability"), (said == seen).alias("correct"))


def notes(task: Task, n_training: int, n_features: int, n_evaluation: int, class_counts: dict[str, int], constants: Sequence[str], warned: Sequence[str], beats: bool | None, r_squared: float | None, role: str = "evaluation") -> list[dict[str, str]]:
    """Rule-based cautions on an evaluation."""
    out: list[dict[str, str]] = []

    def add(severity: str, code: str, message: str, recommendation: str) -> None:
        out.append({"severity": severity, "code": code, "message": message, "recommendation": recommendation})

    if n_evaluation < 50:
        add("caution", "small_evaluation_set", f"{role}: {n_evaluation} rows, under 50.", "Score more rows; one row moves these figures.")
    if constants:
        add("note", "constant_inputs_removed", f"One value in all training rows: {', '.join(constants)}.", "Left out of the fit; compare with the source table.")
    if warned:
        add("warning", "model_fit_warning", f"The solver warned while fitting {', '.join(warned)}.", "Read the fit's notes; probabilities near 0 or 1 may be artefacts.")
    if n_training / max(1, n_features) < 10:
        add("caution", "few_rows_per_feature", f"{n_training} rows train {n_features} features, under 10 for each.", "Drop features or add rows.")
    scarce = [c for c, n in class_counts.items() if n < 5]
    if task.kind != REGRESSION and scarce:
        add("caution", "few_rows_in_class", f"Under 5 scored rows: {', '.join(scarce)}.", "Class metrics of these rest on single rows.")
    if beats is False:
        add("warning", "baseline_not_beaten", f"The constant prediction has the same {task.primary} or a better one.", "Nothing was learned that holds out of sample.")
    if task.kind == REGRESSION and r_squared is not None and r_squared < 0:
        add("warning", "negative_heldout_r_squared", f"R-squared is {r_squared:.3g} on the scored rows.", "Their own mean predicts them better than the model.")
    return out
