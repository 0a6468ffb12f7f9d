"""Diagnostics of scored evaluation rows: calibration, thresholds, subgroups, missingness, ambiguity, trade-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, HIGHER_IS_BETTER, REGRESSION, ContractError, Task
from lucidframe.functions.expr import col, is_missing, order_statistics, rate, tie_blocks
from lucidframe.functions.stats import pareto
from lucidframe.operators.explain import metric_by
from lucidframe.operators.metrics import binary_aggregates, first_argmax, multiclass_aggregates, regression_aggregates
from lucidframe.operators.prep import profile

SCOPE = "Descriptive of these evaluation rows; no guarantee for others."
THRESHOLDS = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))


# Calibration


def calibration_groups(df: DataFrame, p: str, event: str, bins: int = 5) -> DataFrame:
    """Groups of about equal counts, equal probabilities sharing one: group, n, mean_probability, observed_rate, gap."""
    blocks = tie_blocks(df.select(F.col(p).alias("p"), F.col(event).cast("double").alias("event")), "p", {"events": F.col("event")})
    total = df.count()
    used = min(bins, max(1, total // 10))
    raw = F.least(F.lit(used), F.ceil(F.col("mean_rank") / F.lit(float(max(total, 1))) * used)).cast("int")
    grouped = blocks.groupBy(raw.alias("raw")).agg(F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("ps"), F.sum("events").alias("es"))
    dense = grouped.withColumn("group", F.row_number().over(Window.orderBy("raw")))  # at most `bins` rows
    mean, seen = rate(F.col("ps"), F.col("n")), rate(F.col("es"), F.col("n"))
    return dense.select("group", "n", mean.alias("mean_probability"), seen.alias("observed_rate"), F.abs(mean - seen).alias("gap"))


def calibration_error(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), rate(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("calibration_error"), F.max("gap").alias("max_gap"))


def calibration(df: DataFrame, task: Task, y: str = "y", score: str = "score", bins: int = 5) -> DataFrame:
    """Binary: P(positive) against the class. Multiclass: the greatest probability against being right."""
    if task.kind == REGRESSION:
        raise ContractError("calibration needs class probabilities")
    if task.kind == BINARY:
        return calibration_groups(df, score, y, bins)
    top = df.select(F.array_max(score).alias("p"), (first_argmax(F.col(score)) == F.col(y)).cast("int").alias("event"))
    return calibration_groups(top, "p", "event", bins)


# Thresholds


def thresholds(df: DataFrame, y: str = "y", score: str = "score", at: Sequence[float] = THRESHOLDS, false_positive_cost: float = 1.0, false_negative_cost: float = 1.0) -> DataFrame:
    """One row for each cutoff: the confusion counts, rates and mean cost of calling p >= t positive.

    Rows are counted once by (score interval, class): cumulative sums over these few counts give every cutoff.
    """
    if not at or any(not 0 <= t <= 1 for t in at) or min(false_positive_cost, false_negative_cost) < 0:
        raise ContractError("thresholds must lie in [0, 1] and costs must not be negative")
    cuts = sorted(set(float(t) for t in at))
    place = F.lit(0)
    for t in cuts:
        place = place + (F.col(score) >= F.lit(t)).cast("int")
    counts = df.select(place.alias("place"), F.col(y).alias("y")).groupBy("place").agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg"))
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])).alias("g")
    above = F.col("place") >= F.col("g.i")
    sums = counts.select("*", grid).groupBy("g.i", "g.threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"), F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    cost = (fp * float(false_positive_cost) + fn * float(false_negative_cost)) / n
    wide = sums.select(
        "threshold", "tp", "fp", "tn", "fn", rate(tp, F.nullif(tp + fn, F.lit(0))).alias("sensitivity"), rate(tn, F.nullif(tn + fp, F.lit(0))).alias("specificity"),
        rate(tp, F.nullif(tp + fp, F.lit(0))).alias("precision"), rate(tn, F.nullif(tn + fn, F.lit(0))).alias("negative_predictive_value"), rate(tp + tn, n).alias("accuracy"),
        rate(2 * tp, F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"), cost.alias("cost"),
    )
    both = [F.col("sensitivity"), F.col("specificity")]
    known = sum(c.isNotNull().cast("int") for c in both)
    balanced = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in both), F.lit(0.0)), known)
    f1 = F.when(F.col("precision").isNotNull() & F.col("sensitivity").isNotNull() & (F.col("tp") > 0), F.col("f1"))
    wide = wide.withColumn("balanced_accuracy", balanced).withColumn("f1", f1)
    return wide.withColumn("minimum_cost", F.col("cost") == F.min("cost").over(Window.partitionBy())).orderBy("threshold")


# Subgroups


def subgroups(df: DataFrame, task: Task, by: str, y: str = "y", score: str = "score", min_rows: int = 10) -> DataFrame:
    """The task's metrics for each value of a column; missing is a group of its own; 2 to 20 groups."""
    group = F.coalesce(F.when(is_missing(df, by), F.lit(None)).otherwise(col(by).cast("string")), F.lit("(missing)"))
    named = df.withColumn("group", group)
    found = named.groupBy("group").count().limit(21).collect()
    if not 2 <= len(found) <= 20:
        raise ContractError("subgroups need between 2 and 20 groups")
    actual, p = F.col(y), F.col(score)
    total = F.sum("n").over(Window.partitionBy())
    aggregates = {REGRESSION: lambda: regression_aggregates(actual, p), BINARY: lambda: binary_aggregates(actual, p)}.get(task.kind, lambda: multiclass_aggregates(actual, p, len(task.levels)))()
    out = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    if task.kind == BINARY:  # all groups' areas in one pass
        areas = metric_by(named.select("group", actual.alias("y"), p.alias("score")), task, "auc", ["group"])
        out = out.join(F.broadcast(areas.withColumnRenamed("value", "roc_auc")), "group")
    sign = -1.0 if task.primary in HIGHER_IS_BETTER else 1.0
    enough = F.col("n") >= min_rows
    best = F.min(F.when(enough, F.col(task.primary) * sign)).over(Window.partitionBy()) * sign
    return out.withColumns({"share": rate(F.col("n"), total), "enough_rows": enough, "gap": F.abs(F.col(task.primary) - best)}).orderBy("group")


# Missing values


def missingness_shift(training: DataFrame, evaluation: DataFrame, target: str, threshold: float = 0.05, used: Sequence[str] | None = None) -> DataFrame:
    """Missing rates by column on both sides, the shift, and whether it reaches the threshold."""
    names = [c for c in training.columns if c in evaluation.columns and c != target]
    a = profile(training.select(*[col(c) for c in names])).select("position", "column", F.col("missing").alias("training_missing"), F.col("missing_rate").alias("training_rate"))
    b = profile(evaluation.select(*[col(c) for c in names])).select("column", F.col("missing").alias("evaluation_missing"), F.col("missing_rate").alias("evaluation_rate"))
    shift = F.col("evaluation_rate") - F.col("training_rate")
    known = names if used is None else list(used)
    out = a.join(b, "column").withColumns({"shift": shift, "flagged": F.abs(F.round(shift, 12)) >= threshold, "used": F.col("column").isin(*known) if known else F.lit(False)})
    return out.drop("position").orderBy(F.desc("flagged"), F.desc("used"), F.desc(F.abs("shift")), "column")


# Ambiguity between models


def pair_distance(scores: Column) -> Column:
    """Greatest total variation distance between any two probability arrays of an array of them; 0 for one."""
    def distance(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2

    return F.coalesce(F.array_max(F.flatten(F.transform(scores, lambda a: F.transform(scores, lambda b: distance(a, b))))), F.lit(0.0))


def regression_ambiguity(df: DataFrame, models: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Row by row over the models' predictions: least, greatest, range and deviation."""
    all_ = F.array(*[F.col(m).cast("double") for m in models])
    mean = F.aggregate(all_, F.lit(0.0), lambda a, x: a + x) / len(models)
    squares = F.aggregate(all_, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    deviation = F.sqrt(squares / (len(models) - 1)) if len(models) > 1 else F.lit(0.0)
    return df.select(row_id, F.array_min(all_).alias("minimum"), F.array_max(all_).alias("maximum"), (F.array_max(all_) - F.array_min(all_)).alias("range"), deviation.alias("sd"))


def class_ambiguity(df: DataFrame, models: Sequence[str], levels: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Row by row over the models' probability arrays: classes called (first of equals), how many, greatest distance."""
    names = F.array(*[F.lit(x) for x in levels])
    labels = F.sort_array(F.array_distinct(F.array(*[F.get(names, first_argmax(F.col(m))) for m in models])))
    return df.select(row_id, F.array_join(labels, ", ").alias("classes"), F.size(labels).alias("n_classes"), pair_distance(F.array(*[F.col(m) for m in models])).alias("max_distance"))


def ambiguity_summary(rows: DataFrame, regression: bool) -> DataFrame:
    if regression:
        middle, high = order_statistics(rows, {"range": F.col("range")}, (0.5, 0.9))["range"]
        return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(middle).cast("double").alias("median_range"), F.lit(high).cast("double").alias("p90_range"), F.max("range").alias("max_range"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_classes") > 1).cast("double")).alias("disagreement_rate"), F.avg("max_distance").alias("mean_distance"), F.max("max_distance").alias("max_distance"))


def near_best(scores: dict[str, float], metric: str, tolerance: float, slack: float = 0.0) -> list[str]:
    """Models whose relative gap to the best is within tolerance. Ambiguity takes no slack, audits the root of machine epsilon."""
    sign = -1.0 if metric in HIGHER_IS_BETTER else 1.0
    known = {m: s * sign for m, s in scores.items() if s is not None and s == s}
    best = min(known.values())
    scale = max(abs(best), 2.0**-26)
    return [m for m, s in known.items() if s - best <= tolerance * scale + slack]


# Trade-offs


def tradeoffs(models: Sequence[dict], loss: str, secondary: str) -> list[dict]:
    """Models with both figures, marked whether none is better on one axis and as good on the other."""
    usable = [m for m in models if all(isinstance(m.get(k), (int, float)) and abs(m[k]) != float("inf") and m[k] == m[k] for k in (loss, secondary))]
    if len(usable) < 2:
        raise ContractError("trade-offs need two models with finite figures")
    sign = -1.0 if loss in HIGHER_IS_BETTER else 1.0
    front = pareto([(m[loss] * sign, m[secondary]) for m in usable])
    out = [m | {"pareto": f} for m, f in zip(usable, front)]
    return sorted(out, key=lambda m: (not m["pareto"], m[loss] * sign, m[secondary], m.get("model_id", "")))


def pareto_frame(df: DataFrame, loss: str, secondary: str, model: str = "model_id") -> DataFrame:
    """The frontier as an anti-join on dominance, over a frame of models."""
    b = df.select(F.col(loss).alias("__l"), F.col(secondary).alias("__s"))
    worse = (F.col("__l") <= F.col(loss)) & (F.col("__s") <= F.col(secondary)) & ((F.col("__l") < F.col(loss)) | (F.col("__s") < F.col(secondary)))
    front = df.join(F.broadcast(b), worse, "left_anti").select(F.col(model).alias("__m"))
    return df.join(F.broadcast(front), F.col(model) == F.col("__m"), "left").withColumn("pareto", F.col("__m").isNotNull()).drop("__m")


def weighted_efficiency(models: Sequence[dict], performance: str, speed: str, weight: float = 0.5) -> list[dict]:
    """Performance and speed on a common scale, 1 the best; a figure that doesn't vary counts one half."""
    def scaled(name: str, higher: bool) -> list[float]:
        values = [m[name] for m in models]
        low, high = min(values), max(values)
        return [0.5 if high == low else ((v - low) if higher else (high - v)) / (high - low) for v in values]

    a, b = scaled(performance, performance in HIGHER_IS_BETTER), scaled(speed, False)
    return [m | {"efficiency": weight * x + (1 - weight) * y} for m, x, y in zip(models, a, b)]
