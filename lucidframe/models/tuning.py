"""Tuning on training rows alone: a search plan, folds prepared anew from raw rows, out-of-fold evidence, selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, REGRESSION, ContractError, Task
from lucidframe.functions.expr import clamp, col
from lucidframe.models.fit import Fitted, Formula, checked_loss, fit_learner
from lucidframe.models.grams import Gram, grams
from lucidframe.models.registry import FAMILIES, check_parameters, portfolio
from lucidframe.operators import prep, selection, split
from lucidframe.operators.metrics import first_argmax
from lucidframe.shipping import ship

SCHEMA_VERSION = 4
#: Folds that are worked on at once.
POOL = 4
#: What a configuration may fail with on its data; anything else is a fault of the program and ends the search.
FAILURES = (ValueError, ArithmeticError, np.linalg.LinAlgError, PySparkException, Py4JError)


@dataclass(frozen=True)
class TuningControl:
    """Settings of a search. Budgets by family replace the shared number of models; fold labels name a training column."""

    grids: dict[str, list[dict]] = field(default_factory=dict)
    family_budgets: dict[str, int] | None = None
    fold_column: str | None = None
    metric: str = "auto"
    retain_oof: bool = True
    failure_policy: str = "record"

    def __post_init__(self):
        if self.failure_policy not in ("record", "raise"):
            raise ContractError("failure_policy must be record or raise")
        for family, grid in self.grids.items():
            if family not in FAMILIES:
                raise ContractError(f"unknown learner: {family}")
            keys = [parameter_key(check_parameters(family, p)) for p in grid]
            if not grid or len(set(keys)) != len(keys):
                raise ContractError(f"the grid of {family} is empty or repeats a setting")
        if self.family_budgets is not None and (not self.family_budgets or min(self.family_budgets.values()) < 1):
            raise ContractError("family budgets must be at least one")


def tuning_metric(task: Task, metric: str) -> str:
    allowed = ("rmse", "mae") if task.kind == REGRESSION else ("log_loss", "brier_score")
    name = allowed[0] if metric == "auto" else metric
    if name not in allowed:
        raise ContractError(f"tuning a {task.kind} task takes {' or '.join(allowed)}")
    return name


# Configurations


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("=", "\\=")


def parameter_key(parameters: dict) -> str:
    """One string for a setting: name, type and value in contract order."""
    if not parameters:
        return "<default>"
    out = []
    for name, value in parameters.items():
        kind = "logical" if isinstance(value, bool) else "integer" if isinstance(value, int) else "double" if isinstance(value, float) else "character"
        shown = ("TRUE" if value else "FALSE") if kind == "logical" else f"{value:.16e}" if kind in ("integer", "double") else str(value)
        out.append(f"{name}={kind}:{_escaped(shown)}")
    return "|".join(out)


def configuration_seed(seed: int, family: str, parameters: dict) -> int:
    """A polynomial hash of seed, family and setting, below 2^31 - 1."""
    found = 0
    for c in f"{seed}|{family}|{parameter_key(parameters)}":
        found = (found * 131 + ord(c)) % (2**31 - 1)
    return found


def effective_parameters(family: str, parameters: dict, n: int, p: int) -> dict:
    """The setting after what the data allow."""
    q = dict(parameters)
    if family == "forest":
        q["mtry"] = min(q["mtry"], max(1, p))
    elif family == "neighbors":
        q["k"] = min(q["k"], max(1, n - 1))
    elif family == "mars":
        q["nprune"] = min(q["nprune"], max(3, n - 2))
    return q


def search_plan(budget: int, n: int, p: int, task: Task, learners: Sequence[str], seed: int = 123, grids: dict[str, list[dict]] | None = None, family_budgets: dict[str, int] | None = None) -> list[dict]:
    """Settings in the order of the search: one from each family's grid, then the next of each, until the budget is used."""
    portfolio("core", task.kind, list(learners))
    classes = max(2, len(task.levels))
    if budget < len(learners):
        raise ContractError("the budget must cover every learner once")
    custom = grids or {}
    if set(custom) - set(learners):
        raise ContractError("a grid is given for a learner that isn't searched")
    if task.kind != REGRESSION and any(g["epsilon"] != 0.1 for g in custom.get("kernel", [])):
        raise ContractError("classification kernels must keep epsilon at 0.1, which changes nothing there")
    all_ = {f: [check_parameters(f, q) for q in custom.get(f) or FAMILIES[f].grid(n, p, task.kind, classes)] for f in learners}
    if family_budgets is not None:
        if set(family_budgets) != set(learners) or sum(family_budgets.values()) != budget:
            raise ContractError("family budgets must name the learners and add up to the budget")
        if any(family_budgets[f] > len(all_[f]) for f in learners):
            raise ContractError("a family's budget exceeds its grid")
    chosen, depth = [], 0
    while len(chosen) < budget and any(depth < len(g) for g in all_.values()):
        for f in learners:
            if len(chosen) < budget and depth < len(all_[f]) and (family_budgets is None or depth < family_budgets[f]):
                chosen.append((f, depth, all_[f][depth]))
        depth += 1
    return [
        {
            "configuration_id": f"{f}_{d + 1:02d}", "family": f, "plan_order": i, "parameters": q, "hyperparameters": ", ".join(f"{k}={v}" for k, v in q.items()) or "default",
            "simplicity_rank": FAMILIES[f].priority, "complexity_proxy": float(max(1, FAMILIES[f].complexity(q, n, p, classes))), "seed": configuration_seed(seed, f, q),
        }
        for i, (f, d, q) in enumerate(chosen)
    ]


# Folds


@dataclass
class Fold:
    """shared: what fits on its training rows have in common; held: the Gram matrix of its validation rows, if one scan served all folds."""

    number: int
    training: DataFrame
    validation: DataFrame
    features: list[str]
    rows: int
    omitted: int
    recipe: prep.Recipe | None = None
    shared: dict = field(default_factory=dict)
    held: Gram | None = None

    def release(self) -> None:
        self.training.unpersist()
        self.validation.unpersist()
        if "binned" in self.shared:
            self.shared.pop("binned").release()


def prepare_fold(df: DataFrame, task: Task, row_id: str, number: int, options: dict) -> Fold:
    """One fold from raw rows: the recipe and the constants are learned from its training part alone."""
    training, validation = (df.where(c).drop("fold") for c in (F.col("fold") != number, F.col("fold") == number))
    before = validation.count()
    recipe = prep.learn_recipe(training, task.target, skip=(row_id,), **options)
    ready = recipe.apply(training, keep=(row_id,))
    if task.kind != REGRESSION and options.get("missing") in ("drop_rows", "remove_rows"):
        left = {r[0] for r in ready.select(col(task.target).cast("string")).distinct().collect()}
        if left != set(task.levels):
            raise ContractError("dropping rows with missing values would leave a fold without a class")
    gone = prep.constants(ready.drop(row_id), task.target)
    recipe = recipe.without(gone)
    ready, held = recipe.apply(training, keep=(row_id,)).persist(), recipe.apply(validation, keep=(row_id,)).persist()
    prep.check_finite(ready.drop(row_id), task.target)
    rows = held.count()
    return Fold(number, ready, held, [c for c in recipe.columns if c != task.target], rows, before - rows, recipe)


def share_grams(dealt: DataFrame, folds: list[Fold], task: Task) -> None:
    """One scan for the Gram matrices of all folds, if their recipes and encodings agree: training on all but one is a subtraction.

    Where they don't agree, as with imputed medians that differ, every fold makes its own on its first linear fit.
    """
    recipe, features = folds[0].recipe, folds[0].features
    # With equal levels no row of a fold is new to another, so what new levels would turn into doesn't matter.
    if any(replace(f.recipe, fallback={}) != replace(recipe, fallback={}) or f.features != features for f in folds):
        return
    encodings = [prep.learn_encoding(f.training, features, "treatment") for f in folds]
    if any(e != encodings[0] for e in encodings):
        return
    rows = recipe.apply(dealt, keep=("fold",))
    found = grams(rows, encodings[0].array(), task.label(), F.col("fold"))
    total = reduce(Gram.__add__, found.values())
    for f in folds:
        f.held = found[f.number]
        f.shared[("encoding", "treatment", False)] = encodings[0]
        f.shared[("gram", "treatment")] = total - f.held


def oof_rows(scored: DataFrame, task: Task, configuration: str, fold: int, row_id: str) -> DataFrame:
    """Row by row: outcome, estimate, called class (first of equals), the probability of the outcome and its loss."""
    y, p = task.label(), F.col("score")
    head = [F.lit(configuration).alias("configuration_id"), F.lit(fold).alias("fold"), F.col(row_id).alias("row_id"), col(task.target).cast("string").alias("truth")]
    if task.kind == REGRESSION:
        return scored.select(*head, p.alias("estimate"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("p_truth"), ((p - y) * (p - y)).alias("loss"), F.array().cast("array<double>").alias("probabilities"))
    if task.kind == BINARY:
        at = task.levels.index(task.positive)
        probabilities = F.array(*[p if i == at else 1 - p for i in range(2)])
        own = F.when(y == 1, p).otherwise(1 - p)
    else:
        probabilities, own = p, F.get(p, y)
    names = F.array(*[F.lit(x) for x in task.levels])
    return scored.select(*head, F.lit(None).cast("double").alias("estimate"), F.get(names, first_argmax(probabilities)).alias("class"), own.alias("p_truth"), (-F.log(clamp(own))).alias("loss"), probabilities.alias("probabilities"))


@dataclass
class TuningRecord:
    plan: list[dict]
    candidates: list[dict]
    fold_scores: list[dict]
    evidence: list[Callable[[], DataFrame]] | None
    metric: str
    rule: str
    selected: str
    folds: int
    omissions: list[dict]
    final: str | None = None
    refit: dict = field(default_factory=dict)
    schema_version: int = SCHEMA_VERSION

    @cached_property
    def oof(self) -> DataFrame | None:
        """Out-of-fold rows of all configurations; put together when asked for, as a plan of all fits is long."""
        return reduce(DataFrame.unionByName, [rows() for rows in self.evidence]) if self.evidence else None

    def __repr__(self) -> str:
        return f"<tuning of {len(self.plan)} configurations on {self.folds} folds by {self.metric}, {self.rule}: {self.selected}>"


def fit_seed(c: dict, q: dict) -> int:
    """The seed of a fit: that of its configuration and what the data left of its setting, below 2^31 - 1."""
    return configuration_seed(c["seed"], c["family"], q)


def _fold_score(fold: Fold, task: Task, c: dict, metric: str, row_id: str) -> tuple[float, Callable[[], DataFrame]]:
    q = effective_parameters(c["family"], c["parameters"], fold.rows, len(fold.features))
    model = fit_learner(fold.training, task, c["family"], q, fold.features, fit_seed(c, q), shared=fold.shared)
    scored = model.score(fold.validation).withColumn("y", task.label().cast("double" if task.kind == REGRESSION else "int"))
    if fold.held is not None and metric == "rmse" and isinstance(model.scorer, Formula) and model.scorer.form == "linear":
        numbers = model.scorer.numbers
        value = (fold.held.squared_error(numbers["intercept"], np.array(numbers["coefficients"])) / fold.held.n) ** 0.5
    else:
        value = checked_loss(scored, task, metric)
    if value is None or not np.isfinite(value):
        raise ContractError("the fold has no finite score")
    return float(value), lambda: oof_rows(scored, task, c["configuration_id"], fold.number, row_id)


def _fold_scores(fold: Fold, task: Task, plan: list[dict], metric: str, row_id: str, policy: str) -> list[tuple[dict, Callable[[], DataFrame] | None]]:
    """Every configuration on one fold, in the order of the plan."""
    out = []
    asked = [(effective_parameters(c["family"], c["parameters"], fold.rows, len(fold.features)), c) for c in plan if c["family"] == "neural"]
    fold.shared["nets asked for"] = [(q, fit_seed(c, q)) for q, c in asked]
    for c in plan:
        row, evidence = {"configuration_id": c["configuration_id"], "fold": fold.number, "rows": fold.rows, "score": None, "error": ""}, None
        try:
            row["score"], evidence = _fold_score(fold, task, c, metric, row_id)
        except FAILURES as e:
            if policy == "raise":
                raise
            row["error"] = str(e)[:500]
        out.append((row, evidence))
    return out


def tune(df: DataFrame, task: Task, row_id: str, learners: Sequence[str], budget: int, *, folds: int = 5, rule: str = "one_se", seed: int = 123, control: TuningControl | None = None, options: dict | None = None) -> TuningRecord:
    """Score every configuration of the plan on every fold of the raw training rows and select one. POOL folds are worked on at once."""
    control, options = control or TuningControl(), options or {}
    if rule not in ("one_se", "best"):
        raise ContractError("the rule must be one_se or best")
    metric = tuning_metric(task, control.metric)
    ship(df.sparkSession)
    stratum = task.target if task.kind != REGRESSION else None
    dealt = split.supplied_folds(df, control.fold_column, row_id, stratum).drop(control.fold_column) if control.fold_column else split.folds(df, row_id, folds, seed, stratum)
    dealt, prepared = dealt.persist(), []
    try:
        numbers = sorted(r[0] for r in dealt.select("fold").distinct().collect())
        for k in numbers:
            prepared.append(prepare_fold(dealt, task, row_id, k, options))
        n, p = dealt.count(), max(len(f.features) for f in prepared)
        plan = search_plan(sum(control.family_budgets.values()) if control.family_budgets else budget, n, p, task, learners, seed, control.grids, control.family_budgets)
        if task.kind == REGRESSION and {"linear", "regularized"} & {c["family"] for c in plan}:
            share_grams(dealt, prepared, task)
        with ThreadPoolExecutor(POOL) as pool:
            by_fold = list(pool.map(lambda f: _fold_scores(f, task, plan, metric, row_id, control.failure_policy), prepared))
    finally:
        for f in prepared:
            f.release()
        dealt.unpersist()
    each = [by_fold[k][i] for i in range(len(plan)) for k in range(len(prepared))]
    scores, oof = [row for row, _ in each], [rows for _, rows in each if rows is not None]
    found = _summaries(df, scores, metric)
    candidates = [c | found[c["configuration_id"]] for c in plan]
    usable = [c for c in candidates if c["cv_score"] is not None]
    if not usable:
        raise ContractError("no configuration has a score on every fold")
    best = min(usable, key=lambda c: c["cv_score"]) if rule == "best" else selection.one_se(usable)
    omissions = [{"fold": f.number, "omitted": f.omitted} for f in prepared if f.omitted]
    return TuningRecord(plan, candidates, scores, oof if control.retain_oof else None, metric, rule, best["configuration_id"], len(numbers), omissions)


def paired_oof(record: TuningRecord, a: str, b: str) -> DataFrame:
    """The out-of-fold rows of two configurations side by side, joined by fold and row; unequal sets of rows are an error."""
    if record.oof is None:
        raise ContractError("out-of-fold rows weren't retained")
    unknown = {a, b} - {c["configuration_id"] for c in record.plan}
    if unknown:
        raise ContractError(f"not searched: {', '.join(sorted(unknown))}")
    key, values = ["fold", "row_id"], ["truth", "estimate", "class", "p_truth", "loss"]
    left, right = (record.oof.where(F.col("configuration_id") == c).select(*key, *[F.col(v).alias(f"{v}_{side}") for v in values]) for c, side in ((a, "a"), (b, "b")))
    both = left.join(right, key, "full")
    truth = F.col("truth_a").eqNullSafe(F.col("truth_b")) & F.col("loss_a").isNotNull() & F.col("loss_b").isNotNull()
    wrong, rows, distinct = both.agg(F.count(F.when(~truth, 1)), F.count(F.lit(1)), F.count_distinct("fold", "row_id")).first()
    if wrong or rows != distinct:
        raise ContractError(f"{a} and {b} weren't scored on the same rows of the same folds")
    return both.drop("truth_b").withColumnRenamed("truth_a", "truth").withColumn("loss_difference", F.col("loss_a") - F.col("loss_b"))


def _summaries(df: DataFrame, scores: list[dict], metric: str) -> dict[str, dict]:
    rows = df.sparkSession.createDataFrame([(s["configuration_id"], s["fold"], s["score"], s["rows"]) for s in scores], "configuration_id string, fold int, score double, rows long")
    return {r["configuration_id"]: {"cv_score": r["cv_score"], "cv_sd": r["cv_sd"], "cv_se": r["cv_se"]} for r in selection.fold_uncertainty(rows, metric).collect()}


def refit(record: TuningRecord, training: DataFrame, task: Task, features: list[str], fitter=fit_learner) -> list[Fitted]:
    """Fit the selected configuration on all training rows, falling back in score order; and the best of each other family."""
    usable = [c for c in record.candidates if c["cv_score"] is not None]
    order = sorted(usable, key=lambda c: (c["configuration_id"] != record.selected, c["cv_score"], c["simplicity_rank"], c["complexity_proxy"], c["configuration_id"]))
    attempts, models, n = [], [], training.count()

    def attempt(c: dict, role: str) -> Fitted | None:
        q = effective_parameters(c["family"], c["parameters"], n, len(features))
        try:
            model = fitter(training, task, c["family"], q, features, configuration_seed(c["seed"], c["family"], q), "main_model" if role == "primary" else f"{c['family']}_model")
            attempts.append({"configuration_id": c["configuration_id"], "role": role, "status": "ok", "error": ""})
            return model
        except FAILURES as e:
            attempts.append({"configuration_id": c["configuration_id"], "role": role, "status": "failed", "error": str(e)[:500]})
            return None

    for c in order:
        model = attempt(c, "primary")
        if model:
            models.append(model)
            record.final = c["configuration_id"]
            break
    if not models:
        raise ContractError("no configuration could be fitted on all training rows")
    tried = {a["configuration_id"] for a in attempts}
    families = list(dict.fromkeys(c["family"] for c in record.plan))
    missing = []
    for f in families:
        if f == models[0].family:
            continue
        others = [c for c in sorted(usable, key=lambda c: (c["cv_score"], c["complexity_proxy"], c["configuration_id"])) if c["family"] == f and c["configuration_id"] not in tried]
        model = next((m for m in (attempt(c, "alternative") for c in others) if m), None)
        if model:
            models.append(model)
        elif any(c["family"] == f for c in usable):
            missing.append(f)
    failed = [f for f in families if not any(c["family"] == f for c in usable)]
    fallback = record.final != record.selected
    record.refit = {"attempts": attempts, "fallback_used": fallback, "status": "fallback" if fallback else "partial" if missing or failed else "ok", "families_refit_failed": missing, "families_resampling_failed": failed}
    return models


def refit_notes(record: TuningRecord) -> list[dict]:
    out = []
    if record.refit.get("fallback_used"):
        why = next((a["error"] for a in record.refit["attempts"] if a["configuration_id"] == record.selected and a["error"]), "")
        out.append({"severity": "warning", "code": "tuning_refit_fallback", "message": f"The selected configuration {record.selected} could not be fitted on all training rows{': ' + why if why else ''}; the primary model uses {record.final}.", "recommendation": "Look at the refit attempts; the fallback is a recovery, not a selection."})
    if record.refit.get("families_resampling_failed"):
        out.append({"severity": "note", "code": "tuning_family_resampling_failed", "message": f"Every configuration failed on some fold for: {', '.join(record.refit['families_resampling_failed'])}.", "recommendation": "Look at the fold scores' errors; these families can't be compared."})
    if record.refit.get("families_refit_failed"):
        out.append({"severity": "note", "code": "tuning_alternative_refit_failed", "message": f"No alternative was kept for: {', '.join(record.refit['families_refit_failed'])}.", "recommendation": "The primary model stands; the leaderboard lacks these families."})
    return out


