"""Guided fits: from a frame and a target column to models, a held-out leaderboard and what can be said about them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task, make_task, predictor_kind, unsupported_predictors, validate_inputs
from lucidframe.functions.expr import col, frame_digest
from lucidframe.models.fit import Fitted, baseline, check_features, check_scores, fit_learner, user_model
from lucidframe.models.registry import default_budget, portfolio
from lucidframe.models.tuning import TuningControl, TuningRecord, refit, refit_notes, tune
from lucidframe.operators import diagnostics, metrics, prep, split

ROLES = ("auto", "test", "validation", "evaluation")
ROW = "row_id"
#: (training rows, task, features) -> fitted models, best first, and the engine's own leaderboard in any form.
FitProvider = Callable[[DataFrame, Task, list[str]], tuple[list[Fitted], object]]


@dataclass
class Explainer:
    """A model with the rows it is explained on: row_id, y and the features."""

    model: Fitted
    data: DataFrame
    task: Task
    role: str = "unspecified"

    @cached_property
    def fingerprint(self) -> str:
        """What the model says of which rows: a digest of the rows with their scores, to nine places, and of how the model is named."""
        score = F.transform("score", lambda p: F.round(p, 9)) if self.task.kind == MULTICLASS else F.round("score", 9)
        scored = frame_digest(self.predict(self.data).withColumn("score", score))
        return hashlib.sha256(f"{self.model.model_id}|{self.model.family}|{self.task}|{scored}".encode()).hexdigest()[:16]

    @property
    def features(self) -> list[str]:
        return list(self.model.features) or [c for c in self.data.columns if c not in (ROW, "y")]

    def predict(self, df: DataFrame) -> DataFrame:
        check_features(df, tuple(self.model.features))
        return self.model.score(df)


@dataclass
class Result:
    """A guided fit. Scores of all models stand in one wide frame: row_id, y, the features and a column for each model."""

    task: Task
    models: list[Fitted]
    leaderboard: DataFrame
    scores: DataFrame
    training: DataFrame
    evaluation: DataFrame
    raw_training: DataFrame
    raw_evaluation: DataFrame
    recipe: prep.Recipe
    role: str
    notes: list[dict]
    shift: DataFrame
    provenance: dict
    tuning: TuningRecord | None = None
    extra: dict = field(default_factory=dict)

    @property
    def metric(self) -> str:
        """What models are ranked and compared by: the tuned metric, or the task's primary one."""
        return self.tuning.metric if self.tuning else self.task.primary

    def model(self, which: str | int | None = None) -> Fitted:
        """A model by id or place; the primary one by default."""
        if which is None:
            return next(m for m in self.models if m.model_id == "main_model")
        if isinstance(which, int):
            if not 0 <= which < len(self.models):
                raise ContractError("no such model")
            return self.models[which]
        found = [m for m in self.models if m.model_id == which]
        if not found:
            raise ContractError(f"no model {which}; there are {', '.join(m.model_id for m in self.models)}")
        return found[0]

    def scored(self, which: str | None = None) -> DataFrame:
        """row_id, y and one model's score, with the features."""
        name = self.model(which).model_id
        return self.scores.withColumn("score", F.col(name))

    def rebind(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Other rows under the same recipe and outcome contract."""
        ready = _labelled(self.recipe.apply(split.with_row_id(df), keep=(ROW,)), self.task)
        return ready, "user-supplied"

    def explainers(self, models: list[str] | None = None, data: DataFrame | None = None) -> list[Explainer]:
        rows, role = (self.evaluation, self.role) if data is None else self.rebind(data)
        chosen = [self.model(m) for m in models] if models else [m for m in self.models if m.family != "baseline"]
        return [Explainer(m, rows, self.task, role) for m in chosen]

    def predictions(self, which: str | None = None) -> DataFrame:
        return metrics.prediction_table(self.scored(which), self.task)

    def diagnostics(self, which: str | None = None) -> DataFrame:
        if self.task.kind == REGRESSION:
            return metrics.error_summary(self.scored(which), "y", "score")
        return metrics.confusion(self.predictions(which), "observed", "predicted")

    def calibration(self, which: str | None = None, bins: int = 5) -> DataFrame:
        return diagnostics.calibration(self.scored(which), self.task, bins=bins)

    def thresholds(self, which: str | None = None, **options) -> DataFrame:
        if self.task.kind != BINARY:
            raise ContractError("thresholds need a binary task")
        return diagnostics.thresholds(self.scored(which), **options)

    def subgroups(self, by: str, which: str | None = None, min_rows: int = 10) -> DataFrame:
        rows = self.scored(which)
        if by not in rows.columns:
            rows = rows.join(self.raw_evaluation.select(ROW, col(by)), ROW)
        return diagnostics.subgroups(rows, self.task, by, min_rows=min_rows)

    def retained(self, tolerance: float | None = None, models: list[str] | None = None) -> list[str]:
        """The compared models: the named ones, or all but the baseline; near the best if a tolerance is given."""
        names = models or [m.model_id for m in self.models if m.family != "baseline"]
        if tolerance is not None:
            board = {r["model_id"]: r[self.metric] for r in self.leaderboard.collect() if r["model_id"] in names}
            near = diagnostics.near_best(board, self.metric, tolerance)
            names = [n for n in names if n in near]
        return names

    def ambiguity(self, models: list[str] | None = None, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Row by row, and a summary."""
        names = self.retained(tolerance, models)
        if self.task.kind == REGRESSION:
            rows = diagnostics.regression_ambiguity(self.scores, names)
            return rows, diagnostics.ambiguity_summary(rows, True)
        wide = self.scores
        if self.task.kind == BINARY:
            at = self.task.levels.index(self.task.positive)
            wide = wide.withColumns({n: F.array(*[F.col(n) if i == at else 1 - F.col(n) for i in range(2)]) for n in names})
        rows = diagnostics.class_ambiguity(wide, names, self.task.levels)
        return rows, diagnostics.ambiguity_summary(rows, False)

    def tradeoffs(self, performance: str | None = None, secondary: str = "complexity", include_baseline: bool = False) -> list[dict]:
        rows = [r.asDict() for r in self.leaderboard.collect()]
        rows = [r for r in rows if include_baseline or r["family"] != "baseline"]
        return diagnostics.tradeoffs(rows, performance or self.metric, secondary)

    def metadata(self) -> list[dict]:
        """Rank, family, time, complexity and parameters of each model."""
        rank = {r["model_id"]: r["rank"] for r in self.leaderboard.collect()}
        return [{"model_id": m.model_id, "rank": rank[m.model_id], "family": m.family, "algorithm": m.label, "training_seconds": m.seconds, "complexity": m.complexity, "parameters": dict(m.parameters)} for m in self.models]

    def __repr__(self) -> str:
        return f"<{self.task.kind} of {self.task.target}: {len(self.models)} models, {self.role} rows scored>"


def _labelled(df: DataFrame, task: Task) -> DataFrame:
    y = task.label().cast("double" if task.kind == REGRESSION else "int")
    ready = df.withColumn("y", y).drop(task.target) if task.target != "y" else df.withColumn("y", y)
    if task.kind != REGRESSION and ready.where(F.col("y").isNull()).limit(1).count():
        raise ContractError("an outcome has a class that training rows don't have")
    return ready


def _role(supplied: bool, role: str) -> str:
    if role not in ROLES:
        raise ContractError("unknown evaluation role")
    return ("evaluation" if supplied else "test") if role == "auto" else role


def wide_scores(evaluation: DataFrame, models: list[Fitted]) -> DataFrame:
    """All models' scores side by side, computed once."""
    out = evaluation
    for m in models:
        out = m.score(out, m.model_id)
    return out.persist()


def board(scores: DataFrame, task: Task, models: list[Fitted], metric: str | None = None) -> DataFrame:
    """The leaderboard: metrics of every model on the same rows, and by one, the task's primary or the tuned one, rank, winner and improvement over the baseline."""
    rows = [metrics.evaluate(scores.withColumn("score", F.col(m.model_id)), task).select(F.lit(m.model_id).alias("model_id"), F.lit(m.family).alias("family"), F.lit(float(m.complexity or 0.0)).alias("complexity"), "*") for m in models]
    found = reduce(DataFrame.unionByName, rows).collect()
    frame = scores.sparkSession.createDataFrame(found, rows[0].schema)
    return metrics.leaderboard(frame, metric or task.primary)


def guided_fit(
    df: DataFrame, target: str, *, test: DataFrame | None = None, test_fraction: float = 0.2, seed: int = 123, task: str = "auto", positive: str | None = None, model_set: str = "quick",
    portfolio_name: str = "recommended", learners: list[str] | None = None, max_models: int | None = None, folds: int = 5, rule: str = "one_se", control: TuningControl | None = None,
    preprocess: bool = True, options: dict | None = None, role: str = "auto", overlap: str = "warn", row_order: list[str] | None = None, provider: FitProvider | None = None,
) -> Result:
    """Check, split, learn a recipe from training rows, fit, and score all models on the same held-out rows.

    model_set: quick (a linear model and the baseline), comparison (two trees more) or tuned (a search over families).
    provider: an outside engine that fits the models instead; its own leaderboard is kept apart, its first model is primary.
    """
    if model_set not in ("quick", "comparison", "tuned"):
        raise ContractError("model_set must be quick, comparison or tuned")
    if control is not None and model_set != "tuned":
        raise ContractError("a tuning control needs the tuned model set")
    if control is not None and control.family_budgets and max_models is not None:
        raise ContractError("family budgets and a number of models exclude each other")
    labels = None
    if control is not None and control.fold_column:
        if test is None:
            raise ContractError("supplied folds need supplied test rows: a split of one's own would cut through them")
        if control.fold_column not in df.columns or control.fold_column == target:
            raise ContractError("the fold column must be a column of the training rows other than the target")
        if folds != 5:
            raise ContractError("supplied folds set their own number")
        # Fold labels are no predictor: they stand beside the rows until the search.
        df = split.with_row_id(df, ROW, row_order)
        labels, row_order = df.select(ROW, col(control.fold_column)), None
        df, test = df.drop(control.fold_column), test.drop(control.fold_column)
    validate_inputs(df.drop(ROW) if labels is not None else df, target, test)
    contract = make_task(df, target, task, positive)
    wrong = unsupported_predictors(df.drop(ROW) if labels is not None else df, target)
    if wrong:
        raise ContractError(f"types that can't be predictors: {', '.join(wrong)}")
    empty = prep.wholly_missing(df, target)
    if empty:
        raise ContractError(f"wholly missing predictors: {', '.join(empty)}")
    rows = (df if labels is not None else split.with_row_id(df, ROW, row_order)).persist()
    stratum = target if contract.kind != REGRESSION else None
    if test is None:
        dealt = split.holdout(rows, ROW, test_fraction, seed, stratum)
        raw_training, raw_evaluation = dealt.where(~F.col("held_out")).drop("held_out").persist(), dealt.where("held_out").drop("held_out").persist()
        overlapping = 0
    else:
        raw_training, raw_evaluation = rows, split.with_row_id(test, ROW, row_order).persist()
        overlapping = split.check_overlap(raw_training.drop(ROW), raw_evaluation.drop(ROW), overlap)
    gone = prep.constants(raw_training.drop(ROW), target)
    raw_training, raw_evaluation = raw_training.drop(*gone), raw_evaluation.drop(*gone)
    settings = {"missing": "impute", "novel": "mode"} | (options or {}) if preprocess else {"missing": "keep", "novel": "error"}
    recipe = prep.learn_recipe(raw_training, target, skip=(ROW,), **settings)
    more = prep.constants(recipe.apply(raw_training), target)
    recipe = recipe.without(more)
    training = recipe.apply(raw_training, keep=(ROW,)).persist()
    evaluation_rows = recipe.apply(raw_evaluation, keep=(ROW,)).persist()
    for part in (training, evaluation_rows):
        prep.check_finite(part.drop(ROW), target)
    features = [c for c in recipe.columns if c != target]
    if not features:
        raise ContractError("no predictor varies in the training rows")
    evaluation = _labelled(evaluation_rows, contract)
    base, record, extra = baseline(training, contract), None, {}
    if provider is not None:
        models, extra["engine_leaderboard"] = provider(training, contract, features)
        models = [replace(m, model_id="main_model" if i == 0 else m.model_id) for i, m in enumerate(models)] + [base]
    elif model_set == "tuned":
        families = portfolio(portfolio_name, contract.kind, learners)
        searched = raw_training if labels is None else raw_training.join(labels, ROW)
        record = tune(searched, contract, ROW, families, max_models or default_budget(portfolio_name, learners), folds=folds, rule=rule, seed=seed, control=control, options=settings)
        models = [*refit(record, training, contract, features), base]
    else:
        models = [fit_learner(training, contract, "linear", {}, features, seed, "main_model")]
        if model_set == "comparison":
            n = training.count()
            for name, depth, gain in (("shallow_tree", 2, 0.01), ("flexible_tree", 5, 0.001)):
                models.append(fit_learner(training, contract, "tree", {"maxdepth": depth, "cp": gain, "minsplit": max(4, min(20, n // 10))}, features, seed, name))
        models.append(base)
    scores = wide_scores(evaluation, models)
    for m in models:
        check_scores(scores, contract, m.model_id)
    leaders = board(scores, contract, models, record.metric if record else None)
    main = next(r for r in leaders.collect() if r["model_id"] == "main_model")
    counts = {} if contract.kind == REGRESSION else {r[0]: r[1] for r in evaluation_rows.groupBy(col(target).cast("string")).count().collect()}
    evaluation_role = _role(test is not None, role)
    found = metrics.notes(contract, training.count(), len(features), evaluation.count(), counts, [*gone, *more], [m.model_id for m in models if m.notes], None if main["improvement"] is None else main["improvement"] > 0, main["r_squared"] if contract.kind == REGRESSION else None, evaluation_role)
    if overlapping:
        found.append({"severity": "warning", "code": "evaluation_overlap", "message": f"{overlapping} evaluation rows are training rows too.", "recommendation": "Score on rows that weren't trained on."})
    found += refit_notes(record) if record else []
    shift = diagnostics.missingness_shift(raw_training.drop(ROW), raw_evaluation.drop(ROW), target, used=features)
    provenance = {"created": datetime.now(timezone.utc).isoformat(), "seed": seed, "model_set": model_set, "split": "hash holdout" if test is None else "supplied", "test_fraction": test_fraction if test is None else None, "engine": "spark", "schema_version": 1}
    return Result(contract, models, leaders, scores, training, evaluation, raw_training, raw_evaluation, recipe, evaluation_role, found, shift, provenance, record, extra)


def explain_model(model, df: DataFrame, target: str, task: str = "auto", positive: str | None = None, role: str = "unspecified") -> Explainer:
    """An explainer for a fitted model, or for a function of a pandas frame; three rows are scored as a probe."""
    contract = make_task(df, target, task, positive)
    rows = _labelled(split.with_row_id(df, ROW), contract)
    features = [c for c in df.columns if c != target and predictor_kind(df.schema[c].dataType) != "unsupported"]
    if rows.limit(2).count() < 2:
        raise ContractError("an explanation needs two rows")
    fitted = model if isinstance(model, Fitted) else user_model(model, contract, features)
    check_scores(fitted.score(rows.limit(3)), contract)
    return Explainer(fitted, rows, contract, role)
