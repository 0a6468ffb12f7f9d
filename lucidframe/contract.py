"""What a task is: its kind, its outcome's levels, its metrics, and which inputs are allowed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidframe.functions.expr import col, is_missing

REGRESSION, BINARY, MULTICLASS = "regression", "binary", "multiclass"
TASKS = (REGRESSION, BINARY, MULTICLASS)

# Metrics by task, the first is the primary one; names that others go by; metrics where more is better.
METRICS = {
    REGRESSION: ("rmse", "mae", "r_squared"),
    BINARY: ("log_loss", "brier_score", "accuracy", "balanced_accuracy", "roc_auc"),
    MULTICLASS: ("log_loss", "brier_score", "accuracy", "macro_recall"),
}
ALIASES = {"log_loss": "logloss", "brier_score": "brier", "roc_auc": "auc"}
HIGHER_IS_BETTER = frozenset({"accuracy", "balanced_accuracy", "macro_recall", "roc_auc", "auc", "r_squared"})


class ContractError(ValueError):
    """An input that breaks a rule of the engine."""


@dataclass(frozen=True)
class Task:
    kind: str
    target: str
    levels: tuple[str, ...] = ()
    positive: str | None = None
    notes: tuple[str, ...] = field(default=())

    @property
    def primary(self) -> str:
        return METRICS[self.kind][0]

    def label(self) -> Column:
        """The outcome as a number: itself, 1 for the positive class, or the 0-based place of its level."""
        if self.kind == REGRESSION:
            return col(self.target).cast("double")
        text = level_text(col(self.target))
        if self.kind == BINARY:
            return F.when(text.isNotNull(), (text == self.positive).cast("int"))
        return F.array_position(F.array(*[F.lit(x) for x in self.levels]), text).cast("int") - 1


def level_text(c: Column) -> Column:
    return c.cast("string")


def require_frame(df, name: str = "data") -> None:
    if not isinstance(df, DataFrame):
        raise ContractError(f"{name} must be a DataFrame")


def predictor_kind(kind: T.DataType) -> str:
    """numeric, logical, categorical or unsupported (dates, arrays, maps, structs, binaries, intervals)."""
    if isinstance(kind, T.BooleanType):
        return "logical"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "categorical" if isinstance(kind, T.StringType) else "unsupported"


def unsupported_predictors(df: DataFrame, target: str) -> list[str]:
    return [f.name for f in df.schema if f.name != target and predictor_kind(f.dataType) == "unsupported"]


def detect_kind(df: DataFrame, target: str) -> str:
    """Two distinct values are binary, other strings and booleans multiclass, other numbers regression."""
    found = df.where(~is_missing(df, target)).select(col(target)).distinct().limit(3).count()
    kind = predictor_kind(df.schema[target].dataType)
    if kind == "unsupported":
        raise ContractError(f"the type of {target} can't be an outcome")
    if found == 2:
        return BINARY
    return REGRESSION if kind == "numeric" else MULTICLASS


def validate_inputs(df: DataFrame, target: str, evaluation: DataFrame | None = None) -> None:
    require_frame(df)
    for frame in (df, evaluation):
        if frame is not None and len(set(frame.columns)) != len(frame.columns):
            raise ContractError("column names must be unique")
        if frame is not None and target not in frame.columns:
            raise ContractError(f"{target} is not a column")
    rows, values = df.agg(F.count(F.lit(1)), F.count_distinct(F.when(~is_missing(df, target), col(target)))).first()
    if rows < 10:
        raise ContractError("at least 10 rows are needed")
    if values < 2:
        raise ContractError("the outcome needs at least two distinct values")


def outcome_levels(df: DataFrame, target: str, most: int = 1000) -> tuple[str, ...]:
    """Observed classes in byte order."""
    found = df.where(~is_missing(df, target)).select(level_text(col(target)).alias("x")).distinct().orderBy("x").limit(most + 1).collect()
    if len(found) > most:
        raise ContractError(f"more than {most} classes")
    return tuple(r[0] for r in found)


def make_task(df: DataFrame, target: str, kind: str = "auto", positive: str | None = None, levels: tuple[str, ...] | None = None) -> Task:
    """The task of a training frame, checked against what is asserted."""
    detected = detect_kind(df, target) if kind == "auto" else kind
    if detected not in TASKS:
        raise ContractError(f"unknown task: {detected}")
    if detected == REGRESSION:
        if predictor_kind(df.schema[target].dataType) != "numeric":
            raise ContractError("a regression outcome must be numeric")
        x = col(target).cast("double")
        if df.agg(F.count(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 1))).first()[0]:
            raise ContractError("a regression outcome must be finite")
        return Task(detected, target)
    if df.where(is_missing(df, target)).limit(1).count():
        raise ContractError("the outcome must not be missing")
    levels = levels or outcome_levels(df, target)
    if detected == BINARY and len(levels) != 2 or detected == MULTICLASS and len(levels) < 3:
        raise ContractError(f"a {detected} outcome needs {'exactly two' if detected == BINARY else 'at least three'} classes, found {len(levels)}")
    if positive is not None and positive not in levels:
        raise ContractError(f"{positive} is not a class")
    return Task(detected, target, levels, (positive or levels[1]) if detected == BINARY else None)


def resolve_metric(task: Task, metric: str = "auto") -> str:
    """A metric's name for importance and audits, checked against the task."""
    name = task.primary if metric == "auto" else metric
    name = ALIASES.get(name, name)
    allowed = {REGRESSION: ("rmse", "mae"), BINARY: ("logloss", "brier", "accuracy", "auc"), MULTICLASS: ("logloss", "brier", "accuracy")}[task.kind]
    if name not in allowed:
        raise ContractError(f"{metric} does not fit a {task.kind} task")
    return name
