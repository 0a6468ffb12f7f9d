"""Comparing a result's models: behaviour on the same rows, and aligned effect curves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import ContractError
from lucidframe.models.registry import FAMILIES
from lucidframe.operators import compare, explain
from lucidframe.operators.split import reference_sample


@dataclass
class Behavior:
    models: list[dict]
    pairs: DataFrame
    ambiguity: DataFrame
    reliance: dict | None
    contrast: tuple[str, str] | None
    scope: str


def compare_behavior(result, models: list[str] | None = None, tolerance: float | None = None, audit=None) -> Behavior:
    """Who predicts what differently: a model table, distances of every pair, ambiguity and, given an audit, reliance."""
    names = result.retained(tolerance, models)
    if len(names) < 2:
        raise ContractError("behaviour needs two models")
    board = {r["model_id"]: r.asDict() for r in result.leaderboard.collect()}
    primary = result.metric
    best = min(board[n][primary] for n in names)
    trade = {t["model_id"]: t["pareto"] for t in result.tradeoffs(include_baseline=True)}
    rows = []
    for n in names:
        name = result.model(n).family  # a baseline or a model of the user's has no card
        family = FAMILIES.get(name)
        rows.append({"model_id": n, "family": name, "rank": board[n]["rank"], primary: board[n][primary], "relative_gap": abs(board[n][primary] - best) / max(abs(best), compare.ROOT_EPSILON), "complexity": board[n]["complexity"], "pareto": trade.get(n), "nonlinearity": family.nonlinearity if family else "not described", "interactions": family.interactions if family else "not described"})
    reliance = None
    if audit is not None:
        by = {n: {r["feature"]: r["importance"] for r in audit.importance if r["model_id"] == n} for n in names}
        if any(not v for v in by.values()):
            raise ContractError("the audit does not cover these models")
        if any(audit.fingerprints.get(e.model.model_id) != e.fingerprint for e in result.explainers(names)):
            raise ContractError("the audit was made of other models or other rows")
        features = list(next(iter(by.values())))
        reliance = compare.importance_agreement(by, features) | {"top": {n: sorted(features, key=lambda f: -by[n][f])[:5] for n in names}}
    return Behavior(rows, compare.prediction_pairs(result.scores, result.task, names), result.ambiguity(names)[1], reliance, structural_contrast(rows), "Computed on common evaluation rows; not inferred from family names.")


def structural_contrast(rows: list[dict]) -> tuple[str, str] | None:
    """The pair whose behaviour cards differ most, first in order of equals."""
    best, found = -1, None
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            differ = (a["nonlinearity"] != b["nonlinearity"]) + (a["interactions"] != b["interactions"]) + (a["family"] != b["family"])
            if differ > best:
                best, found = differ, (a["model_id"], b["model_id"])
    return found


@dataclass
class EffectComparison:
    curves: DataFrame
    pairs: DataFrame
    failures: list[dict]
    method: str


def compare_effects(result, feature: str, models: list[str] | None = None, method: str = "ale", points: int = 20, min_support: float = 0.1, sample_size: int | None = 1000, seed: int = 123, klass: str | None = None) -> EffectComparison:
    """One feature's curve for every model on the same rows and grid; a model that fails is set aside, two must succeed."""
    names = result.retained(None, models)
    rows = reference_sample(result.evaluation, "row_id", sample_size, seed).persist() if sample_size else result.evaluation
    grid = None
    if method == "pdp":
        grid = explain.numeric_grid(rows, feature, points) if explain._is_number(rows, feature) else explain.categorical_grid(rows, feature, points)
    curves, failures = [], []
    for n in names:
        try:
            score = result.model(n).score
            e = explain.ale(rows, score, result.task, feature, points, klass=klass) if method == "ale" else explain.partial_dependence(rows, score, result.task, feature, points, sample_size=sample_size or 1000, grid=grid, klass=klass)
            index = F.col("bin") if method == "ale" else F.col("grid_index")
            curves.append(e.frame.select(F.lit(n).alias("model_id"), index.cast("int").alias("grid_index"), "value", "effect", "support"))
        except Exception as e:
            failures.append({"model_id": n, "error": str(e)[:500]})
    if len(curves) < 2:
        raise ContractError("fewer than two models have a curve")
    all_ = reduce(DataFrame.unionByName, curves).persist()
    return EffectComparison(all_, compare.effect_pairs(all_, min_support), failures, method)
