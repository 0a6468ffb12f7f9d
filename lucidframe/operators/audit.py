"""An audit of explanations: importance of several models, dependence, agreement, evidence grades, findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import ContractError, resolve_metric
from lucidframe.operators import compare, diagnostics, explain
from lucidframe.operators.compare import ROOT_EPSILON

GRADES = ("A", "B", "C", "D")
# What a grade lets one say.
CLAIMS = {
    "A": "Strong evidence that the model relies on this feature.",
    "B": "Good evidence that the model relies on this feature.",
    "C": "Qualified evidence: direction or size may change.",
    "D": "No supported claim about this feature.",
}


def evidence_grade(stability: float, low: float | None, high: float | None, association: float, threshold: float = 0.7) -> str:
    """D; C from a stability of 0.6; B from 0.8 and A from 0.9 if the interval excludes zero and associations are low enough."""
    known = low is not None and high is not None and low == low and high == high
    excludes = known and (low > 0 or high < 0)
    grade = "C" if stability >= 0.6 else "D"
    if stability >= 0.8 and excludes and association < threshold:
        grade = "B"
    if stability >= 0.9 and excludes and association < min(0.5, threshold):
        grade = "A"
    return grade


def overall_grade(grades: Sequence[str], critical: bool) -> str:
    """The grade nearest to the median, the better of equals; two steps down if a finding is critical."""
    worth = {g: 4 - i for i, g in enumerate(GRADES)}
    middle = median(worth[g] for g in grades)
    best = min(GRADES, key=lambda g: abs(worth[g] - middle))
    return GRADES[min(GRADES.index(best) + 2, 3)] if critical else best


@dataclass
class Audit:
    metric: str
    importance: list[dict]
    dependence: list[dict]
    performance: list[dict]
    agreement: dict
    prediction: dict
    findings: list[dict]
    summary: dict
    scope: str = field(default=diagnostics.SCOPE)
    fingerprints: dict[str, str] = field(default_factory=dict)  # of the explainers, by model

    def __repr__(self) -> str:
        return f"<audit of {self.summary['n_models']} models: grade {self.summary['grade']}, {len(self.findings)} findings>"


def audit_explanations(explainers: Sequence, features: Sequence[str] | None = None, metric: str = "auto", repeats: int = 20, seed: int = 123, confidence: float = 0.95, tolerance: float = 0.05, threshold: float = 0.7) -> Audit:
    """Importance of each explainer's features (a seed further for each), and what the models agree on."""
    if not explainers:
        raise ContractError("an audit needs an explainer")
    first = explainers[0]
    if any(e.task != first.task for e in explainers):
        raise ContractError("explainers of one audit share a task")
    if len({e.model.model_id for e in explainers}) != len(explainers):
        raise ContractError("explainers need distinct model ids")
    name = resolve_metric(first.task, metric)
    shared = [f for f in first.features if all(f in e.features for e in explainers)]
    features = list(features) if features else shared
    if not features or set(features) - set(shared):
        raise ContractError("the explainers don't share these features")
    importance, scores, by_model = [], {}, {}
    strongest = {r["feature"]: r.asDict() for r in explain.dependence(first.data, features, threshold).collect()} if len(features) > 1 else {features[0]: {"feature": features[0], "most_associated": None, "max_association": 0.0, "high_dependence": False}}
    for i, e in enumerate(explainers):
        found = explain.permutation_importance(e.data, e.predict, e.task, name, features, repeats, seed + i, confidence=confidence).collect()
        scores[e.model.model_id] = found[0]["baseline_score"]
        by_model[e.model.model_id] = {r["feature"]: r["importance"] for r in found}
        for r in found:
            grade = evidence_grade(r["sign_stability"], r["conf_low"], r["conf_high"], strongest[r["feature"]]["max_association"], threshold)
            importance.append({"model_id": e.model.model_id, **r.asDict(), "max_association": strongest[r["feature"]]["max_association"], "evidence_grade": grade, "claim": CLAIMS[grade]})
    near = diagnostics.near_best(scores, name, tolerance, slack=ROOT_EPSILON)
    best = (max if explain.better(name) < 0 else min)(scores.values())
    performance = [{"model_id": m, "metric": name, "score": s, "relative_gap": abs(s - best) / max(abs(best), ROOT_EPSILON), "near_optimal": m in near} for m, s in scores.items()]
    agreement = compare.importance_agreement({m: by_model[m] for m in near}, features)
    prediction = _prediction_agreement([e for e in explainers if e.model.model_id in near])
    dependence = list(strongest.values())
    found = findings(importance, dependence, performance, agreement, prediction, repeats, threshold, [e.role for e in explainers])
    grades = [r["evidence_grade"] for r in importance]
    critical = sum(f["severity"] == "critical" for f in found)
    summary = {
        "grade": overall_grade(grades, critical > 0), "n_models": len(explainers), "n_near_optimal": len(near), "stable_claim_rate": sum(g in "AB" for g in grades) / len(grades), "max_association": max(d["max_association"] for d in dependence),
        "mean_rank_agreement": agreement["mean_rank_correlation"], "prediction_agreement": prediction["score"], "critical_findings": critical, "warning_findings": sum(f["severity"] == "warning" for f in found),
    }
    return Audit(name, importance, dependence, performance, agreement, prediction, found, summary, fingerprints={e.model.model_id: e.fingerprint for e in explainers})


def _prediction_agreement(explainers: Sequence) -> dict:
    if len(explainers) < 2:
        return {"score": None, "ambiguity": None}
    wide: DataFrame = explainers[0].data
    names = []
    for i, e in enumerate(explainers):
        wide = e.predict(wide).withColumnRenamed("score", f"__m{i}")
        names.append(f"__m{i}")
    return compare.prediction_agreement(wide.select(*names), explainers[0].task, names)


def findings(importance, dependence, performance, agreement, prediction, repeats: int, threshold: float, roles: Sequence[str]) -> list[dict]:
    """Rule-based findings, the critical ones about models that fit alike and explain differently."""
    out: list[dict] = []

    def add(severity: str, code: str, message: str, evidence: str, recommendation: str) -> None:
        out.append({"severity": severity, "code": code, "message": message, "evidence": evidence, "recommendation": recommendation})

    high = [d for d in dependence if d["high_dependence"]]
    if high:
        add("warning", "feature_dependence", f"Associated at {threshold:g} or more: {', '.join(d['feature'] for d in high)}.", f"Maximum {max(d['max_association'] for d in high):.3g}.", "Shuffled values make rows that don't occur; use accumulated effects or groups.")
    limited = [r for r in importance if r["evidence_grade"] in "CD"]
    if limited:
        crosses = sum(r["conf_low"] is None or not (r["conf_low"] > 0 or r["conf_high"] < 0) for r in limited)
        unstable, dependent = sum(r["sign_stability"] < 0.8 for r in limited), sum(r["max_association"] >= threshold for r in limited)
        add("warning", "limited_importance_evidence", f"Graded C or D: {len(limited)} of {len(importance)} model-feature rows.", f"Interval over zero: {crosses}; sign stability under 0.8: {unstable}; associated: {dependent}.", "Raise repeats or rows before ordering these features.")
    several = sum(p["near_optimal"] for p in performance) > 1
    rank = agreement["mean_rank_correlation"]
    if several and rank is not None and rank < 0.7:
        add("critical", "rashomon_disagreement", "Near-optimal models order the features differently.", f"Rank correlation {rank:.3g} on average, under 0.7.", "Give each feature's range over the models.")
    if several and prediction["ambiguity"] is not None and prediction["ambiguity"] > 0.1:
        add("warning", "predictive_multiplicity", "Near-optimal models score the same rows differently.", f"Ambiguity {prediction['ambiguity']:.3g}, over 0.1.", "List the rows in question and the rule that chose the model.")
    if repeats < 20:
        add("note", "low_monte_carlo_budget", f"{repeats} shuffles of each feature, under 20.", "Intervals have few degrees of freedom.", "Run 20 for a result to keep.")
    if "unspecified" in roles:
        add("note", "evaluation_role_unspecified", "An explainer doesn't say where its rows come from.", "role = unspecified.", "Give the role; training rows flatter a model.")
    if not out:
        add("note", "no_automatic_red_flags", "None of the rules above applied.", f"{len(importance)} rows looked at.", "Rules don't see the meaning of columns; someone who knows them should.")
    return out


def frame(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """A list of findings or grades as a frame."""
    return df.sparkSession.createDataFrame([{k: v for k, v in r.items()} for r in rows]) if rows else df.limit(0).select(F.lit("").alias("empty"))
