"""Fitting and scoring: every model is reached through `Fitted.score(df)`, which adds a score column.

A regression score is a number, a binary one P(positive), a multiclass one an array of probabilities in level order.
Fits are Spark ML estimators on an encoded vector, except for what Spark ML lacks; see the registry for approximations.
"""

from __future__ import annotations

import contextlib
import importlib
import json
import threading
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task, predictor_kind
from lucidframe.functions.expr import candidate_cuts, col
from lucidframe.models import cells, forest, grams, margin, mars, neural, trees
from lucidframe.models.registry import FAMILIES, check_parameters
from lucidframe.operators import metrics
from lucidframe.operators.prep import Encoding, learn_encoding
from lucidframe.shipping import ship



@dataclass
class Fitted:
    """A fitted model behind the scoring contract."""

    model_id: str
    family: str
    task: Task
    features: tuple[str, ...]
    scorer: Callable[[DataFrame], DataFrame]
    parameters: dict = field(default_factory=dict)
    complexity: float | None = None
    seconds: float = 0.0
    notes: tuple[str, ...] = ()
    details: dict = field(default_factory=dict)

    def release(self) -> None:
        """Let go of what the scorer keeps in the executors' memory; it can't score any more."""
        if isinstance(self.scorer, NeighborScorer):
            self.scorer.cells.blocks.unpersist()
        if isinstance(self.scorer, ForestScorer) and self.scorer.sent is not None:
            self.scorer.sent.unpersist()

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = self.scorer(df)
        return out if name == "score" else out.withColumnRenamed("score", name)

    @property
    def label(self) -> str:
        family = FAMILIES.get(self.family)
        return family.labels.get(self.task.kind, self.family) if family else "intercept-only baseline"

    def __repr__(self) -> str:
        return f"<{self.model_id}: {self.label}, {self.task.kind}, {len(self.features)} features>"


def _probabilities(column: str, task: Task) -> Column:
    array = vector_to_array(F.col(column))
    return array[1] if task.kind == BINARY else array


def baseline(df: DataFrame, task: Task, model_id: str = "baseline") -> Fitted:
    """The mean, or the classes' shares."""
    y = task.label()
    if task.kind == MULTICLASS:
        counts = {r[0]: r[1] for r in df.groupBy(y.alias("y")).count().collect()}
        total = sum(counts.values())
        value: float | list[float] = [counts.get(i, 0) / total for i in range(len(task.levels))]
    else:
        value = float(df.agg(F.avg(y)).first()[0])
    return Fitted(model_id, "baseline", task, (), Formula("constant", None, task, {"value": value}), complexity=1.0)


@dataclass
class Formula:
    """A score that is one expression of the columns, from numbers that can be written down."""

    form: str
    encoding: Encoding | None
    task: Task
    numbers: dict

    def __call__(self, df: DataFrame) -> DataFrame:
        value = getattr(self, f"_{self.form}")([c for _, c in self.encoding.columns()] if self.encoding else [])
        out = self.encoding.guard(df) if self.encoding else df
        if self.form != "constant" and self.task.kind == BINARY:
            value = 1 / (1 + F.exp(-value))
        return out.withColumn("score", value)

    def _constant(self, x: list[Column]) -> Column:
        value = self.numbers["value"]
        return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)

    def _linear(self, x: list[Column]) -> Column:
        return sum((c * float(b) for c, b in zip(x, self.numbers["coefficients"]) if b), F.lit(float(self.numbers["intercept"])))

    def _splines(self, x: list[Column]) -> Column:
        total = F.lit(float(self.numbers["intercept"]))
        for smooth, weights in zip(self.numbers["smooths"], self.numbers["weights"]):
            term = grams.Smooth(*smooth)
            total = total + term.expression(x[term.at], np.asarray(weights))
        return sum((x[j] * float(b) for j, b in zip(self.numbers["straight"], self.numbers["coefficients"])), total)

    def _hinges(self, x: list[Column]) -> Column:
        low, width = self.numbers["low"], self.numbers["width"]
        unit = [(c - F.lit(float(a))) / F.lit(float(w)) for c, a, w in zip(x, low, width)]
        terms = [tuple(tuple(f) for f in t) for t in self.numbers["terms"]]
        return sum((mars.expression(t, unit) * float(b) for t, b in zip(terms, self.numbers["coefficients"])), F.lit(0.0))

    def state(self) -> dict:
        return {"form": self.form, "numbers": self.numbers}


def shared_of(shared: dict | None, key, make: Callable):
    """What fits of the same rows have in common, made once."""
    if shared is None:
        return make()
    if key not in shared:
        shared[key] = make()
    return shared[key]


def _gram(df: DataFrame, task: Task, encoding: Encoding, shared: dict | None) -> grams.Gram:
    return shared_of(shared, ("gram", encoding.contrast), lambda: grams.grams(df, encoding.array(), task.label())[0])


def _spark_ml(estimator, encoding: Encoding, task: Task, data: DataFrame):
    """Fit on the vector column."""
    model = estimator.fit(data)
    return model, MlScorer(model, encoding, task)


class MlScorer:
    """Score by transforming, and drop what isn't asked for; it keeps what a save needs."""

    def __init__(self, model, encoding: Encoding, task: Task):
        self.model, self.encoding, self.task = model, encoding, task

    def __call__(self, df: DataFrame) -> DataFrame:
        model, encoding, task = self.model, self.encoding, self.task
        names = df.columns
        out = model.transform(encoding.assemble(df, "__features"))
        value = F.col("prediction") if task.kind == REGRESSION else _probabilities("probability", task)
        return out.select(*[col(c) for c in names if c != "score"], value.alias("score"))


def _vectors(df: DataFrame, encoding: Encoding, task: Task) -> DataFrame:
    return encoding.assemble(df.withColumn("__label", task.label().cast("double")), "__features").select("__features", "__label")


def _common(estimator, **extra):
    return estimator(featuresCol="__features", labelCol="__label", predictionCol="prediction", **extra)


def _linear(df, task, encoding, q, seed, shared=None):
    if task.kind == REGRESSION:
        intercept, beta = grams.least_squares(_gram(df, task, encoding, shared))
        numbers = {"intercept": intercept, "coefficients": beta.tolist()}
        return Formula("linear", encoding, task, numbers), {"complexity": float(np.count_nonzero(beta) + 1)} | numbers
    data = _vectors(df, encoding, task)
    model, score = _spark_ml(_common(C.LogisticRegression, regParam=0.0, maxIter=200, family="binomial" if task.kind == BINARY else "multinomial"), encoding, task, data)
    notes = ("the iteration cap was reached",) if model.summary.totalIterations >= 200 else ()
    return score, {"complexity": float(model.coefficientMatrix.toArray().size + model.interceptVector.size), "notes": notes}


def _largest_penalty(df: DataFrame, encoding: Encoding, task: Task, alpha: float) -> float:
    """The penalty at which all coefficients are zero: the greatest scaled covariance with a class, in one pass."""
    y = task.label().cast("double")
    targets = [y] if task.kind == BINARY else [(y == k).cast("double") for k in range(len(task.levels))]
    parts = [(F.covar_pop(x, t) / F.nullif(F.stddev_pop(x), F.lit(0.0))) for _, x in encoding.columns() for t in targets]
    row = df.agg(*[F.abs(c).alias(f"c{i}") for i, c in enumerate(parts)]).first()
    return max((x for x in row if x is not None), default=1.0) / max(alpha, 1e-3)


def _regularized(df, task, encoding, q, seed, shared=None):
    step = round(q["path_fraction"] * (grams.PATH - 1))
    if task.kind == REGRESSION:
        path = shared_of(shared, ("path", q["alpha"]), lambda: grams.elastic_net_path(_gram(df, task, encoding, shared), q["alpha"]))
        penalty, intercept, beta = path[step]
        numbers = {"intercept": intercept, "coefficients": beta.tolist()}
        return Formula("linear", encoding, task, numbers), {"complexity": float(np.count_nonzero(beta) + 1), "lambda": penalty} | numbers
    penalty = _largest_penalty(df, encoding, task, q["alpha"]) * grams.LEAST ** (step / (grams.PATH - 1))
    model, score = _spark_ml(_common(C.LogisticRegression, regParam=float(penalty), elasticNetParam=q["alpha"], maxIter=200), encoding, task, _vectors(df, encoding, task))
    return score, {"complexity": float(np.count_nonzero(model.coefficientMatrix.toArray()) + 1), "lambda": penalty}


@dataclass
class TreeScorer:
    """Scores by trees in arrays, in Arrow batches: one tree, or boosted ones where start holds the margins that all begin with."""

    encoding: Encoding
    task: Task
    rounds: list[list[trees.Tree]]
    start: list[float] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        kind, boosted = self.task.kind, None if self.start is None else trees.Boosted(self.task.kind, np.array(self.start), self.rounds)
        alone = self.rounds[0][0] if boosted is None else None

        cuts = boosted.cuts(len(self.encoding.names)) if boosted else []

        @F.pandas_udf("array<double>" if kind == MULTICLASS else "double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = trees.Remembered(cuts, lambda bins, x: boosted.predict(x)) if boosted else alone.says
            for x in batches:
                found = score(np.stack(x.to_numpy())) if len(x) else np.empty((0, 2))
                yield pd.Series(list(found[:, 1] if alone and kind == BINARY else found), dtype=None if len(x) else object)

        return self.encoding.guard(df).withColumn("score", run(self.encoding.array()))

    def state(self) -> dict:
        return {"rounds": [[asdict(t) for t in r] for r in self.rounds], "start": self.start}


def _scale(df: DataFrame, y: Column) -> tuple[float, float]:
    """Mean and deviation to 12 digits, so that the order of summation doesn't show."""
    mean, sd = (float(f"{v or 0.0:.12g}") for v in df.agg(F.avg(y), F.stddev_pop(y)).first())
    return mean, sd or 1.0


def _tree(df, task, encoding, q, seed, shared=None):
    """One tree, grown to its depth and cut back by cost and complexity."""

    def whole() -> trees.Grown:
        y = task.label()
        if task.kind == REGRESSION:  # on a scale of its own, so that sums are exact
            scale = _scale(df, y)
            y = (y - scale[0]) / scale[1]
        else:
            scale = (0.0, 1.0)
        rows = shared_of(shared, "binned", lambda: trees.binned(df, dict(encoding.columns()), y, np.zeros(1)))
        try:
            found = trees.grow(rows, task.kind, len(task.levels), min(30, q["maxdepth"]), q["minsplit"])
        finally:
            if shared is None:  # else whoever shares it lets go of it
                rows.release()
        if task.kind == REGRESSION:
            found.tree.value = [v * scale[1] + scale[0] for v in found.tree.value]
        return found

    cut = trees.pruned(shared_of(shared, ("tree", q["maxdepth"], q["minsplit"]), whole), q["cp"])
    return TreeScorer(encoding, task, [[cut]]), {"complexity": float(cut.leaves)}


@dataclass
class ForestScorer:
    """Scores by a forest's trees, in Arrow batches; the trees are broadcast once."""

    encoding: Encoding
    task: Task
    forest: forest.Forest
    sent: object = None

    def __call__(self, df: DataFrame) -> DataFrame:
        kind = self.task.kind
        if self.sent is None:
            self.sent = df.sparkSession.sparkContext.broadcast(self.forest)
        sent = self.sent

        @F.pandas_udf("array<double>" if kind == MULTICLASS else "double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = trees.Remembered(sent.value.cuts, lambda bins, x: sent.value.of_bins(bins))
            for x in batches:
                found = score(np.stack(x.to_numpy())) if len(x) else np.empty((0, 2))
                yield pd.Series(list(found[:, 1] if kind == BINARY else found), dtype=None if len(x) else object)

        return self.encoding.guard(df).withColumn("score", run(self.encoding.array()))

    def state(self) -> dict:
        return {"cuts": [c.tolist() for c in self.forest.cuts]}


def _forest(df, task, encoding, q, seed, shared=None):
    """Trees of full depth on Poisson weights; cut points are the best, or drawn where the split rule is extratrees."""
    y, scale = task.label(), (0.0, 1.0)
    if task.kind == REGRESSION:  # on a scale of its own, so that sums are exact
        scale = _scale(df, y)
        y = (y - scale[0]) / scale[1]
    rows = trees.binned(df, dict(encoding.columns()), y, np.zeros(1), local=0)
    try:
        found = forest.plant(rows, forest.plan_of(rows, task.kind, len(task.levels), q, seed))
    finally:
        rows.release()
    if task.kind == REGRESSION:
        found.nodes.value = found.nodes.value * scale[1] + scale[0]
    return ForestScorer(encoding, task, found), {"complexity": float(len(found.nodes.column))}


def _boosting(df, task, encoding, q, seed, shared=None):
    """Second-order boosting on histograms; several classes share one model of a tree for each in a round."""
    y, mean, sd = task.label(), 0.0, 1.0
    if task.kind == MULTICLASS:
        counts = {r[0]: r[1] for r in df.groupBy(y.alias("y")).count().collect()}
        start = np.log([max(counts.get(k, 0), 0.5) for k in range(len(task.levels))]) - np.log(sum(counts.values()))
    else:
        mean, sd = _scale(df, y)
        if task.kind == REGRESSION:  # on a scale of its own, so that sums are exact
            y, start, q = (y - mean) / sd, np.zeros(1), q | {"reg_alpha": q["reg_alpha"] / sd}
        else:
            start = np.log([mean / (1 - mean)])
    columns = dict(encoding.columns())
    rows = trees.binned(df, columns, y, start) if q["subsample"] < 1 else trees.celled(df, columns, y, task.kind, start)
    try:
        found = trees.boost(rows, task.kind, start, q, seed)
    finally:
        rows.release()
    if task.kind == REGRESSION:
        found.start = np.array([mean])
        for t in (t for r in found.rounds for t in r):
            t.value = [v * sd for v in t.value]
    return TreeScorer(encoding, task, found.rounds, found.start.tolist()), {"complexity": float(sum(len(t.column) for r in found.rounds for t in r))}


# Learners on driver-made bases


#: Steps of Fisher scoring at most, and the change of the deviance that ends it.
SCORING, SETTLED = 30, 1e-7


def _additive(df, task, encoding, q, seed, shared=None):
    names = encoding.names
    numbers = [f for f in encoding.features if encoding.kinds[f] == "numeric"]

    def ranges() -> dict[str, tuple[float, float, int]]:
        """Ends of each number, and its distinct values as far as they matter."""
        row = df.agg(*[x for f in numbers for x in (F.min(col(f).cast("double")), F.max(col(f).cast("double")))]).first() if numbers else ()
        return {f: (row[2 * i], row[2 * i + 1], df.select(col(f)).distinct().limit(64).count()) for i, f in enumerate(numbers)}

    smooths = []
    for f, (low, high, distinct) in shared_of(shared, "ranges", ranges).items():
        if distinct >= 4 and high > low:
            smooths.append(grams.Smooth(names.index(f), max(3, min(q["k"], distinct - 1)), low, high))
    if not smooths:
        raise ContractError("the additive learner needs a number with at least four values")
    straight = [j for j in range(len(names)) if j not in {t.at for t in smooths}]
    make = grams.spline_columns(smooths, straight)
    if task.kind == REGRESSION:
        gram = shared_of(shared, ("splines", q["k"]), lambda: grams.grams(df, encoding.array(), task.label(), make=make)[0])
        found, scans = grams.fit_splines(gram, smooths, len(straight), q["gamma"], q["select"]), 1
    else:
        found, scans = _scored_splines(df, task, encoding, smooths, straight, make, q)
    about = {"intercept": found.intercept, "smooths": [(t.at, t.k, t.low, t.high) for t in smooths], "weights": [w.tolist() for w in found.weights], "straight": straight, "coefficients": found.straight.tolist()}
    freedom = {names[t.at]: f for t, f in zip(smooths, found.freedom)}
    return Formula("splines", encoding, task, about), {"complexity": 1 + len(straight) + sum(found.freedom), "freedom": freedom, "scans": scans}


def _scored_splines(df, task, encoding, smooths, straight, make, q) -> tuple[grams.SplineFit, int]:
    """Fisher scoring: a pass for each step, which sums the weighted Gram matrix of the working outcome and the deviance."""
    mean = float(df.agg(F.avg(task.label())).first()[0])
    rate = min(max(mean, 1e-6), 1 - 1e-6)
    eta, found, before = F.lit(float(np.log(rate / (1 - rate)))), None, None
    y = task.label().cast("double")
    for scan in range(1, SCORING + 1):
        p = F.least(F.greatest(1 / (1 + F.exp(-F.col("__eta"))), F.lit(1e-9)), F.lit(1 - 1e-9))
        rows = df.withColumn("__eta", eta)
        w = p * (1 - p)
        gram = grams.grams(rows, encoding.array(), F.col("__eta") + (y - p) / w, make=make, weight=w, shifted=False)[0]
        found = grams.fit_splines(gram, smooths, len(straight), q["gamma"], q["select"], None if found is None else found.penalties, variance=1.0)
        about = {"intercept": found.intercept, "smooths": [(t.at, t.k, t.low, t.high) for t in smooths], "weights": [x.tolist() for x in found.weights], "straight": straight, "coefficients": found.straight.tolist()}
        eta = Formula("splines", encoding, replace(task, kind=REGRESSION), about)._splines([c for _, c in encoding.columns()])
        now = np.concatenate([[found.intercept], *found.weights, found.straight])
        if before is not None and np.max(np.abs(now - before)) <= SETTLED * (1 + np.max(np.abs(now))):
            break
        before = now
    return found, scan


def _unit_scale(df: DataFrame, encoding: Encoding) -> tuple[np.ndarray, np.ndarray]:
    columns = [c for _, c in encoding.columns()]
    row = df.agg(*[x for c in columns for x in (F.min(c), F.max(c))]).first()
    low, high = np.array(row[::2], float), np.array(row[1::2], float)
    return low, np.where(high > low, high - low, 1.0)


def _mars(df, task, encoding, q, seed, shared=None):
    """Forward passes over interval sums, pruning on the Gram matrix they leave; a binary outcome's terms get a logistic fit."""
    most = max(21, 2 * q["nprune"] + 1)

    def search() -> tuple[mars.Forward, np.ndarray, np.ndarray]:
        low, width = _unit_scale(df, encoding)
        columns = {n: (c - F.lit(float(a))) / F.lit(float(w)) for (n, c), a, w in zip(encoding.columns(), low, width)}
        numbers = {n: columns[n] for n in encoding.features if encoding.kinds[n] == "numeric"}
        cuts = candidate_cuts(df, numbers, [i / (mars.KNOTS + 1) for i in range(mars.KNOTS + 1)])
        knots = [np.array([c for c in cuts[n] if c < 1]) if n in cuts else np.zeros(1) for n in encoding.names]
        rows = df.select(F.array(*columns.values()).alias("x"), task.label().cast("double").alias("y")).persist()
        try:
            return mars.forward(rows, knots, q["degree"], most), low, width
        finally:
            rows.unpersist()

    found, low, width = shared_of(shared, ("hinges", q["degree"], most), search)
    chosen, beta = mars.prune(found, q["nprune"], q["degree"])
    terms = [found.terms[j] for j in chosen]
    about = {"complexity": float(len(terms)), "scans": found.scans, "terms": terms}
    if task.kind == BINARY:
        columns = [(c - F.lit(float(a))) / F.lit(float(w)) for (_, c), a, w in zip(encoding.columns(), low, width)]
        beta = _logistic(df, task, [mars.expression(t, columns) for t in terms[1:]])
    else:
        beta = beta.copy()
        beta[0] += float(df.agg(F.avg(task.label())).first()[0])  # the matrix is about the outcome's mean
    numbers = {"terms": [[list(f) for f in t] for t in terms], "coefficients": beta.tolist(), "low": low.tolist(), "width": width.tolist()}
    return Formula("hinges", encoding, task, numbers), about


def _logistic(df: DataFrame, task: Task, columns: list[Column]) -> np.ndarray:
    """Intercept and coefficients of a logistic fit on expressions."""
    if not columns:
        rate = float(df.agg(F.avg(task.label())).first()[0])
        return np.array([np.log(rate / (1 - rate))])
    data = df.select(array_to_vector(F.array(*columns)).alias("__features"), task.label().cast("double").alias("__label"))
    model = _common(C.LogisticRegression, regParam=1e-8, maxIter=200).fit(data)
    return np.concatenate(([model.intercept], model.coefficients.toArray()))


@dataclass
class MarginScorer:
    """Scores by a margin machine's weights, in Arrow batches."""

    encoding: Encoding
    task: Task
    machine: margin.Machine
    weights: np.ndarray
    sigmoid: np.ndarray | None

    def __call__(self, df: DataFrame) -> DataFrame:
        machine, w, sigmoid = self.machine, self.weights, self.sigmoid

        @F.pandas_udf("array<double>" if self.task.kind == MULTICLASS else "double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(machine.predict(w, sigmoid, np.stack(x.to_numpy()))) if len(x) else [])

        return self.encoding.guard(df).withColumn("score", run(self.encoding.array()))

    def state(self) -> dict:
        return {"machine": asdict(self.machine), "weights": self.weights.tolist(), "sigmoid": None if self.sigmoid is None else self.sigmoid.tolist()}


def _kernel(df, task, encoding, q, seed, shared=None):
    """A radial margin machine on random features; numbers are standardised, classes get calibrated probabilities."""
    centre, scale = _scale(df, task.label()) if task.kind == REGRESSION else (0.0, 1.0)
    p = max(1, len(encoding.names))
    machine = margin.Machine(p, len(task.levels) if task.kind == MULTICLASS else 1, task.kind, q["cost"], q["gamma_multiplier"] / p, q["epsilon"], seed, centre, scale)
    w, sigmoid, about = margin.fit(df, encoding.array(), task.label(), machine)
    return MarginScorer(encoding, task, machine, w, sigmoid), {"complexity": float(margin.FEATURES), "notes": () if about["converged"] else ("the cap on passes was reached",)} | about


@dataclass
class NetScorer:
    """Scores by a network's weights, in Arrow batches."""

    encoding: Encoding
    task: Task
    net: neural.Net
    weights: np.ndarray

    def __call__(self, df: DataFrame) -> DataFrame:
        net, w = self.net, self.weights

        @F.pandas_udf("array<double>" if self.task.kind == MULTICLASS else "double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(net.predict(w, np.stack(x.to_numpy()))) if len(x) else [])

        return self.encoding.guard(df).withColumn("score", run(self.encoding.array()))

    def state(self) -> dict:
        return {"net": asdict(self.net), "weights": self.weights.tolist()}


def _neural(df, task, encoding, q, seed, shared=None):
    """One hidden layer with weight decay, on all rows."""
    y = task.label().cast("double")
    centre, scale = 0.0, 1.0
    if task.kind == REGRESSION:
        centre, scale = df.agg(F.avg(y), F.stddev_samp(y)).first()
        if not scale:
            raise ContractError("the outcome doesn't vary")
    net = neural.Net(len(encoding.names), q["size"], len(task.levels) if task.kind == MULTICLASS else 1, task.kind, q["decay"], float(centre), float(scale))
    # A search over settings says which nets it will ask for, and they are fitted together.
    nets = [(replace(net, hidden=p["size"], decay=p["decay"]), s) for p, s in (shared or {}).get("nets asked for", [])]
    if (net, seed) in nets:
        weights, about = shared_of(shared, "nets", lambda: dict(zip(nets, neural.fit_several(df, encoding.array(), y, nets))))[net, seed]
    else:
        weights, about = neural.fit(df, encoding.array(), y, net, seed)
    about = dict(about)
    notes = () if about["converged"] else ("the cap on passes was reached",)
    return NetScorer(encoding, task, net, weights), {"complexity": float(net.size), "notes": notes} | about


def _weights(kernel: str, d: np.ndarray, k: int) -> np.ndarray:
    """Kernel weights of scaled distances in [0, 1), nearest first."""
    place = np.arange(1, d.shape[1] + 1)[None, :]
    return {
        "rectangular": lambda: np.ones_like(d), "triangular": lambda: 1 - d, "epanechnikov": lambda: 0.75 * (1 - d**2), "biweight": lambda: (1 - d**2) ** 2, "triweight": lambda: (1 - d**2) ** 3,
        "cos": lambda: np.cos(d * np.pi / 2), "inv": lambda: 1 / np.maximum(d, 1e-6), "gaussian": lambda: np.exp(-0.5 * (d * 2.5) ** 2), "rank": lambda: np.broadcast_to(k + 1.0 - place, d.shape),
        "optimal": lambda: np.broadcast_to(np.maximum(1e-6, 1 + k / 2 * (1 - (place**1.5 - (place - 1) ** 1.5) / k**0.5)), d.shape),
    }[kernel]()


@dataclass
class NeighborScorer:
    """Weighted means of the nearest rows' outcomes; equal points are looked up once."""

    encoding: Encoding
    task: Task
    cells: cells.Cells
    k: int
    kernel: str

    def lookup(self, df: DataFrame) -> DataFrame:
        """(id, check, near, compared): what is found for each distinct point of some rows."""
        points = df.select(*self.keys(), self.encoding.array().alias("x")).dropDuplicates(["id", "check"])
        return cells.nearest(points, self.cells, self.k + 1)  # the next one scales the weights

    def keys(self) -> list[Column]:
        x = self.encoding.array()
        return [F.xxhash64(x).alias("id"), F.xxhash64(F.lit(1), x).alias("check")]

    def __call__(self, df: DataFrame) -> DataFrame:
        k, kernel, classes = self.k, self.kernel, len(self.task.levels) if self.task.kind == MULTICLASS else 0

        @F.pandas_udf("array<double>" if classes else "double")
        def combine(found: pd.Series) -> pd.Series:
            out = []
            for rows in found:
                d, y = np.array([r["d"] for r in rows]), np.array([r["y"] for r in rows])
                reach = max(d[k] if len(d) > k else d.max(), 1e-12)
                d, y = d[:k], y[:k]
                w = _weights(kernel, np.clip(d / reach, 0, 1 - 1e-6)[None, :], k)[0]
                w = w / w.sum() if w.sum() > 0 else np.full(len(d), 1 / len(d))
                out.append([float(w[y == c].sum()) for c in range(classes)] if classes else float(w @ y))
            return pd.Series(out)

        df = self.encoding.guard(df)
        found = self.lookup(df).select(F.col("id").alias("__id"), F.col("check").alias("__check"), combine("near").alias("score"))
        kept = [c for c in df.columns if c != "score"]
        id_, check = self.keys()
        keyed = df.select(*[col(c) for c in kept], id_.alias("__own_id"), check.alias("__own_check"))
        joined = keyed.join(found, (F.col("__own_id") == F.col("__id")) & (F.col("__own_check") == F.col("__check")))
        return joined.select(*[col(c) for c in kept], "score")

    def state(self) -> dict:
        return {"k": self.k, "kernel": self.kernel, "order": self.cells.order}


def _neighbors(df, task, encoding, q, seed, shared=None):
    """Exact weighted neighbours, found through metric cells."""
    found = cells.build(df, encoding.array(), task.label(), q["distance"], seed)
    n = int(found.rows.sum())
    k = min(q["k"], max(1, n - 1))
    return NeighborScorer(encoding, task, found, k, q["kernel"]), {"complexity": n / k, "blocks": len(found.rows)}


_FITS = {"linear": _linear, "regularized": _regularized, "additive": _additive, "tree": _tree, "mars": _mars, "neighbors": _neighbors, "forest": _forest, "kernel": _kernel, "neural": _neural, "boosting": _boosting}
_SCALED, _ONE_HOT = ("neighbors", "kernel", "neural"), ("neighbors", "kernel")


def fit_learner(df: DataFrame, task: Task, family: str, parameters: dict, features: list[str], seed: int = 123, model_id: str | None = None, shared: dict | None = None) -> Fitted:
    """Fit one family on prepared training rows. shared: kept between fits of the same rows and features, so that they share scans."""
    if family not in FAMILIES or task.kind not in FAMILIES[family].tasks:
        raise ContractError(f"{family} does not fit a {task.kind} task")
    parameters = check_parameters(family, parameters)
    ship(df.sparkSession)
    started = time.perf_counter()
    contrast, scaled = "one_hot" if family in _ONE_HOT else "treatment", family in _SCALED
    encoding = shared_of(shared, ("encoding", contrast, scaled), lambda: learn_encoding(df, features, contrast, standardize=scaled))
    alone = threading.current_thread() is threading.main_thread()  # warnings belong to the process, not to one of several fits
    with warnings.catch_warnings(record=True) if alone else contextlib.nullcontext([]) as caught:
        if alone:
            warnings.simplefilter("always")
        scorer, details = _FITS[family](df, task, encoding, parameters, int(seed % (2**31 - 1)), shared)
    if not hasattr(scorer, "encoding"):  # these guard themselves
        inner = scorer
        scorer = lambda d: inner(encoding.guard(d))
    notes = (*details.pop("notes", ()), *[str(w.message) for w in caught if issubclass(w.category, (RuntimeWarning, UserWarning))])
    return Fitted(model_id or f"{family}_model", family, task, tuple(features), scorer, parameters, details.pop("complexity", None), time.perf_counter() - started, notes, details)


def save_fitted(fitted: Fitted, path: str) -> None:
    """Write a fit to a folder: what scoring needs as JSON, and Spark ML models, or the rows that neighbours are looked up in, beside it."""
    held, spark = fitted.scorer, SparkSession.active()
    kind = type(held).__name__
    if kind not in ("MlScorer", *_RESTORED):
        raise ContractError(f"a {fitted.family} fit can't be saved")
    about = {
        "scorer": kind, "encoding": asdict(held.encoding) if held.encoding else None, "task": asdict(fitted.task),
        "fitted": {"model_id": fitted.model_id, "family": fitted.family, "features": fitted.features, "parameters": fitted.parameters, "complexity": fitted.complexity},
    }
    if kind == "MlScorer":
        held.model.write().overwrite().save(f"{path}/model")
        about["class"] = f"{type(held.model).__module__}.{type(held.model).__name__}"
    else:
        about["state"] = held.state()
        if kind == "ForestScorer":
            table = spark.createDataFrame(held.forest.rows(), "tree int, column binary, bin binary, left binary, value binary")
            table.write.mode("overwrite").parquet(f"{path}/trees")
        if kind == "NeighborScorer":
            held.cells.blocks.write.mode("overwrite").parquet(f"{path}/rows")
            about["state"] |= {name: getattr(held.cells, name).tolist() for name in ("pivots", "cell", "part", "rows", "low", "high")}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_fitted(path: str) -> Fitted:
    spark = SparkSession.active()
    about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()[0])
    e, t, f = about["encoding"], about["task"], about["fitted"]
    encoding = e and Encoding(tuple(e["features"]), e["kinds"], {k: tuple(v) for k, v in e["levels"].items()}, e["contrast"], e["centre"], e["scale"])
    task = Task(t["kind"], t["target"], tuple(t["levels"]), t["positive"], tuple(t["notes"]))
    if about["scorer"] == "MlScorer":
        module, _, name = about["class"].rpartition(".")
        if not module.startswith("pyspark.ml."):
            raise ContractError("not a saved fit")
        scorer = MlScorer(getattr(importlib.import_module(module), name).load(f"{path}/model"), encoding, task)
    elif about["scorer"] in _RESTORED:
        ship(spark)
        scorer = _RESTORED[about["scorer"]](encoding, task, about["state"], path)
    else:
        raise ContractError("not a saved fit")
    return Fitted(f["model_id"], f["family"], task, tuple(f["features"]), scorer, f["parameters"], f["complexity"])


def _restored_neighbors(encoding, task, state, path) -> NeighborScorer:
    blocks = SparkSession.active().read.parquet(f"{path}/rows")
    known = (np.array(state[name]) for name in ("pivots", "cell", "part", "rows", "low", "high"))
    return NeighborScorer(encoding, task, cells.Cells(blocks, *known, state["order"]), state["k"], state["kernel"])


def _restored_forest(encoding, task, state, path) -> ForestScorer:
    rows = sorted(SparkSession.active().read.parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
    found = [forest.Part.of(r["column"], r["bin"], r["left"], r["value"]) for r in rows]
    return ForestScorer(encoding, task, forest.Forest.of(task.kind, [np.array(c) for c in state["cuts"]], found))


#: How saved scorers come back.
_RESTORED: dict[str, Callable] = {
    "Formula": lambda encoding, task, state, path: Formula(state["form"], encoding, task, state["numbers"]),
    "NetScorer": lambda encoding, task, state, path: NetScorer(encoding, task, neural.Net(**state["net"]), np.array(state["weights"])),
    "MarginScorer": lambda encoding, task, state, path: MarginScorer(encoding, task, margin.Machine(**state["machine"]), np.array(state["weights"]), None if state["sigmoid"] is None else np.array(state["sigmoid"])),
    "TreeScorer": lambda encoding, task, state, path: TreeScorer(encoding, task, [[trees.Tree(**t) for t in r] for r in state["rounds"]], state["start"]),
    "NeighborScorer": _restored_neighbors,
    "ForestScorer": _restored_forest,
}


def wrong_scores(task: Task, score: str = "score") -> Column:
    """How many scores break the contract: they must be there and finite, probabilities in [0, 1] and, for several classes, add up to one."""
    p = F.col(score)
    if task.kind == MULTICLASS:
        bad = p.isNull() | (F.size(p) != len(task.levels)) | F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)) | (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6)
    else:
        x = p.cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        if task.kind == BINARY:
            bad = bad | (x < 0) | (x > 1)
    return F.count(F.when(bad, 1))


def check_scores(df: DataFrame, task: Task, score: str = "score") -> None:
    """An error if scores break the contract."""
    _refuse(df.agg(wrong_scores(task, score)).first()[0], task)


def checked_loss(df: DataFrame, task: Task, metric: str) -> float | None:
    """A metric of y and score and the check of the scores, in one pass that makes nothing else."""
    wrong, value = df.agg(wrong_scores(task), metrics.aggregates(task, F.col("y"), F.col("score"))[metric]).first()
    _refuse(wrong, task)
    return value


def _refuse(wrong: int, task: Task) -> None:
    if wrong:
        raise ContractError(f"{wrong} predictions break the contract of a {task.kind} task")


def user_model(predict: Callable[[pd.DataFrame], object], task: Task, features: list[str], model_id: str = "user_model") -> Fitted:
    """A model from a function of a pandas frame of features: a vector, P(positive), or a matrix in level order, in Arrow batches."""
    kind = "array<double>" if task.kind == MULTICLASS else "double"

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        found = predict(rows)
        if isinstance(found, pd.DataFrame):
            found = align_probabilities(found, task)
        return pd.Series(list(np.asarray(found)))

    return Fitted(model_id, "user", task, tuple(features), lambda d: d.withColumn("score", run(F.struct(*[col(f) for f in features]))))


def align_probabilities(frame: pd.DataFrame, task: Task) -> np.ndarray:
    """A prediction frame's columns by their names: predict, the levels, p<level> or prob_<level>; anything else is ambiguous."""
    names = {str(c): c for c in frame.columns}
    if task.kind == REGRESSION or len(names) == 1:
        column = names.get("predict", next(iter(names.values())) if len(names) == 1 else None)
        if column is None:
            raise ContractError("several prediction columns, none called predict")
        return frame[column].to_numpy(float)
    for prefix in ("", "p", "prob_"):
        if all(f"{prefix}{x}" in names for x in task.levels):
            found = frame[[names[f"{prefix}{x}"] for x in task.levels]].to_numpy(float)
            return found if task.kind == MULTICLASS else found[:, task.levels.index(task.positive)]
    raise ContractError("prediction columns can't be matched to the classes")


def check_features(df: DataFrame, features: tuple[str, ...]) -> None:
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ContractError(f"missing columns: {', '.join(absent)}")
    wrong = [f for f in features if predictor_kind(df.schema[f].dataType) == "unsupported"]
    if wrong:
        raise ContractError(f"types that can't be predictors: {', '.join(wrong)}")
