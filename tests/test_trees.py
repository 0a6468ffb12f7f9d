"""Boosting and pruned trees against plain numpy on the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, Task
from lucidframe.functions.expr import candidate_cuts
from lucidframe.models import fit, trees

REG, BIN, MULTI = Task(REGRESSION, "y"), Task(BINARY, "side", ("no", "yes"), "yes"), Task(MULTICLASS, "kind", ("p", "q", "r"))
BOOST = {"nrounds": 6, "eta": 0.3, "max_depth": 2, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = np.round(rng.random((n, 3)), 2)
    y = np.where(x[:, 0] > 0.5, 5.0, 1.0) + 3 * x[:, 1] * (x[:, 0] > 0.5) + rng.normal(0, 0.3, n)
    side, kind = y + rng.normal(0, 1, n) > 3.5, np.digitize(y, [2, 5])
    rows = [(i, *map(float, x[i]), float(y[i]), "yes" if side[i] else "no", "pqr"[kind[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, side string, kind string").repartition(3).persist()
    yield df
    df.unpersist()


def plain_boost(x, y, q, cuts):
    """Squared errors, all rows: every split by trying it."""
    margin = np.full(len(y), y.mean())
    soft = lambda g: np.sign(g) * max(abs(g) - q["reg_alpha"], 0)
    worth = lambda g, h: soft(g) ** 2 / (h + q["reg_lambda"])
    for _ in range(q["nrounds"]):
        g, step = margin - y, np.zeros(len(y))
        leaves = [(np.arange(len(y)), 0)]
        while leaves:
            rows, depth = leaves.pop()
            best = (1e-9, None)
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    left = x[rows, j] <= c
                    nl, nr = left.sum(), (~left).sum()
                    if min(nl, nr) >= max(1, q["min_child_weight"]):
                        gain = (worth(g[rows][left].sum(), nl) + worth(g[rows][~left].sum(), nr) - worth(g[rows].sum(), len(rows))) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
            if best[1] is None or depth == q["max_depth"]:
                step[rows] = -q["eta"] * soft(g[rows].sum()) / (len(rows) + q["reg_lambda"])
            else:
                leaves += [(rows[best[1]], depth + 1), (rows[~best[1]], depth + 1)]
        margin = margin + step
    return margin


@pytest.mark.parametrize("change", [{}, {"reg_lambda": 50.0}, {"reg_alpha": 20.0}, {"min_child_weight": 120.0}, {"max_depth": 3, "eta": 1.0}])
def test_boosting_equals_trying_every_split(data, change):
    q = BOOST | change
    model = fit.fit_learner(data, REG, "boosting", q, ["a", "b", "c"])
    rows = model.score(data).toPandas()
    x = rows[["a", "b", "c"]].to_numpy()
    cuts = list(candidate_cuts(data, {c: F.col(c) for c in "abc"}, [i / trees.BINS for i in range(1, trees.BINS)]).values())
    assert np.allclose(rows.score, plain_boost(x, rows.y.to_numpy(), q, cuts), atol=1e-4)


def test_parameters_change_the_fit(data):
    def loss(task, target, **change):
        model = fit.fit_learner(data, task, "boosting", BOOST | change, ["a", "b", "c"], seed=7)
        scored = model.score(data)
        if task is REG:
            return scored.select(F.avg((F.col("score") - F.col(target)) ** 2)).first()[0], model
        own = F.when(F.col("side") == "yes", F.col("score")).otherwise(1 - F.col("score")) if task is BIN else F.get("score", F.array_position(F.array(*map(F.lit, "pqr")), F.col("kind")).cast("int") - 1)
        return scored.select(F.avg(-F.log(own))).first()[0], model

    base, model = loss(REG, "y")
    assert loss(REG, "y", nrounds=20)[0] < base < loss(REG, "y", eta=0.05)[0]
    half = loss(REG, "y", subsample=0.5)
    assert half[0] != base and half[0] < 3 * base
    one = loss(REG, "y", colsample_bytree=0.3)[1]
    assert all(len({c for c in t.column if c >= 0}) <= 1 for r in one.scorer.rounds for t in r) and len({c for r in one.scorer.rounds for t in r for c in t.column if c >= 0}) > 1
    assert all(len(r) == 1 for r in model.scorer.rounds)
    assert loss(BIN, "side", nrounds=20)[0] < 0.45
    several, several_model = loss(MULTI, "kind", nrounds=15)
    assert several < 0.35 and all(len(r) == 3 for r in several_model.scorer.rounds)
    sums = several_model.score(data).select(F.aggregate("score", F.lit(0.0), lambda a, v: a + v).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)


def test_trees_do_not_depend_on_partitions(data, monkeypatch):
    q = BOOST | {"subsample": 0.7, "colsample_bytree": 0.7, "nrounds": 3}
    monkeypatch.setattr(trees, "BLOCK", 100)
    fits = [fit.fit_learner(data, REG, "boosting", q, ["a", "b", "c"])]
    monkeypatch.setattr(trees, "LOCAL", 0)
    monkeypatch.setattr(trees, "PENDING", 2)
    fits += [fit.fit_learner(data.repartition(k), REG, "boosting", q, ["a", "b", "c"]) for k in (1, 5)]
    assert fits[0].scorer.state() == fits[1].scorer.state() == fits[2].scorer.state()


def test_pruning_follows_the_weakest_links(data):
    sizes, errors = [], []
    for cp in (0.0, 0.001, 0.01, 0.05, 0.3, 1.0):
        model = fit.fit_learner(data, REG, "tree", {"maxdepth": 8, "cp": cp, "minsplit": 6}, ["a", "b", "c"])
        sizes.append(model.complexity)
        errors.append(model.score(data).select(F.avg((F.col("score") - F.col("y")) ** 2)).first()[0])
    assert sizes == sorted(sizes, reverse=True) and errors == sorted(errors) and sizes[0] > 20 and sizes[-1] == 1
    # By hand: a root of risk 100 whose left child saves 10 by a split of its own, and whose right child is a leaf.
    t = trees.Tree()
    a, b = t.split(0, 0, 0, 0.5)
    t.split(a, 1, 0, 0.25)
    grown = trees.Grown(t, {}, {0: 100.0, a: 30.0, b: 20.0, 3: 12.0, 4: 8.0})
    links = trees.weakest_links(grown)
    assert [(round(c, 9), x.leaves) for c, x in links] == [(0.0, 3), (0.1, 2), (0.5, 1)]
    assert [trees.pruned(grown, cp).leaves for cp in (0.0, 0.05, 0.1, 0.4, 0.5)] == [3, 3, 2, 2, 1]


def test_tree_rules(spark, data):
    for task in (BIN, MULTI):
        model = fit.fit_learner(data, task, "tree", {"maxdepth": 4, "cp": 0.0, "minsplit": 30}, ["a", "b", "c"])
        grown = model.scorer.rounds[0][0]
        counts = np.bincount(grown.nodes(data.select("a", "b", "c").toPandas().to_numpy(), False))
        assert counts[counts > 0].min() >= 10 and model.complexity <= 16
    line = spark.createDataFrame([(float(i), 1.0 if i < 30 else 2.0) for i in range(60)], "a double, y double")
    model = fit.fit_learner(line, REG, "tree", {"maxdepth": 3, "cp": 0.01, "minsplit": 2}, ["a"])
    assert model.complexity == 2 and model.score(line).where("abs(score - y) > 1e-6").count() == 0


def test_trees_survive_a_round_trip(data, tmp_path):
    for i, (task, family, q) in enumerate(((REG, "boosting", BOOST), (MULTI, "boosting", BOOST | {"nrounds": 2}), (MULTI, "tree", {"maxdepth": 3, "cp": 0.0, "minsplit": 9}))):
        model = fit.fit_learner(data, task, family, q, ["a", "b", "c"])
        fit.save_fitted(model, str(tmp_path / str(i)))
        a, b = ({r.id: r.score for r in m.score(data).collect()} for m in (model, fit.load_fitted(str(tmp_path / str(i)))))
        assert a == b
