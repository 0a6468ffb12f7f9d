"""The learners that Lucidframe fits itself, against plain numpy and their defining conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task
from lucidframe.models import cells, fit, grams, neural, tuning
from lucidframe.operators import split
from lucidframe.plans import workflow

WAVE, PRODUCT, SIDE, KIND = Task(REGRESSION, "wave"), Task(REGRESSION, "product"), Task(BINARY, "side", ("no", "yes"), "yes"), Task(MULTICLASS, "kind", ("a", "b", "c"))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 1200
    a, b, g = rng.random(n), rng.random(n), rng.integers(0, 3, n)
    wave = np.sin(6 * a) + b + 0.1 * rng.normal(size=n)
    side = rng.random(n) < 1 / (1 + np.exp(-(3 * np.sin(6 * a) + b - 0.5)))
    rows = [(i, float(a[i]), float(b[i]), "abc"[g[i]], float(wave[i]), float(max(a[i] - 0.5, 0) * max(b[i] - 0.5, 0)), "yes" if side[i] else "no", "abc"[g[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, g string, wave double, product double, side string, kind string").repartition(4).persist()
    yield df
    df.unpersist()


def error(model, df, target):
    return model.score(df).select(F.sqrt(F.avg((F.col("score") - F.col(target)) ** 2))).first()[0]


def design(df):
    rows = df.select("a", "b", "g", "wave").toPandas()
    return np.column_stack([np.ones(len(rows)), rows.a, rows.b, rows.g == "b", rows.g == "c"]).astype(float), rows.wave.to_numpy()


def test_least_squares_on_a_gram_matrix(data):
    x, y = design(data)
    model = fit.fit_learner(data, WAVE, "linear", {}, ["a", "b", "g"])
    assert np.allclose([model.details["intercept"], *model.details["coefficients"]], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-10)
    # Columns that others express, and constant ones, get zero.
    twice = data.withColumns({"again": F.col("a") * 2 + 1e6, "same": F.lit(7.0)})
    more = fit.fit_learner(twice, WAVE, "linear", {}, ["a", "again", "b", "same", "g"])
    assert more.details["coefficients"][1] == more.details["coefficients"][3] == 0 and error(more, twice, "wave") == pytest.approx(error(model, data, "wave"), abs=1e-9)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_path_meets_the_conditions_of_its_optimum(data, alpha):
    gram = grams.grams(data, F.array("a", "b", (F.col("g") == "b").cast("double")), F.col("wave"))[0]
    mean, c = gram.centred()
    sd = np.sqrt(np.diag(c)[:-1] / gram.n)
    path = grams.elastic_net_path(gram, alpha)
    assert len(path) == 80 and path[-1][0] == pytest.approx(path[0][0] * 1e-3)
    for penalty, intercept, beta in path:
        slope = (c[:-1, -1] - c[:-1, :-1] @ beta) / sd / gram.n - penalty * (1 - alpha) * beta * sd
        assert np.all(np.abs(slope) <= penalty * alpha + 1e-9)
        assert np.allclose(slope[beta != 0], penalty * alpha * np.sign(beta[beta != 0]), atol=1e-9) and intercept == pytest.approx(mean[-1] - beta @ mean[:-1])
    if alpha:
        assert not path[0][2].any() and path[1][2].any()
    assert np.allclose(grams.elastic_net_path(gram, alpha, [0.0])[0][2], grams.least_squares(gram)[1], atol=1e-8)


def test_folds_share_one_scan_and_equal_separate_fits(data, monkeypatch):
    calls = []
    real = grams.summed
    monkeypatch.setattr(grams, "summed", lambda rows, part: calls.append(1) or real(rows, part))
    rows = data.select("id", "a", "b", "g", "wave")
    record = tuning.tune(rows, WAVE, "id", ["linear", "regularized"], 6)
    assert len(calls) == 1 and not any(s["error"] for s in record.fold_scores)
    dealt = split.folds(rows, "id", 5, 123)
    for s in record.fold_scores:
        c = next(c for c in record.plan if c["configuration_id"] == s["configuration_id"])
        model = fit.fit_learner(dealt.where(F.col("fold") != s["fold"]), WAVE, c["family"], c["parameters"], ["a", "b", "g"])
        if s["fold"] in (1, 4) and c["plan_order"] in (0, 3):
            assert s["score"] == pytest.approx(error(model, dealt.where(F.col("fold") == s["fold"]), "wave"), abs=1e-8)
    assert record.oof.count() == 6 * 1200
    paired = tuning.paired_oof(record, "linear_01", "regularized_01")
    assert paired.count() == 1200 and "loss_difference" in paired.columns
    with pytest.raises(ContractError):
        tuning.paired_oof(record, "linear_01", "nobody")
    record.oof = record.oof.where("NOT (configuration_id = 'linear_01' AND row_id = 5)")
    with pytest.raises(ContractError, match="same rows"):
        tuning.paired_oof(record, "linear_01", "regularized_01")


def test_search_errors_and_releases(spark, data, monkeypatch):
    rows = data.select("id", "a", "b", "side")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(tuning, "fit_learner", lambda *a, **k: 1 / 0)
    with pytest.raises(ContractError, match="no configuration"):
        tuning.tune(rows, SIDE, "id", ["linear"], 1, folds=2)
    monkeypatch.setattr(tuning, "fit_learner", lambda *a, **k: {}["a fault of the program"])
    with pytest.raises(KeyError):
        tuning.tune(rows, SIDE, "id", ["linear"], 1, folds=2)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    with pytest.raises(ContractError, match="exclude"):
        workflow.guided_fit(data, "wave", model_set="tuned", learners=["linear"], max_models=2, control=tuning.TuningControl(family_budgets={"linear": 1}))


def test_smoothness_is_chosen(spark, data):
    settings = {"k": 10, "gamma": 1.0, "select": True}
    model = fit.fit_learner(data, WAVE, "additive", settings, ["a", "b", "g"])
    free = model.details["freedom"]
    assert free["a"] > 5 and free["b"] < 3 and error(model, data, "wave") < 0.105
    assert fit.fit_learner(data, WAVE, "additive", settings | {"k": 5}, ["a", "b", "g"]).details["freedom"]["a"] < 4.01
    assert fit.fit_learner(data, WAVE, "additive", settings | {"gamma": 4.0}, ["a", "b", "g"]).details["freedom"]["a"] < free["a"]
    noise = data.withColumn("noise", F.sin(F.col("id") * 12.9898) * 43758.5453 % 1)
    assert fit.fit_learner(noise, WAVE, "additive", settings, ["a", "noise"]).details["freedom"]["noise"] < 0.8  # select lets a term vanish
    # The curve is that of its own spline basis, and straight beyond the ends.
    smooth, x = grams.Smooth(0, 7, -1.0, 3.0), np.linspace(-1, 3, 41)
    w = np.random.default_rng(1).normal(size=7)
    points = spark.createDataFrame([(float(v),) for v in [*x, -3.0, -2.0, 4.0, 5.0, 6.0]], "x double")
    got = np.array([r[0] for r in points.select(smooth.expression(F.col("x"), w)).collect()])
    assert np.allclose(got[:41], smooth.basis(x) @ w) and np.isclose(got[45] - got[44], got[44] - got[43]) and np.isclose(got[41] - got[42], got[42] - got[0])
    two = fit.fit_learner(data, SIDE, "additive", settings | {"k": 8}, ["a", "b", "g"])
    loss = two.score(data).select(F.avg(-F.log(F.when(F.col("side") == "yes", F.col("score")).otherwise(1 - F.col("score"))))).first()[0]
    line = fit.fit_learner(data, SIDE, "linear", {}, ["a", "b", "g"]).score(data).select(F.avg(-F.log(F.when(F.col("side") == "yes", F.col("score")).otherwise(1 - F.col("score"))))).first()[0]
    assert loss < line - 0.05 and two.details["freedom"]["a"] > 3 and two.details["scans"] < 15
    with pytest.raises(ContractError):
        fit.fit_learner(data, WAVE, "additive", settings, ["g"])


def test_hinges_and_their_products(data):
    one = fit.fit_learner(data, PRODUCT, "mars", {"degree": 1, "nprune": 20}, ["a", "b"])
    two = fit.fit_learner(data, PRODUCT, "mars", {"degree": 2, "nprune": 20}, ["a", "b"])
    assert error(two, data, "product") < 0.003 < error(one, data, "product")
    assert max(len(t) for t in one.details["terms"]) == 1 and max(len(t) for t in two.details["terms"]) == 2
    small = fit.fit_learner(data, WAVE, "mars", {"degree": 1, "nprune": 3}, ["a", "b", "g"])
    assert small.complexity <= 3 and error(small, data, "wave") > error(fit.fit_learner(data, WAVE, "mars", {"degree": 1, "nprune": 12}, ["a", "b", "g"]), data, "wave")
    side = fit.fit_learner(data, SIDE, "mars", {"degree": 1, "nprune": 8}, ["a", "b"])
    assert 0 < side.score(data).agg(F.min("score")).first()[0] and side.score(data).agg(F.max("score")).first()[0] < 1


def test_interval_sums_equal_products_of_columns(spark):
    from lucidframe.models import mars

    rng = np.random.default_rng(5)
    x = np.round(rng.random((400, 2)), 2)
    y = np.maximum(x[:, 0] - 0.3, 0) * 4 + np.maximum(0.6 - x[:, 1], 0) * np.maximum(x[:, 0] - 0.5, 0) * 9
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double").repartition(3)
    knots = [np.array([0.1, 0.3, 0.5, 0.7]), np.array([0.2, 0.6])]
    found = mars.forward(rows, knots, 2, 9)
    b = mars.columns_of(x, found.terms)
    every = np.column_stack((b, y - y.mean()))
    assert np.allclose(found.gram, every.T @ every, atol=1e-8)
    assert mars.error_of(found.gram, list(range(len(found.terms))))[0] < 1e-6 * len(y)


@pytest.mark.parametrize("order,kernel,task", [(2.0, "rectangular", WAVE), (1.0, "triangular", WAVE), (0.5, "optimal", WAVE), (3.0, "gaussian", SIDE), (2.0, "inv", KIND)])
def test_neighbours_are_exact(data, order, kernel, task, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    some = data.select("id", "a", "b", "wave", "side", "kind")
    some = some.unionByName(some.where("id < 200").withColumn("id", F.lit(-1).cast("long")).withColumn("a", F.lit(0.5)).withColumn("b", F.lit(0.5)))  # a hot point
    model = fit.fit_learner(some, task, "neighbors", {"k": 7, "distance": order, "kernel": kernel}, ["a", "b"])
    rows = model.score(some).withColumn("t", task.label().cast("double")).toPandas()
    z = ((rows[["a", "b"]] - rows[["a", "b"]].mean()) / rows[["a", "b"]].std(ddof=1)).to_numpy()
    d = np.round((np.abs(z[:, None] - z[None]) ** order).sum(axis=2) ** (1 / order if order > 1 else 1), 10)
    t = rows.t.to_numpy()
    for i in range(0, len(rows), 37):
        near = np.lexsort((t, d[i]))[:8]
        scaled = np.clip(d[i][near[:7]] / max(d[i][near[7]], 1e-12), 0, 1 - 1e-6)
        w = fit._weights(kernel, scaled[None], 7)[0]
        w = w / w.sum() if w.sum() > 0 else np.full(7, 1 / 7)
        want = [w[t[near[:7]] == k].sum() for k in range(3)] if task is KIND else w @ t[near[:7]]
        assert np.allclose(rows.score[i], want, atol=1e-9)
    points = some.select("a", "b").distinct().count()
    compared = model.scorer.lookup(some).agg(F.sum("compared")).first()[0]
    assert compared < (0.5 if order >= 1 else 0.6) * points * len(rows)  # powers below 1 bound less
    assert int(model.scorer.cells.rows.sum()) == len(rows) and model.scorer.cells.rows.max() < 100  # equal rows spread over blocks
    model.release()


def test_networks_do_not_depend_on_partitions(data, monkeypatch):
    net = neural.Net(2, 3, 1, REGRESSION, 0.01)
    monkeypatch.setattr(neural, "BLOCK", 300)
    monkeypatch.setattr(neural.minimise, "__defaults__", (12, 15, 1e-9))
    x = F.array("a", "b")
    local = neural.fit(data, x, F.col("wave"), net, 5)[0]
    monkeypatch.setattr(neural, "LOCAL", 0)
    found = [neural.fit(data.repartition(k), x, F.col("wave"), net, 5)[0] for k in (1, 3, 7)]
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[2]) and np.allclose(found[0], local, atol=1e-6)


def test_margin_machines(data):
    settings = {"cost": 4.0, "gamma_multiplier": 1.0, "epsilon": 0.1}
    wave = fit.fit_learner(data, WAVE, "kernel", settings, ["a", "b"])
    wide = fit.fit_learner(data, WAVE, "kernel", settings | {"epsilon": 1.0}, ["a", "b"])
    assert error(wave, data, "wave") < 0.15 < error(wide, data, "wave")
    scaled = data.withColumn("wave", F.col("wave") * 1000 + 5)  # the outcome is standardised
    assert error(fit.fit_learner(scaled, WAVE, "kernel", settings, ["a", "b"]), scaled, "wave") == pytest.approx(1000 * error(wave, data, "wave"), rel=1e-2)
    # On rows that weren't trained on, calibrated probabilities lose less than margins do, as they are or through a plain sigmoid.
    side = fit.fit_learner(data.where("id < 600"), SIDE, "kernel", {"cost": 64.0, "gamma_multiplier": 4.0, "epsilon": 0.1}, ["a", "b"])
    rows = side.score(data.where("id >= 600")).select("score", (F.col("side") == "yes").cast("double").alias("t"), "a", "b").toPandas()
    enc = side.scorer.encoding
    f = side.scorer.machine.margins(side.scorer.weights, np.column_stack([(rows[c] - enc.centre[c]) / enc.scale[c] for c in ("a", "b")]))[:, 0]
    loss = lambda p: -np.mean(rows.t * np.log(p) + (1 - rows.t) * np.log(1 - p))
    found, plain, sigmoid = loss(rows.score.to_numpy()), loss(np.clip((f + 1) / 2, 1e-3, 1 - 1e-3)), loss(1 / (1 + np.exp(-f)))
    assert found < plain and found < sigmoid
    assert abs(rows.score.mean() - rows.t.mean()) < 0.06
    kind = fit.fit_learner(data, KIND, "kernel", settings, ["a", "g"])
    assert kind.score(data).agg(F.avg((F.get("score", F.array_position(F.array(*map(F.lit, "abc")), F.col("kind")).cast("int") - 1) > 0.8).cast("double"))).first()[0] > 0.95


@pytest.mark.parametrize("kind,outputs", [(REGRESSION, 1), (BINARY, 1), (MULTICLASS, 3)])
def test_margin_gradients_are_those_of_the_loss(kind, outputs, monkeypatch):
    from lucidframe.models import margin

    monkeypatch.setattr(margin, "FEATURES", 5)
    rng = np.random.default_rng(2)
    machine = margin.Machine(3, outputs, kind, 2.0, 0.4, 0.3, 7, 0.3, 1.7)
    x, count = rng.normal(size=(20, 3)), rng.integers(1, 4, 20).astype(float)
    y = rng.normal(size=20) if kind == REGRESSION else rng.integers(0, 2 if kind == BINARY else 3, 20).astype(float)
    w, step = rng.normal(size=machine.size), 1e-6
    slopes = [(machine.loss(w + step * e, x, y, count)[0] - machine.loss(w - step * e, x, y, count)[0]) / (2 * step) for e in np.eye(machine.size)]
    assert np.allclose(machine.loss(w, x, y, count)[1:], slopes, rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("kind,outputs", [(REGRESSION, 1), (BINARY, 1), (MULTICLASS, 3)])
def test_gradients_are_those_of_the_loss(kind, outputs):
    rng = np.random.default_rng(2)
    net = neural.Net(3, 4, outputs, kind, 0.0, 0.3, 1.7)
    x, count = rng.normal(size=(20, 3)), rng.integers(1, 4, 20).astype(float)
    y = rng.normal(size=20) if kind == REGRESSION else rng.integers(0, 2 if kind == BINARY else 3, 20).astype(float)
    w = rng.normal(size=net.size)
    found, step = net.loss(w, x, y, count), 1e-6
    slopes = [(net.loss(w + step * e, x, y, count)[0] - net.loss(w - step * e, x, y, count)[0]) / (2 * step) for e in np.eye(net.size)]
    assert np.allclose(found[1:], slopes, rtol=1e-5, atol=1e-6)
    assert np.allclose(found, net.loss(w, np.repeat(x, count.astype(int), axis=0), np.repeat(y, count.astype(int)), np.ones(int(count.sum()))))


def test_networks_learn_waves_and_classes(data):
    wave = fit.fit_learner(data, WAVE, "neural", {"size": 6, "decay": 0.001}, ["a", "b", "g"])
    assert error(wave, data, "wave") < 0.12
    kind = fit.fit_learner(data, KIND, "neural", {"size": 3, "decay": 0.01}, ["a", "g"])
    assert kind.score(data).agg(F.avg((F.get("score", F.array_position(F.array(*map(F.lit, "abc")), F.col("kind")).cast("int") - 1) > 0.9).cast("double"))).first()[0] > 0.95


def test_own_learners_survive_a_round_trip(spark, data, tmp_path):
    settings = {
        "linear": {}, "regularized": {"alpha": 0.5, "path_fraction": 0.5}, "additive": {"k": 5, "gamma": 1.0, "select": True}, "mars": {"degree": 2, "nprune": 6},
        "neighbors": {"k": 3, "distance": 2.0, "kernel": "optimal"}, "neural": {"size": 2, "decay": 0.1}, "kernel": {"cost": 1.0, "gamma_multiplier": 1.0, "epsilon": 0.1},
    }
    some = data.limit(200)
    models = [fit.fit_learner(some, WAVE, f, q, ["a", "b", "g"]) for f, q in settings.items()] + [fit.baseline(some, WAVE), fit.baseline(some, KIND)]
    for i, model in enumerate(models):
        fit.save_fitted(model, str(tmp_path / str(i)))
        again = fit.load_fitted(str(tmp_path / str(i)))
        a, b = ({r.id: r.score for r in m.score(some).collect()} for m in (model, again))
        assert a == b and (again.family, again.parameters, again.features) == (model.family, model.parameters, model.features)
