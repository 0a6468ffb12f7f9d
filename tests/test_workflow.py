from pyspark.sql import functions as F
import json

import numpy as np
import pytest

from lucidframe.contract import ContractError, make_task
from lucidframe.models.fit import check_scores, fit_learner
from lucidframe.models.registry import FAMILIES
from lucidframe.operators import audit, explain
from lucidframe.plans import compare, workflow
from lucidframe.report import html, narrative, plots


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        x, z = rng.standard_normal(2)
        g = "abc"[i % 3]
        rows.append((float(x), None if i % 20 == 3 else float(z), g, float(3 * x + (g == "b") + rng.normal(0, 0.2)), "yes" if x + rng.normal(0, 0.4) > 0 else "no", 1))
    return spark.createDataFrame(rows, "x double, z double, g string, y double, event string, same int").persist()


@pytest.fixture(scope="module")
def result(data):
    return workflow.guided_fit(data.drop("event"), "y", model_set="comparison")


def test_quick_fit_beats_the_baseline(result):
    board = {r.model_id: r for r in result.leaderboard.collect()}
    assert board["main_model"]["rank"] == 1 and board["main_model"].improvement > 0.8 and board["baseline"].improvement == 0
    assert result.evaluation.count() == 32 and {n["code"] for n in result.notes} == {"small_evaluation_set", "constant_inputs_removed"}
    assert "same" not in result.model().features and result.role == "test"
    assert result.predictions().count() == 32 and result.diagnostics().first().median_absolute_error < 0.5
    with pytest.raises(ContractError):
        result.model("nobody")


def test_results_can_be_compared(result):
    found = compare.compare_behavior(result)
    assert len(found.models) == 3 and found.pairs.count() == 3 and found.contrast is not None
    effects = compare.compare_effects(result, "x", points=6)
    assert effects.pairs.count() == 3 and not effects.failures
    assert result.ambiguity()[1].first().max_range > 0 and result.tradeoffs(include_baseline=True)[0]["pareto"]


def test_audit_report_and_memo(result, tmp_path):
    found = audit.audit_explanations(result.explainers(["main_model", "flexible_tree"]), ["x", "z"], repeats=3)
    top = [r for r in found.importance if r["feature"] == "x"]
    assert all(r["evidence_grade"] in "AB" for r in top) and "low_monte_carlo_budget" in {f["code"] for f in found.findings}
    memo = narrative.narrate(result)
    assert memo == narrative.narrate(result) and "## Against the constant prediction" in memo and "## Limits" in memo
    path = html.model_report(result, str(tmp_path / "deep" / "report.html"), {"audit": found, "effects": []}, memo)
    text = open(path).read()
    assert text.startswith("<!doctype html>") and "Scores on the held rows" in text and "<script" not in text
    assert "Grade and counts" in html.evidence_report_html(found, narrative.narrate(found)) and "main_model" in html.metadata_report_html(result)
    assert plots.agreement_cells(found.agreement)


def test_foreign_audits_are_refused(result):
    names = ["main_model", "flexible_tree"]
    explainers = result.explainers(names)
    assert explainers[0].fingerprint == result.explainers(names)[0].fingerprint != explainers[1].fingerprint
    own = audit.audit_explanations(explainers, ["x", "z"], repeats=2)
    assert compare.compare_behavior(result, names, audit=own).reliance["top"]
    fewer = [type(e)(e.model, e.data.where("x > -10 AND row_id > 3"), e.task, e.role) for e in explainers]
    with pytest.raises(ContractError, match="other rows"):
        compare.compare_behavior(result, names, audit=audit.audit_explanations(fewer, ["x", "z"], repeats=2))


def test_digests_ignore_order_and_see_every_change(spark):
    from lucidframe.functions.expr import frame_digest

    rows = [(i, None if i % 3 else float(i), "ab"[i % 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, x double, s string")
    same = frame_digest(df.orderBy(F.desc("i")).repartition(3).select("s", "x", "i"))
    assert same == frame_digest(df)
    changed = [df.where("i > 0"), df.unionByName(df.where("i = 1")), df.withColumn("x", F.coalesce("x", F.lit(0.0))), df.withColumnRenamed("s", "t"), df.withColumn("i", F.col("i").cast("int"))]
    assert len({same, *map(frame_digest, changed)}) == 6 and frame_digest(df.limit(0)) != same


def test_dashboards_and_rebinding(result, data, tmp_path):
    paths = [html.dashboard(result, str(tmp_path / "a.html"), 1, 2, 2), html.simple_dashboard(result, str(tmp_path / "b.html"), 1, 2)]
    for path in paths:
        text = open(path).read()
        assert text.startswith("<!doctype html>") and "main_model" in text
    rows, role = result.rebind(data.drop("event").limit(10))
    assert rows.count() == 10 and role == "user-supplied" and set(result.model().features) <= set(rows.columns)
    again = result.explainers(["main_model"], data.drop("event").limit(10))[0]
    assert again.predict(again.data).where("score IS NULL").count() == 0 and again.fingerprint != result.explainers(["main_model"])[0].fingerprint


def test_binary_result(data):
    r = workflow.guided_fit(data.drop("y"), "event")
    assert r.task.positive == "yes" and r.calibration().count() <= 5 and r.thresholds().count() == 17
    assert r.subgroups("g", min_rows=5).count() == 3
    evaluation = r.explainers()[0]
    curve = explain.explain_effect(evaluation.data, evaluation.predict, r.task, "x", points=4).frame.collect()
    assert curve[-1].effect > curve[0].effect


def test_tuning_keeps_to_training_rows(data):
    r = workflow.guided_fit(data.drop("event"), "y", model_set="tuned", learners=["linear", "tree"], max_models=3, folds=3)
    t = r.tuning
    assert t.selected == "linear_01" == t.final and t.refit["status"] == "ok"
    assert t.oof.count() == 3 * r.raw_training.count() and t.oof.select("configuration_id", "row_id").distinct().count() == t.oof.count()
    held = {x.row_id for x in r.raw_evaluation.collect()}
    assert not held & {x.row_id for x in t.oof.select("row_id").collect()}


@pytest.mark.parametrize("target", ["y", "event", "g"])
def test_every_family_keeps_the_contract(data, target):
    df = data.select("x", "y", "event", "g").limit(90)
    task = make_task(df, target)
    features = [c for c in df.columns if c != target]
    small = {"num.trees": 5, "mtry": 2}
    for name, family in FAMILIES.items():
        if task.kind in family.tasks:
            q = family.grid(90, 4, task.kind, 3)[0]
            q = q | ({k: v for k, v in small.items() if k in q} if name == "forest" else {"nrounds": 3} if name == "boosting" else {})
            model = fit_learner(df, task, name, q, features)
            scored = model.score(df)
            check_scores(scored, task)
            assert scored.count() == 90 and model.complexity is not None


def test_rejections(spark, data):
    with pytest.raises(ContractError):
        workflow.guided_fit(data, "nothing")
    with pytest.raises(ContractError):
        workflow.guided_fit(spark.sql("SELECT id AS y, array(id) AS a FROM range(20)"), "y")
    with pytest.raises(ContractError):
        workflow.guided_fit(data.limit(5), "y")


def test_overlapping_evaluation_rows_are_noted(data):
    r = workflow.guided_fit(data.drop("event"), "y", test=data.drop("event").limit(20))
    assert "evaluation_overlap" in {n["code"] for n in r.notes} and r.role == "evaluation"


GOOD = {"headline": "h", "performance": "p", "patterns": ["a"], "cautions": ["b"], "next_steps": ["c"]}


def test_structured_narratives():
    assert narrative.parse("```json\n" + json.dumps(GOOD) + "\n```") == GOOD
    bad = ["no json", json.dumps({**GOOD, "more": 1}), json.dumps({**GOOD, "patterns": []}), '{"headline": "a", ' + json.dumps(GOOD)[1:], json.dumps({**GOOD, "performance": "w " * 501})]
    for text in bad:
        with pytest.raises(ContractError):
            narrative.parse(text)
    seen = []

    def transport(request):
        seen.append(request)
        return {"choices": [{"message": {"content": json.dumps(GOOD)}}]}

    out = narrative.narrate({"kind": "audit", "models": 1}, "groq", transport, key="k")
    assert "## Next" in out and seen[0]["headers"]["Authorization"] == "Bearer k" and seen[0]["body"]["response_format"]["type"] == "json_schema"
    for options in ({"name": "custom", "endpoint": "http://example.org", "model": "m"}, {"name": "groq", "key": ""}, {"name": "who"}):
        with pytest.raises(ContractError):
            narrative.resolve(**options)
    assert narrative.resolve("ollama").remote is False


def test_fits_survive_a_round_trip(data, tmp_path):
    from lucidframe.models.fit import load_fitted, save_fitted

    df = data.select("x", "g", "y")
    model = fit_learner(df, make_task(df, "y"), "tree", {"maxdepth": 3, "cp": 0.0, "minsplit": 4}, ["x", "g"])
    save_fitted(model, str(tmp_path / "fit"))
    again = load_fitted(str(tmp_path / "fit"))
    assert [r.score for r in model.score(df).collect()] == [r.score for r in again.score(df).collect()] and again.task == model.task


def test_an_outside_engine_keeps_its_own_leaderboard(data):
    def provider(training, task, features):
        return [fit_learner(training, task, "linear", {}, features, model_id="theirs")], ["theirs"]

    r = workflow.guided_fit(data.drop("event"), "y", provider=provider)
    assert [m.model_id for m in r.models] == ["main_model", "baseline"] and r.extra["engine_leaderboard"] == ["theirs"]


def test_scoring_refuses_new_levels_and_changed_types(spark):
    from lucidframe.contract import BINARY, REGRESSION, ContractError, Task
    from lucidframe.models import fit

    rows = spark.createDataFrame([(float(i), "ab"[i % 2], 2.0 * i + (i % 2)) for i in range(40)], "x double, g string, y double")
    for family, parameters in (("linear", {}), ("tree", {"maxdepth": 3, "cp": 0.0, "minsplit": 4}), ("kernel", {"cost": 1.0, "gamma_multiplier": 1.0, "epsilon": 0.1})):
        model = fit.fit_learner(rows, Task(REGRESSION, "y"), family, parameters, ["x", "g"])
        assert model.score(rows).count() == 40
        new = spark.createDataFrame([(1.0, "zzz", 0.0)], "x double, g string, y double")
        with pytest.raises(Exception, match="weren't learned"):
            model.score(new).select("score").collect()
        with pytest.raises(ContractError, match="categorical"):
            model.score(spark.createDataFrame([(1.0, 3.0, 0.0)], "x double, g double, y double")).select("score").collect()


def test_supplied_folds_are_no_predictor_and_the_tuned_metric_ranks(spark):
    from lucidframe.contract import ContractError
    from lucidframe.models.tuning import TuningControl
    from lucidframe.plans import compare, workflow

    make = lambda lo, n: spark.createDataFrame([(i, float(i % 17), "ab"[i % 2], 3.0 * (i % 17) + (i % 2) + (i % 5) / 10, i % 3) for i in range(lo, lo + n)], "k int, x double, g string, y double, part int")
    control = TuningControl(fold_column="part", metric="mae")
    training, test = make(0, 90).drop("k"), make(1000, 40).drop("k", "part").withColumn("x", F.col("x") + 0.01)
    result = workflow.guided_fit(training, "y", test=test, model_set="tuned", learners=["linear", "tree"], max_models=3, control=control)
    assert "part" not in result.model().features and "part" not in result.recipe.columns and result.tuning.folds == 3
    assert result.metric == "mae"
    board = result.leaderboard.collect()
    assert [r["mae"] for r in board] == sorted(r["mae"] for r in board) and board[0]["rank"] == 1
    behavior = compare.compare_behavior(result, ["main_model", "baseline"])
    assert {m["family"] for m in behavior.models} >= {"baseline"} and all("mae" in m for m in behavior.models)
    with pytest.raises(ContractError, match="test rows"):
        workflow.guided_fit(training, "y", model_set="tuned", learners=["linear"], control=control)
    with pytest.raises(ContractError, match="tuned"):
        workflow.guided_fit(training, "y", test=test, control=control)


def test_effects_of_several_features_and_their_errors(spark):
    from lucidframe.contract import REGRESSION, Task
    from lucidframe.operators import explain

    rows = spark.createDataFrame([(str(i), float(i), float(i % 2), 0.0) for i in range(1, 7)], "row_id string, x double, z double, y double")
    score = explain.expression_scorer(lambda c: 2 * c("x") + c("z"))
    effect = explain.ale(rows, score, Task(REGRESSION, "y"), "x", points=5)
    assert all(r["se"] is None and r["conf_low"] is None for r in effect.frame.collect())  # a bin of one row has no error
    found = explain.partial_dependences(rows, score, Task(REGRESSION, "y"), ["z", "x"], points=3)
    assert list(found) == ["z", "x"]
    wide = spark.createDataFrame([(str(i), float(i % 50), float(i % 7), 0.0) for i in range(400)], "row_id string, x double, z double, y double")
    bands = explain.ale(wide, explain.expression_scorer(lambda c: c("x") * c("z")), Task(REGRESSION, "y"), "x", points=4).frame.collect()
    assert all(r["conf_low"] < r["effect"] < r["conf_high"] for r in bands)


def test_order_statistics_are_exact(spark):
    import numpy as np

    from lucidframe.functions import expr

    rng = np.random.default_rng(3)
    columns = {"flat": [1.0] * 3000, "ties": rng.integers(0, 4, 3000).astype(float).tolist(), "fine": rng.standard_normal(3000).tolist(), "none": [None] * 3000, "holes": [None if i % 3 else float(i) for i in range(3000)]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    for picked in (1_000_000, 0):  # in one pass, or by brackets within brackets
        expr.PICKED, kept = picked, expr.PICKED
        try:
            got = expr.order_statistics(df, {c: F.col(c) for c in columns}, probs)
        finally:
            expr.PICKED = kept
        assert got["none"] == [None] * len(probs)
        for c in ("flat", "ties", "fine", "holes"):
            assert np.allclose(got[c], np.quantile([x for x in columns[c] if x is not None], probs))
