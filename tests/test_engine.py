import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task, detect_kind, make_task, resolve_metric
from lucidframe.functions.expr import hash_key, hash_rank, tie_blocks
from lucidframe.functions.stats import pareto, t_cdf, t_quantile
from lucidframe.models import fit, registry, tuning
from lucidframe.operators import audit, compare, diagnostics, explain, metrics, prep, selection, split

REG, BIN = Task(REGRESSION, "y"), Task(BINARY, "truth", ("no", "yes"), "yes")


# Functions


def test_student_quantiles():
    assert t_quantile(0.975, 19) == pytest.approx(2.093024054408263, abs=1e-10)
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-7) and t_quantile(0.5, 5) == pytest.approx(0, abs=1e-12)
    assert t_cdf(t_quantile(0.9, 7), 7) == pytest.approx(0.9) and math.isnan(t_quantile(0.9, 0))


def test_hash_rank_is_a_repeatable_bijection(spark):
    rows = spark.range(1000).withColumn("s", F.col("id") % 3).withColumn("key", hash_key(1, "x", F.col("id")))
    a = {r.id: r.r for r in hash_rank(rows, "key", "r", ["s"]).collect()}
    b = {r.id: r.r for r in hash_rank(rows.repartition(13), "key", "r", ["s"]).collect()}
    assert a == b and all(sorted(v for i, v in a.items() if i % 3 == k) == list(range(len([i for i in a if i % 3 == k]))) for k in range(3))


def test_tie_blocks_have_mean_ranks(spark):
    values = [3.0, 1.0, 1.0, 2.0, 2.0, 2.0, 9.0]
    got = {r.v: r.mean_rank for r in tie_blocks(spark.createDataFrame([(v,) for v in values], "v double"), "v", parts=3).collect()}
    assert got == {1.0: 1.5, 2.0: 4.0, 3.0: 6.0, 9.0: 7.0}


# Contract


def test_tasks(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (2, "b", 2.5, False), (1, "c", 3.5, True)], "two int, three string, many double, flag boolean")
    assert [detect_kind(df, c) for c in ("two", "three", "many", "flag")] == [BINARY, MULTICLASS, REGRESSION, BINARY]
    assert make_task(df, "two").positive == "2" and make_task(df, "three").levels == ("a", "b", "c")
    for kind, target in ((BINARY, "three"), (MULTICLASS, "two"), (REGRESSION, "three")):
        with pytest.raises(ContractError):
            make_task(df, target, kind)
    assert resolve_metric(REG) == "rmse" and resolve_metric(BIN, "roc_auc") == "auc"
    with pytest.raises(ContractError):
        resolve_metric(REG, "auc")


# Partitions


def test_holdout_sizes_and_folds(spark):
    df = spark.range(103).withColumn("c", F.when(F.col("id") < 13, "rare").otherwise("common"))
    assert split.holdout(df, "id").where("held_out").count() == 21
    by = {r.c: r.n for r in split.holdout(df, "id", stratum="c").where("held_out").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert by == {"rare": 3, "common": 18}
    sizes = [r["count"] for r in split.folds(df, "id", 5, stratum="c").groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    assert split.folds(df, "id", 50, stratum="c").select("fold").distinct().count() == 13
    assert split.quota(2, 0.2) == 1 and split.quota(25, 0.5) == 12
    with pytest.raises(ContractError):
        split.holdout(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, c string"), "id", stratum="c")


def test_overlap_counts_missing_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (2, "y")], "a int, b string")
    assert split.check_overlap(a, b) == 1 and split.check_overlap(a, b, "ignore") == 0
    with pytest.raises(ContractError):
        split.check_overlap(a, b, "error")


def permutations_of(spark, df, repeats, within="s"):
    """Which row gave its value to which, for each repeat and stratum, as the scorer sees it."""
    seen = []

    def score(d):
        seen.append(d)
        return d.withColumn("score", F.col("x"))

    explain.permutation_scores(df, score, REG, "rmse", {"x": ["x"]}, repeats, within=within).collect()
    found = {}
    for r in seen[0].select("__repeat", "row_id", "x", "s").collect():
        found.setdefault((r["__repeat"], r.s), {})[r.row_id] = int(r.x)
    return found


def test_permutations_are_bijections_and_all_equally_likely(spark):
    rows = [(i, float(i), f"{size}-{i // size}") for size in (2, 3, 4, 5) for i in range(100_000 * size, 100_000 * size + 240 * size)]
    df = spark.createDataFrame(rows, "row_id long, x double, s string").withColumn("y", F.lit(0.0))
    seen = {}
    for (_, stratum), gave in permutations_of(spark, df, 20).items():
        ids = sorted(gave)
        assert sorted(gave.values()) == ids  # within the stratum, each value once
        seen.setdefault(len(ids), []).append(tuple(ids.index(gave[i]) for i in ids))
    for size, found in seen.items():
        every = list(itertools.permutations(range(size)))
        expected = len(found) / len(every)
        chi = sum((found.count(p) - expected) ** 2 / expected for p in every)
        freedom = len(every) - 1
        assert chi < freedom + 4 * (2 * freedom) ** 0.5, (size, chi)
        assert sum(p[0] == 0 for p in found) == pytest.approx(len(found) / size, rel=0.1)  # own values are kept as often as chance has it


def test_large_strata_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(explain, "DEALT", 50)
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("s"), F.lit(0.0).alias("y"))
    found = permutations_of(spark, df, 3)
    assert len(found) == 6 and len({tuple(sorted(m.items())) for m in found.values()}) == 6
    for (_, s), gave in found.items():
        assert sorted(gave.values()) == sorted(gave) == [i for i in range(1000) if str(i % 2) == s]
        assert sum(k == v for k, v in gave.items()) < 50
    again = permutations_of(spark, df.repartition(7), 3)
    assert again == found


def test_small_strata_have_an_honest_spread(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.sin("id").alias("x"), (F.col("id") / 2).cast("int").cast("string").alias("s")).withColumn("y", F.col("x"))
    r = explain.permutation_importance(df, explain.expression_scorer(lambda c: c("x")), REG, "rmse", ["x"], within="s").first()
    assert r.repeats == 20 and r.se > 0 and r.conf_low < r.importance < r.conf_high


# Preparation


TRAIN = [("a", 1.0, 1), ("a", 2.0, 2), ("b", None, 3), (None, 4.0, 4)]


def test_recipe_learns_from_training_only(spark):
    train = spark.createDataFrame(TRAIN, "group string, x double, y int")
    recipe = prep.learn_recipe(train, "y", missing="impute", novel="mode")
    got = recipe.apply(spark.createDataFrame([("a", None, 5), (None, 10.0, 6), ("c", 1.0, 1)], "group string, x double, y int")).collect()
    assert [tuple(r) for r in got] == [("a", 2.0, 5), ("a", 10.0, 6), ("a", 1.0, 1)]
    assert recipe.novel_counts(spark.createDataFrame([("c", 1.0, 1)], "group string, x double, y int")) == {"group": 1}
    strict = prep.learn_recipe(train, "y")
    with pytest.raises(ContractError):
        strict.apply(spark.createDataFrame([("c", 1.0, 1)], "group string, x double, y int"))


def test_recipe_strategies(spark):
    df = spark.createDataFrame([(i, None if i < 6 else 1.0, float(i), str(i % 3), i) for i in range(10)], "id int, hole double, x double, `odd``name` string, y int")
    ready, recipe = prep.prepare(df, "y", missing="drop_columns", remove_ids=True, numeric_like=True)
    assert ready.columns == ["x", "odd`name", "y"] and dict(ready.dtypes)["odd`name"] == "double" and recipe.removed_ids == ("id",)
    assert prep.prepare(df, "y", missing="drop_rows")[0].count() == 4
    levels = {"odd`name": ("2", "1", "0")}
    assert [r[0] for r in prep.prepare(df.limit(3), "y", ordered=levels)[0].select("`odd``name`").collect()] == [3.0, 2.0, 1.0]
    assert prep.constants(df.withColumn("same", F.lit(1)), "y") == ["hole", "same"]
    with pytest.raises(ContractError):
        prep.check_finite(df, "y")


def test_encoding_geometry(spark):
    df = spark.createDataFrame([(1.0, "a", True), (2.0, "b", False), (3.0, "c", True)], "n double, g string, e boolean")
    one = prep.learn_encoding(df, ["g"], "one_hot", standardize=True)
    x = np.array([list(r) for r in one.transform(df).collect()])
    assert all(np.linalg.norm(x[i] - x[j]) == pytest.approx(math.sqrt(2)) for i in range(3) for j in range(i))
    assert prep.learn_encoding(df, ["n", "g", "e"]).names == ["n", "g=b", "g=c", "e"]
    z = prep.learn_encoding(df, ["n"], standardize=True).transform(df).collect()
    assert [r[0] for r in z] == pytest.approx([-1.0, 0.0, 1.0])
    with pytest.raises(ContractError):
        one.check(spark.createDataFrame([(1.0, "new", True)], "n double, g string, e boolean"))


# Metrics and diagnostics


def scored(spark, rows):
    return spark.createDataFrame([(i, int(t), float(p)) for i, (t, p) in enumerate(rows)], "row_id int, y int, score double")


def test_auc(spark):
    assert metrics.auc(scored(spark, [(0, 0.5), (1, 0.5)]), "y", "score").first().roc_auc == 0.5
    one = scored(spark, [(1, 0.2), (1, 0.8)])
    assert metrics.auc(one, "y", "score").first().roc_auc is None
    with pytest.raises(ValueError):
        metrics.auc(one, "y", "score", strict=True)


def test_threshold_fixture(spark):
    r = diagnostics.thresholds(scored(spark, [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)]), at=[0.5], false_negative_cost=2.0).first()
    assert (r.sensitivity, r.specificity, r.precision, r.negative_predictive_value, r.accuracy, r.f1, r.fp, r.fn, r.cost, r.minimum_cost) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 1, 1, 0.75, True)
    grid = diagnostics.thresholds(scored(spark, [(i % 2, i / 100) for i in range(100)])).collect()
    assert [r.sensitivity for r in grid] == sorted((r.sensitivity for r in grid), reverse=True)


def test_calibration_ties_share_a_group(spark):
    got = diagnostics.calibration_groups(scored(spark, [(i % 2, 0.5) for i in range(20)]), "score", "y").collect()
    assert len(got) == 1 and got[0].gap == 0 and got[0].n == 20


def test_missingness_fixture(spark):
    a = spark.range(120).select(F.when(F.col("id") >= 6, 1.0).alias("x"), F.lit(1).alias("y"))
    b = spark.range(60).select(F.when(F.col("id") >= 30, 1.0).alias("x"), F.lit(1).alias("y"))
    r = diagnostics.missingness_shift(a, b, "y").first()
    assert (r.training_rate, r.evaluation_rate, round(r["shift"], 12), r.flagged) == (0.05, 0.5, 0.45, True)


def test_ambiguity_and_distances(spark):
    df = spark.createDataFrame([(1, [0.8, 0.2], [0.5, 0.5], [0.1, 0.9])], "row_id int, a array<double>, b array<double>, c array<double>")
    r = diagnostics.class_ambiguity(df, ["a", "b", "c"], ["n", "y"]).first()
    assert r.max_distance == pytest.approx(0.7) and (r.classes, r.n_classes) == ("n, y", 2)
    assert diagnostics.class_ambiguity(df, ["a"], ["n", "y"]).first().max_distance == 0
    assert diagnostics.near_best({"a": 1.0, "b": 1.04, "c": 1.06}, "rmse", 0.05) == ["a", "b"]
    assert diagnostics.near_best({"a": 0.9, "b": 0.8}, "accuracy", 0.05) == ["a"]


def test_pareto_and_efficiency():
    assert pareto([(1, 2), (2, 1), (1, 2)]) == [True, True, True] and pareto([(1, 1), (2, 2)]) == [True, False]
    models = [{"model_id": "a", "rmse": 1.0, "complexity": 5.0}, {"model_id": "b", "rmse": 2.0, "complexity": 9.0}, {"model_id": "c", "rmse": float("nan"), "complexity": 1.0}]
    assert [(m["model_id"], m["pareto"]) for m in diagnostics.tradeoffs(models, "rmse", "complexity")] == [("a", True), ("b", False)]
    assert [m["efficiency"] for m in diagnostics.weighted_efficiency(models[:2], "rmse", "complexity")] == [1.0, 0.0]


# Explanation


def test_ale_errors_and_grades():
    assert explain.ale_errors([1, 2], [0.25, 0.75]) == pytest.approx([1.5, 0.5])
    assert explain.ale_errors([1, None], [0.5, 0.5]) == [None, None]
    assert [audit.evidence_grade(*a) for a in ((0.5, 1, 2, 0), (0.7, 1, 2, 0), (0.85, 1, 2, 0), (1, 1, 2, 0), (1, -1, 2, 0), (1, 1, 2, 0.6), (1, None, None, 0))] == ["D", "C", "B", "A", "C", "B", "C"]
    assert audit.overall_grade(["A", "B"], False) == "A" and audit.overall_grade(["A", "A"], True) == "C"


def test_ale_of_a_line_is_the_line(spark):
    df = spark.range(6).select(F.col("id").alias("row_id"), (F.col("id") + 1).cast("double").alias("x"), (F.col("id") % 2).alias("z"), F.lit(0.0).alias("y"))
    e = explain.ale(df, explain.expression_scorer(lambda c: 2 * c("x") + c("z")), REG, "x", points=3).frame.collect()
    slopes = [(r.upper - r.lower, r.local) for r in e]
    assert all(local == pytest.approx(2 * width) for width, local in slopes) and sum(r.effect * r.weight for r in e) == pytest.approx(0)


def test_importance_finds_the_used_feature(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.sin("id").alias("x"), F.cos(F.col("id") * 7).alias("noise")).withColumn("y", F.col("x") * 3)
    got = explain.permutation_importance(df, explain.expression_scorer(lambda c: c("x") * 3), REG, "rmse", ["x", "noise"], repeats=4).collect()
    assert got[0].feature == "x" and got[0].conf_low > 0 and got[1].importance == pytest.approx(0, abs=1e-12)
    one = explain.permutation_importance(df, explain.expression_scorer(lambda c: c("x") * 3), REG, "rmse", ["x"], repeats=1).first()
    assert one.se is None and one.conf_low is None


def test_partial_dependence_and_associations(spark):
    df = spark.range(80).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    score = explain.expression_scorer(lambda c: F.when(c("g") == "b", 2.0).otherwise(0.0) + c("x"))
    found = {r.value: r.effect for r in explain.partial_dependence(df, score, REG, "g").frame.collect()}
    assert found["b"] - found["a"] == pytest.approx(2.0)
    with pytest.raises(ContractError):
        explain.ale(df, score, REG, "g")
    same = df.withColumn("twin", F.col("g"))
    assert explain.association(same, "g", "twin").first().association == pytest.approx(1.0)
    assert explain.association(df.withColumn("k", F.lit(1.0)), "x", "k").first().association == 0.0


# Selection


def test_fold_uncertainty_fixture(spark):
    rows = spark.createDataFrame([("a", 1.0, 90), ("a", 3.0, 10)], "configuration_id string, score double, rows int")
    r = selection.fold_uncertainty(rows, "mae").first()
    assert (r.cv_score, r.cv_sd) == pytest.approx((1.2, math.sqrt(2))) and r.cv_se == pytest.approx(math.sqrt(2) / math.sqrt(1 / 0.82))
    r = selection.fold_uncertainty(rows, "rmse").first()
    assert (r.cv_score, r.cv_sd) == pytest.approx((math.sqrt(1.8), math.sqrt(32) / (2 * math.sqrt(1.8))))


def test_one_standard_error_rule():
    base = {"cv_se": 0.1, "plan_order": 0}
    rows = [base | dict(configuration_id="a_simple", family="a", simplicity_rank=1, complexity_proxy=2.0, cv_score=1.05), base | dict(configuration_id="a_big", family="a", simplicity_rank=1, complexity_proxy=9.0, cv_score=1.0), base | dict(configuration_id="b", family="b", simplicity_rank=4, complexity_proxy=1.0, cv_score=0.99)]
    assert selection.one_se(rows)["configuration_id"] == "a_simple"


def test_search_plan_and_seeds():
    plan = tuning.search_plan(7, 200, 4, REG, ["linear", "tree", "neural"])
    assert [c["configuration_id"] for c in plan] == ["linear_01", "tree_01", "neural_01", "tree_02", "neural_02", "tree_03", "neural_03"]
    assert tuning.configuration_seed(123, "linear", {}) == tuning.configuration_seed(123, "linear", {}) < 2**31 - 1
    again = tuning.search_plan(7, 200, 4, REG, ["tree", "linear", "neural"])
    assert {c["configuration_id"]: c["seed"] for c in plan} == {c["configuration_id"]: c["seed"] for c in again}
    for bad in (dict(budget=2), dict(budget=3, grids={"forest": []})):
        with pytest.raises(ContractError):
            tuning.search_plan(bad["budget"], 200, 4, REG, ["linear", "tree", "neural"], grids=bad.get("grids"))
    with pytest.raises(ContractError):
        registry.check_parameters("tree", {"maxdepth": 0, "cp": 0.1, "minsplit": 4})


def test_registry():
    assert registry.portfolio("core", REGRESSION) == ["linear", "tree", "neural"]
    assert "additive" not in registry.portfolio("extended", MULTICLASS) and len(registry.portfolio("extended", BINARY)) == 10
    assert registry.default_budget("extended") == 40 and registry.default_budget("core", ["linear"]) == 5 and len(registry.catalog()) == 10
    for f in registry.FAMILIES.values():
        for kind in f.tasks:
            assert all(registry.check_parameters(f.name, q) == q for q in f.grid(300, 6, kind, 3))


def test_user_models_and_contracts(spark):
    df = spark.createDataFrame([(1.0, "no"), (2.0, "yes")], "x double, truth string")
    m = fit.user_model(lambda d: pd.DataFrame({"no": 1 - d["x"] / 4, "yes": d["x"] / 4}), BIN, ["x"])
    assert [r.score for r in m.score(df).collect()] == [0.25, 0.5]
    with pytest.raises(ContractError):
        fit.check_scores(fit.user_model(lambda d: d["x"] * 9, BIN, ["x"]).score(df), BIN)
    with pytest.raises(ContractError):
        fit.align_probabilities(pd.DataFrame({"a": [1], "b": [2]}), BIN)


def test_comparisons(spark):
    assert compare.rank_correlation([1, 2, 3], [1, 2, 2]) == pytest.approx(0.8660254) and compare.rank_correlation([1, 1], [1, 2]) is None
    df = spark.createDataFrame([(0.1, 0.2), (0.6, 0.4), (0.9, 0.8)], "a double, b double")
    r = compare.prediction_pairs(df, BIN, ["a", "b"]).first()
    assert r.class_disagreement_rate == pytest.approx(1 / 3) and r.max_prediction_distance == pytest.approx(0.2) and r.prediction_rank_correlation == pytest.approx(1.0)
    assert compare.prediction_agreement(df, BIN, ["a", "b"])["ambiguity"] == pytest.approx(1 / 3)
