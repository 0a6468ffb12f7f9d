"""Searches and scores that share their passes say what each says alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task
from lucidframe.models import fit, neural, trees, tuning
from lucidframe.operators import explain

BIN = Task(BINARY, "side", ("no", "yes"), "yes")
CELL_TASKS = [Task(REGRESSION, "y"), Task(BINARY, "y", ("no", "yes"), "yes"), Task(MULTICLASS, "y", ("p", "q", "r"))]


def rows(spark):
    df = spark.range(240).select(F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 50.0).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(89)) / 50.0).alias("b"))
    return df.withColumn("side", F.when(F.col("a") + F.col("b") * F.col("b") > 2, "yes").otherwise("no"))


def test_nets_fitted_together_equal_nets_fitted_alone(spark, monkeypatch):
    df, x, y = rows(spark), F.array("a", "b"), BIN.label()
    nets = [(neural.Net(2, h, 1, BINARY, d), s) for h, d, s in ((1, 0.1, 3), (3, 0.01, 4), (2, 0.03, 5))]
    monkeypatch.setattr(neural.minimise, "__defaults__", (12, 9, 1e-9))
    passes, asked = [], neural.Source.sums
    monkeypatch.setattr(neural.Source, "sums", lambda self, part, size: passes.append(size) or asked(self, part, size))
    together = neural.fit_several(df, x, y, nets)
    assert len(passes) <= 9
    for (net, seed), (w, about) in zip(nets, together):
        alone, said = neural.fit(df, x, y, net, seed)
        assert np.array_equal(w, alone) and about == said
    monkeypatch.setattr(neural, "LOCAL", 0)
    assert np.array_equal(neural.fit_several(df.repartition(5), x, y, nets[:2])[1][0], together[1][0])


def test_a_search_bins_rows_and_fits_nets_once_a_fold(spark, monkeypatch):
    calls = {"binned": 0, "fit_several": 0, "evaluate": 0}

    def counted(module, name):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.__setitem__(name, calls[name] + 1) or own(*a, **k))

    counted(fit.trees, "binned")
    counted(neural, "fit_several")
    counted(fit.metrics, "evaluate")
    monkeypatch.setattr(neural.minimise, "__defaults__", (12, 9, 1e-9))
    record = tuning.tune(rows(spark), BIN, "row_id", ["tree", "neural"], 6, folds=2)
    assert calls == {"binned": 2, "fit_several": 2, "evaluate": 0}
    assert all(c["cv_score"] is not None for c in record.candidates)
    assert record.oof.count() == 6 * 240
    loss = {r[0]: r[1] for r in record.oof.groupBy("configuration_id").agg(F.avg("loss")).collect()}
    assert all(abs(loss[c["configuration_id"]] - c["cv_score"]) < 1e-2 * c["cv_score"] for c in record.candidates)  # probabilities of 0 are clamped on one side or the other


def test_checked_loss_refuses_what_is_no_probability(spark):
    scored = rows(spark).select(BIN.label().cast("int").alias("y"), F.lit(1.5).alias("score"))
    try:
        fit.checked_loss(scored, BIN, "log_loss")
    except ContractError:
        return
    raise AssertionError("a score of 1.5 was taken")


@pytest.mark.parametrize("task", ["regression", "binary", "multiclass"])
def test_boosting_on_cells_equals_boosting_on_rows(spark, monkeypatch, task):
    df = spark.range(500).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(7)) / 7.0).alias(n) for k, n in enumerate("ab")], F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)).alias("r"))
    y = {"regression": F.col("a") + F.col("r") / 1000, "binary": (F.col("r") > 600).cast("int"), "multiclass": (F.col("r") % 3).cast("int")}[task]
    start, q = np.zeros(3 if task == "multiclass" else 1), {"nrounds": 4, "eta": 0.3, "max_depth": 3, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0}
    columns = {n: F.col(n) for n in "ab"}
    plain = trees._boosted(trees.binned(df, columns, y, start), task, start, q, 3)
    passes, own = [], trees.Rows.sums
    monkeypatch.setattr(trees.Rows, "sums", lambda self, part: passes.append((self.distinct, self.cells)) or own(self, part))
    for local in (None, 0):  # rows held on the driver, or in Spark
        found = trees.boost(trees.binned(df, columns, y, start, local), task, start, q, 3)
        assert [[(t.column, t.bin) for t in r] for r in found.rounds] == [[(t.column, t.bin) for t in r] for r in plain.rounds]
        assert np.allclose([v for r in found.rounds for t in r for v in t.value], [v for r in plain.rounds for t in r for v in t.value], atol=1e-6)
    assert set(passes) == {(49, True)}


@pytest.mark.parametrize("task", CELL_TASKS)
def test_boosting_of_all_rows_reads_cells_and_groups_no_rows(spark, monkeypatch, task):
    df = spark.range(500).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(7)) / 7.0).alias(n) for k, n in enumerate("ab")], F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)).alias("r"))
    df = df.withColumn("y", F.col("a") + F.col("r") / 1000 if task.kind == REGRESSION else F.element_at(F.array(*map(F.lit, task.levels)), (1 + F.col("r") % len(task.levels)).cast("int")))
    q = {"nrounds": 4, "eta": 0.3, "max_depth": 3, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0}
    rows, cells = trees.binned, trees.celled
    with monkeypatch.context() as m:  # from rows
        m.setattr(trees, "celled", lambda df, columns, y, kind, start: rows(df, columns, y, start))
        wanted = fit.fit_learner(df, task, "boosting", q, ["a", "b"]).scorer.state()
    monkeypatch.setattr(trees, "binned", None)
    monkeypatch.setattr(trees, "FULL", 20)
    for local in (None, 0):  # cells held on the driver, or in Spark
        monkeypatch.setattr(trees, "celled", lambda *a, local=local: cells(*a, local=local))
        assert fit.fit_learner(df, task, "boosting", q, ["a", "b"]).scorer.state() == wanted


def test_orders_are_those_of_the_cubes():
    keys = np.array([[5, 2**28 - 1, 77], [123, 4, 2**27]], np.uint64)
    for row, order in zip(keys.tolist(), explain.dealt_orders(300, keys)):
        x = [row[0] + i for i in range(300)]
        for key in (*row[1:], 0):
            x = [v**3 % explain.PRIME + key for v in x]
        assert order.tolist() == sorted(range(300), key=x.__getitem__)


def test_no_shuffle_by_stratum(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), "id", F.when(F.col("id") < 1600, "a").when(F.col("id") < 2300, "b").when(F.col("id") < 2900, "c").otherwise("d").alias("__stratum"))

    def dealt():
        blocks = explain.random_blocks(df, ["id"], ["__stratum"], 1, "row_id")
        return blocks, {(r["__stratum"], r["__block"]): [x["c0"] for x in r["rows"]] for r in blocks.collect()}

    blocks, found = dealt()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("hashpartitioning(") == plan.count("hashpartitioning(__stratum") and "hashpartitioning(__stratum#" in plan
    assert "__block" in plan[plan.index("hashpartitioning(__stratum") :].split("\n")[0]
    assert len({b for s, b in found if s == "a"}) == 4 and len({b for s, b in found if s == "d"}) == 1
    monkeypatch.setattr(explain, "LARGE", 1)  # some large strata meet their blocks by a join
    assert dealt()[1] == found
