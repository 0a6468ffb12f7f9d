"""Forests against a plain recursion over values, whatever the partitioning and the size of tasks' nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe import queries
from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, ContractError, Task
from lucidframe.models import fit, forest, trees
from lucidframe.operators.prep import learn_encoding

REG, BIN, MULTI = Task(REGRESSION, "y"), Task(BINARY, "side", ("no", "yes"), "yes"), Task(MULTICLASS, "kind", ("p", "q", "r"))
Q = {"num.trees": 6, "mtry": 2, "min.node.size": 5, "sample.fraction": 0.632, "splitrule": "default"}
INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 800
    x = np.round(rng.random((n, 3)), 2)
    y = np.round(4 * (x[:, 0] > 0.4) + np.sin(9 * x[:, 1]) + rng.normal(0, 0.2, n), 3)
    rows = [(i, *map(float, x[i]), float(y[i]), "yes" if y[i] > 2 else "no", "pqr"[int(np.digitize(y[i], [1, 4]))]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, side string, kind string").repartition(3).persist()
    yield df
    df.unpersist()


def planted(df, q=Q, task=REG, seed=7, resample=True):
    y = F.col("y") if task is REG else task.label()
    rows = trees.binned(df, dict(learn_encoding(df, INPUTS).columns()), y, np.zeros(1), local=0)
    try:
        return forest.plant(rows, forest.plan_of(rows, task.kind, len(task.levels), q, seed, resample))
    finally:
        rows.release()


def same(a, b):
    return np.array_equal(a.starts, b.starts) and all(np.array_equal(getattr(a.nodes, k), getattr(b.nodes, k)) for k in ("column", "bin", "left", "value"))


def plain(x, y, least, cuts):
    """What a tree of all rows and columns says of each row, by trying every split of every node."""
    out = np.empty(len(y))
    todo = [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        best, found = 1e-7, None
        whole = len(rows) * y[rows].mean() ** 2
        if len(rows) > least:
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    low = x[rows, j] <= c
                    if low.any() and not low.all():
                        gain = low.sum() * y[rows[low]].mean() ** 2 + (~low).sum() * y[rows[~low]].mean() ** 2 - whole
                        if gain > best + 1e-9:
                            best, found = gain, low
        if found is None:
            out[rows] = y[rows].mean()
        else:
            todo += [rows[found], rows[~found]]
    return out


@pytest.mark.parametrize("least", [5, 40])
def test_a_tree_of_all_rows_equals_plain_recursion(data, least):
    found = planted(data, Q | {"num.trees": 1, "mtry": 3, "min.node.size": least}, resample=False)
    rows = data.toPandas()
    x, y = rows[INPUTS].to_numpy(), rows["y"].to_numpy()
    assert np.allclose(found.predict(x), plain(x, y, least, found.cuts), atol=1e-5)


@pytest.mark.parametrize("rule", ["default", "extratrees"])
@pytest.mark.parametrize("task", [REG, MULTI])
def test_partitions_and_sizes_of_tasks_do_not_show(data, monkeypatch, rule, task):
    q = Q | {"splitrule": rule}
    first = planted(data, q, task)
    assert same(first, planted(data.repartition(7), q, task))
    monkeypatch.setattr(forest, "SMALL", 60)
    monkeypatch.setattr(forest, "PASS", 20_000)  # a few nodes a pass
    monkeypatch.setattr(forest, "SENT", 40_000)  # several jobs
    assert walked(first) == walked(planted(data, q, task))


def walked(found):
    """Trees as nested rules, whatever the order of their nodes."""
    def rule(k):
        p = found.nodes
        return (int(p.column[k]), int(p.bin[k]), rule(p.left[k]), rule(p.left[k] + 1)) if p.column[k] >= 0 else tuple(p.value[k])

    return [rule(s) for s in found.starts]


def test_every_parameter_changes_the_forest(data):
    base = planted(data)
    for other in ({"mtry": 1}, {"min.node.size": 20}, {"sample.fraction": 0.8}, {"splitrule": "extratrees"}):
        assert not same(base, planted(data, Q | other))
    assert not same(base, planted(data, seed=8))
    assert len(planted(data, Q | {"min.node.size": 20}).nodes.column) < len(base.nodes.column)
    assert len(planted(data, Q | {"num.trees": 9}).starts) == 9


def test_no_depth_ends_a_tree(spark):
    df = spark.range(120).select(F.col("id").cast("double").alias("a"), F.expr("CASE WHEN id % 2 = 0 THEN pow(1.2D, id) ELSE -pow(1.2D, id) END").alias("y"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    found = planted(df, Q | {"num.trees": 1, "mtry": 3, "min.node.size": 1}, resample=False)

    def depth(k):
        return 1 + max(depth(found.nodes.left[k]), depth(found.nodes.left[k] + 1)) if found.nodes.column[k] >= 0 else 0

    assert depth(0) > 30


def test_drawn_cuts_lie_between_a_nodes_ends_and_spread():
    edges = np.full((2, trees.BINS), np.inf)
    edges[0, :100], edges[1, :3] = np.arange(100), [0, 1, 90]
    plan = forest.Plan(REGRESSION, 0, 1, 2, 5, 1.0, True, 1, edges, 1.0)
    keys = forest.mixed(np.arange(4000, dtype=np.uint64))
    filled = np.zeros((4000, 2, trees.BINS), bool)
    filled[:, 0, [20, 60]] = True  # cuts 20 to 59
    filled[:, 1, :4] = True  # values near 0 and 1 are nearest to a 60th each
    bins = forest.drawn_bins(plan, keys, np.tile([0, 1], (4000, 1)), filled)
    assert bins[:, 0].min() == 20 and bins[:, 0].max() == 59
    seen = np.bincount(bins[:, 0], minlength=60)[21:59]  # both ends are nearest to half as much
    assert ((seen - 4000 / 39) ** 2 / (4000 / 39)).sum() < 80
    assert (bins[:, 1] == 2).mean() == pytest.approx(0.5, abs=0.05)


def test_weights_are_poisson_and_columns_even():
    plan = forest.Plan(REGRESSION, 0, 1, 2, 5, 0.632, False, 1, np.zeros((5, trees.BINS)), 1.0)
    w = plan.weights(3, 0, np.full(50_000, 2.0))
    assert w.mean() == pytest.approx(1.264, abs=0.02) and w.var() == pytest.approx(1.264, abs=0.04)
    assert not np.array_equal(w, plan.weights(4, 0, np.full(50_000, 2.0)))
    drawn = plan.columns_of(forest.mixed(np.arange(20_000, dtype=np.uint64)))
    assert np.bincount(drawn.ravel()) / 20_000 == pytest.approx(np.full(5, 0.4), abs=0.02)


def test_scores_saves_and_limits(data, tmp_path, monkeypatch):
    for i, task in enumerate((REG, BIN, MULTI)):
        model = fit.fit_learner(data, task, "forest", Q | {"num.trees": 20}, INPUTS)
        scored = model.score(data)
        fit.check_scores(scored, task)
        first = {r.id: r.score for r in scored.select("id", "score").collect()}
        fit.save_fitted(model, str(tmp_path / str(i)))
        again = {r.id: r.score for r in fit.load_fitted(str(tmp_path / str(i))).score(data).select("id", "score").collect()}
        assert first == again
        if task is REG:
            y = {r.id: r.y for r in data.select("id", "y").collect()}
            errors = np.array([first[k] - y[k] for k in y])
            assert np.sqrt((errors**2).mean()) < 0.4 * np.std(list(y.values()))
    monkeypatch.setattr(forest, "MODEL", 1000)
    with pytest.raises(ContractError):
        fit.fit_learner(data, REG, "forest", Q, INPUTS)


def test_very_small_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 5.0), (2.0, 1.0, 0.0, 7.0), (2.0, 1.0, 0.0, 7.0)], "a double, b double, c double, y double")
    scored = fit.fit_learner(df, REG, "forest", Q | {"num.trees": 30}, INPUTS).score(df).collect()
    assert all(5 <= r.score <= 7 for r in scored)


def test_trees_over_few_cells_grow_in_one_job_without_passes(data, monkeypatch):
    first = planted(data)
    with monkeypatch.context() as m:
        m.setattr(forest, "SMALL", 60)  # more cells than that: passes over rows
        passes = planted(data)
    many = data.select((F.round(F.col("a"), 1)).alias("a"), F.lit(0.5).alias("b"), (F.col("c") > 0.5).cast("double").alias("c"), "y")
    with monkeypatch.context() as m:
        m.setattr(forest, "SMALL", 60)  # some 22 cells of 800 rows: no pass, though every root has more rows than SMALL
        m.setattr(forest, "_upper", None)
        m.setattr(forest, "SUMS", 22 * 2 * 8 * 4)  # several jobs
        found = planted(many)
    assert walked(first) == walked(passes)
    assert same(found, planted(many))


@pytest.mark.parametrize("task", [REG, BIN, MULTI])
@pytest.mark.parametrize("small", [65_536, 60])
def test_a_tree_of_all_rows_grows_from_cells(data, monkeypatch, task, small):
    """The same tree as from rows, by a task and by passes; without draws rows aren't grouped, and draws need rows."""
    q, columns = Q | {"num.trees": 1}, dict(learn_encoding(data, INPUTS).columns())
    y, start = F.col("y") if task is REG else task.label(), np.zeros(3 if task is MULTI else 1)
    plan = lambda rows, **more: forest.plan_of(rows, task.kind, len(task.levels), q, 7, **more)
    wanted = planted(data, q, task, resample=False)
    monkeypatch.setattr(forest, "SMALL", small)
    monkeypatch.setattr(trees, "FULL", 50)  # tasks send several times
    rows = trees.celled(data.repartition(5), columns, y, task.kind, start, local=0)
    try:
        assert walked(forest.plant(rows, plan(rows, resample=False))) == walked(wanted)
        with pytest.raises(ContractError):
            forest.plant(rows, plan(rows))
    finally:
        rows.release()


def test_forest_splits_moves_cells_not_rows(spark, tmp_path, monkeypatch):
    """Of 20,000 different rows in 20 cells the tree sees the cells only."""
    rows = spark.range(20_000, numPartitions=4).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "1L AS l_partkey", "1L AS l_suppkey", "double(id % 10) AS l_quantity", "100.0D * (id % 10) + id / 7 AS l_extendedprice",
                                                           "double(id % 4) AS l_discount", "double(id % 2) AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    own, seen = forest.plant, []
    monkeypatch.setattr(trees, "binned", None)
    monkeypatch.setattr(forest, "plant", lambda rows, plan: seen.append((rows.n, rows.distinct)) or own(rows, plan))
    assert queries.QUERIES["forest_splits"](spark, str(tmp_path)).count() == 3
    assert seen == [(20_000.0, 20)]


@pytest.mark.parametrize("kept", [0, 5, 10_000])
def test_cells_are_scored_once(data, monkeypatch, kept):
    monkeypatch.setattr(trees, "KEPT", kept)
    found, rng, asked = planted(data), np.random.default_rng(3), []
    x = np.round(rng.random((400, 3)), 1)

    def scores(bins, rows):
        asked.append(len(bins))
        return found.of_bins(bins)

    score = trees.Remembered(found.cuts, scores)
    for part in (x[:150], x[150:], x):
        assert np.array_equal(score(part), found.predict(part))
    cells = len(np.unique(trees.in_bins(found.cuts, x), axis=0))
    assert sum(asked) == cells if kept == 10_000 else sum(asked) > cells
