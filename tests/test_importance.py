"""Permutations of importance reach over whole tables and strata, however many parts these lie in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.contract import REGRESSION, ContractError, Task
from lucidframe.operators import explain

REG = Task(REGRESSION, "y")
NO_SCORE = explain.expression_scorer(lambda c: F.lit(0.0))


def givers(spark, df, repeats, within=None, groups=None):
    """{(feature, repeat): {row: the values dealt to it}} of the columns x and g."""
    seen = []

    def score(d):
        seen.append(d)
        return d.withColumn("score", F.lit(0.0))

    groups = groups or {"x": ["x"]}
    explain.permutation_scores(df, score, REG, "rmse", groups, repeats, within=within).collect()
    found = {}
    for r in seen[0].collect():
        found.setdefault((list(groups)[r["__group"]], r["__repeat"]), {})[r.row_id] = (r.x, r.g)
    return found


def rows(spark, n):
    g = F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id")))
    return spark.range(n).select(F.col("id").alias("row_id"), F.col("id").alias("x"), g.alias("g"), F.when(F.col("id") < n // 2, "a").when(F.col("id") < n - 30, "b").otherwise("c").alias("s"), F.lit(0.0).alias("y"))


@pytest.mark.parametrize("part", [100, 32_768])
def test_any_row_gives_to_any_other(spark, monkeypatch, part):
    monkeypatch.setattr(explain, "PART", part, raising=False)
    df = rows(spark, 1500)
    block = {r: b["__block"] for b in explain.random_blocks(df, ["row_id"], [], 123, "row_id").collect() for r in [x["c0"] for x in b["rows"]]}
    found = givers(spark, df, 20)
    assert len(found) == 20
    own = [gave == row for m in found.values() for row, (gave, _) in m.items()]
    near = [block[gave] == block[row] for m in found.values() for row, (gave, _) in m.items()]
    for m in found.values():
        assert sorted(gave for gave, _ in m.values()) == sorted(m) == list(range(1500))  # each value once
    assert np.mean(near) == pytest.approx(1 / 3, abs=0.03)  # of three blocks of about 512 rows, as chance has it
    assert sum(own) < 20 + 4 * 20**0.5  # one for each permutation, on the average


def test_parts_decide_nothing(spark, monkeypatch):
    df, groups = rows(spark, 1500), {"both": ["x", "g"], "g": ["g"]}
    for within in (None, "s"):
        monkeypatch.setattr(explain, "PART", 100_000)
        whole = givers(spark, df, 3, within, groups)
        monkeypatch.setattr(explain, "PART", 90)
        assert givers(spark, df.repartition(5), 3, within, groups) == whole
        kind = {r.row_id: r.s for r in df.collect()}
        names = {r.row_id: r.g for r in df.collect()}
        for (feature, _), m in whole.items():
            assert len(m) == 1500 and sorted(str(g) for _, g in m.values()) == sorted(map(str, names.values()))
            if feature == "both":
                assert all(g == names[x] and (not within or kind[x] == kind[row]) for row, (x, g) in m.items())
            else:
                assert all(x == row for row, (x, _) in m.items())


def test_rows_of_one_identity_are_all_dealt(spark, monkeypatch):
    monkeypatch.setattr(explain, "PART", 50)
    df = rows(spark, 600).withColumn("row_id", F.col("row_id") % 3)
    found = []
    score = lambda d: found.append(d) or d.withColumn("score", F.lit(0.0))
    explain.permutation_scores(df, score, REG, "rmse", {"x": ["x"]}, 2).collect()
    dealt = found[0].groupBy("__repeat").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()
    assert [r.x for r in dealt] == [list(range(600))] * 2
    assert explain.permutation_scores(df.where("false"), NO_SCORE, REG, "rmse", {"x": ["x"]}, 2).count() == 0


@pytest.mark.parametrize("size", [513, 600, 4242])
def test_ranks_without_sorting_are_those_of_the_orders(size):
    keys, prime = explain.order_keys(["1|x|1|", "1|x|2|", "1|x|3|"], "|0"), explain.order_prime(size)
    orders, ranks = explain.dealt_orders(size, keys, prime), explain.dealt_ranks(np.arange(size), size, prime, keys)
    assert all((o[r] == np.arange(size)).all() for o, r in zip(orders, ranks))


def test_the_modulus_allows_cubes():
    for size in (513, 1024, 60_000, 600_000, explain.PRIME):
        p = explain.order_prime(size)
        assert size <= p < size + 2000 and p % 3 == 2
    assert explain.order_prime(512) == explain.PRIME
    with pytest.raises(ContractError):
        explain.order_prime(explain.PRIME + 1)


def test_scores_of_large_orders_spread_as_chance_has_it():
    """The mean product of a column and a dealt one: over many orders it has the mean and the spread of uniform permutations."""
    n = 3000
    x, y = np.sin(np.arange(n) * 0.7) + (np.arange(n) > 2000), np.log1p(np.arange(n))
    keys = explain.order_keys([f"9|x|{r}|" for r in range(400)], "|0")
    ranks = explain.dealt_ranks(np.arange(n), n, explain.order_prime(n), keys)
    got = np.array([np.corrcoef(x, y[r])[0, 1] for r in ranks]) * (n - 1) ** 0.5
    assert abs(got.mean()) < 4 / 400**0.5 and got.std() == pytest.approx(1, abs=4 / 800**0.5)
