import pytest

from lucidframe import queries
from lucidframe.models import tuning


def test_tuned_core_searches_the_whole_portfolio(spark, monkeypatch):
    class Called(Exception):
        pass

    def tune(df, task, row_id, learners, budget, *, folds=5, **options):
        raise Called(list(learners), budget, folds)

    monkeypatch.setattr(tuning, "tune", tune)
    with pytest.raises(Called) as e:
        queries.QUERIES["tuned_core"](spark, "/root/testdata/sf0.001")
    assert e.value.args == (["linear", "tree", "neural"], 15, 5)
