"""Registered queries run at the stated sizes, on labels and draws that can be judged."""

import pytest

from siftwell.operators import learning
from siftwell.plans import catalog, q_learning

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


class Stop(Exception):
    pass


@pytest.mark.parametrize("name, runs", [
    ("i06_random_forest", 1), ("i07_gradient_boosting", 1), ("i09_model_comparison", 11), ("i09_best_model", 11), ("i13_all_retrained", 11)])  # beside the stump
def test_models_are_fitted_at_full_size(spark, monkeypatch, name, runs):
    def compare(train, test, dim, asked, models=None):
        models = models or learning.estimators()
        forest, boosted = models["RandomForest"][0], models["GradientBoosting"][0]
        assert (forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter(), boosted.getMaxDepth()) == (200, 20, 200, 8)
        assert len([name for name, _ in asked if name != q_learning.STUMP]) == runs
        raise Stop

    monkeypatch.setattr(learning, "compare", compare)
    monkeypatch.setattr(q_learning, "_results", {})
    with pytest.raises(Stop):
        QUERIES[name](spark, SF)


def test_no_single_feature_decides_the_label(spark):
    train, test = q_learning._splits(spark, SF)
    share = train.selectExpr("avg(label)").first()[0]
    assert 0.1 < share < 0.23  # so rare that oversampling adds rows
    least = q_learning.stump(train, test).first()["optimal_f1"]
    assert least < 0.6
    assert learning.compare(train, test, q_learning.DIM, [("LogisticRegression", False)]).first()["optimal_f1"] > least + 0.15


def test_ten_thousand_resamples(spark):
    per = QUERIES["c15_resample_join_10000"](spark, SF)
    assert per.select("iteration").distinct().count() == 10_000
    assert {r[0] for r in per.groupBy("iteration").sum("n").select("sum(n)").distinct().collect()} == {15 * 5}  # each draw has a rating per criterion
