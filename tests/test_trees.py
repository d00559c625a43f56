"""Trees grown in tasks: splits against a search of all, models against Spark's, and rows too many for a task."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from siftwell.operators import learning, metrics, trees


def bins(n=300, width=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, trees.BINS, (n, width)).astype(np.uint8)
    return rng, x, (x[:, 0].astype(int) + x[:, 1] + rng.integers(0, 8, n) > 38).astype(np.int64), rng.uniform(0.5, 2, n)


def test_class_split_is_the_best_of_all():
    rng, x, y, w = bins()
    bag = rng.poisson(1.0, len(x)).astype(float)
    feature, cut, child, share = trees.class_tree(x, y, w, bag, 1, 2, 5, rng)

    def impurity(rows):
        a, b = ((w * bag)[rows & (y == k)].sum() for k in (0, 1))
        return 2 * a * b / max(a + b, 1e-300)

    found = {(f, c): impurity(x[:, f] <= c) + impurity(x[:, f] > c) for f in range(5) for c in range(trees.BINS - 1)
             if min(bag[x[:, f] <= c].sum(), bag[x[:, f] > c].sum()) >= 2}
    assert found[feature[0], cut[0]] == pytest.approx(min(found.values()))
    right = x[:, feature[0]] > cut[0]
    assert share[child[0] + 1] == pytest.approx((w * bag)[right & (y == 1)].sum() / (w * bag)[right].sum())


def test_full_class_tree_knows_its_rows_and_merges_equal_leaves():
    rng, x, y, w = bins()
    feature, cut, child, share = trees.class_tree(x, y, w, np.ones(len(x)), 20, 1, 5, rng)
    assert ((share[trees._descend(x, feature, cut, child)] > 0.5) == (y == 1)).all()
    inner = np.flatnonzero(feature >= 0)
    ends = inner[(feature[child[inner]] < 0) & (feature[child[inner] + 1] < 0)]
    assert ((share[child[ends]] > 0.5) != (share[child[ends] + 1] > 0.5)).all()


def test_value_tree_counts_the_larger_child_by_difference():
    """Each leaf's value is the weighted mean of its rows, and no split of a level gains more than the one taken."""
    rng, x, y, w = bins()
    target, rows = rng.normal(size=len(x)), np.arange(0, len(x), 2)
    feature, cut, child, value = trees.value_tree(np.ascontiguousarray(x.T), target, w, rows, 3, 5, rng)
    members = {0: rows}
    for node in range(len(feature)):
        r = members[node]
        assert value[node] == pytest.approx(np.average(target[r], weights=w[r]))
        if feature[node] < 0:
            continue
        right = x[r, feature[node]] > cut[node]
        members[child[node]], members[child[node] + 1] = r[~right], r[right]

        def loss(part):
            return (w[part] * (target[part] - np.average(target[part], weights=w[part])) ** 2).sum() if len(part) else np.inf

        best = min(loss(r[x[r, f] <= c]) + loss(r[x[r, f] > c]) for f in range(5) for c in range(trees.BINS - 1))
        assert loss(r[~right]) + loss(r[right]) == pytest.approx(best)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=900) / 2 > 0.7).astype(int)
    rows = [(f"u{i}", int(t), [float(v) for v in e]) for i, (e, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "uid string, label int, embedding array<double>").repartition(3)
    number = F.substring("uid", 2, 9).cast("int")
    return learning.class_weights(df.filter(number < 600)), df.filter(number >= 600)


@pytest.mark.parametrize("name", ["RandomForest", "RandomForest_Subsample", "GradientBoosting"])
def test_models_rank_as_those_of_spark(spark, labelled, name, monkeypatch):
    """Nothing is fitted by Spark, whose models live on the driver, and scores are as good and as large as its own."""
    fit, held = labelled
    estimator = learning.estimators(trees=40, depth=8, rounds=20, boost_depth=3)[name][0]
    model = learning.without_summary(estimator.fit(learning.with_features(fit)))
    old = model.transform(learning.with_features(held)).select("uid", "label", learning.vector_to_array("probability")[1].alias("pred_proba"))
    a = metrics.evaluate(old).first()
    for kind in (RandomForestClassifier, GBTClassifier):
        monkeypatch.setattr(kind, "_fit", lambda *_: pytest.fail("fitted on the driver"))
    new = learning.predictions(estimator, fit, held)
    assert new.columns == old.columns and new.count() == 300 and new.join(held, ["uid", "label"]).count() == 300
    b = metrics.evaluate(new).first()
    assert abs(a.roc_auc - b.roc_auc) < 0.03 and abs(a.optimal_f1 - b.optimal_f1) < 0.06
    apart = old.join(new.withColumnRenamed("pred_proba", "p"), "uid").select(F.corr("p", "pred_proba"), F.avg(F.abs(F.col("p") - F.col("pred_proba")))).first()
    assert apart[0] > 0.9 and apart[1] < 0.1
    assert sorted(learning.predictions(estimator, fit, held).collect()) == sorted(new.collect())


def test_rows_too_many_for_a_task_are_fitted_in_parts(spark, labelled, monkeypatch):
    fit, held = labelled
    estimator = learning.estimators(trees=12, depth=6)["RandomForest"][0]
    made, real = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: (made.append(self.getNumTrees()), real(self, rows))[1])
    monkeypatch.setattr(trees, "fits_task", lambda rows, width: False)
    monkeypatch.setattr(trees.forest_in_parts, "__defaults__", (600 * 5,))
    found = metrics.evaluate(learning.predictions(estimator, fit, held)).first()
    assert made == [5, 5, 2] and found.roc_auc > 0.8
