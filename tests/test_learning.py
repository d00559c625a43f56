"""Models against plain computations: the penalty, the kernel machine, its probabilities, and shared training tables."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Observation, functions as F

from siftwell.operators import kernel, learning, metrics


def frame(spark, x, y):
    rows = [(f"u{i}", int(t), [float(v) for v in e]) for i, (e, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "uid string, label int, embedding array<double>").coalesce(2)


@pytest.fixture(scope="module")
def rings():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    return x, ((x**2).sum(1) < 1.2).astype(int)


def test_standardise_by_one_aggregate(spark):
    x = np.array([[1.0, 5.0, 2.0], [2.0, 5.0, 4.0], [6.0, 5.0, 9.0]])
    df = frame(spark, x, [0, 1, 0])
    got = np.array([r.embedding for r in learning.standardise(df).orderBy("uid").collect()])
    sd = x.std(0)
    np.testing.assert_allclose(got, (x - x.mean(0)) / np.where(sd > 0, sd, 1), atol=1e-12)
    one = learning.standardise(df.limit(1)).first().embedding
    assert one == [0.0, 0.0, 0.0]


def test_penalty_of_logistic_regression_is_one_over_n(spark):
    """Minimise |w|^2 / 2 + sum of weighted losses, by Newton steps."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0.8).astype(int)
    weighted = learning.class_weights(frame(spark, x, y))
    model = learning.penalised(learning.estimators()["LogisticRegression"][0], 120).fit(learning.with_features(weighted))
    c = np.array([r.weight for r in weighted.orderBy(F.substring("uid", 2, 9).cast("int")).collect()])
    a, w = np.hstack([x, np.ones((120, 1))]), np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (c * p * (1 - p))[:, None]) + ridge, a.T @ (c * (p - y)) + ridge @ w)
    np.testing.assert_allclose([*model.coefficients, model.intercept], w, atol=2e-3)
    assert learning.penalised(LogisticRegression(), 50).getRegParam() == 0.02


def test_all_rows_as_landmarks_give_the_kernel_itself(spark, rings):
    x, y = rings
    df = frame(spark, x[:60], y[:60])
    fitted = kernel.NystroemMap.fit(df, 100, 0.5)
    lifted = {r.uid: np.array(r.z) for r in df.select("uid", fitted.lift(F.col("embedding")).alias("z")).collect()}
    z = np.array([lifted[f"u{i}"] for i in range(60)])
    np.testing.assert_allclose(z @ z.T, kernel.rbf(x[:60], x[:60], 0.5), atol=1e-4)
    few = kernel.NystroemMap.fit(df, 10, 0.5)
    assert few.landmarks.shape == (10, 2) and few.root.shape[1] <= 10


def test_kernel_machine_separates_rings_and_is_calibrated(spark, rings):
    x, y = rings
    df = learning.class_weights(frame(spark, x, y))
    train, test = df.filter(F.substring("uid", 2, 9).cast("int") < 300), df.filter(F.substring("uid", 2, 9).cast("int") >= 300)
    scored = kernel.RbfSvm(gamma=0.5, landmarks=200).fit(train).transform(test)
    found = metrics.evaluate(scored).first()
    assert found.roc_auc > 0.95 and found.accuracy > 0.88
    shares = scored.groupBy((F.col("pred_proba") > 0.5).alias("k")).agg(F.avg("pred_proba").alias("p"), F.avg("label").alias("y")).collect()
    assert all(abs(r.p - r.y) < 0.15 for r in shares)


def test_platt_targets(spark):
    """The sigmoid of separable decisions stays finite, because targets are not 0 and 1."""
    rows = [(1, 2.0)] * 8 + [(0, -2.0)] * 8
    slope, offset = kernel.platt([spark.createDataFrame(rows, "label int, decision double")])
    assert abs(1 / (1 + np.exp(-(2 * slope + offset))) - 9 / 10) < 1e-3 and abs(offset) < 1e-3
    assert kernel.platt([]) == (1.0, 0.0)


def test_one_class_folds_are_left_out(spark):
    x = np.random.default_rng(0).normal(size=(30, 2))
    y = [1] + [0] * 29
    scored = kernel.RbfSvm().fit(learning.class_weights(frame(spark, x, y))).transform(frame(spark, x, y))
    assert scored.filter(F.col("pred_proba").between(0, 1)).count() == 30


def test_runs_share_tables_and_keep_their_names(spark, rings, monkeypatch):
    x, y = rings
    made = []
    real = learning.stored
    monkeypatch.setattr(learning, "stored", lambda df, name: (made.append(name), real(df, name))[1])
    df = frame(spark, np.hstack([x, x + 1]), y)
    models = {n: (learning.estimators(trees=5, depth=4, rounds=2, boost_depth=2)[n]) for n in learning.MODEL_NAMES if n != "SVM_RBF"}
    runs = [(n, s) for n in models for s in (False, True)]
    out = learning.compare(df, df, 4, runs, models)
    assert {r.model for r in out.collect()} == {learning.run_name(*r) for r in runs}
    assert sorted(made) == ["fit"] * 4 + ["test", "test-scaled", "train", "train-scaled"]
    best = learning.best_model(out).first()
    assert best.f1 == out.agg(F.max("f1")).first()[0]


def test_one_pass_metrics_equal_the_single_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(rng.integers(0, 2)) if g != "one" else 1, None if rng.random() < 0.05 else float(rng.integers(0, 12)) / 11) for g in ("a", "b", "one") for _ in range(150)]
    df = spark.createDataFrame(rows, "model string, label int, pred_proba double")
    got = {r.model: r for r in metrics.evaluate(df, groups=["model"]).collect()}
    for g in ("a", "b", "one"):
        part = df.filter(F.col("model") == g).filter("pred_proba IS NOT NULL")
        plain, best = metrics.confusion(part).first(), metrics.best_threshold(part).first()
        tuned = metrics.confusion(part, threshold=best.optimal_threshold).first()
        for c in ("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "specificity"):
            assert got[g][c] == pytest.approx(plain[c]), c
            if c != "f1":
                assert got[g]["optimal_" + c] == pytest.approx(tuned[c]), c
        assert got[g].roc_auc == pytest.approx(metrics.roc_auc(part).first()[0])
        assert got[g].pr_auc == pytest.approx(metrics.average_precision(part).first()[0])
        assert got[g].optimal_threshold == best.optimal_threshold and got[g].optimal_f1 == pytest.approx(best.optimal_f1)
    none = metrics.evaluate(df.limit(0)).first()
    assert (none.tp, none.f1, none.roc_auc, none.optimal_threshold) == (0, 0.0, 0.0, 0.5)


def test_evaluation_takes_few_stages(spark):
    df = spark.range(500).select(F.lit("m").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 97 / 97).alias("pred_proba"))
    plan = metrics.evaluate(df, groups=["model"])
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString()
    assert final.split("Initial Plan")[0].count("Exchange hashpartitioning") + final.split("Initial Plan")[0].count("Exchange SinglePartition") <= 8


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForest", "SVM_RBF"])
def test_models_score_in_a_session_that_has_observed(spark, name):
    """An observation stays in the session, which a training summary would take to the tasks."""
    spark.range(5).observe(Observation("seen"), F.count("*").alias("n")).collect()
    rng = np.random.default_rng(2)
    rows = [(str(i), int(x.sum() > 0), [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(120, 3)))]
    train = spark.createDataFrame(rows, "uid string, label int, embedding array<double>")
    models = learning.estimators(trees=3, depth=3)
    out = learning.compare(train, train, 3, [(name, False)], models).first()
    assert out["model"] == name and out["roc_auc"] > 0.9


def test_training_rows_are_dealt_by_size(spark):
    """One row group read as several splits is one piece of all rows if small, and equal pieces if not."""
    rows = kernel.materialise(spark.range(4000).select(F.array_repeat(F.rand(1), 8).alias("embedding")).coalesce(1), "rows")
    small, large = kernel.in_pieces(rows, 8), kernel.in_pieces(rows, 8, piece=64_000)
    assert small.rdd.getNumPartitions() == 1
    sizes = large.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and all(900 < r["count"] < 1100 for r in sizes)


def test_lifted_rows_do_not_depend_on_their_chunk(spark, rings):
    x, y = rings
    train = frame(spark, np.concatenate((x, x, x)), np.concatenate((y, y, y)))
    fitted = kernel.NystroemMap.fit(train, 40)
    got = {r.uid: r.m for r in train.select("uid", fitted.lift(F.col("embedding")).alias("m")).collect()}
    want = kernel.rbf(np.concatenate((x, x, x)), fitted.landmarks, fitted.gamma) @ fitted.root
    np.testing.assert_allclose(np.array([got[f"u{i}"] for i in range(1200)]), want, atol=1e-9)


def test_absolute_penalty_takes_few_passes_to_the_minimum_of_spark(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    y = (x @ [2.0, -1.0, 0, 0, 0, 0, 0, 0.3] + rng.normal(size=400) / 2 > 0.5).astype(int)
    fit = learning.with_features(learning.class_weights(frame(spark, x, y)))
    passes, real = [], learning.linear._summed
    monkeypatch.setattr(learning.linear, "_summed", lambda *a: (passes.append(1), real(*a))[1])
    for penalty in (0.1, 0.01, 1 / 400):
        passes.clear()
        weights, bias = learning.linear.fit_logistic(fit, penalty, 1.0)
        spark_model = LogisticRegression(maxIter=1000, tol=1e-10, elasticNetParam=1.0, regParam=penalty, standardization=False, weightCol="weight").fit(fit)
        np.testing.assert_allclose([*weights, bias], [*spark_model.coefficients, spark_model.intercept], atol=2e-3)
        assert len(passes) < 40 and ((np.abs(weights) > 1e-6) == (np.abs(spark_model.coefficients) > 1e-6)).all()


def test_absolute_penalty_is_not_fitted_by_thousands_of_passes(spark, rings, monkeypatch):
    x, y = rings
    fit = learning.class_weights(frame(spark, np.hstack((x, x**2)), y))
    monkeypatch.setattr(LogisticRegression, "_fit", lambda *_: pytest.fail("a job per pass"))
    out = metrics.evaluate(learning.predictions(learning.estimators()["LogisticRegression_L1"][0], fit, fit)).first()
    assert out.roc_auc > 0.95


def test_neighbours_of_some_rows_are_those_among_all(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(500, 4)).round(1), np.zeros(500))
    every = {(r.uid, r["rank"]): (r.neighbour, r.distance) for r in learning.nearest_in_class(df, 3, block_rows=7).collect()}
    some = learning.nearest_in_class(df, 3, of=df.filter("uid LIKE '%7'").select("uid")).collect()
    assert len(some) == 150 and all(every[r.uid, r["rank"]] == (r.neighbour, r.distance) for r in some)


def test_both_rounds_of_retraining_run_at_the_same_time(spark, tmp_path, monkeypatch):
    from threading import Barrier

    from siftwell.plans import q_learning

    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(rng.normal(size=(200, 64)) / 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    both, sizes, real = Barrier(2, timeout=60), [], learning.compare

    def compare(train, *rest):
        both.wait()
        sizes.append(train.count())
        return real(train, *rest)

    monkeypatch.setattr(learning, "compare", compare)
    out = q_learning._retrained(spark, str(tmp_path), [("LogisticRegression", False)]).collect()
    assert sorted(r.iteration for r in out) == [0, 1] and sorted(sizes)[1] in range(2 * sorted(sizes)[0] - 2, 2 * sorted(sizes)[0] + 3)
