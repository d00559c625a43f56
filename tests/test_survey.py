import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import tails
from siftwell.operators import survey


def _ratings(spark, n=40, criteria=("a", "b", "c", "d"), seed=5, missing=0.1):
    rng = random.Random(seed)
    rows = [(i, c, min(5, max(1, round(rng.gauss(3 + j / 2, 1))))) for i in range(n) for j, c in enumerate(criteria) if rng.random() > missing]
    return rows, spark.createDataFrame(rows, "respondent long, criterion string, rating int")


def test_tail_probabilities():
    # Table values of the t, chi-square and normal distributions.
    assert abs(tails.student_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(tails.student_two_sided(12.706, 1) - 0.05) < 1e-4
    assert abs(tails.chi2_upper(16.919, 9) - 0.05) < 1e-4
    assert abs(tails.chi2_upper(3.841, 1) - 0.05) < 1e-4
    assert abs(tails.chi2_upper(2.0, 2) - np.exp(-1)) < 1e-12
    assert abs(tails.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert tails.student_two_sided(0.0, 5) == pytest.approx(1.0)


def _alpha(rows, level):
    """Alpha straight from its definition over all pairs of values inside units."""
    units = {}
    for unit, _, value in rows:
        units.setdefault(unit, []).append(value)
    units = {u: v for u, v in units.items() if len(v) > 1}
    values = [v for vs in units.values() for v in vs]
    n = len(values)
    count = {v: values.count(v) for v in set(values)}

    def delta(a, b):
        if level == "nominal":
            return float(a != b)
        if level == "interval":
            return (a - b) ** 2
        low, high = min(a, b), max(a, b)
        return (sum(c for v, c in count.items() if low <= v <= high) - (count[a] + count[b]) / 2) ** 2

    observed = sum(delta(a, b) / (len(vs) - 1) for vs in units.values() for a, b in itertools.permutations(vs, 2)) / n
    expected = sum(delta(a, b) for a, b in itertools.permutations(values, 2)) / (n * (n - 1))
    return 1 - observed / expected


@pytest.mark.parametrize("level", ["ordinal", "interval", "nominal"])
@pytest.mark.parametrize("unit", ["respondent", "criterion"])
def test_alpha_by_definition(spark, level, unit):
    rows, df = _ratings(spark)
    flat = rows if unit == "respondent" else [(c, r, v) for r, c, v in rows]
    assert survey.krippendorff_alpha(df, level, unit).first()[0] == pytest.approx(_alpha(flat, level), abs=1e-9)


def test_jackknife_by_leaving_one_out(spark):
    rows, df = _ratings(spark)
    for r in survey.jackknife_weights(df).collect():
        col = [(i, v) for i, c, v in rows if c == r.criterion]
        full = (np.mean([v for _, v in col]) - 1) / 4
        loo = {i: (np.mean([v for j, v in col if j != i]) - 1) / 4 for i, _ in col}
        assert r.jk_min == pytest.approx(min(loo.values())) and r.jk_max == pytest.approx(max(loo.values()))
        change = {i: round(abs(w - full), 12) for i, w in loo.items()}
        assert r.most_influential == min(i for i, x in change.items() if x == max(change.values()))


def test_bootstrap_weights_are_close_to_theory_and_repeatable(spark):
    rows, df = _ratings(spark, 200)
    first = {r.criterion: r for r in survey.bootstrap_weights(df, 2000).collect()}
    again = {r.criterion: r for r in survey.bootstrap_weights(df.repartition(3), 2000).collect()}
    for c, r in first.items():
        col = np.array([v for _, k, v in rows if k == c])
        se = col.std() / 4 / np.sqrt(len(col))
        assert r.weight == pytest.approx((col.mean() - 1) / 4)
        assert r.boot_mean == pytest.approx(r.weight, abs=4 * se / np.sqrt(2000) + 1e-9)
        assert r.se == pytest.approx(se, rel=0.1) and r.ci_lo == pytest.approx(r.weight - 1.96 * se, abs=0.3 * se)
        assert again[c].ci_hi == r.ci_hi


def test_bootstrap_alpha_brackets_the_value(spark):
    _, df = _ratings(spark, 60)
    r = survey.bootstrap_alpha(df, 300).first()
    assert r.ci_lo < r.alpha < r.ci_hi and r.se > 0


def test_spearman_edges(spark):
    line = spark.createDataFrame([(float(i), float(i) ** 3) for i in range(10)], "x double, y double")
    r = survey.spearman(line, "x", "y").first()
    assert (r.n, r.rho, r.p) == (10, 1.0, 0.0)
    r = survey.spearman(line.limit(2), "x", "y").first()
    assert r.rho is None
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0), (6.0, None)]
    r = survey.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert r.n == 5 and r.rho == pytest.approx(0.8) and r.p == pytest.approx(0.104088, abs=1e-5)


def test_friedman_uses_complete_respondents(spark):
    rows, df = _ratings(spark)
    complete = [i for i in range(40) if sum(r[0] == i for r in rows) == 4]
    test, ranks = survey.friedman(df, 4)
    r = test.first()
    assert r.n == len(complete) and r.df == 3 and 0 <= r.p <= 1
    assert sum(x.mean_rank for x in ranks.collect()) == pytest.approx(10.0)


def test_wilcoxon_drops_zeros(spark):
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate([3, 3, 4, 5, 5, 2, 5, 4])], "respondent long, criterion string, rating int")
    r = survey.wilcoxon(df).first()
    # |d| = 1,2,2,1,2,1 -> ranks 2,5,5,2,5,2; the only negative one has rank 2
    assert (r.n, r.w) == (6, 2.0)


def test_kendall_w_of_identical_judges(spark):
    df = spark.createDataFrame([(j, c, r) for j in ("x", "y", "z") for r, c in enumerate("abcd", 1)], "judge string, criterion string, rank int")
    r = survey.kendall_w(df, "judge").first()
    assert (r.w, r.chi2) == (pytest.approx(1.0), pytest.approx(9.0)) and r.p == pytest.approx(0.029291, abs=1e-5)


def test_ranking_ties_follow_declaration_order(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 3.0)], "criterion string, mean double")
    got = {r.criterion: r["rank"] for r in survey.ranking(df, "mean", ["b", "a", "c"]).collect()}
    assert got == {"c": 1, "b": 2, "a": 3}


def test_weight_of_means(spark):
    from siftwell.functions.scores import severity_weight

    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "m double")
    assert [r[0] for r in df.select(severity_weight(F.col("m"))).collect()] == [0.0, 0.5, 1.0]
