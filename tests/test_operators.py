import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import filters, joins, learning, metrics, ordering, profiles, quality, sampling, sets, state
from siftwell.schemas import CRITERIA_IDS


def _random(spark, n=4000, seed=3):
    """Rows whose probabilities repeat; one domain and one label hold most of the rows."""
    rng = random.Random(seed)
    rows = [(str(i), "hot" if rng.random() < 0.4 else f"d{rng.randint(0, 60)}", round(rng.random() ** 3, 2), int(rng.random() < 0.1))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "uid string, domain string, pred_proba double, label int").repartition(7)


def test_running_totals_and_quantiles(spark):
    rows, df = _random(spark)
    values = np.array([r[2] for r in rows])
    got = {r.prob: r.value for r in ordering.exact_quantiles(df, "pred_proba", [0.0, 0.1, 0.5, 0.975, 1.0]).collect()}
    for p, v in got.items():
        assert abs(v - np.quantile(values, p)) < 1e-12
    cum = ordering.running_totals(ordering.per_value(df, "pred_proba"), "pred_proba", ["n"], descending=True).collect()
    for r in cum:
        assert r.cum_n == int((values >= r.pred_proba).sum()) and r.all_n == len(rows)
    grouped = ordering.quantile_columns(df, "pred_proba", {"m": 0.5}, ["domain"]).collect()
    for r in grouped:
        assert abs(r.m - np.median([x[2] for x in rows if x[1] == r.domain])) < 1e-12


def test_quantiles_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([(2.5,), (2.5,), (None,)], "x double")
    assert ordering.exact_quantiles(one, "x", [0.5]).first()["value"] == 2.5
    assert ordering.exact_quantiles(one.filter("x IS NULL"), "x", [0.5]).count() == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, 1.0, 3.0, 2.0, 3.0]], "x double")
    assert {r.x: r.avg_rank for r in ordering.average_ranks(df, "x").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_random_samples_are_exact_and_repeatable(spark):
    rows, df = _random(spark)
    small, large = sampling.take_random(df, 50), sampling.take_random(df, 1500)
    first = {r.uid for r in large.collect()}
    assert len(first) == 1500 == large.count()
    assert {r.uid for r in sampling.take_random(df.repartition(3), 1500).collect()} == first
    assert {r.uid for r in small.collect()} <= first
    assert sampling.take_random(df, 10_000).count() == len(rows)


def test_quota_sample(spark):
    rows, df = _random(spark)
    quotas = sampling.literal_quotas(df, "domain", {"hot": 321, "d1": 5, "d2": 10_000, "d3": 0})
    got = {r.domain: r["count"] for r in sampling.quota_sample(df, "domain", quotas).groupBy("domain").count().collect()}
    assert got == {"hot": 321, "d1": 5, "d2": sum(r[1] == "d2" for r in rows)}


def test_domain_cap_with_hot_domain(spark):
    rows, df = _random(spark)
    for k in (10, 1200):
        got = {r.domain: r["count"] for r in sampling.cap_per_domain(df, k).groupBy("domain").count().collect()}
        assert got == {d: min(k, sum(r[1] == d for r in rows)) for d in {r[1] for r in rows}}


def test_stratified_sample_is_disjoint(spark):
    _, df = _random(spark)
    out = sampling.stratified_sample(df, 100).collect()
    assert len({r.uid for r in out}) == len(out)
    for r in out:
        low, high = map(float, r.stratum.split("-"))
        assert low <= r.pred_proba < max(high, 0)


def test_minimum_per_bin_takes_all_when_short(spark):
    _, df = _random(spark, 300)
    assert sampling.minimum_per_bin_sample(df, 10_000, 5, "domain").count() == 300
    assert sampling.minimum_per_bin_sample(df, 200, 1, "domain").select("uid").distinct().count() == 200


def test_bin_quotas_sum_to_target(spark):
    _, df = _random(spark)
    none = spark.createDataFrame([], "domain string, n_done long")
    assert sampling.bin_quotas(df, 333, none, "domain").agg(F.sum("quota")).first()[0] == 333


def test_stratified_uncertain_fills_missing_positives(spark):
    rows = [(str(i), 0.9 if i < 3 else 0.1 + i / 10_000) for i in range(500)]
    df = spark.createDataFrame(rows, "uid string, pred_proba double")
    out = sampling.stratified_uncertain(df, 62, positive_ratio=0.4)
    assert out.count() == 100 and out.filter("pred_proba > 0.5").count() == 3
    flipped = df.withColumn("pred_proba", 1 - F.col("pred_proba"))
    assert sampling.stratified_uncertain(flipped, 62, positive_ratio=0.4).count() == 40 + 3


@pytest.mark.parametrize("n, ratio, positives", [(1090, 0.40, 436), (727, 0.35, 254)])
def test_published_selection_sizes(spark, n, ratio, positives):
    df = spark.range(4000).select(F.col("id").cast("string").alias("uid"), (F.col("id") / 4000).alias("pred_proba"))
    out = sampling.stratified_uncertain(df, n, invalid_rate=0.0, positive_ratio=ratio)
    assert out.count() == n and out.filter("pred_proba > 0.5").count() == positives


def test_split_is_disjoint_complete_and_frozen(spark):
    rows, df = _random(spark)
    split = sampling.stratified_split(df)
    test = {r.uid for r in split.filter("split = 'test'").collect()}
    assert split.select("uid").distinct().count() == len(rows) == split.count()
    assert {r.uid for r in sampling.stratified_split(df.repartition(2)).filter("split = 'test'").collect()} == test
    positive = sum(r[3] for r in rows)
    assert len(test) == math.ceil(len(rows) * 0.2)
    assert abs(sum(1 for r in rows if r[3] and r[0] in test) - positive * 0.2) < 1


@pytest.mark.parametrize("sizes, quotas", [((739, 3263), (148, 653)), ((7, 8), (1, 2)), ((1, 4), (0, 1))])
def test_split_sizes(spark, sizes, quotas):
    df = spark.createDataFrame([(str(i), int(i >= sizes[0])) for i in range(sum(sizes))], "uid string, label int")
    got = {r.label: r.quota for r in sampling.proportional_quotas(df, "label", 0.2).collect()}
    assert (got[0], got[1]) == quotas


def test_dedup_keeps_the_maximum(spark):
    rows, df = _random(spark)
    out = {r.domain: (r.pred_proba, r.uid) for r in profiles.dedup_best(df, "domain").collect()}
    for d in {r[1] for r in rows}:
        best = max(r[2] for r in rows if r[1] == d)
        assert out[d] == (best, min(r[0] for r in rows if r[1] == d and r[2] == best))


# ---------------------------------------------------------------- metrics

def _confusion_rows(spark, tp, fp, tn, fn):
    return spark.createDataFrame([(1, 0.9)] * tp + [(0, 0.9)] * fp + [(0, 0.1)] * tn + [(1, 0.1)] * fn, "label int, pred_proba double")


@pytest.mark.parametrize("cells, precision, recall, f1", [
    ((142, 55, 598, 6), 0.720812, 0.959459, 0.823188), ((137, 32, 621, 11), 0.810651, 0.925676, 0.864353)])
def test_published_metrics(spark, cells, precision, recall, f1):
    r = metrics.confusion(_confusion_rows(spark, *cells)).first()
    assert (r.tp, r.fp, r.tn, r.fn) == cells
    assert abs(r.precision - precision) < 1e-6 and abs(r.recall - recall) < 1e-6 and abs(r.f1 - f1) < 1e-6


def test_undefined_metrics_are_zero(spark):
    r = metrics.evaluate(_confusion_rows(spark, 0, 0, 5, 0)).first()
    assert (r.precision, r.recall, r.f1, r.roc_auc, r.pr_auc, r.optimal_threshold) == (0, 0, 0, 0, 0, 0.5)


def test_auc_and_average_precision_by_brute_force(spark):
    rows, df = _random(spark, 600)
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df).first()[0] - wins) < 1e-12
    area, seen = 0.0, 0
    for t in sorted({r[2] for r in rows}, reverse=True):
        tp, new = sum(p >= t for p in pos), sum(p == t for p in pos)
        area += tp / (tp + sum(n >= t for n in neg)) * new / len(pos)
    assert abs(metrics.average_precision(df).first()[0] - area) < 1e-12
    best = metrics.best_threshold(df).first()
    f1 = {t: 2 * sum(p >= t for p in pos) / (len(pos) + sum(r[2] >= t for r in rows)) for t in {r[2] for r in rows}}
    assert abs(best.optimal_f1 - max(f1.values())) < 1e-9
    assert best.optimal_threshold == min(t for t, v in f1.items() if abs(v - max(f1.values())) < 1e-12)


# ---------------------------------------------------------------- quality and state

def test_quality_scores(spark):
    assert abs(sum(quality.WEIGHTS.values()) - 7.18) < 1e-9
    cases = [([], 60.0), (["L3"], 54.57), (["D2", "A1"], 49.05), (CRITERIA_IDS, 0.0)]
    rows = [tuple([str(i), "checked", *[c in bad for c in CRITERIA_IDS]]) for i, (bad, _) in enumerate(cases)]
    schema = "uid string, disq_status string, " + ", ".join(f"disq_{c} boolean" for c in CRITERIA_IDS)
    df = spark.createDataFrame(rows, schema).withColumns({f"human_{c}": F.lit(None).cast("boolean") for c in CRITERIA_IDS})
    got = quality.score_maps(df).orderBy("uid").collect()
    assert [r.quality_score for r in got] == [q for _, q in cases]
    assert [r.violations_count for r in got] == [len(bad) for bad, _ in cases]


def test_unchecked_flags_stay_in_the_denominator(spark):
    df = spark.createDataFrame([("a", "checked")], "uid string, disq_status string").withColumns(
        {**{f"disq_{c}": F.lit(None).cast("boolean") for c in CRITERIA_IDS}, **{f"human_{c}": F.lit(None).cast("boolean") for c in CRITERIA_IDS},
         "disq_D1": F.lit(True), "human_D1": F.lit(False), "human_L1": F.lit(True)})
    r = quality.score_maps(df).first()
    assert (r.violations_count, r.quality_score) == (1, round(60 * (1 - 0.64 / 7.18), 2))


def test_condition_allows_only_listed_columns(spark):
    df = spark.createDataFrame([(True, None), (None, True)], "a boolean, b boolean")
    got = [r.passed for r in quality.evaluate_condition(df, "a and not b", ["a", "b"]).collect()]
    assert got == [False, False]
    assert [r.passed for r in quality.evaluate_condition(df, "a or c", ["a", "c"]).collect()] == [True, False]
    for bad in ("a or uid", "a; drop", "__import__('os')"):
        with pytest.raises(ValueError):
            quality.evaluate_condition(df, bad, ["a", "b"])


def test_insert_ignore_is_idempotent(spark):
    _, rows = _random(spark, 100)
    once = state.insert_ignore(rows.limit(0), rows.unionByName(rows))
    assert once.count() == 100 and state.insert_ignore(once, rows).count() == 100
    r = state.insert_counts(once, rows).first()
    assert (r.n_inserted, r.n_skipped) == (0, 100)


def test_upsert_changes_only_named_columns(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "uid string, n int, s string")
    new = spark.createDataFrame([("b", None)], "uid string, n int")
    assert sorted(map(tuple, state.upsert(base, new).collect())) == [("a", 1, "x"), ("b", None, "y")]


def test_undo_keeps_members_without_batch(spark):
    members = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "uid string, batch_id long")
    batches = spark.createDataFrame([(1, "active"), (2, "active")], "id long, status string")
    kept, marked = state.undo_batch(members, batches, 1)
    assert {r.uid for r in kept.collect()} == {"b", "c"}
    assert {r.id: r.status for r in marked.collect()} == {1: "undone", 2: "active"}


def test_filters_ignore_absent_keys(spark):
    df = spark.createDataFrame([("a", "success", None), ("b", "pending", True), ("c", "success", False)], "uid string, download_status string, passes_f3 boolean")
    assert filters.candidate_filter(df, {}).count() == 2
    assert [r.uid for r in filters.candidate_filter(df, {"f3": "0"}).collect()] == ["c"]
    kept = filters.exclude_domains(spark.createDataFrame([("a", None), ("b", "ville-data.com"), ("c", "x.org")], "uid string, domain string"))
    assert {r.uid for r in kept.collect()} == {"a", "c"}


def test_set_operations(spark):
    a = spark.createDataFrame([("a", 1), ("b", 0)], "uid string, label int")
    b = spark.createDataFrame([("b", 1), ("c", 1)], "uid string, label int")
    assert sorted(map(tuple, sets.extend_training(a, b).collect())) == [("a", 1), ("b", 0), ("c", 1)]


# ---------------------------------------------------------------- learning

def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6)).round(1)
    x[1] = x[0]
    df = spark.createDataFrame([(f"{i:02d}", [float(v) for v in row]) for i, row in enumerate(x)], "uid string, embedding array<double>")
    got = {}
    for r in learning.nearest_in_class(df, 3, cells=4).collect():
        got.setdefault(r.uid, {})[r.rank] = r.neighbour
    for i in range(90):
        d = ((x - x[i]) ** 2).sum(1).round(9)
        order = sorted((j for j in range(90) if j != i), key=lambda j: (d[j], j))[:3]
        assert [got[f"{i:02d}"][k] for k in (1, 2, 3)] == [f"{j:02d}" for j in order]


def test_oversampling_reaches_the_ratio_between_neighbours(spark):
    assert 591 + learning.synthetic_size(591, 2610, 0.3) == 783
    rng = np.random.default_rng(1)
    rows = [(str(i), int(i < 10), [float(v) for v in rng.normal(size=4)]) for i in range(110)]
    df = spark.createDataFrame(rows, "uid string, label int, embedding array<double>")
    out = learning.oversample(df).collect()
    made = [r for r in out if r.uid.startswith("synthetic")]
    assert len(made) == 20 and all(r.label == 1 for r in made) and len(out) == 130
    minority = np.array([r[2] for r in rows if r[1]])
    for r in made:
        e = np.array(r.embedding)
        assert any(abs(np.linalg.norm(e - a) + np.linalg.norm(e - b) - np.linalg.norm(a - b)) < 1e-9 for a in minority for b in minority)


def test_wide_scoring_equals_narrow_scoring(spark, monkeypatch):
    rng = np.random.default_rng(2)
    w = rng.normal(size=20).tolist()
    rows = [(str(i), [float(v) for v in rng.normal(size=20)] if i % 5 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "uid string, embedding array<float>")
    narrow = {r.uid: r.p for r in df.select("uid", learning.linear_proba(w, 0.3).alias("p")).collect()}
    monkeypatch.setattr(learning, "WIDE", 10)
    wide = {r.uid: r.p for r in df.select("uid", learning.linear_proba(w, 0.3).alias("p")).collect()}
    assert narrow.keys() == wide.keys()
    assert all((a is None and wide[u] is None) or abs(a - wide[u]) < 1e-9 for u, a in narrow.items())


def test_model_can_be_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression

    rows = [(i % 2, [float(i % 2), float(i)]) for i in range(40)]
    df = learning.with_features(spark.createDataFrame(rows, "label int, embedding array<double>"))
    model = learning.scaled_pipeline(LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01)).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    raw = df.drop("features")
    a = [r.pred_proba for r in learning.score_with_model(model, raw).collect()]
    assert a == [r.pred_proba for r in learning.score_with_model(again, raw).collect()]
    assert all((p > 0.5) == bool(i % 2) for i, p in enumerate(a))


def test_scratch_dir_follows_the_session(spark, monkeypatch):
    from siftwell import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(key, default)

    class Fake:
        conf = Conf()

    assert session.scratch_dir(Fake(), "a").startswith("hdfs://shared/x/a-")

    class Cluster:
        master = "yarn"

    class Unset(Fake):
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.scratch_dir(Unset())


def test_spread_leaves_large_inputs_alone(spark):
    from siftwell.session import spread

    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=20)
    assert spread(many) is many


def test_quota_sample_with_many_groups(spark, monkeypatch):
    rows, df = _random(spark, 800)
    quotas = df.groupBy("domain").agg(F.lit(3).alias("quota"))
    small = {r.uid for r in sampling.quota_sample(df, "domain", quotas).collect()}
    monkeypatch.setattr(sampling, "MAX_BROADCAST_GROUPS", 2)
    assert {r.uid for r in sampling.quota_sample(df, "domain", quotas).collect()} == small
    counts = {d: sum(r[1] == d for r in rows) for d in {r[1] for r in rows}}
    assert len(small) == sum(min(3, c) for c in counts.values())


def test_enrich_retries_then_reports(spark):
    from pyspark.sql import types as T

    seen = {}

    def flaky(row):
        seen[row["uid"]] = seen.get(row["uid"], 0) + 1
        if seen[row["uid"]] < 3 or row["uid"] == "bad":
            raise ValueError("down")
        return {"status": "alive"}

    df = spark.createDataFrame([("ok",), ("bad",)], "uid string").coalesce(1)
    out = {r.uid: (r.status, r.error) for r in state.enrich(df, flaky, T.StructType([T.StructField("status", T.StringType())])).collect()}
    assert out == {"ok": ("alive", None), "bad": ("error", "down")}


def test_resample_totals_as_columns_and_as_rows(spark):
    """Both forms equal the sums drawn one by one, with a null rating, a null criterion and a respondent without a criterion."""
    import hashlib

    given = [(10, "a", 1), (10, "b", 5), (11, "a", 4), (11, None, 2), (12, "b", None), (13, "c", 3), (13, "a", 2)]
    rows = spark.createDataFrame([(0, 10), (1, 11), (2, 12), (3, 13)], "idx long, respondent long")
    ratings = spark.createDataFrame(given, "respondent long, criterion string, rating long")
    want = {}
    for b in range(50):
        for draw in range(4):
            idx = int(hashlib.md5(f"42:{b}:{draw}".encode()).hexdigest()[:12], 16) % 4
            for respondent, criterion, rating in given:
                if respondent == 10 + idx:
                    n, total = want.get((b, criterion), (0, None))
                    want[b, criterion] = (n, total) if rating is None else (n + 1, (total or 0) + rating)
    for wide in (64, 2):
        per = joins.resample_totals(rows, ratings, 50, wide)
        assert {(r.iteration, r.criterion): (r.weight, r.total) for r in per.collect()} == want
        assert per.count() == len(want)
