"""Scaling, oversampling, training, scoring and comparing classifiers."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from siftwell.operators import learning, metrics, sampling, sets
from siftwell.plans import tables as t
from siftwell.plans.registry import query
from siftwell.session import materialise, scratch_dir

DIM = 64


def _label():
    """A rare label that the vectors determine but no single feature decides."""
    e = F.col("embedding")
    return (e[0] + e[1] > 0.15).cast("int").alias("label")


def _splits(spark, sf):
    """Train and test rows with a label that the vectors determine, so that a fitted model can be judged."""
    rows = sampling.stratified_split(t.vectors(spark, sf).select("uid", _label(), "embedding"))
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


@query("i02_standardised", """
    SELECT uid, dim, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 5) AS z
    FROM (SELECT CAST(vec_id AS VARCHAR) AS uid, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    WINDOW w AS (PARTITION BY dim)""")
def i02(spark, sf):
    z = learning.standardise(t.vectors(spark, sf).select("uid", "embedding"))
    return t.rounded(z.select("uid", F.posexplode("embedding").alias("dim", "z")), "z", digits=5)


@query("i03_class_weights", """
    SELECT uid, label, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM lab""")
def i03(spark, sf):
    return t.rounded(learning.class_weights(t.lab(spark, sf)).select("uid", "label", "weight"), "weight")


@query("i04_nearest_neighbours", """
    WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS uid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0)
    SELECT uid, neighbour, rn AS rank, round(d, 6) AS distance FROM (
        SELECT a.uid, b.uid AS neighbour, list_distance(a.e, b.e) ** 2 AS d, row_number() OVER (PARTITION BY a.uid ORDER BY round(list_distance(a.e, b.e) ** 2, 9), b.uid) AS rn
        FROM v a JOIN v b ON a.uid <> b.uid) WHERE rn <= 3""")
def i04n(spark, sf):
    rare = t.table(spark, sf, "embeddings").filter("label = 0").select(F.col("vec_id").cast("string").alias("uid"), "embedding")
    return t.rounded(learning.nearest_in_class(rare, 3, cells=3).select("uid", "neighbour", "rank", "distance"), "distance")


def _rare(spark, sf):
    return t.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("uid"), (F.col("label") < 1).cast("int").alias("label"), "embedding")


@query("i04_oversampled", """
    SELECT CASE WHEN label < 1 THEN 1 ELSE 0 END AS label,
           CASE WHEN label < 1 THEN CAST(floor((SELECT count(*) FROM embeddings WHERE label > 0) * 0.3) AS BIGINT) ELSE count(*) END AS n
    FROM (SELECT least(label, 1) AS label FROM embeddings) GROUP BY label""")
def i04(spark, sf):
    return learning.oversample(_rare(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query("i04_synthetic_rows", """
    SELECT CAST(floor((SELECT count(*) FROM embeddings WHERE label > 0) * 0.3) AS BIGINT) - count(*) AS n, TRUE AS on_lines, TRUE AS within FROM embeddings WHERE label < 1""")
def i04_lines(spark, sf):
    """Every synthetic vector lies on the line from its row to one of that row's three nearest neighbours."""
    rows = _rare(spark, sf)
    made = learning.oversample(rows).filter(F.col("uid").startswith("synthetic-")).select(
        F.col("uid").alias("made"), F.regexp_extract("uid", "^synthetic-(.*)-[0-9]+$", 1).alias("uid"), F.col("embedding").alias("s"))
    near = learning.nearest_in_class(rows.filter("label = 1").select("uid", "embedding"))
    both = made.join(near, "uid").withColumn("u", F.zip_with("n_embedding", "embedding", lambda a, b: a - b)).withColumn("v", F.zip_with("s", "embedding", lambda a, b: a - b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    gap = dot("u", "v") / F.nullif(dot("u", "u"), F.lit(0.0))
    off = F.sqrt(F.abs(dot("v", "v") - F.coalesce(gap * dot("u", "v"), F.lit(0.0))))
    per = both.withColumn("off", off).withColumn("gap", F.coalesce(gap, F.lit(0.0))).groupBy("made").agg(F.min(F.struct("off", "gap")).alias("b"))
    return per.agg(F.count("*").alias("n"), F.bool_and(F.col("b.off") < 1e-6).alias("on_lines"), F.bool_and(F.col("b.gap").between(-1e-9, 1 + 1e-9)).alias("within"))


STUMP = "Stump"


def models():
    """The models at full size, and the best single split on one feature."""
    split = DecisionTreeClassifier(maxDepth=1, featuresCol="features", labelCol="label", weightCol="weight")
    return learning.estimators() | {STUMP: (split, False)}


def stump(train, test):
    return learning.compare(train, test, DIM, [(STUMP, False)], models())


def judged(results, test):
    """What must hold for any fitted model: (model, test rows, best F1 above calling every row positive and above a stump's, ranking above a stump's).

    F1 is taken at each model's best threshold: shares of a forest grown to its full depth are far from 0.5 for a rare label.
    """
    share = test.agg(F.avg("label").alias("p")).scalar()
    rows = test.agg(F.count("*").alias("n")).scalar()
    least = results.filter(F.col("model") == STUMP)
    f1, auc = (least.select(c).scalar() for c in ("optimal_f1", "roc_auc"))
    return results.filter(F.col("model") != STUMP).select(
        "model", rows.alias("n_test"), ((F.col("optimal_f1") > 2 * share / (1 + share)) & (F.col("optimal_f1") > f1)).alias("beats_majority"),
        ((F.col("roc_auc") > F.greatest(auc, F.lit(0.5))) & (F.col("roc_auc") <= 1)).alias("ranks"), (F.col("optimal_f1") >= F.col("f1") - 1e-9).alias("optimum_holds"))


def judged_sql(*models: str, more: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS model, CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_test, TRUE AS beats_majority, TRUE AS ranks, TRUE AS optimum_holds{more} FROM embeddings"
        for m in models)


def _one(name, smote=False):
    def run(spark, sf):
        train, test = _splits(spark, sf)
        return judged(learning.compare(train, test, DIM, [(name, smote), (STUMP, False)], models()), test)

    return run


for _query, _model in (("i05_logistic_regression", "LogisticRegression"), ("i05_logistic_regression_l1", "LogisticRegression_L1"),
                       ("i06_random_forest", "RandomForest"), ("i06_random_forest_subsample", "RandomForest_Subsample"),
                       ("i07_gradient_boosting", "GradientBoosting"), ("i08_rbf_kernel", "SVM_RBF")):
    query(_query, judged_sql(_model))(_one(_model))


@query("i08_rbf_ring", "SELECT 'SVM_RBF' AS model, TRUE AS beats_logistic, TRUE AS ranks_rings, TRUE AS calibrated FROM embeddings LIMIT 1")
def i08_ring(spark, sf):
    """A label that no line separates: rows at a middle distance from the centre of two features."""
    e = F.col("embedding")
    rows = t.vectors(spark, sf).select("uid", F.slice(e, 1, 2).alias("embedding"))
    radius = F.col("embedding")[0] * F.col("embedding")[0] + F.col("embedding")[1] * F.col("embedding")[1]
    rows = sampling.stratified_split(rows.withColumn("label", radius.between(0.008, 0.03).cast("int")))
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    results = learning.compare(train, test, 2, [("SVM_RBF", False), ("LogisticRegression", False)])
    rates = results.groupBy().pivot("model", ["SVM_RBF", "LogisticRegression"]).agg(F.first("roc_auc").alias("auc"), F.first("f1").alias("f1"), F.first("optimal_f1").alias("best"))
    share = F.col("SVM_RBF_f1") / F.col("SVM_RBF_best")
    return rates.select(F.lit("SVM_RBF").alias("model"), ((F.col("SVM_RBF_auc") > F.col("LogisticRegression_auc") + 0.1)).alias("beats_logistic"),
                        (F.col("SVM_RBF_auc") > 0.8).alias("ranks_rings"), (share > 0.85).alias("calibrated"))


RUNS = [(name, smote) for name in learning.MODEL_NAMES for smote in (False, True) if not (smote and name == "SVM_RBF")]

_run_name = learning.run_name
_results = {}


def stored_results(spark, sf):
    """The comparison of all runs, fitted and stored once for a session and a set of tables; later queries read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _results:
        train, test = _splits(spark, sf)
        _results[key] = learning.compare(train, test, DIM, [*RUNS, (STUMP, False)], models()).inputFiles()
    return spark.read.parquet(*_results[key])


@query("i09_model_comparison", judged_sql(*[_run_name(*r) for r in RUNS]))
def i09(spark, sf):
    return judged(stored_results(spark, sf), _splits(spark, sf)[1])


@query("i09_best_model", "SELECT 1 AS n, TRUE AS known, TRUE AS best")
def i09b(spark, sf):
    """The model that is picked is one of the runs, and no other run has a larger F1 (nor an equal one and an earlier name)."""
    results = stored_results(spark, sf).filter(F.col("model") != STUMP)
    picked = learning.best_model(results).select(F.struct(F.col("f1").alias("f"), F.col("model").alias("m"))).scalar()
    better = (F.col("f1") > F.col("_p.f")) | ((F.col("f1") == F.col("_p.f")) & (F.col("model") < F.col("_p.m")))
    return results.withColumn("_p", picked).agg(
        F.count_if(F.col("model") == F.col("_p.m")).cast("int").alias("n"), F.bool_or(F.col("_p.m").isin(*[_run_name(*r) for r in RUNS])).alias("known"),
        (~F.bool_or(better)).alias("best"))


_METRICS = """
    round((tp + tn) / n, 6) AS {0}accuracy, round(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS {0}precision,
    round(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS {0}recall"""


def _cells(threshold: str) -> str:
    return f"""SELECT count(*) AS n, count(*) FILTER (WHERE pred_proba >= {threshold} AND label = 1) AS tp,
        count(*) FILTER (WHERE pred_proba >= {threshold} AND label = 0) AS fp, count(*) FILTER (WHERE pred_proba < {threshold} AND label = 0) AS tn,
        count(*) FILTER (WHERE pred_proba < {threshold} AND label = 1) AS fn FROM lab"""


@query("i10_metrics_at_both_thresholds", f"""
    WITH best AS (SELECT threshold FROM (SELECT threshold, round(2 * p * r / (p + r + 1e-10), 12) AS f1
        FROM (SELECT threshold, tp / seen AS p, tp / all_pos AS r FROM curve)) ORDER BY f1 DESC, threshold LIMIT 1),
    a AS (SELECT {_METRICS.format('')} FROM ({_cells('0.5')})),
    b AS (SELECT {_METRICS.format('optimal_')} FROM ({_cells('(SELECT threshold FROM best)')}))
    SELECT a.*, b.*, threshold AS optimal_threshold FROM a, b, best""")
def i10(spark, sf):
    out = metrics.evaluate(t.lab(spark, sf))
    cols = [p + m for p in ("", "optimal_") for m in ("accuracy", "precision", "recall")]
    return t.rounded(out.select(*cols, "optimal_threshold"), *cols)


@query("i11_batch_scoring", "SELECT uid, pred_proba, CASE WHEN pred_proba >= 0.6 THEN 1 ELSE 0 END AS pred_label FROM vec")
def i11(spark, sf):
    p = F.round(learning.linear_proba(t.LINEAR, t.BIAS), 9)
    return learning.predicted_labels(t.vectors(spark, sf), p, 0.6).select("uid", "pred_proba", "pred_label")


@query("i12_large_scale_scoring", "SELECT uid, url, score, pred_proba FROM vec WHERE pred_proba >= 0.5")
def i12(spark, sf):
    p = F.round(learning.linear_proba(t.LINEAR, t.BIAS), 9)
    return learning.score_and_keep(t.vectors(spark, sf), p)


@query("i12_fitted_model_scoring", """
    SELECT count(*) AS n, TRUE AS in_range, TRUE AS separates, TRUE AS latest_wins, TRUE AS baseline_serves FROM embeddings""")
def i12f(spark, sf):
    """Fit, save, load the latest model or else the baseline, and score the whole table with it."""
    train, _ = _splits(spark, sf)
    root = scratch_dir(spark, "models")
    places = [f"{root}/iteration_2", f"{root}/iteration_1", f"{root}/baseline"]
    half = sampling.stratified_split(train, 0.5).filter("split = 'train'").drop("split")
    learning.save_model(learning.fit_pipeline(half), places[2])
    first = learning.load_latest_model(spark, places)[0]
    learning.save_model(learning.fit_pipeline(train), places[1])
    used, model = learning.load_latest_model(spark, places)
    scored = learning.score_with_model(model, t.vectors(spark, sf).select("uid", _label(), "embedding"))
    p = F.col("pred_proba")
    return scored.agg(
        F.count("*").alias("n"), F.bool_and(p.between(0, 1)).alias("in_range"),
        (F.avg(F.when(F.col("label") == 1, p)) > F.avg(F.when(F.col("label") == 0, p))).alias("separates"),
        F.lit(used == places[1]).alias("latest_wins"), F.lit(first == places[2]).alias("baseline_serves"))


@query("i13_retrained", judged_sql("LogisticRegression", more=", 0 AS iteration") + " UNION ALL " + judged_sql("LogisticRegression", more=", 1 AS iteration"))
def i13(spark, sf):
    return _retrained(spark, sf, [("LogisticRegression", False)])


@query("i13_all_retrained", " UNION ALL ".join(judged_sql(*[_run_name(*r) for r in RUNS], more=f", {i} AS iteration") for i in (0, 1)))
def i13_all(spark, sf):
    """Every run of the comparison, on half of the training rows and again on all of them."""
    return _retrained(spark, sf, RUNS)


def _retrained(spark, sf, runs):
    train, test = (materialise(rows, "split") for rows in _splits(spark, sf))
    half = materialise(sampling.stratified_split(train, 0.5), "half")
    first, more = (half.filter(F.col("split") == s).drop("split") for s in ("train", "test"))

    def one(i):
        rows = (first, sets.extend_training(first, more))[i]
        return judged(learning.compare(rows, test, DIM, [*runs, (STUMP, False)], models()), test).withColumn("iteration", F.lit(i))

    with ThreadPoolExecutor(2) as pool:
        rounds = list(pool.map(inheritable_thread_target(spark)(one), (0, 1)))
    return rounds[0].unionByName(rounds[1])


def _scores_sql(p: str) -> str:
    return f"""SELECT 2 * tp / (2 * tp + fp + fn) AS f1, tp / NULLIF(tp + fp, 0) AS precision, tp / (tp + fn) AS recall, roc_auc, pr_auc FROM (
        SELECT count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn,
               (sum(r) FILTER (WHERE label = 1) - max(np) * (max(np) + 1) / 2) / (max(np) * (count(*) - max(np))) AS roc_auc,
               sum(CASE WHEN label = 1 THEN above / seen / np ELSE 0 END) AS pr_auc
        FROM (SELECT label, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r, sum(label) OVER () AS np,
                     sum(label) OVER (ORDER BY p DESC) AS above, count(*) OVER (ORDER BY p DESC) AS seen FROM (SELECT label, {p} AS p FROM lab)))"""


@query("i14_verdict", f"""
    WITH o AS ({_scores_sql('pred_proba')}), n AS ({_scores_sql('(pred_proba + label) / 2')})
    SELECT {", ".join(f"round(n.{m} - o.{m}, 6) AS {m}_change" for m in ("f1", "precision", "recall", "roc_auc", "pr_auc"))},
           CASE WHEN n.f1 > o.f1 AND n.recall > o.recall THEN 'clearly better' WHEN n.recall > o.recall THEN 'better' WHEN n.pr_auc > o.pr_auc THEN 'slightly better'
                WHEN n.f1 > o.f1 OR n.precision > o.precision OR n.roc_auc > o.roc_auc THEN 'partly better' ELSE 'no improvement' END AS verdict FROM o, n""")
def i14(spark, sf):
    rows = t.lab(spark, sf)
    better = rows.withColumn("pred_proba", (F.col("pred_proba") + F.col("label")) / 2)
    out = learning.verdict(metrics.evaluate(rows), metrics.evaluate(better))
    return t.rounded(out, *[c for c in out.columns if c != "verdict"])
