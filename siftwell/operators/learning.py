"""Training, scoring and comparing classifiers on embeddings with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.functions.scores import direction, percent_change
from siftwell.operators import linear, trees
from siftwell.operators.kernel import PIECE, RbfSvm, in_pieces, without_summary
from siftwell.operators.metrics import evaluate
from siftwell.operators.ordering import attach_row
from siftwell.session import bounded_batches, materialise
from siftwell.sources.readers import path_exists

RESULT_COLUMNS = ["model", "f1", "precision", "recall", "accuracy", "roc_auc", "pr_auc", "optimal_threshold",
                  "optimal_f1"]


def with_features(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))


def fixed_length(df: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Embeddings as float arrays of exactly ``dim`` elements; other rows are dropped."""
    return df.filter(F.size(embedding) == dim).withColumn(embedding, F.col(embedding).cast("array<float>"))


# ---------------------------------------------------------------- scaling and weights

def dimension_statistics(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: mean and population SD of every dimension, as arrays, in one aggregate of vectors."""
    rows = with_features(df.filter(F.col(embedding).isNotNull()).select(embedding), embedding)
    moments = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("m"))
    share = F.when(F.col("m.count") > 1, (F.col("m.count") - 1) / F.col("m.count")).otherwise(0.0)
    sd = F.transform(vector_to_array("m.variance"), lambda v: F.sqrt(v * share))
    return moments.select(vector_to_array("m.mean").alias("mean"), sd.alias("sd"))


def standardise(df: DataFrame, fitted_on: DataFrame | None = None, embedding: str = "embedding") -> DataFrame:
    """Centre and scale by the population statistics of ``fitted_on`` (default the rows themselves); a constant dimension is only centred."""
    stats = dimension_statistics(fitted_on if fitted_on is not None else df, embedding)
    packed = stats.select(F.struct("mean", "sd").alias("s")).scalar()
    z = F.transform(embedding, lambda x, i: (x.cast("double") - F.get(F.col("_s.mean"), i))
                    / F.when(F.get(F.col("_s.sd"), i) > 0, F.get(F.col("_s.sd"), i)).otherwise(1.0))
    return df.withColumn("_s", packed).withColumn(embedding, z).drop("_s")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (2 n_class) on every row."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    n1, n0 = F.col("_n1"), F.col("_n0")
    weight = (n1 + n0) / (2 * F.when(F.col(label) == 1, n1).otherwise(n0))
    return attach_row(df, sizes).withColumn("weight", weight).drop("_n1", "_n0")


def synthetic_size(n_minority: int, n_majority: int, ratio: float = 0.3) -> int:
    """Minority rows to add until minority/majority reaches the ratio."""
    return max(0, int(n_majority * ratio) - n_minority)


PIVOTS = 64
"""Rows whose cells the rows of a class are cut into; more of them make smaller cells and longer rows."""


def nearest_in_class(rows: DataFrame, k: int = 3, embedding: str = "embedding", uid: str = "uid",
                     cells: int = 0, pivots: int = PIVOTS, block_rows: int = 4096, of: DataFrame | None = None) -> DataFrame:
    """k nearest neighbours of each row of one class: (uid, rank, neighbour, distance, embedding, n_embedding).  Exact; ties to the smaller uid.

    With ``of``, a table of uids, only those rows are asked for, among all.

    Rows go to the cell of the nearest pivot (``cells`` of them, or up to ``pivots``), and each first searches its own
    cell, which bounds the distance of its k-th neighbour.  By the triangle inequality a row can have a nearer one in
    another cell only if its distance to that cell's pivot, less the cell's radius, is within that bound; no other row
    is sent there.  A cell of more than ``block_rows`` rows is searched block by block, each packed into one row, so a task
    holds a few of them and a pair of blocks is one matrix product.
    """
    base = rows.select(F.col(uid).cast("string").alias("uid"), F.col(embedding).cast("array<double>").alias("e"))
    base = materialise(base.filter(F.col("e").isNotNull()), "class")
    from siftwell.operators.sampling import shuffled

    centres = shuffled(base).limit(cells or pivots).collect()  # a bounded number
    if not centres:
        return base.select("uid", F.lit(0).alias("rank"), F.col("uid").alias("neighbour"), F.lit(0.0).alias("distance"), F.col("e").alias("embedding"), F.col("e").alias("n_embedding"))
    points = np.array([c["e"] for c in centres])

    def place(batches):
        for pdf in batches:
            x = np.stack(pdf["e"].to_numpy())
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T, 0))
            yield pdf.assign(cell=d.argmin(1).astype("int64"), far=list(d))

    placed = materialise(base.mapInPandas(place, "uid string, e array<double>, cell long, far array<double>"), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.get("far", F.col("cell").cast("int"))).alias("radius")).collect()  # one row per pivot
    blocks = {r["cell"]: max(1, -(-r["n"] // block_rows)) for r in sizes}
    radius = {r["cell"]: r["radius"] for r in sizes}
    parts = F.get(F.array(*[F.lit(blocks.get(c, 1)) for c in range(len(points))]), F.col("cell").cast("int"))
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("uid"), parts))
    bounded_batches(rows.sparkSession)

    def packed(part: DataFrame, elsewhere: bool = False) -> DataFrame:
        """One row per cell and block: its rows in the order of their uid, and the cells in which they search."""
        def pack(key: tuple, table: pa.Table) -> pa.Table:
            cell, pdf = key[0].as_py(), table.to_pandas().sort_values("uid", kind="stable", ignore_index=True)
            reach = pdf["kth"].fillna(np.inf).to_numpy(dtype="float64")
            if elsewhere:
                far = np.stack(pdf["far"].to_numpy())
                cells = [c for c in sorted(radius) if c != cell and (far[:, c] - radius[c] <= reach + 1e-6).any()]
            else:
                cells = [cell]
            names = [None if pd.isna(u) else u for u in pdf["uid"]]
            values = [[cell], [names], [np.stack(pdf["e"].to_numpy()).astype("float64").tobytes()], [reach.tobytes()], [cells]]
            return pa.table([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["cell", "uid", "e", "kth", "cells"])

        kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        if "kth" not in part.columns:
            part = part.withColumn("kth", F.lit(None).cast("double"))
        return part.groupBy("cell", "block").applyInArrow(pack, "cell long, uid array<string>, e binary, kth binary, cells array<long>")

    def best(names: np.ndarray, a: np.ndarray, kth: np.ndarray, others: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        """Row, other row and distance of up to k others within reach of each row, the nearest."""
        norms = (b * b).sum(1)
        for start in range(0, len(a), 256):
            part = a[start:start + 256]
            d = np.maximum((part * part).sum(1)[:, None] + norms - 2 * part @ b.T, 0).round(9)
            d[names[start:start + 256, None] == others[None, :]] = np.inf
            last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            i, j = np.nonzero((d <= last[:, None]) & (d <= (kth[start:start + 256, None] + 1e-6) ** 2) & np.isfinite(d))
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            few = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield start + i[few], j[few], d[i[few], j[few]]

    def search(queries: DataFrame, targets: DataFrame) -> DataFrame:
        """Each pack of queries against every pack of the cells in which it searches."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(len(batch)):
                    uid, e, kth, t_uid, t_e = (batch.column(c)[r] for c in ("uid", "e", "kth", "t_uid", "t_e"))
                    names, others = (np.array(u.as_py(), dtype=object) for u in (uid, t_uid))
                    a, b = (np.frombuffer(x.as_buffer(), "float64").reshape(len(n), -1) for x, n in ((e, names), (t_e, others)))
                    for i, j, d in best(names, a, np.frombuffer(kth.as_buffer(), "float64"), others, b):
                        yield pa.RecordBatch.from_arrays([pa.array(names[i], pa.string()), pa.array(others[j], pa.string()), pa.array(d)], names=["uid", "neighbour", "distance"])

        sent = queries.select("uid", "e", "kth", F.explode("cells").alias("cell"))
        pairs = sent.join(targets.select("cell", F.col("uid").alias("t_uid"), F.col("e").alias("t_e")), "cell")
        return pairs.mapInArrow(run, "uid string, neighbour string, distance double")

    targets = materialise(packed(blocked), "packs")
    asked = blocked if of is None else materialise(blocked.join(of.select(F.col(uid).cast("string").alias("uid")).distinct(), "uid", "left_semi"), "asked")
    own = materialise(search(targets if of is None else materialise(packed(asked), "packs"), targets), "own")
    bound = own.groupBy("uid").agg(F.sort_array(F.collect_list("distance")).alias("d")).select("uid", F.sqrt(F.get("d", F.lit(k - 1))).alias("kth"))
    found = own.unionByName(search(materialise(packed(asked.join(bound, "uid", "left"), True), "packs"), targets))
    w = Window.partitionBy("uid").orderBy("distance", "neighbour")
    near = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ends = base.select(F.col("uid").alias("neighbour"), F.col("e").alias("n_embedding"))
    return near.join(base.withColumnRenamed("e", "embedding"), "uid").join(ends, "neighbour").select(
        "uid", "rank", "neighbour", "distance", "embedding", "n_embedding")


def oversample(df: DataFrame, ratio: float = 0.3, k: int = 3, label: str = "label", embedding: str = "embedding",
               uid: str = "uid", seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """Rows (uid, label, embedding) with synthetic minority rows on the lines to near neighbours.

    The number of synthetic rows follows from the class counts; each minority row gives an equal share,
    the rest going to the first ones in hash order.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    minority = min(counts, key=lambda c: (counts[c], -c))
    need = synthetic_size(counts[minority], counts[1 - minority], ratio)
    plain = df.select(F.col(uid).cast("string").alias("uid"), label, F.col(embedding).cast("array<double>").alias("embedding"))
    if need == 0:
        return plain
    rows = plain.filter(F.col(label) == minority)
    share, rest = divmod(need, counts[minority])
    from siftwell.operators.sampling import draw_key, take_random

    firsts = take_random(rows.select("uid"), rest, "uid", seed) if rest else rows.select("uid").limit(0)
    if not share:
        firsts = materialise(firsts, "firsts")
    near = nearest_in_class(rows, k, "embedding", "uid", block_rows=block_rows, of=None if share else firsts)
    copies = rows.select("uid").join(firsts.withColumn("_extra", F.lit(1)), "uid", "left").select(
        "uid", F.explode(F.when(F.lit(share) + F.coalesce("_extra", F.lit(0)) > 0, F.sequence(
            F.lit(1), F.lit(share) + F.coalesce("_extra", F.lit(0))))).alias("copy"))
    dice = lambda tag: F.conv(F.substring(draw_key(F.concat_ws("-", "uid", "copy", F.lit(tag)), seed), 1, 8), 16, 10).cast("long")
    lists = near.groupBy("uid").agg(F.first("embedding").alias("e"), F.array_sort(F.collect_list(
        F.struct("rank", "n_embedding"))).alias("near"))
    picked = copies.join(lists, "uid").select(
        F.concat_ws("-", F.lit("synthetic"), "uid", "copy").alias("uid"), "e",
        F.element_at("near", (F.pmod(dice("n"), F.size("near")) + 1).cast("int"))["n_embedding"].alias("n"),
        (dice("g") / 4294967296.0).alias("gap"))
    made = picked.select("uid", F.lit(minority).alias(label),
                         F.zip_with("e", "n", lambda a, b: a + F.col("gap") * (b - a)).alias("embedding"))
    return plain.unionByName(made)


# ---------------------------------------------------------------- models

# Model names and sizes.
MODEL_NAMES = ["LogisticRegression", "LogisticRegression_L1", "RandomForest", "RandomForest_Subsample", "GradientBoosting", "SVM_RBF"]
TREES, DEPTH, ROUNDS, BOOST_DEPTH = 200, 20, 200, 8


def estimators(trees: int = TREES, depth: int = DEPTH, rounds: int = ROUNDS, boost_depth: int = BOOST_DEPTH, seed: int = 42) -> dict:
    """name -> (estimator, scaled input).  All use the balanced ``weight`` column.

    The penalty of the linear models is the usual C = 1, which depends on the rows; ``penalised`` sets it.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    forest = dict(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed, maxMemoryInMB=512, **common)
    return {
        "LogisticRegression": (LogisticRegression(maxIter=1000, elasticNetParam=0.0, standardization=False, **common), True),
        "LogisticRegression_L1": (LogisticRegression(maxIter=1000, elasticNetParam=1.0, standardization=False, **common), True),
        "RandomForest": (RandomForestClassifier(**forest), False),
        "RandomForest_Subsample": (RandomForestClassifier(subsamplingRate=0.8, **forest), False),
        "GradientBoosting": (GBTClassifier(maxIter=rounds, maxDepth=boost_depth, stepSize=0.1, subsamplingRate=0.8, maxMemoryInMB=512,
                                           featureSubsetStrategy="0.8", seed=seed, **common), False),
        "SVM_RBF": (RbfSvm(seed=seed), True),
    }


def penalised(estimator, n: int, C: float = 1.0):
    """A logistic regression with the penalty that stands against C times the summed loss of n rows; others as they are."""
    if isinstance(estimator, LogisticRegression):
        return estimator.copy({estimator.regParam: 1.0 / (C * max(1, n))})
    return estimator


def stored(df: DataFrame, name: str) -> DataFrame:
    """A training table, written once in pieces of full size: a small one is one piece, so its many short jobs are one task each."""
    return materialise(df.hint("rebalance"), name)


def training_sets(train: DataFrame, test: DataFrame, kinds: set[tuple[bool, bool]]) -> dict:
    """(scaled, oversampled) -> stored (training rows with weight, test rows), each made once whatever the number of models."""
    columns = ("uid", "label", "embedding")
    train, test = stored(train.select(*columns), "train"), stored(test.select(*columns), "test")
    plain = {False: (train, test)}
    if any(scaled for scaled, _ in kinds):
        plain[True] = (stored(standardise(train, train), "train-scaled"), stored(standardise(test, train), "test-scaled"))

    def one(kind: tuple[bool, bool]) -> tuple[DataFrame, DataFrame]:
        fit, held = plain[kind[0]]
        return stored(class_weights(oversample(fit) if kind[1] else fit), "fit"), held

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(kinds, pool.map(inheritable_thread_target(train.sparkSession)(one), kinds), strict=True))


def predictions(estimator, fit: DataFrame, held: DataFrame) -> DataFrame:
    """Test rows (uid, label, pred_proba) of one model."""
    if isinstance(estimator, RbfSvm):
        return estimator.fit(fit).transform(held).select("uid", "label", "pred_proba")
    width = fit.agg(F.max(F.size("embedding"))).first()[0] or 1
    if isinstance(estimator, (RandomForestClassifier, GBTClassifier)):
        n, features = fit.count(), with_features(held).select("uid", "label", "features")
        plain = fit.filter(F.col("label").isin(0, 1)).count() == n
        if plain and trees.fits_task(n + held.count(), width):
            return trees.predictions(estimator, with_features(fit), features, width)
        if plain and isinstance(estimator, RandomForestClassifier):
            return trees.forest_in_parts(estimator, with_features(in_pieces(fit, width)), features, n)
    if isinstance(estimator, LogisticRegression) and estimator.getElasticNetParam() > 0 and linear.fits_driver(n := fit.count(), width, PIECE):
        weights, bias = linear.fit_logistic(with_features(in_pieces(fit, width)), penalised(estimator, n).getRegParam(), estimator.getElasticNetParam())
        return held.select("uid", "label", linear_proba(weights.tolist(), bias).alias("pred_proba"))
    model = without_summary(penalised(estimator, fit.count()).fit(with_features(in_pieces(fit, width))))
    return model.transform(with_features(held)).select("uid", "label", vector_to_array("probability")[1].alias("pred_proba"))


def run_name(name: str, smote: bool) -> str:
    return name + (" + SMOTE" if smote else "")


def compare(train: DataFrame, test: DataFrame, dim: int, runs: list[tuple[str, bool]],
            models: dict | None = None, parallel: int = 8) -> DataFrame:
    """One stored row of metrics per (model, with oversampling).

    Scaled and oversampled tables are made once and shared.  Models are fitted at the same time, as a fit of many short
    jobs leaves most of a cluster idle; each writes its predictions, and all are evaluated in one pass.
    """
    models, spark = models or estimators(), train.sparkSession
    sets = training_sets(fixed_length(train, dim), fixed_length(test, dim), {(models[name][1], smote) for name, smote in runs})

    def one(run: tuple[str, bool]) -> DataFrame:
        name, smote = run
        estimator, scaled = models[name]
        scored = predictions(estimator, *sets[scaled, smote]).withColumn("model", F.lit(run_name(name, smote)))
        return materialise(scored, "scored")

    slow_first = sorted(runs, key=lambda run: run[0] != "GradientBoosting")
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(one), slow_first))
    scored = spark.createDataFrame([], parts[0].schema)
    for part in parts:
        scored = scored.unionByName(part)
    return materialise(evaluate(scored, groups=["model"]).select(*RESULT_COLUMNS), "results")


def best_model(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("f1"), "model").limit(1)


# ---------------------------------------------------------------- scoring

WIDE = 128


def linear_proba(weights: list[float], bias: float, embedding: str = "embedding") -> Column:
    """Sigmoid of a fixed linear model, inside the scan stage: no vector conversion and no shuffle.

    Short embeddings are summed in the JVM; wide ones go through Arrow as one matrix product per batch.
    An embedding that is NULL, of another length or with a NULL element gives NULL on either way.
    """
    if len(weights) > WIDE:
        return _matrix_proba(weights, bias)(F.col(embedding))
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(F.col(embedding), w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-(dot + bias)))


def _matrix_proba(weights: list[float], bias: float):
    w = np.asarray(weights, dtype="float64")

    @F.arrow_udf("double")
    def proba(e: pa.Array) -> pa.Array:
        known = pc.fill_null(pc.equal(pc.list_value_length(e), len(w)), False).to_numpy(zero_copy_only=False)
        if e.flatten().null_count:
            known &= np.array([v.is_valid and v.values.null_count == 0 for v in e])
        out = np.full(len(e), np.nan)
        if known.any():
            x = e.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w)).astype("float64")
            out[known] = 1 / (1 + np.exp(-(x @ w + bias)))
        return pa.array(out, mask=~known)

    return proba


def score_and_keep(df: DataFrame, proba: Column, threshold: float = 0.5, inclusive: bool = True,
                   keep: list[str] = ("uid", "url", "score")) -> DataFrame:
    """Slim rows at or above the threshold; the embedding never leaves the scan."""
    scored = df.withColumn("pred_proba", proba).select(*[c for c in keep if c in df.columns], "pred_proba")
    return scored.filter(F.col("pred_proba") >= threshold if inclusive else F.col("pred_proba") > threshold)


def predicted_labels(df: DataFrame, proba: Column, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("pred_proba", proba).withColumn("pred_label", (F.col("pred_proba") >= threshold).cast("int"))


def score_with_model(model: PipelineModel, df: DataFrame, embedding: str = "embedding") -> DataFrame:
    scored = model.transform(with_features(df, embedding))
    return scored.withColumn("pred_proba", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", "scaled")


def scaled_pipeline(estimator) -> Pipeline:
    """Scaler and estimator as one saveable model."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, estimator.copy({estimator.featuresCol: "scaled"})])


def fit_pipeline(train: DataFrame, name: str = "LogisticRegression") -> PipelineModel:
    """A saveable model on class-weighted labelled rows: scaling and estimator in one."""
    model = scaled_pipeline(penalised(estimators()[name][0], train.count())).fit(with_features(class_weights(train)))
    without_summary(model.stages[-1])
    return model


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_latest_model(spark, paths: list[str]) -> tuple[str, PipelineModel]:
    """The first of several places, latest iteration first and baseline last, that holds a model."""
    for path in paths:
        if path_exists(spark, f"{path.rstrip('/')}/metadata"):
            return path, PipelineModel.load(path)
    raise FileNotFoundError(f"no model in {paths}")


# ---------------------------------------------------------------- iterations

def model_trends(history: DataFrame) -> DataFrame:
    """First against last F1 per model with two or more iterations: (model, iteration, f1) in."""
    w = history.groupBy("model").agg(
        F.count("*").alias("n"), F.min_by("f1", "iteration").alias("baseline_f1"),
        F.max_by("f1", "iteration").alias("latest_f1"))
    old, new = F.col("baseline_f1"), F.col("latest_f1")
    return w.filter(F.col("n") >= 2).select("model", old, new, (new - old).alias("change"),
                                            percent_change(old, new).alias("change_pct"),
                                            direction(old, new).alias("trend"))


def most_improved(trends: DataFrame, k: int = 3) -> DataFrame:
    return trends.orderBy(F.desc(F.round("change", 12)), "model").limit(k)


def verdict(baseline: DataFrame, iteration: DataFrame) -> DataFrame:
    """Compare two one-row metric tables and name the outcome by which metrics rose."""
    metrics = ["f1", "precision", "recall", "roc_auc", "pr_auc"]
    both = baseline.select(F.struct(*metrics).alias("old")).withColumn(
        "new", iteration.select(F.struct(*metrics).alias("new")).scalar())
    rose = {m: F.col(f"new.{m}") > F.col(f"old.{m}") for m in metrics}
    any_rose = rose["f1"] | rose["precision"] | rose["roc_auc"]
    name = (F.when(rose["f1"] & rose["recall"], "clearly better").when(rose["recall"], "better")
            .when(rose["pr_auc"], "slightly better").when(any_rose, "partly better").otherwise("no improvement"))
    return both.select(*[(F.col(f"new.{m}") - F.col(f"old.{m}")).alias(f"{m}_change") for m in metrics],
                       name.alias("verdict"))
