"""An RBF-kernel support-vector machine with probabilities, from Spark's linear one on a Nystroem map.

The map takes a row to its kernel values with a bounded number of landmark rows, multiplied by the inverse root of the
landmarks' own kernel matrix; inner products of mapped rows are then the kernel's projection on the landmarks (with all
training rows as landmarks, the kernel itself).  The hinge loss is minimised by ``LinearSVC``.  Probabilities follow
Platt: a sigmoid of the decision value, fitted on decision values that each fold gets from a machine trained on the others.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwell.operators.sampling import draw_key, take_random
from siftwell.session import materialise

LANDMARKS = 512
FOLDS = 5
LIFT_ROWS = 512
"""Rows whose kernel values with the landmarks are in memory at once, whatever the size of an Arrow batch."""

PIECE = 16 << 20
"""Bytes of features in a partition of training rows."""


@dataclass(frozen=True)
class NystroemMap:
    """Landmark rows, the kernel's width, and the inverse root of the landmarks' kernel matrix."""

    landmarks: np.ndarray
    gamma: float
    root: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, n: int = LANDMARKS, gamma: float | None = None, seed: int = 42) -> NystroemMap:
        """Landmarks are at most ``n`` random rows (uid, embedding); ``gamma`` defaults to 1/dim, right for standardised input."""
        picked = take_random(rows.select("uid", "embedding"), n, "uid", seed).orderBy("uid").collect()
        points = np.array([r["embedding"] for r in picked], dtype="float64")
        gamma = gamma or 1.0 / points.shape[1]
        values, vectors = np.linalg.eigh(rbf(points, points, gamma))
        kept = values > 1e-9 * values[-1]
        return cls(points, gamma, vectors[:, kept] / np.sqrt(values[kept]))

    def lift(self, embedding: Column) -> Column:
        """The mapped row, an array."""
        landmarks, gamma, root = self.landmarks, self.gamma, self.root

        @F.pandas_udf("array<double>")
        def mapped(e: pd.Series) -> pd.Series:
            rows = e.to_numpy()
            parts = [rbf(np.stack(rows[i:i + LIFT_ROWS]), landmarks, gamma) @ root for i in range(0, len(rows), LIFT_ROWS)]
            return pd.Series([row for part in parts for row in part], index=e.index, dtype="object")

        return mapped(embedding)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) of each row of a to each of b."""
    distance = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(distance, 0))


def in_pieces(rows: DataFrame, width: int, piece: int = PIECE) -> DataFrame:
    """Training rows of ``width`` features in equal partitions of about ``piece`` bytes.

    A fit is hundreds of passes over its rows.  A stored table is split by its bytes, but rows come only from the splits that
    begin a row group: one task would have all rows, and the empty others cost each pass their tasks and a stage more.
    """
    return rows.repartition(max(1, -(-rows.count() * 8 * width // piece)))


def without_summary(model):
    """A fitted model that leaves its training summary behind.

    The summary of a binary classifier holds the session, which cannot go to the tasks once anything in it was observed.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


@dataclass(frozen=True)
class RbfModel:
    kernel: NystroemMap
    machine: object
    slope: float
    offset: float

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``pred_proba``."""
        lifted = rows.withColumn("features", array_to_vector(self.kernel.lift(F.col("embedding"))))
        decision = vector_to_array("rawPrediction")[1]
        scored = self.machine.transform(lifted).withColumn("pred_proba", 1 / (1 + F.exp(-(self.slope * decision + self.offset))))
        return scored.drop("features", "rawPrediction", "prediction")


@dataclass(frozen=True)
class RbfSvm:
    """The estimator: ``C`` is the usual penalty of the hinge loss, so Spark's ``regParam`` is 1 / (C n)."""

    C: float = 1.0
    landmarks: int = LANDMARKS
    gamma: float | None = None
    folds: int = FOLDS
    seed: int = 42

    def fit(self, train: DataFrame) -> RbfModel:
        """Fit on rows (uid, label, weight, embedding)."""
        kernel = NystroemMap.fit(train, self.landmarks, self.gamma, self.seed)
        fold = F.pmod(F.conv(F.substring(draw_key(F.col("uid"), self.seed), 1, 8), 16, 10).cast("long"), F.lit(self.folds))
        lifted = in_pieces(train, self.landmarks).select("label", "weight", fold.alias("fold"), array_to_vector(kernel.lift(F.col("embedding"))).alias("features"))
        lifted = materialise(lifted, "lifted")

        def decisions(k: int | None):
            rows = in_pieces(lifted if k is None else lifted.filter(F.col("fold") != k), self.landmarks)
            sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
            if k is not None and not 0 < sizes.n1 < sizes.n:
                return None
            machine = without_summary(LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=200, standardization=False,
                                                regParam=1.0 / (self.C * max(1, sizes.n))).fit(rows))
            if k is None:
                return machine
            return machine.transform(lifted.filter(F.col("fold") == k)).select("label", vector_to_array("rawPrediction")[1].alias("decision"))

        with ThreadPoolExecutor(self.folds + 1) as pool:
            machine, *parts = list(pool.map(inheritable_thread_target(train.sparkSession)(decisions), [None, *range(self.folds)]))
        return RbfModel(kernel, machine, *platt([p for p in parts if p is not None]))


def platt(parts: list[DataFrame]) -> tuple[float, float]:
    """Slope and offset of the sigmoid over held-out decisions (label, decision).

    Targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2): each row stands for both classes with these weights.
    """
    if not parts:
        return 1.0, 0.0
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = materialise(rows, "decisions")
    counts = rows.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).first()
    target = F.when(F.col("label") == 1, (counts.n1 + 1) / (counts.n1 + 2)).otherwise(1 / (counts.n0 + 2))
    both = F.inline(F.array(F.struct(F.lit(1.0).alias("target"), F.col("share").alias("w")), F.struct(F.lit(0.0).alias("target"), (1 - F.col("share")).alias("w"))))
    split = rows.withColumn("share", target).select(array_to_vector(F.array("decision")).alias("f"), both)
    fitted = LogisticRegression(featuresCol="f", labelCol="target", weightCol="w", regParam=0.0, maxIter=100).fit(in_pieces(split, 1))
    return float(fitted.coefficients[0]), float(fitted.intercept)
