"""Forests and boosted trees grown inside tasks, from rows cut into bins of one byte a feature.

A fit by Spark is a job per level, and a forest of full depth, with all its nodes, lives on the driver.  Here every task
gets all rows, at a byte a feature, and grows trees of its own: a share of a forest's, or all of a boosting run, whose
trees follow each other.  It scores the test rows as it goes, so no tree ever leaves it.  The methods are those of Spark:
Gini or variance gain over 32 bins, a feature subset per node, Poisson bags of a forest, merged leaves of equal class,
and boosting of twice the logistic loss.  Rows that are too many for a task are left to Spark (``fits_task``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from siftwell.operators.kernel import without_summary
from siftwell.session import materialise

BINS = 32
BLOCK = 4096
"""Rows that are packed into one row of a table."""
TASK_BYTES = 160 << 20
"""Bytes of binned rows that a task may hold; it takes about twice that."""
CELLS = 1 << 19
"""Entries of the counts of the nodes that are split at once."""


# ---------------------------------------------------------------- one tree


def _descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x`` (rows, features)."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        node = at[rows]
        at[rows] = child[node] + (x[rows, feature[node]] > cut[node])
    return at


def _subsets(rng: np.random.Generator, nodes: int, width: int, n: int) -> np.ndarray:
    """``n`` features of each node."""
    if n >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return rng.random((nodes, width), dtype=np.float32).argpartition(n - 1, axis=1)[:, :n]


def _class_splits(x, y, weight, bag, rows, at, totals, which, least, features, rng):
    """``feature, cut`` of the best split of the nodes ``which``, -1 where none gains."""
    feature, cut = np.full(len(totals), -1), np.zeros(len(totals), np.uint8)
    step = max(1, CELLS // (features * BINS))
    for low in range(0, len(which), step):
        nodes = which[low : low + step]
        mine = rows, at
        if len(nodes) < len(totals):
            place = np.full(len(totals), -1)
            place[nodes] = np.arange(len(nodes))
            here = place[at] >= 0
            mine = rows[here], place[at[here]]
        r, a = mine
        picked = _subsets(rng, len(nodes), x.shape[1], features)
        left, n = np.empty((len(nodes), features, BINS, 2)), np.empty((len(nodes), features, BINS))
        for j in range(features):
            key = a * BINS + x[r, picked[a, j]]
            n[:, j] = np.bincount(key, bag[r], len(nodes) * BINS).reshape(-1, BINS)
            left[:, j] = np.bincount(2 * key + y[r], weight[r], len(nodes) * BINS * 2).reshape(-1, BINS, 2)
        left, n = left.cumsum(2)[:, :, :-1], n.cumsum(2)
        right, all_n = totals[nodes][:, None, None] - left, n[:, :, -1:]
        n = n[:, :, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left**2).sum(3) / left.sum(3) + (right**2).sum(3) / right.sum(3)
        gain[(n < least) | (all_n - n < least) | ~np.isfinite(gain)] = -np.inf
        gain = gain.reshape(len(nodes), -1)
        best = gain.argmax(1)
        t = totals[nodes]
        good = gain[np.arange(len(nodes)), best] > (t**2).sum(1) / t.sum(1) * (1 + 1e-12)
        feature[nodes[good]] = picked[np.arange(len(nodes)), best // (BINS - 1)][good]
        cut[nodes[good]] = (best % (BINS - 1))[good]
    return feature, cut


def class_tree(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bag: np.ndarray, depth: int, least: int, features: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """``feature, cut, child, share``: a tree by Gini gain over rows ``x`` (rows, features) of class ``y``, each taken ``bag`` times.

    A row goes to ``child``, or to the one after it if its bin is above the cut; ``share`` is that of class 1.  Both sides
    of a split have ``least`` rows.  Two leaves that name the same class are merged.
    """
    weight, rows = weight * bag, np.flatnonzero(bag)
    at, levels, start, n = np.zeros(len(rows), np.int64), [], 0, 1
    for level in range(depth + 1):
        totals = np.bincount(2 * at + y[rows], weight[rows], 2 * n).reshape(n, 2)
        which = np.flatnonzero(totals.min(1) > 0) if level < depth else np.zeros(0, np.int64)
        feature, cut = _class_splits(x, y, weight, bag, rows, at, totals, which, least, features, rng)
        split = feature >= 0
        child = np.where(split, start + n + 2 * (np.cumsum(split) - 1), 0)
        levels.append((feature, cut, child, totals))
        stays = split[at]
        rows, at = rows[stays], at[stays]
        at = child[at] - start - n + (x[rows, feature[at]] > cut[at])
        start, n = start + n, 2 * int(split.sum())
        if not n:
            break
    feature, cut, child, totals = (np.concatenate(parts) for parts in zip(*levels, strict=True))
    ones = totals[:, 1] > totals[:, 0]
    end = len(feature)
    for size in reversed([len(part[0]) for part in levels]):
        node = np.arange(end - size, end)
        end -= size
        node = node[feature[node] >= 0]
        left = child[node]
        merged = (feature[left] < 0) & (feature[left + 1] < 0) & (ones[left] == ones[left + 1])
        feature[node[merged]] = -1
    return feature, cut, child, totals[:, 1] / np.maximum(totals.sum(1), 1e-300)


def _moments(xt: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per node, feature and bin: rows, weight, and weighted target."""
    out = np.empty((3, n, len(xt), BINS))
    base, w, t = at * BINS, weight[rows], target[rows]
    for f, values in enumerate(xt):
        key = base + values[rows]
        for k, part in enumerate((None, w, t)):
            out[k, :, f] = np.bincount(key, part, n * BINS).reshape(n, BINS)
    return out


def value_tree(xt: np.ndarray, target: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, features: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """``feature, cut, child, value``: a tree by variance gain over the given rows of ``xt`` (features, rows).

    Of two children only the smaller is counted; the other has the rest of its parent.
    """
    weighted = target * weight
    at, levels, start, n = np.zeros(len(rows), np.int64), [], 0, 1
    counts = _moments(xt, rows, at, 1, weight, weighted)
    for level in range(depth + 1):
        _, w, t = totals = counts[:, :, 0].sum(2)
        feature, cut = np.full(n, -1), np.zeros(n, np.uint8)
        if level < depth:
            left = counts.cumsum(3)
            right = totals[:, :, None, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[2] ** 2 / left[1] + right[2] ** 2 / right[1]
            gain[(left[0] < 0.5) | (right[0] < 0.5) | ~np.isfinite(gain)] = -np.inf
            if features < len(xt):
                allowed = np.zeros((n, len(xt)), bool)
                np.put_along_axis(allowed, _subsets(rng, n, len(xt), features), True, 1)
                gain[~allowed] = -np.inf
            gain = gain.reshape(n, -1)
            best = gain.argmax(1)
            good = gain[np.arange(n), best] > t**2 / w + 1e-12 * np.abs(w)
            feature[good], cut[good] = (best // BINS)[good], (best % BINS)[good]
        split = feature >= 0
        child = np.where(split, start + n + 2 * (np.cumsum(split) - 1), 0)
        levels.append((feature, cut, child, t / w))
        parents = np.flatnonzero(split)
        if not len(parents):
            break
        stays = split[at]
        rows, at = rows[stays], at[stays]
        at = child[at] - start - n + (xt[feature[at], rows] > cut[at])
        start, n = start + n, 2 * len(parents)
        if level + 1 == depth:
            totals = np.stack([np.bincount(at, v, n) for v in (None, weight[rows], weighted[rows])])
            levels.append((np.full(n, -1), np.zeros(n, np.uint8), np.zeros(n, np.int64), totals[2] / totals[1]))
            break
        sizes = np.bincount(at, minlength=n).reshape(-1, 2)
        small = sizes.argmin(1)
        here = at % 2 == small[at // 2]
        part = _moments(xt, rows[here], at[here] // 2, len(parents), weight, weighted)
        below = np.empty((3, n, *counts.shape[2:]))
        below[:, 2 * np.arange(len(parents)) + small] = part
        below[:, 2 * np.arange(len(parents)) + 1 - small] = counts[:, parents] - part
        counts = below
    feature, cut, child, value = (np.concatenate(parts) for parts in zip(*levels, strict=True))
    return feature, cut, child, value


# ---------------------------------------------------------------- models


def forest_share(fit: tuple, held: np.ndarray, trees: range, params: dict) -> np.ndarray:
    """The sum over the given trees of the share of class 1 in each held row's leaf."""
    x, y, weight = fit
    total = np.zeros(len(held))
    for k in trees:
        rng = np.random.default_rng([params["seed"] & 0xFFFFFFFF, k])
        bag = rng.poisson(params["rate"], len(x)).astype(np.float64)
        if not bag.any():
            bag[:] = 1
        feature, cut, child, share = class_tree(x, y, weight, bag, params["depth"], params["least"], params["features"], rng)
        total += share[_descend(held, feature, cut, child)]
    return total


def boosted_margin(fit: tuple, held: np.ndarray, params: dict) -> np.ndarray:
    """The margin of each held row after all rounds; the first tree is fitted to the labels and counts in full."""
    x, y, weight = fit
    xt, sign = np.ascontiguousarray(x.T), 2.0 * y - 1
    rng = np.random.default_rng([params["seed"] & 0xFFFFFFFF])
    own, out = np.zeros(len(x)), np.zeros(len(held))
    for k in range(params["rounds"]):
        target = sign if k == 0 else 4 * sign / (1 + np.exp(2 * sign * own))
        rows = np.flatnonzero(rng.random(len(x)) < params["rate"])
        if not len(rows):
            continue
        feature, cut, child, value = value_tree(xt, target, weight, rows, params["depth"], params["features"], rng)
        step = 1.0 if k == 0 else params["step"]
        own += step * value[_descend(x, feature, cut, child)]
        out += step * value[_descend(held, feature, cut, child)]
    return out


# ---------------------------------------------------------------- tables


def fits_task(rows: int, width: int) -> bool:
    return rows * (width + 24) <= TASK_BYTES


def thresholds(vectors: DataFrame, width: int) -> np.ndarray:
    """(features, up to BINS - 1) increasing values at which the column ``v`` of all rows is cut: its minimum and quantiles."""
    shares = [0.0, *[k / (BINS - 1) for k in range(1, BINS - 1)]]
    found = vectors.agg(*[F.percentile_approx(F.get("v", F.lit(i)), shares).alias(f"q{i}") for i in range(width)]).first()
    return np.array([q or [0.0] * len(shares) for q in found], dtype=np.float64)


def _blocks(rows: DataFrame, cuts: np.ndarray, kept: list[str]) -> DataFrame:
    """``block, bins`` and arrays of the kept columns: rows packed together, stored."""
    names = ["block", "bins", *kept]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in kept}
    unit = 1 << 32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() * unit
        for whole in batches:
            for start in range(0, len(whole), BLOCK):
                batch = whole.slice(start, BLOCK)
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                x = np.stack([np.searchsorted(c, v[:, f]) for f, c in enumerate(cuts)], 1).astype(np.uint8)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), pa.concat_arrays([batch.column(k + 1)])) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([x.tobytes()], pa.binary()), *lists], names=names)
                block += 1

    schema = ", ".join(["block long", "bins binary", *[f"`{c}` array<{kinds[c]}>" for c in kept]])
    return materialise(rows.select("v", *kept).mapInArrow(pack, schema), "blocks")


def predictions(estimator, fit: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """Test rows (uid, label, pred_proba) of a forest or of boosted trees; both tables have uid, label and a vector ``features``."""
    boosts = isinstance(estimator, GBTClassifier)
    params = {"seed": estimator.getSeed(), "rate": estimator.getSubsamplingRate(), "depth": estimator.getMaxDepth(), "least": estimator.getMinInstancesPerNode()}
    if boosts:
        share = estimator.getFeatureSubsetStrategy()
        params |= {"rounds": estimator.getMaxIter(), "step": estimator.getStepSize(), "features": width if share in ("auto", "all") else int(np.ceil(float(share) * width))}
    else:
        params |= {"features": int(np.ceil(np.sqrt(width))) if estimator.getNumTrees() > 1 else width}
    trees = 1 if boosts else estimator.getNumTrees()
    fit = fit.select(vector_to_array("features").alias("v"), F.col("label").cast("long").alias("label"), F.col("weight").cast("double").alias("weight"))
    cuts = thresholds(fit, width)
    fit = _blocks(fit, cuts, ["label", "weight"])
    held = _blocks(held.select(vector_to_array("features").alias("v"), "uid", "label"), cuts, ["uid", "label"])
    tasks = min(trees, fit.sparkSession.sparkContext.defaultParallelism * 2)
    every = fit.withColumn("test", F.lit(False)).unionByName(held.select("block", "bins", F.lit(True).alias("test")), allowMissingColumns=True)
    sent = every.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tested, task = [], [], None
        for batch in batches:
            for row in range(len(batch)):
                block, bins, label, weight, test, task = (batch.column(c)[row] for c in ("block", "bins", "label", "weight", "test", "task"))
                x = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width).copy()
                if test.as_py():
                    tested.append((block.as_py(), x))
                else:
                    known.append((block.as_py(), x, *(v.values.to_numpy(zero_copy_only=False).copy() for v in (label, weight))))
        if not tested:
            return
        names, parts = zip(*sorted(tested, key=lambda part: part[0]), strict=True)
        ends, tested = np.cumsum([len(p) for p in parts]), np.concatenate(parts)
        _, *fitted = (list(c) for c in zip(*sorted(known, key=lambda part: part[0]), strict=True))
        del known, parts
        fitted = tuple(np.concatenate(c) for c in fitted)
        found = boosted_margin(fitted, tested, params) if boosts else forest_share(fitted, tested, range(task.as_py(), trees, tasks), params)
        values = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(found))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), values], names=["block", "score"])

    scores = materialise(sent.mapInArrow(grow, "block long, score array<double>"), "scores")
    each = scores.select("block", F.posexplode("score").alias("at", "score")).groupBy("block", "at").agg(F.sum("score").alias("score"))
    score = F.col("score")
    rows = held.select("block", F.posexplode(F.arrays_zip("uid", "label")).alias("at", "row")).select("block", "at", "row.uid", "row.label")
    return rows.join(each, ["block", "at"]).select("uid", "label", (1 / (1 + F.exp(-2 * score)) if boosts else score / trees).alias("pred_proba"))


def forest_in_parts(estimator: RandomForestClassifier, fit: DataFrame, held: DataFrame, n: int, nodes: int = 4_000_000) -> DataFrame:
    """Test rows (uid, label, pred_proba) of a forest fitted by Spark on rows too many for a task, some trees at a time.

    A tree has up to as many nodes as rows; the driver has about ``nodes`` of them at once.  The sum of the
    parts' votes is the forest's.
    """
    trees, share = estimator.getNumTrees(), max(1, min(estimator.getNumTrees(), nodes // max(1, n)))
    out = None
    for k in range(0, trees, share):
        part = estimator.copy({estimator.numTrees: min(share, trees - k), estimator.seed: estimator.getSeed() + k, estimator.featureSubsetStrategy: "sqrt" if trees > 1 else "auto"})
        source = held.withColumn("votes", F.lit(0.0)) if out is None else out
        scored = without_summary(part.fit(fit)).transform(source)
        out = materialise(scored.select("uid", "label", "features", (F.col("votes") + vector_to_array("rawPrediction")[1]).alias("votes")), "votes")
    return out.select("uid", "label", (F.col("votes") / trees).alias("pred_proba"))
