"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftwell.llm.common import add_columns, fresh, held_out, materialise, slices, table, without

EXAMPLES = 3_000
"""About how many labelled rows of each label the model is fitted on; the sample follows a hash of the row's key."""
TELLING, FREQUENT = 1_500, 60
"""Terms of the vocabulary: those most associated with label 1, and the most frequent ones, which tell a text's length."""
LEAST_Z = 4.0
NEAREST, BLOCK = 15, 64

_words = re.compile(r"[^\W\d_]+").findall


def word_terms(word: str) -> list[str]:
    """A word is counted as itself and, if longer, by its beginnings of four to six letters."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


class Vectors:
    """Unit TF-IDF vectors over a fixed vocabulary: sorted term numbers and weights."""

    def __init__(self, terms: list[str], idf: np.ndarray):
        self.number, self.idf, self.cache = {t: i for i, t in enumerate(terms)}, idf, {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts: Counter[int] = Counter()
        if len(self.cache) > 200_000:
            self.cache.clear()
        for word, n in Counter(_words((text or "").lower())).items():
            known = self.cache.get(word)
            if known is None:
                known = tuple(i for i in map(self.number.get, word_terms(word)) if i is not None)
                if len(word) <= 40:
                    self.cache[word] = known
            for i in known:
                counts[i] += n
        ids = np.array(sorted(counts), np.int64)
        weights = (1 + np.log([counts[i] for i in ids.tolist()])) * self.idf[ids] if len(ids) else np.zeros(0)
        norm = np.sqrt((weights * weights).sum())
        return (ids, weights / norm) if norm else (ids[:0], weights[:0])


class BlockMaxIndex:
    """Posting lists cut into blocks of examples, each with its largest weight.

    Only blocks that hold a posting are stored; the others share an empty one.  A search adds up the bounds of
    all blocks, visits those with the largest first, and leaves those that cannot hold a nearer neighbour.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n, blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        table = np.zeros((terms, blocks * BLOCK), np.float32)
        for row, (ids, weights) in enumerate(vectors):
            table[ids, row] = weights
        table = table.reshape(terms, blocks, BLOCK)
        self.largest = table.max(2)
        self.place = np.zeros((terms, blocks), np.int64)
        used = self.largest > 0
        self.place[used] = np.arange(1, used.sum() + 1)
        self.postings = np.concatenate((np.zeros((1, BLOCK), np.float32), table[used]))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, skip: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties: earlier example), those without a common term and those to skip left out."""
        if not len(ids) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        w = weights.astype(np.float32)
        bound = w @ self.largest[ids]
        order = np.argsort(-bound, kind="stable")
        places = self.place[ids]
        found, scores, low, at, step = [], [], 0.0, 0, 4
        while at < len(order) and bound[order[at]] + 1e-5 >= low and bound[order[at]] > 0:
            blocks = order[at : at + step]
            blocks = blocks[(bound[blocks] + 1e-5 >= low) & (bound[blocks] > 0)]
            score = np.einsum("t,tbx->bx", w, self.postings[places[:, blocks]])
            rows = blocks[:, None] * BLOCK + np.arange(BLOCK)
            fits = (score > 0) & (score >= low)
            for row in skip:
                fits &= rows != row
            found.append(rows[fits])
            scores.append(score[fits])
            all_scores = np.concatenate(scores)
            if len(all_scores) >= k:
                low = float(np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k])
            at, step = at + step, step * 2
        rows, score = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(scores or [np.zeros(0)])
        pick = np.lexsort((rows, -score))[:k]
        return rows[pick], score[pick].astype(np.float64)


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    keys: list[int]
    labels: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    base: float
    steps: np.ndarray  # votes at which the calibrated share changes
    shares: np.ndarray


def vote(labels: np.ndarray, rows: np.ndarray, score: np.ndarray, base: float) -> float:
    """Share of label 1 among the neighbours, each weighted by closeness; the base rate has a small weight of its own."""
    weight = 1 / (1.02 - np.minimum(score, 1.0))
    return float((weight @ labels[rows] + base) / (weight.sum() + 1)) if len(rows) else base


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, least: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Monotone steps from vote to weighted share of label 1, by pooling adjacent violators and groups below ``least``."""
    groups: list[list[float]] = []
    for v, y, w in sorted(zip(votes.tolist(), labels.tolist(), weights.tolist(), strict=True)):
        groups.append([v, y * w, w])
        while len(groups) > 1 and (groups[-2][1] * groups[-1][2] >= groups[-1][1] * groups[-2][2] or groups[-2][2] < least):
            v, y, n = groups.pop()
            groups[-1][1] += y
            groups[-1][2] += n
    return np.array([g[0] for g in groups]), np.array([(g[1] + 0.5) / (g[2] + 1) for g in groups])


def rows_of_keys(keys: Sequence[int | None]) -> dict[int, list[int]]:
    """The examples that belong to each known key."""
    rows: dict[int, list[int]] = {}
    for row, key in enumerate(keys):
        if key is not None:
            rows.setdefault(key, []).append(row)
    return rows


def fit(examples: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = EXAMPLES, natural: dict[int, int] | None = None) -> Model:
    """Fit on labelled texts: the label must be 0 or 1, other rows teach nothing.

    At most about ``per_label`` rows of each label are used, chosen by a hash of the key; vocabulary, vectors and
    the calibration by leaving one out come from them.  ``natural`` has the labels' numbers where ``examples`` is a
    sample already.  Collected are that sample's vectors and the vocabulary.
    """
    sizes = {r[0]: r[1] for r in examples.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | (F.col(label) == value) & (h * F.lit(n) <= F.lit(float(per_label * (1 << 30))))
    sample = materialise(examples.where(keep).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")), "examples")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for value, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                for term in {t for w in set(_words((value.as_py() or "").lower())) for t in word_terms(w)}:
                    counts.setdefault(term, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[y] for c in counts.values()], pa.int64()) for y in (0, 1))], names=["term", "n0", "n1"])

    total = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    t0, t1 = max(1, total.get(0, 0)), max(1, total.get(1, 0))
    df = materialise(sample.mapInArrow(terms, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "terms")
    p = (F.col("n0") + F.col("n1") + 1) / (t0 + t1 + 2)
    z = (F.col("n1") / t1 - F.col("n0") / t0) / F.sqrt(p * (1 - p) * (1 / t0 + 1 / t1))
    telling = df.where(z >= LEAST_Z).orderBy(F.desc(z), "term").limit(TELLING)
    frequent = df.where(~F.col("term").endswith("*")).orderBy(F.desc(F.col("n0") + F.col("n1")), "term").limit(FREQUENT)
    rows = sorted(set(map(tuple, telling.collect() + frequent.collect())))
    names, idf = [r[0] for r in rows], np.array([np.log((1 + t0 + t1) / (1 + r[1] + r[2])) + 1 for r in rows])
    shared = sample.sparkSession.sparkContext.broadcast((names, idf))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Vectors(*shared.value)
        for batch in batches:
            found = [coder.of(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["key", "label", "ids", "weights"])

    kept = sorted(sample.mapInArrow(vectors, "key long, label int, ids array<long>, weights array<double>").collect(), key=lambda r: (r["key"] is None, r["key"] or 0))
    pairs = [(np.array(r["ids"], np.int64), np.array(r["weights"])) for r in kept]
    labels = np.array([r["label"] for r in kept], np.float64)
    base = float(labels.mean()) if len(labels) else 0.0
    index = BlockMaxIndex(pairs, len(names))
    own = rows_of_keys([r["key"] for r in kept])
    votes = np.array([vote(labels, *index.nearest(*v, NEAREST, own.get(r["key"], [i])), base) for i, (v, r) in enumerate(zip(pairs, kept, strict=True))])
    # a label that was sampled more densely than the other counts less in the calibrated share
    whole = natural or sizes
    dense = np.array([whole.get(int(y), 1) / max(1, total.get(int(y), 1)) for y in labels])
    steps, shares = calibrate(votes, labels, dense / dense.mean()) if len(labels) else (np.zeros(1), np.zeros(1))
    return Model(names, idf, [r["key"] for r in kept], labels, pairs, base, steps, shares)


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Add ``score``, and the keys of the nearest examples with their cosines as ``evidence`` and ``closeness``.

    A document's own label never votes: examples of its key are skipped, as they were when the votes were calibrated.
    Without a column ``key``, and for a null key, nothing is skipped.  Whole texts are read.  A text without a term of the vocabulary, null and empty ones too, gets the calibrated
    base rate and no evidence; so does every text if nothing was learned (score 0).  Columns of these names are replaced.
    The model is broadcast; its size is bound by ``EXAMPLES`` and the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        m = shared.value
        coder, index, own = Vectors(m.terms, m.idf), BlockMaxIndex(m.vectors, len(m.terms)), rows_of_keys(m.keys)

        def one(value: str | None, of: int | None) -> tuple[float, list, list]:
            rows, close = index.nearest(*coder.of(value), NEAREST, own.get(of, ()))
            at = np.searchsorted(m.steps, vote(m.labels, rows, close, m.base), side="right") - 1
            return float(m.shares[max(0, at)]), [m.keys[i] for i in rows.tolist()], close.tolist()

        for batch in texts:
            whole, keys = batch.field(0), iter(batch.field(1).to_pylist())
            found = [one(v.as_py(), next(keys)) for part in slices(whole) for v in part]
            yield [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))]

    new = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("closeness", T.ArrayType(T.DoubleType()))])
    if keep is None:
        keep = without(docs, new.names).columns
    both, id_ = fresh(docs, "text_and_key"), F.col(f"`{key}`") if key in docs.columns else F.lit(None)
    return add_columns(docs.withColumn(both, F.struct(F.col(f"`{text}`").alias("text"), id_.cast("long").alias("key"))), both, new, make, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(F.col("doc_id")))
    out = score(docs, fit_joined(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def fit_joined(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES) -> Model:
    """Fit on documents and their labels in another table; only sampled label rows, a bounded number, are sent to the documents."""
    sizes = {r[0]: r[1] for r in labels.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    h, keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), F.lit(False)
    for value, n in sizes.items():
        keep = keep | (F.col("toxic") == value) & (h * F.lit(n) <= F.lit(float(per_label * (1 << 30))))
    return fit(docs.join(F.broadcast(labels.where(keep).select("doc_id", "toxic")), "doc_id"), per_label=per_label, natural=sizes)


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
