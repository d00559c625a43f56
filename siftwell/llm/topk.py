"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftwell.llm.common import materialise, table

K = 20
HEAD = 2_048
"""The longest vectors, which every query meets first; a fixed number, so it is broadcast."""
PACK, QUERY_PACK = 4_096, 1_024
LEAD = (8, 24)
"""Rotated dimensions after which candidates are pruned."""


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, ints, norm2`` with ints = floor(64 x); vectors null or with null or non-finite components are left out."""
    ints = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * 64).cast("long"))
    fine = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = df.where(F.col(f"`{vector}`").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), ints.alias("ints"))
    return out.withColumn("norm2", F.aggregate("ints", F.lit(0).cast("long"), lambda a, x: a + x * x))


def _matrix(lists: pa.ListArray | list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for k, row in enumerate(lists):
        values = row.values.to_numpy(zero_copy_only=False) if isinstance(row, pa.ListScalar) else np.asarray(row)
        out[k, : len(values)] = values
    return out


def _gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products over all vectors: one small matrix per task, added up by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    rows = vectors.select("ints").mapInArrow(run, "i long, sums array<double>")
    sums = rows.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((dim, dim))
    for r in sums:
        out[r["i"], r["j"]] = r["x"]
    return out


class Search:
    """Exact inner products of integer matrices, by pruning candidates that cannot reach a query's threshold."""

    def __init__(self, rotation: np.ndarray):
        self.rotation = rotation

    def best(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the candidates, other than itself, that may be among its k best of these."""
        order = np.lexsort((ids, -(c * c).sum(1)))
        ids, c = ids[order], c[order]
        rc, rq = c @ self.rotation, q @ self.rotation
        ends = [d for d in LEAD if d < c.shape[1]]
        rest_c = [np.sqrt((rc[:, d:] ** 2).sum(1)) for d in (0, *ends)]
        rest_q = [np.sqrt((rq[:, d:] ** 2).sum(1)) for d in (0, *ends)]
        exact = int(np.abs(c).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, c.shape[1]) < 1 << 53
        c_f = c.astype(np.float64) if exact else c
        for n, own in enumerate(q_ids):
            low = floor[n]
            slack = 1e-6 * (1 + rest_q[0][n] * rest_c[0].max(initial=0))
            # lengths fall, so those that can reach the threshold come first
            alive = np.arange(int(np.searchsorted(-rest_c[0] * rest_q[0][n], -(low - slack), side="right")))
            partial, start = np.zeros(len(alive)), 0
            for d, rq_d, rc_d in zip(ends, rest_q[1:], rest_c[1:], strict=True):
                partial += rc[alive, start:d] @ rq[n, start:d]
                fits = partial + rq_d[n] * rc_d[alive] >= low - slack
                alive, partial, start = alive[fits], partial[fits], d
            alive = alive[ids[alive] != own]
            score = (c_f[alive] @ (q[n].astype(np.float64) if exact else q[n])).astype(np.int64)
            if len(score) > k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                fits = score >= kth
                alive, score = alive[fits], score[fits]
            pick = np.lexsort((ids[alive], -score))[:k]
            yield n, ids[alive][pick], score[pick]


def top_products(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k candidates of largest integer inner product.

    Both frames are ``vec_id, ints, norm2`` as of :func:`integer_vectors`.  A query is no candidate of its own;
    ties go to the smaller id; shorter vectors are read as padded with zeros.  Repeated ids are repeated
    candidates.  Equal query rows are one query; an id with several vectors is as many queries, each with its list.  Empty frames give no rows.  Exact while 64-bit integers hold the products.

    Every query first meets the ``HEAD`` longest vectors, which gives the score it has to beat.  The candidates,
    sorted by length, and the queries are packed; a pair of packs is one row, dropped before the shuffle of its
    vectors if Cauchy-Schwarz rules it out, else searched by rotated partial sums.  The rotation is that of
    the singular vectors of all candidates, from the sum of their outer products.
    """
    spark = candidates.sparkSession
    candidates = materialise(candidates, "candidates")
    queries = materialise(queries.dropDuplicates(["vec_id", "ints"]).withColumn("query", F.monotonically_increasing_id()), "queries")
    dim = candidates.select(F.max(F.size("ints"))).union(queries.select(F.max(F.size("ints")))).agg(F.max("max(size(ints))")).first()[0] or 1
    rotation = np.linalg.eigh(_gram(candidates, dim))[1][:, ::-1]
    head = candidates.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).collect()
    shared = spark.sparkContext.broadcast((rotation, np.array([r["vec_id"] for r in head], np.int64), _matrix([r["ints"] for r in head], dim)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, ids, c = shared.value
        for batch in batches:
            q_ids, q = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
            low = np.full(len(q), -np.inf)
            for n, _, score in Search(rotation).best(q_ids, q, low, ids, c, k):
                if len(score) >= k:
                    low[n] = score[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], names=["vec_id", "ints", "norm2", "query", "low"])

    def packs(size: int, columns: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), size):
                    part = batch.slice(at, size)
                    ids, m = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim)
                    low = part.column(4).to_numpy() if columns else np.zeros(0)
                    rows = part.column(3).to_numpy(zero_copy_only=False).astype(np.int64) if columns else np.zeros(0, np.int64)
                    norm = float(part.column(2).to_numpy().max()) ** 0.5
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (norm, float(low.min()) if len(low) else 0.0, ids.tobytes(), m.tobytes(), low.tobytes(), rows.tobytes())], names=["norm", "low", "ids", "ints", "lows", "rows"])

        return run

    pack_schema = "norm double, low double, ids binary, ints binary, lows binary, rows binary"
    n_candidates = max(1, -(-candidates.count() // PACK))
    ordered = candidates.repartitionByRange(n_candidates, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    c_packs = materialise(ordered.mapInArrow(packs(PACK, []), pack_schema).withColumn("c", F.monotonically_increasing_id()), "packs")
    lows = queries.select("vec_id", "ints", "norm2", "query").mapInArrow(floors, "vec_id long, ints array<long>, norm2 long, query long, low double")
    spread = lows.repartitionByRange(max(1, -(-queries.count() // QUERY_PACK)), F.desc("norm2"), "vec_id")
    q_packs = materialise(spread.mapInArrow(packs(QUERY_PACK, ["query", "low"]), pack_schema).withColumn("q", F.monotonically_increasing_id()), "packs")
    # which packs meet follows from their lengths and thresholds alone: rows without vectors, one per pack
    bound = q_packs.select("q", F.col("norm").alias("q_norm"), F.col("low").alias("q_low"))
    pairs = c_packs.select("c", "norm").join(bound, F.col("norm") * F.col("q_norm") * (1 + 1e-9) + 1 >= F.col("q_low"))
    both = pairs.select("c", "q").join(c_packs.select("c", F.col("ids").alias("c_ids"), F.col("ints").alias("c_ints")), "c").join(q_packs.select("q", "ids", "ints", "lows", "rows"), "q")

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        finder, out = Search(shared.value[0]), []
        for r in rows.itertuples():
            q_ids, ids, numbers = np.frombuffer(r.ids, np.int64), np.frombuffer(r.c_ids, np.int64), np.frombuffer(r.rows, np.int64)
            q, c = np.frombuffer(r.ints, np.int64).reshape(-1, dim), np.frombuffer(r.c_ints, np.int64).reshape(-1, dim)
            for n, found, score in finder.best(q_ids, q, np.frombuffer(r.lows), ids, c, k):
                out.append((np.full(len(found), numbers[n]), np.full(len(found), q_ids[n]), found, score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("query", "query_id", "vec_id", "score"), columns, strict=True)))

    # a pack of candidates in each group: one pair of packs is in memory at a time
    found = both.groupBy("c", "q").applyInPandas(search, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_products(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op8_exact_topk": op8_exact_topk}
ORACLES = {
    "op8_exact_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
q AS (SELECT *, row_number() OVER () AS query FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0)),
s AS (SELECT query, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}"""
}
