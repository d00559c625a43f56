"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from siftwell.llm.common import add_columns, held_out, materialise, slices, table
from siftwell.session import broadcast_if_small

LEARN_DOCUMENTS = 2_000
"""About how many documents of each language the profiles are fitted on; the sample follows a hash of the row."""
RANKS = 300
LONGEST = 3

_words = re.compile(r"[^\W\d_]+").findall


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, of the 1- to 3-grams of a whole text's words, and their counts.

    A word stands between boundary marks, which are no 1-grams; a code packs its characters in 21 bits each.  All
    distinct words of the text are coded together, as one array of characters with the word each belongs to.  Both
    arrays are empty for a null text or one without a letter.
    """
    words = Counter(_words((text or "").lower()))
    names = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
    size = np.fromiter(map(len, names), np.int64, len(names))
    if not size.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    times = np.fromiter(words.values(), np.int64, len(names))
    c = np.frombuffer(f"_{'__'.join(names)}_".encode("utf-32-le"), np.uint32).astype(np.int64)
    size += 2
    word = np.repeat(np.arange(len(names)), size)
    ends = np.cumsum(size)
    inside = np.ones(len(c), bool)
    inside[ends - 1] = inside[ends - size] = False
    two, three = word[1:] == word[:-1], word[2:] == word[:-2]
    some = size[word] > 2  # a word without a letter has no n-grams
    two &= some[1:]
    codes = np.concatenate((c[inside], (c[:-1] << 21 | c[1:])[two], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[three]))
    weights = times[np.concatenate((word[inside], word[1:][two], word[2:][three]))]
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights, first)


def most_frequent(codes: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The k codes of largest count in that order, ties by code; only those that reach the k-th count are sorted."""
    if len(n) > k:
        reach = n >= np.partition(n, len(n) - k)[len(n) - k]
        codes, n = codes[reach], n[reach]
    return codes[np.lexsort((codes, -n))[:k]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, per_language: int = LEARN_DOCUMENTS) -> DataFrame:
    """Profiles ``lang, code, rank``: the ``RANKS`` most frequent n-grams of each language, rank 0 first.

    Rows with a null language teach nothing.  Of a language with more than ``per_language`` documents about
    that many are read, chosen by a hash of ``key`` (default: the text).  Counts are added up per task and
    language before they are shuffled; ties go to the smaller code.
    """
    key = F.col(f"`{text}`") if key is None else key
    source = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h")).where("lang IS NOT NULL")
    sizes = source.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = broadcast_if_small(materialise(sizes, "sizes"), 64)
    sample = source.join(sizes, "lang").where(F.col("h") * F.col("n") <= F.lit(float(per_language * (1 << 30)))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter[int]] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, n = count_grams(value.as_py())
                sums.setdefault(name, Counter()).update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
        for name, counter in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(counter), pa.string()), pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())], names=["lang", "code", "n"])

    counted = sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counted.withColumn("rank", rank - 1).where(F.col("rank") < RANKS).select("lang", "code", "rank")


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each document by the nearest profile over its whole text.

    A document's distinct n-grams are ranked by count (ties: smaller code); each of its first ``RANKS`` adds
    the distance between its ranks in document and profile, or ``RANKS`` if the profile lacks it.  The
    smallest sum wins (ties: smaller language).  ``score`` is 1 - best / second best sum, 1 if there is one
    language.  Null texts, texts without a letter, and all texts when nothing was learned get ``und`` and 0.
    Columns of these names are replaced.  The profiles are collected: ``RANKS`` rows for each language.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    codes = np.unique(np.array([r["code"] for r in rows], np.int64))
    ranks = np.full((len(codes) + 1, len(langs)), -1, np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, r["code"]), langs.index(r["lang"])] = r["rank"]
    shared = docs.sparkSession.sparkContext.broadcast((langs, codes, ranks))

    def make(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        langs, codes, ranks = shared.value
        steps = np.arange(RANKS)[:, None]

        def one(value: str | None) -> tuple[str, float]:
            own, n = count_grams(value)
            if not len(own) or not langs:
                return "und", 0.0
            own = most_frequent(own, n, RANKS)
            at = np.searchsorted(codes, own)
            at[(at == len(codes)) | (codes[np.minimum(at, len(codes) - 1)] != own)] = len(codes)
            profile = ranks[at]
            sums = np.where(profile < 0, RANKS, np.abs(profile - steps[: len(own)])).sum(0)
            best = int(sums.argmin())
            second = np.partition(sums, 1)[1] if len(sums) > 1 else max(1, sums[best]) * 1e9
            return langs[best], float(1 - sums[best] / second) if second else 0.0

        for batch in texts:
            found = [one(v.as_py()) for part in slices(batch) for v in part]
            yield [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return add_columns(docs, text, new, make, keep)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), profiles, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in a learned language stay; null texts and texts without a letter go."""
    names = docs.columns
    found = identify(docs, learn_profiles(docs.where(~held_out(F.col("doc_id")))))
    return found.where("lang_pred <> 'und'").select(*[F.col(f"`{c}`") for c in names])


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
