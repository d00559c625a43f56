"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftwell.llm.common import bounded_batches, materialise, slices, table, without

WIDTH = 10
AUTOMATON_WINDOWS = 200_000
"""Windows in one automaton (about 100 MB in a worker); more make several automata, scanned one after another."""

#: A-Z to a-z, every other ASCII character that is no digit or letter to a space; UTF-8 bytes stay.
_NORMAL = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
    ]
)


def windows(items: DataFrame, item_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """One row per distinct (item, window): ``width`` consecutive normalised words, or all of a shorter item.

    Null and empty texts, and those without a word, have no window.  A null id is read as an empty string.
    """
    source = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (value.as_py() or "").encode("utf-8").translate(_NORMAL).split()
                starts = range(max(1, len(words) - width + 1) if words else 0)
                for low in range(0, len(starts), 10_000):
                    some = [b" ".join(words[i : i + width]).decode("utf-8") for i in starts[low : low + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.string())], names=["item", "window"])

    return source.mapInArrow(run, "item string, window string").distinct()


def _scan(df: DataFrame, found: list[tuple[str, str]], text: str) -> DataFrame:
    """One pass: join what this automaton finds to what earlier passes have found."""
    shared = df.sparkSession.sparkContext.broadcast(found)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        owners: dict[str, list[str]] = defaultdict(list)
        for item, window in shared.value:
            owners[window].append(item)
        automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            pattern = window.encode("utf-8").decode("latin-1")
            automaton.add_word(f" {pattern} ", (pattern.count(" ") + 1, ids))
        if owners:
            automaton.make_automaton()
        at = {c: names.index(c) for c in (*FOUND.names, text)}

        def one(value: str | None, items: list[str], spans: list[int]) -> tuple[int, int, list[str], list[int]]:
            raw = (value or "").encode("utf-8").translate(_NORMAL)
            words = raw.split()
            if not words or not (owners or spans):
                return len(words), 0, [], []
            joined = f" {b' '.join(words).decode('latin-1')} "
            hits, ids = [], set(items)
            for end, (size, who) in automaton.iter(joined) if owners else ():
                hits.append((end, size))
                ids.update(who)
            if not hits and not spans:
                return len(words), 0, [], []
            last = np.searchsorted(np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32), [h[0] for h in hits])
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, last, -1)
            np.add.at(change, last - np.array([h[1] for h in hits], np.int64), 1)
            # offsets of the words in the original text: the normal form keeps every byte's place
            space = np.frombuffer(raw, np.uint8) == 32
            edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
            start, stop = edge[::2], edge[1::2]
            if spans:
                np.add.at(change, np.searchsorted(start, spans[::2]), 1)
                np.add.at(change, np.searchsorted(stop, spans[1::2]) + 1, -1)
            hit = np.cumsum(change[:-1]) > 0
            runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
            pairs = np.stack((start[runs[::2]], stop[runs[1::2] - 1]), 1).ravel().tolist()
            return len(words), int(hit.sum()), sorted(ids), pairs

        for whole in batches:
            for part in slices(whole.column(at[text])):
                batch = whole.slice(part.offset - whole.column(at[text]).offset, len(part))
                rows = [one(*x) for x in zip(*(batch.column(at[c]).to_pylist() for c in (text, "items", "spans")), strict=True)]
                columns = list(batch.columns)
                for k, field in enumerate(FOUND):
                    kind = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))[k]
                    columns[at[field.name]] = pa.array([r[k] for r in rows], kind)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``n_words, n_hit, items, spans`` to each document: the test items whose windows occur in it, and where.

    Words are runs of ASCII letters and digits (lower-cased) and of all characters beyond ASCII.  A window is
    ``width`` consecutive words of an item, or all words of a shorter one.  ``spans`` lists start and end of the
    maximal runs of hit words as byte offsets of the original UTF-8 text; ``items`` is sorted and distinct.
    Null, empty and word-free texts have zeros and empty lists, as has every text when there are no items.
    Repeated documents stay repeated; repeated items count once per id.  Columns of these names are replaced.

    The windows are counted first.  Up to ``AUTOMATON_WINDOWS`` make one broadcast automaton and one pass
    without a shuffle; a larger benchmark is cut by window hash into several, each with its own pass.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = materialise(windows(items, item_id, item_text, width), "windows")
    parts = max(1, -(-found.count() // AUTOMATON_WINDOWS))
    kept = without(docs, FOUND.names).columns if keep is None else list(keep)
    names = list(dict.fromkeys([*kept, text]))
    out = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"), F.array().cast("array<int>").alias("spans"),
    )
    for part in range(parts):
        rows = found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        out = _scan(out if not part else materialise(out, "leaks"), [tuple(r) for r in rows], text)
    return out.select(*[F.col(f"`{c}`") for c in kept], *FOUND.names)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: only documents without any word inside a benchmark window."""
    names = docs.columns
    return find_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).where("n_hit = 0").select(*[F.col(f"`{c}`") for c in names])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), {WIDTH}) AS size, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
),
hit AS (SELECT doc_id, item, i, size FROM dw JOIN bw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
