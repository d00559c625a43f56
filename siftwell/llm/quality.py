"""Quality rules: counts that any text can fail by, and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into ``BUCKETS``; one multinomial over the buckets is counted from trusted documents
(``labels.quality`` 1), one from the whole corpus.  A text's score is the mean, over its n-grams, of the logarithm of
the ratio of the two.  The threshold lies midway between the mean scores of good and of bad labelled documents, and
every document is compared with it; nothing is drawn by chance.

Texts are never shuffled: the counts shuffle one row per bucket and task, the scores are computed in the row with the
table of bucket weights (a fixed size) at hand.  Weights and scores are integers in units of 1 / ``UNIT``, so that sums do
not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwell.llm.common import fresh, held_out, materialise, table, without
from siftwell.llm.sqltools import CRC_TABLE, crc32_sql

BUCKETS = 1 << 16
UNIT = 1 << 20
MIX = 1_000_003
"""Multiplier by which two word hashes make the hash of a pair."""
TRUSTED = 20_000
"""About how many trusted documents are learned from, chosen by the CRC-32 of their ids; the corpus is counted whole."""
FEWEST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]+"
NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas of the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def codes_of(words: Column) -> Column:
    """The CRC-32 of each word."""
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def buckets_of(words: Column) -> Column:
    """The bucket of each word, then that of each pair of neighbours."""

    def both(codes: Column) -> Column:
        single = F.transform(codes, lambda c: (c % BUCKETS).cast("int"))
        pairs = F.transform(codes, lambda c, i: ((F.get(codes, i - 1) * MIX + c) % BUCKETS).cast("int"))
        return F.concat(single, F.slice(pairs, F.lit(2), F.greatest(F.size(codes), F.lit(1))))

    return let(codes_of(words), both)


# ---------------------------------------------------------------- base counts


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more, the first such window included.

    Windows are compared as 64-bit hashes of their words; only texts with a repeated hash sort them.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def of(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), gaps)

        return let(placed, of)

    def gaps(at: Column) -> Column:
        own = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    some = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return F.when(n > WINDOW, some).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    total = F.lit(0)
    for s in SYMBOLS:
        total = total + size - F.octet_length(F.replace(text, F.lit(s), F.lit("")))
    return total.cast("long")


# ---------------------------------------------------------------- the model


def learned_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of labelled documents that are not held out, once each; one bad label row makes a bad document."""
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return rows.where("quality IN (0, 1)").select("doc_id", (F.col("quality") == 1).alias("good"))


def trusted_ids(learned: DataFrame) -> DataFrame:
    """At most about ``TRUSTED`` good documents: those of small CRC-32."""
    n = learned.agg(F.count_if("good").alias("n")).first()[0]
    cut = min(1 << 32, (TRUSTED << 32) // max(1, n))
    return learned.where(F.col("good") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) < cut)).select("doc_id", F.lit(True).alias("trusted"))


def bucket_weights(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``model``: for each bucket the log ratio of its smoothed share in trusted texts and in all texts, in 1 / ``UNIT``.

    ``ids`` (``doc_id, trusted``) is of bounded size and broadcast; the explode is counted before it is shuffled.
    """
    # outer: an inner explode would put a filter on the array below, which hashes every text once more
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode_outer(buckets_of(words_of(F.col(f"`{text}`")))).alias("bucket")).where("bucket IS NOT NULL")
    counts = rows.join(F.broadcast(ids), "doc_id", "left").groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    counts = materialise(counts, "buckets")
    totals = counts.agg(F.coalesce(F.sum("target"), F.lit(0)).alias("t"), F.coalesce(F.sum("raw"), F.lit(0)).alias("r")).first()
    ratio = ((F.coalesce("target", F.lit(0)) + 1) / (totals.t + BUCKETS)) / ((F.coalesce("raw", F.lit(0)) + 1) / (totals.r + BUCKETS))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    pairs = F.sort_array(F.collect_list(F.struct("bucket", F.round(F.log(ratio) * UNIT).cast("int").alias("w"))))
    return materialise(every.agg(F.transform(pairs, lambda p: p["w"]).alias("model")), "model")


def likelihood(words: Column, model: Column) -> Column:
    """The floor of the mean weight of a text's words and word pairs, in 1 / ``UNIT``; null without words."""

    def of(v: Column) -> Column:
        weight = lambda c: F.get(v["model"], (c % BUCKETS).cast("int"))
        start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
        total = F.aggregate(
            v["codes"], start,
            lambda a, c: F.struct(c.alias("last"), (a["sum"] + weight(c) + F.when(a["last"] >= 0, weight(a["last"] * MIX + c)).otherwise(F.lit(0))).alias("sum")),
            lambda a: a["sum"],
        )
        n = 2 * F.size(v["codes"]) - 1
        return F.when(n > 0, F.floor(total / n))

    return let(F.struct(codes_of(words).alias("codes"), model.alias("model")), of)


def threshold(scored: DataFrame, learned: DataFrame) -> float | None:
    """Midway between the mean scores ``s`` of good and of bad learned documents; None if either is missing."""
    found = scored.join(learned, "doc_id").agg(
        *[f(F.when(F.col("good") == good, F.col("s"))).alias(f"{name}{int(good)}") for good in (True, False) for name, f in (("n", F.count), ("s", F.sum))]
    ).first()
    return (found.s1 / found.n1 + found.s0 / found.n0) / 2 if found.n1 and found.n0 else None


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' columns but the text, and ``NEW``; ``score`` is in natural units.

    A null or empty text has no words, zero counts and a null score, and fails.  Rows are judged one by one, repeats
    and null ids too; a null id is never learned from.  Without good or without bad labels no threshold is known,
    and all that passes the counts is kept.  Columns named like new ones are replaced.  An empty table gives no rows.
    """
    learned = materialise(learned_labels(labels), "learned")
    model = bucket_weights(docs, trusted_ids(learned), doc_id, text)
    kept = [c for c in without(docs, NEW).columns if c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh(docs, "text_")))
    text_ = F.col(source.columns[-1])

    def of(v: Column) -> Column:
        w = v["words"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
            likelihood(w, v["model"]).alias("score"),
        )

    at = fresh(docs, "counts_")
    beside = fresh(source, "model_")  # a subquery may not stand in a lambda; as a column it is folded into the expression
    counted = source.withColumn(beside, model.scalar()).select(
        *[F.col(f"`{c}`") for c in kept], let(F.struct(words_of(text_).alias("words"), F.col(beside).alias("model")), of).alias(at),
        symbols(text_).alias("n_symbols"), repeated_lines(text_).alias("n_dup_lines"),
    )
    counted = materialise(counted, "counted")
    n, repeats, score = (F.col(at)[c] for c in ("n_words", "n_repeat_words", "score"))
    least = threshold(counted.select(F.col(f"`{doc_id}`").alias("doc_id"), score.alias("s")), learned)
    failed = (n < FEWEST_WORDS) | (100 * repeats > MOST_REPEATED * n)
    good = F.lit(True) if least is None else score >= least
    return counted.select(
        *[F.col(f"`{c}`") for c in kept], n.alias("n_words"), F.col(at)["word_chars"].alias("word_chars"), "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & F.coalesce(good, F.lit(False))).alias("kept"), (score / UNIT).alias("score"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged."""
    judged = judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("doc_id", *NEW[:-1])


_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
_NOT_HELD = f"{crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 <> 1"

QUERIES = {"op12_quality_rules": op12_quality_rules}
ORACLES = {
    "op12_quality_rules": rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT id, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
five AS (SELECT id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i:i+{WINDOW - 1}], ' '))) AS gram FROM d WHERE len(words) > {WINDOW}),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM five) WHERE n > 1),
repeats AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY id),
base AS (
  SELECT d.id, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats r USING (id)),
learned AS (
  SELECT doc_id, min(quality) = 1 AS good, any_value({crc32_sql('CAST(doc_id AS VARCHAR)')}) AS crc FROM labels, crc_table
  WHERE doc_id IS NOT NULL AND {_NOT_HELD} GROUP BY doc_id HAVING min(quality) IN (0, 1)),
trusted AS (SELECT doc_id FROM learned WHERE good AND crc < least(4294967296, {TRUSTED << 32} // (SELECT greatest(1, count(*) FILTER (WHERE good)) FROM learned))),
codes AS (SELECT word, {crc32_sql('word')} AS c FROM (SELECT DISTINCT word FROM w), crc_table),
grams AS (
  SELECT id, doc_id, c % {BUCKETS} AS bucket FROM (SELECT id, doc_id, c FROM w JOIN codes USING (word))
  UNION ALL
  SELECT id, doc_id, (before * {MIX} + c) % {BUCKETS} FROM (SELECT id, doc_id, c, lag(c) OVER (PARTITION BY id ORDER BY i) AS before FROM w JOIN codes USING (word)) WHERE before IS NOT NULL),
counts AS (SELECT bucket, count(*) AS raw, count(t.doc_id) AS target FROM grams LEFT JOIN trusted t USING (doc_id) GROUP BY bucket),
weights AS (SELECT bucket, CAST(round(ln(((target + 1) / ((SELECT sum(target) FROM counts) + {BUCKETS})::DOUBLE) / ((raw + 1) / ((SELECT sum(raw) FROM counts) + {BUCKETS})::DOUBLE)) * {UNIT}) AS BIGINT) AS weight FROM counts),
scores AS (SELECT id, floor(CAST(sum(weight) AS BIGINT) / CAST(count(*) AS DOUBLE)) AS score FROM grams JOIN weights USING (bucket) GROUP BY id),
means AS (
  SELECT sum(score) FILTER (WHERE good) / count(score) FILTER (WHERE good) AS g, sum(score) FILTER (WHERE NOT good) / count(score) FILTER (WHERE NOT good) AS b
  FROM learned JOIN d USING (doc_id) JOIN scores USING (id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed, NOT failed AND (coalesce(score >= (g + b) / 2, (g + b) IS NULL AND score IS NOT NULL)) AS kept
FROM (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS failed FROM base) LEFT JOIN scores USING (id), means"""
}
