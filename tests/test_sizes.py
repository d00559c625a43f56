"""One result at every size: rows that used to depend on a switch, on repeated keys or on NULL groups."""

import math

from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import learning, ordering, sampling, state


def test_phrase_scores_do_not_depend_on_the_path(spark):
    entries = [("c++", "pos", 1.0), ("(map)", "pos", 2.0), ("map", "pos", 1.0), ("density of the people", "neg", 5.0), ("people", "pos", 0.5),
               ("#1", "neg", -1.0), ("a.b", "pos", 3.0), ("map!", "pos", 7.0)]
    dictionary = spark.createDataFrame(entries, "phrase string, polarity string, score double")
    texts = ["a c++ (map) of density of the people here", "C++", "c+++ c++x xc++", "map", "(map)map", "#1 a.b ##1 1#1", "a.b.", "map!! the map", None, "", "++ !!", "density of the  people"]
    rows = [(f"u{i % 7}", t) for i, t in enumerate(texts)]  # uids repeat
    docs = spark.createDataFrame(rows, "uid string, text string").coalesce(1)
    inlined = text.score_texts(docs, text.phrase_set(dictionary)).select("uid", "score", "pos_keys", "neg_keys").collect()
    joined = text.score_texts_by_join(docs, dictionary).collect()
    key = lambda r: (r["uid"], r["score"], sorted(r["pos_keys"]), sorted(r["neg_keys"]))
    assert sorted(map(key, inlined)) == sorted(map(key, joined))
    assert max(r["score"] for r in joined) >= 9.5


def test_repeated_uids_are_scored_apart(spark):
    dictionary = spark.createDataFrame([("map", "pos", 1.0)], "phrase string, polarity string, score double")
    docs = spark.createDataFrame([("u", "a map"), ("u", "the map map")], "uid string, text string")
    assert [(r.score, r.pos_keys) for r in text.score_texts_by_join(docs, dictionary).collect()] == [(1.0, ["map"])] * 2


def test_no_keywords_match_nothing(spark):
    assert not spark.range(1).select(text.contains_any(F.lit("abc"), []).alias("x")).first().x


def test_odd_embeddings_have_no_probability_at_any_width(spark):
    for n in (10, 200):
        weights = [0.01 * i for i in range(n)]
        rows = [(0, [1.0] * n), (1, [1.0] * (n - 1)), (2, [1.0] * (n + 1)), (3, None), (4, [1.0] * (n - 1) + [None]), (5, [2.0] * n), (6, [])]
        df = spark.createDataFrame(rows, "k int, embedding array<float>").coalesce(1)
        got = {r.k: r.p for r in df.select("k", learning.linear_proba(weights, 0.5).alias("p")).collect()}
        assert [k for k, p in got.items() if p is not None] == [0, 5]
        assert all(math.isclose(got[k], 1 / (1 + math.exp(-(x * sum(weights) + 0.5))), rel_tol=1e-9) for k, x in ((0, 1), (5, 2)))


def test_an_outlier_does_not_fill_one_bucket(spark):
    values = spark.range(20_000).select(F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / 1e6).alias("x"), F.lit(1).alias("n"))
    out = ordering.running_totals(values, "x", ["n"])
    assert {r.cum_n for r in out.collect()} == set(range(1, 20_001))
    bounds = values.agg(F.percentile_approx("x", [i / ordering.BUCKETS for i in range(1, ordering.BUCKETS)], 10 * ordering.BUCKETS).alias("b")).first().b
    largest = values.select(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("x"))).alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    assert largest < 3 * 20_000 / ordering.BUCKETS


def test_rows_of_a_null_bin_are_counted_and_picked(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") >= 50, F.lit("a")).alias("score_bin"))
    assert sampling.minimum_per_bin_sample(df, 60, 20).count() == 60
    quotas = spark.createDataFrame([(None, 5), ("a", 3)], "score_bin string, quota long")
    assert {r.score_bin: r["count"] for r in sampling.quota_sample(df, "score_bin", quotas).groupBy("score_bin").count().collect()} == {None: 5, "a": 3}


def test_upsert_keeps_one_row_per_key(spark):
    now = spark.createDataFrame([("a", "x"), ("b", "y")], "uid string, s string")
    changes = spark.createDataFrame([("a", "p"), ("a", "q")], "uid string, s string")
    assert sorted(map(tuple, state.upsert(now, changes).collect())) == [("a", "p"), ("b", "y")]
    assert sorted(map(tuple, state.upsert(now, changes, order=[F.desc("s")]).collect())) == [("a", "q"), ("b", "y")]


def test_phrases_beyond_the_broadcast(spark, monkeypatch):
    """Frequent cores are joined by themselves, rare ones by a shuffle; the scores are those of a broadcast dictionary."""
    entries = [("map", "pos", 1.0), ("old map", "neg", 2.0), ("(map)", "pos", 4.0), ("rare phrase here", "pos", 8.0), ("x", "neg", -1.0)]
    dictionary = spark.createDataFrame(entries, "phrase string, polarity string, score double")
    rows = [(str(i), "map " * (i % 5) + ("an old  map, old map" if i % 3 else "(map) x") + (" rare phrase here" if i == 77 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "uid string, text string")
    want = sorted(map(tuple, text.score_texts_by_join(docs, dictionary).collect()))
    monkeypatch.setattr(text, "fits", lambda df, limit=0: False)
    assert sorted(map(tuple, text.score_texts_by_join(docs, dictionary).collect())) == want
    assert want[0][1] != 0


def test_filter_keeps_few_grams_and_every_core(spark):
    entries = [("old map", "pos", 1.0), ("a b c", "neg", 1.0), ("+", "pos", 1.0)]
    cores = text._cores(spark.createDataFrame(entries, "phrase string, polarity string, score double"))
    bits, size = text.core_filter(cores)
    docs = spark.createDataFrame([("words " * 500 + "old map a b c a b",)], "text string").withColumn("_bits", bits.scalar())
    grams = docs.select(text._placed_grams(F.col("text"), 3, F.col("_bits"), size).alias("g")).first().g
    assert {"old map", "a b c"} <= {g.core for g in grams} and len(grams) < 20


def test_languages_beyond_the_broadcast(spark, monkeypatch):
    texts = [("en", "the map of the land"), ("de", "die karte des landes"), ("fr", "la carte du pays"), (None, "xx")]
    rows = [(str(i), texts[i % 3][1] + f" w{i}" * (i % 7), texts[i % 3][0]) for i in range(90)] + [("none", "123 !!", "en"), ("null", None, "de"), ("odd", "ŧŧŧ", "fr")]
    docs = spark.createDataFrame(rows, "uid string, text string, lang string").coalesce(1)
    profiles = text.language_profiles(docs.filter("uid <> 'odd'"))
    want = sorted(map(tuple, text.identify_language(docs, profiles).collect()))
    assert dict(want)["none"] == dict(want)["null"] == dict(want)["odd"] == "unknown" and dict(want)["0"] == "en"
    monkeypatch.setattr(text, "fits", lambda df, limit=0: False)
    assert sorted(map(tuple, text.identify_language(docs, profiles).collect())) == want
    monkeypatch.setattr(text, "FREQUENT_SHARE", 20)
    assert sorted(map(tuple, text.identify_language(docs, profiles).collect())) == want
