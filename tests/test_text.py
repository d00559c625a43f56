import random

from pyspark.sql import functions as F

from siftwell.functions import jsontext, scores, survey_text, text, urls
from siftwell.schemas import formal_response


def brute_force(body, entries):
    """Whole-word phrases by scanning every position, ordered by first end and then longest first."""
    low = (body or "").lower()
    found = {}
    for phrase in entries:
        for at in range(len(low) - len(phrase) + 1):
            end = at + len(phrase)
            if low[at:end] == phrase and not (at and low[at - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
                found[phrase] = end
                break
    order = sorted(found, key=lambda p: (found[p], -len(p)))
    total = sum(entries[p][1] for p in order)
    return total, [p for p in order if entries[p][0] == "pos"], [p for p in order if entries[p][0] == "neg"]


ENTRIES = {"map": ("pos", 2.0), "per capita": ("pos", 4.0), "cross-section": ("neg", -5.0), "in": ("neg", -1.0),
           "capita": ("pos", 0.5), "floor plan map": ("neg", -3.0), "covid-19": ("pos", 1.0), "карта": ("pos", 1.5),
           "地图": ("pos", 2.0), "c++": ("neg", -2.0), "(c)": ("neg", -0.5)}
TEXTS = [
    None, "", "   ", "Map", "mapping maps", "a map.", "per capita MAP in", "per  capita", "xper capita", "cross-section cross section",
    "floor plan map map", "COVID-19 in covid-19x", "Карта мира", "世界地图", "地图 here", "c++ and c+++ (c) c++x", "«map»—in", "map_in", "1map map2 3 map",
    "in\nmap\tper capita",
]


def _score(spark, texts, entries, scorer):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "uid string, text string")
    rows = scorer(df).orderBy(F.col("uid").cast("int")).collect()
    return [(r.score, list(r.pos_keys), list(r.neg_keys)) for r in rows]


def test_phrase_score_matches_brute_force(spark):
    rng = random.Random(7)
    words = ["map", "per", "capita", "in", "cross", "section", "floor", "plan", "covid", "19", "c++", "(c)", "карта", "地图", "x"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "-", ", ", "  ", ""]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    texts = TEXTS + made
    want = [brute_force(x, ENTRIES) for x in texts]
    assert _score(spark, texts, ENTRIES, lambda d: text.score_texts(d, text.PhraseSet(ENTRIES))) == want


def test_joined_scoring_equals_inlined_scoring(spark):
    plain = {p: e for p, e in ENTRIES.items() if p[0].isalnum() and p[-1].isalnum()}
    dictionary = spark.createDataFrame([(p, s, k) for p, (k, s) in plain.items()], "phrase string, score double, polarity string")
    texts = [x for x in TEXTS if x is not None] + [None]
    inlined = _score(spark, texts, plain, lambda d: text.score_texts(d, text.PhraseSet(plain)))
    assert _score(spark, texts, plain, lambda d: text.score_texts_by_join(d, dictionary)) == inlined
    assert text.phrase_set(dictionary, limit=3) is None


def test_large_dictionary_is_joined(spark, monkeypatch):
    plain = {f"w{i}": ("pos", 0.5) for i in range(50)}
    dictionary = spark.createDataFrame([(p, s, k) for p, (k, s) in plain.items()], "phrase string, score double, polarity string")
    df = spark.createDataFrame([("1", "w1 w2 w2 w99")], "uid string, text string")
    monkeypatch.setattr(text.phrase_set, "__defaults__", (10,))
    assert text.score_corpus(df, dictionary).first()["score"] == 1.0


def test_negative_polarity_wins(spark):
    pos = spark.createDataFrame([("In", 1.0), ("map", 2.0)], "phrase string, score double")
    neg = spark.createDataFrame([("in", -1.0)], "phrase string, score double")
    got = {r.phrase: (r.polarity, r.score) for r in text.build_dictionary(pos, neg).collect()}
    assert got == {"in": ("neg", -1.0), "map": ("pos", 2.0)}


def test_keyword_filters_handle_null_and_substrings(spark):
    df = spark.createDataFrame([(1, "Web PAGE"), (2, None), (3, "none"), (4, "a.b")], "k int, t string")
    assert [r.k for r in df.filter(text.contains_any(F.col("t"), ["age", "."])).orderBy("k").collect()] == [1, 4]
    rule = text.matches_language_rules(F.col("t"), F.lit(None).cast("string"), {"en": ["page"], "fr": ["x"]}, {"en": ["zzz"], "fr": ["web"]})
    assert [r.k for r in df.filter(rule).collect()] == [1]


def test_score_bins_and_categories(spark):
    values = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 10.5, -2.0, float("nan"), 0.25]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    rows = df.select(scores.score_bin(F.col("s")).alias("b"), scores.score_category(F.col("s")).alias("c")).collect()
    assert [r.b for r in rows] == ["bin_9", "bin_1", "bin_2", "bin_3", "bin_4", "bin_5", "bin_6", "bin_7", "bin_8", "bin_9", "bin_9", "bin_3"]
    assert [r.c for r in rows] == ["-1", "-0.5", "0", "0.5", "1", "1 to 2", "2 to 5", "5 to 10", "10+", "10+", "10+", "10+"]


def test_urls(spark):
    df = spark.createDataFrame([("https://www.a.org/x/",), ("http://a.org/x",), ("www.www.b.org//",), ("http://",), ("HTTP://c.org/A?q=1/",)], "u string")
    rows = [tuple(r) for r in urls.with_domain(df, "u").select("url_norm", "domain").collect()]
    assert rows == [("a.org/x", "a.org"), ("a.org/x", "a.org"), ("www.b.org", "www.b.org"), ("", None), ("HTTP://c.org/A?q=1", "HTTP:")]


def test_uncertainty(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (0.2,), (0.8,)], "p double")
    rows = df.select(scores.entropy(F.col("p")).alias("e"), scores.margin(F.col("p")).alias("m"), scores.least_confident(F.col("p")).alias("l")).collect()
    assert rows[0].e == 1.0 and abs(rows[1].e) < 1e-8 and abs(rows[2].e) < 1e-8
    assert abs(rows[3].e - rows[4].e) < 1e-12
    assert [r.m for r in rows][:3] == [1.0, 0.0, 0.0] and rows[0].l == 0.5
    assert scores.buffered_size(600, 0.38) == 967


def test_survey_text(spark):
    years = ["A year and still counting", "Five years", "12.5", None, "often", "no idea", "7 years"]
    df = spark.createDataFrame([(y,) for y in years], "y string")
    assert [r[0] for r in df.select(survey_text.parse_years(F.col("y"))).collect()] == [1.0, 5.0, 12.5, None, 10.0, None, 7.0]
    places = ["Czechia, Poland", "UK/USA", "Austria", "Ghana", None, " uk "]
    df = spark.createDataFrame([(p,) for p in places], "c string")
    assert [r[0] for r in df.select(survey_text.school(F.col("c"))).collect()] == ["CZ", "UK", "DE-speak", "Other", "Other", "UK"]
    names = ["Uk", "Czech Republic", "United Kingdom, France", "usa", "france ", None, "Ghana"]
    df = spark.createDataFrame([(p,) for p in names], "c string")
    assert [r[0] for r in df.select(survey_text.country_name(F.col("c"))).collect()] == [
        "United Kingdom", "Czechia", "Multi-UK", "USA", "France", "Unknown", "Ghana"]
    kinds = ["Leibniz Institute", "Leibniz University", "TU Wien", "Ministry", None]
    df = spark.createDataFrame([(p,) for p in kinds], "c string")
    assert [r[0] for r in df.select(survey_text.institution_class(F.col("c"))).collect()] == [
        "Research institute", "University / higher education", "University / higher education", "Other", "Not provided"]


def test_json_extraction(spark):
    whole = '{"is_map": true, "confidence": "high"}'
    raws = [whole, f"```json\n{whole}\n```", f"Sure: {whole} Hope it helps {{x}}", '{"is_map": false, "brief_description": "cut of', "nothing",
            f"```\n{whole}", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string")
    rows = df.select("i", jsontext.extract_object(F.col("raw"), formal_response()).alias("r")).orderBy("i").collect()
    assert [r.r and r.r.is_map for r in rows] == ["true", "true", "true", "false", None, "true", None]
    assert rows[3].r.brief_description == "cut of"
    assert [r[0] for r in df.limit(1).select(scores.truthy(F.lit("TRUE"))).collect()] == [True]


def test_language_codes(spark):
    df = spark.createDataFrame([("zh-tw",), ("  ",), (None,), ("pl",)], "c string")
    rows = df.select(text.language_code(F.col("c")).alias("c")).select("c", text.language_name(F.col("c")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("zh-cn", "Simplified Chinese"), ("unknown", "Unknown"), ("unknown", "Unknown"), ("pl", "Polish")]
