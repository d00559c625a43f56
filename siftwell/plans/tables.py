"""Input tables of the registered queries, derived from the driver's tables, with matching SQL views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwell.functions.scores import score_bin, uncertainty
from siftwell.functions.text import PhraseSet, score_texts
from siftwell.functions.urls import with_domain
from siftwell.operators.learning import linear_proba
from siftwell.operators.profiles import dedup_best
from siftwell.operators.quality import formal_criteria, score_maps, WEIGHTS
from siftwell.plans.registry import view
from siftwell.schemas import CRITERIA_IDS, METHOD_FLAGS, SUBJECT_FLAGS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(col: str | Column, digits: int = 6) -> Column:
    """Rounded double for comparison with the oracle."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


# ---------------------------------------------------------------- predictions (from pages)

view("pool", """
    SELECT CAST(page_id AS VARCHAR) AS uid, page_id AS k,
           regexp_replace(url, '/[0-9]+.*$', '/' || CAST(page_id % 4 AS VARCHAR)
               || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END) AS url,
           ((page_id * 37) % 100) / 100.0 AS pred_proba, ((page_id * 7) % 31 - 4) / 2.0 AS score
    FROM pages""")


def pool(spark, sf) -> DataFrame:
    return pool_rows(table(spark, sf, "pages"))


def pool_rows(pages: DataFrame) -> DataFrame:
    k = F.col("page_id")
    tail = F.concat(F.lit("/"), (k % 4).cast("string"), F.when(k % 2 == 0, "/").otherwise(""))
    return pages.select(
        k.cast("string").alias("uid"), k.alias("k"), F.regexp_replace("url", F.lit("/[0-9]+.*$"), tail).alias("url"),
        ((k * 37 % 100) / 100).alias("pred_proba"), ((k * 7 % 31 - 4) / 2).alias("score"))


view("pool_norm", r"""
    SELECT *, NULLIF(regexp_extract(url_norm, '^([^/]+)', 1), '') AS domain
    FROM (SELECT *, trim(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/') AS url_norm
          FROM pool)""")


def pool_norm(spark, sf) -> DataFrame:
    return with_domain(pool(spark, sf))


view("clean", """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY url_norm ORDER BY pred_proba DESC, uid) AS rn FROM pool_norm)
    WHERE rn = 1""")


def clean(spark, sf) -> DataFrame:
    return dedup_best(pool_norm(spark, sf))


# ---------------------------------------------------------------- candidates (from pages)

_CAND_FLAGS = {"is_map": 13, "is_statistical_map": 11, "has_quantitative_data": 17, "has_admin_units": 19}
_CAND_METHODS = {"has_choropleth": "k % 2 = 0", "has_proportional_circles": "k % 5 = 0",
                 "has_graduated_circles": "k % 7 = 3", "has_structural_circles": "k % 9 = 0"}

view("cand_flags", f"""
    SELECT uid, k, url, domain, pred_proba, score, 'pool' AS source, k % 5 + 1 AS batch_id,
           CASE WHEN k % 10 < 2 THEN 'pending' WHEN k % 10 = 2 THEN 'dead' WHEN k % 10 = 3 THEN 'error'
                ELSE 'alive' END AS url_status,
           CASE WHEN k % 10 < 4 OR k % 7 = 0 THEN 'pending' WHEN k % 7 = 1 THEN 'failed'
                WHEN k % 7 = 2 THEN 'not_image' ELSE 'success' END AS download_status,
           k % 10 >= 4 AND k % 7 >= 3 AS ok, k % 10 >= 4 AND k % 7 >= 3 AND k % 6 >= 2 AS done,
           CASE WHEN ok THEN 200 + k * 53 % 1500 END AS image_width,
           CASE WHEN ok THEN 150 + k * 31 % 1200 END AS image_height,
           CASE WHEN ok THEN 'img/' || uid || '.png' END AS local_path,
           {", ".join(f"CASE WHEN done AND k % 23 <> 0 THEN k % {m} <> 0 END AS ai_{f}" for f, m in _CAND_FLAGS.items())},
           {", ".join(f"CASE WHEN done THEN {c} END AS ai_{f}" for f, c in _CAND_METHODS.items())},
           CASE WHEN done THEN CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS ai_confidence,
           CASE WHEN done THEN NULLIF(regexp_extract(url, '/(en|fr|de|es)/', 1), '') END AS ai_map_language,
           CASE WHEN done THEN 'Page of ' || domain END AS ai_description
    FROM pool_norm""")
view("cand", f"""
    SELECT * EXCLUDE (ok, done),
           CASE WHEN NOT ok OR k % 6 = 0 THEN 'pending' WHEN k % 6 = 1 THEN 'error' WHEN passes_all THEN 'pass'
                ELSE 'fail' END AS ai_status
    FROM (SELECT *, passes_f3 AND passes_f4 AS passes_all
          FROM (SELECT *, {" AND ".join(f"COALESCE(ai_{f}, FALSE)" for f in SUBJECT_FLAGS)} AS passes_f3,
                       {" OR ".join(f"COALESCE(ai_{f}, FALSE)" for f in METHOD_FLAGS)} AS passes_f4
                FROM cand_flags))""")


def cand(spark, sf) -> DataFrame:
    k = F.col("k")
    base = pool_norm(spark, sf).withColumns({"ok": (k % 10 >= 4) & (k % 7 >= 3)}).withColumn(
        "done", F.col("ok") & (k % 6 >= 2))
    done, ok = F.col("done"), F.col("ok")
    flags = {f"ai_{f}": F.when(done & (k % 23 != 0), k % m != 0) for f, m in _CAND_FLAGS.items()}
    methods = {f"ai_{f}": F.when(done, F.expr(c)) for f, c in _CAND_METHODS.items()}
    rows = base.withColumns({
        "source": F.lit("pool"), "batch_id": k % 5 + 1,
        "url_status": F.when(k % 10 < 2, "pending").when(k % 10 == 2, "dead").when(k % 10 == 3, "error").otherwise("alive"),
        "download_status": F.when((k % 10 < 4) | (k % 7 == 0), "pending").when(k % 7 == 1, "failed")
        .when(k % 7 == 2, "not_image").otherwise("success"),
        "image_width": F.when(ok, 200 + k * 53 % 1500), "image_height": F.when(ok, 150 + k * 31 % 1200),
        "local_path": F.when(ok, F.concat(F.lit("img/"), "uid", F.lit(".png"))), **flags, **methods,
        "ai_confidence": F.when(done, F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")),
        "ai_map_language": F.when(done, F.nullif(F.regexp_extract("url", "/(en|fr|de|es)/", 1), F.lit(""))),
        "ai_description": F.when(done, F.concat(F.lit("Page of "), "domain"))})
    passed = formal_criteria(rows).drop("details", "passes_f1", "url_norm")
    status = (F.when(~ok | (k % 6 == 0), "pending").when(k % 6 == 1, "error").when(F.col("passes_all"), "pass")
              .otherwise("fail"))
    return passed.withColumn("ai_status", status).drop("ok", "done")


view("selected", "SELECT * FROM cand WHERE ai_status = 'pass' AND ai_confidence = 'high'")


def selected(spark, sf) -> DataFrame:
    return cand(spark, sf).filter((F.col("ai_status") == "pass") & (F.col("ai_confidence") == "high"))


view("runs", """
    SELECT page_id % 5 + 1 AS id,
           CASE page_id % 5 WHEN 0 THEN 'sample' WHEN 1 THEN 'add_urls' WHEN 2 THEN 'url_check'
                WHEN 3 THEN 'add_from_domain' ELSE 'load_all' END AS step, count(*) AS items_processed
    FROM pages GROUP BY 1, 2""")


def runs(spark, sf) -> DataFrame:
    m = F.col("page_id") % 5
    step = (F.when(m == 0, "sample").when(m == 1, "add_urls").when(m == 2, "url_check")
            .when(m == 3, "add_from_domain").otherwise("load_all"))
    return (table(spark, sf, "pages").groupBy((m + 1).alias("id"), step.alias("step"))
            .agg(F.count("*").alias("items_processed")))


view("batches", """
    SELECT page_id % 5 + 1 AS id, 'batch ' || CAST(page_id % 5 + 1 AS VARCHAR) AS name, count(*) AS count_requested,
           CASE WHEN page_id % 5 = 4 THEN 'undone' ELSE 'active' END AS status
    FROM pages GROUP BY ALL""")


def batches(spark, sf) -> DataFrame:
    i = F.col("page_id") % 5 + 1
    return (table(spark, sf, "pages").groupBy(
        i.alias("id"), F.concat(F.lit("batch "), i.cast("string")).alias("name"),
        F.when(i == 5, "undone").otherwise("active").alias("status")).agg(F.count("*").alias("count_requested")))


# ---------------------------------------------------------------- maps (from documents)

_MAP_METHODS = {"has_choropleth": 2, "has_proportional_circles": 3, "has_graduated_circles": 5,
                "has_structural_circles": 8}
_CRIT = list(enumerate(CRITERIA_IDS))

view("map_flags", f"""
    SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS k, source AS domain, lang AS ai_map_language,
           ((doc_id * 37) % 100) / 100.0 AS pred_proba, 'img/' || CAST(doc_id AS VARCHAR) AS local_path,
           'Issues of ' || source AS disq_description,
           {", ".join(f"doc_id % {m} = 0 AS ai_{f}" for f, m in _MAP_METHODS.items())},
           CASE doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'checked' END AS disq_status,
           CASE WHEN doc_id % 10 > 1 THEN CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END
               AS disq_confidence,
           {", ".join(f"CASE WHEN doc_id % 10 > 1 AND (doc_id + {i}) % 29 <> 0 THEN (doc_id * {i + 3} + {i}) % 7 < 2 END AS disq_{c}" for i, c in _CRIT)},
           {", ".join(f"CASE (doc_id * {i + 5}) % 13 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS human_{c}" for i, c in _CRIT)}
    FROM documents""")


def _q_sql(flag) -> str:
    total = sum(WEIGHTS.values())
    penalty = " + ".join(f"CASE WHEN {flag(c)} THEN {w}::DOUBLE ELSE 0 END" for c, w in WEIGHTS.items())
    return f"round_even(60::DOUBLE * (1 - ({penalty}) / {total!r}::DOUBLE), 2)"


view("maps", f"""
    SELECT *, CASE WHEN disq_status = 'checked' THEN {_q_sql(lambda c: f"COALESCE(human_{c}, disq_{c})")} END AS quality_score,
           CASE WHEN disq_status = 'checked' THEN {" + ".join(f"CASE WHEN COALESCE(human_{c}, disq_{c}) THEN 1 ELSE 0 END" for c in CRITERIA_IDS)} END AS violations_count
    FROM map_flags""")


def map_flags(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    checked = k % 10 > 1
    return table(spark, sf, "documents").select(
        k.cast("string").alias("uid"), k.alias("k"), F.col("source").alias("domain"),
        F.col("lang").alias("ai_map_language"), ((k * 37 % 100) / 100).alias("pred_proba"),
        F.concat(F.lit("img/"), k.cast("string")).alias("local_path"),
        F.concat(F.lit("Issues of "), "source").alias("disq_description"),
        *[(k % m == 0).alias(f"ai_{f}") for f, m in _MAP_METHODS.items()],
        F.when(k % 10 == 0, "pending").when(k % 10 == 1, "error").otherwise("checked").alias("disq_status"),
        F.when(checked, F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")).alias("disq_confidence"),
        *[F.when(checked & ((k + i) % 29 != 0), (k * (i + 3) + i) % 7 < 2).alias(f"disq_{c}") for i, c in _CRIT],
        *[F.when(k * (i + 5) % 13 == 0, True).when(k * (i + 5) % 13 == 1, False).alias(f"human_{c}") for i, c in _CRIT])


def maps(spark, sf) -> DataFrame:
    return score_maps(map_flags(spark, sf))


# ---------------------------------------------------------------- survey (from events)

EVENT_CRITERIA = ["click", "error", "purchase", "signup", "view"]
EVENT_CATEGORIES = {"click": "USE", "view": "USE", "purchase": "TRADE", "signup": "TRADE", "error": "FAULT"}

view("ratings", """
    SELECT user_id AS respondent, event_type AS criterion, 1 + CAST(floor(v) AS BIGINT) % 5 AS rating
    FROM (SELECT user_id, event_type, arg_min(value, event_id) AS v FROM events GROUP BY ALL)""")


def ratings(spark, sf) -> DataFrame:
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("v"))
    return first.select(F.col("user_id").alias("respondent"), F.col("event_type").alias("criterion"),
                        (1 + F.floor("v").cast("long") % 5).alias("rating"))


view("grouped_ratings", """
    SELECT *, CASE respondent % 4 WHEN 0 THEN 'UK' WHEN 1 THEN 'CZ' WHEN 2 THEN 'DE-speak' ELSE 'Other' END AS school
    FROM ratings""")


def grouped_ratings(spark, sf) -> DataFrame:
    m = F.col("respondent") % 4
    return ratings(spark, sf).withColumn(
        "school", F.when(m == 0, "UK").when(m == 1, "CZ").when(m == 2, "DE-speak").otherwise("Other"))


# survey attributes (from customer and nation)

_COUNTRIES = ["Uk", "CZ", "United Kingdom, France", "Germany/Poland", "usa", "FRANCE ", "Austria", "Czech Republic"]
_YEARS = ["A year and still counting", "Five years", "12.5", "4 years", "often", "Ten years"]
_INSTITUTIONS = ["Leibniz Institute", "TU Dresden", "Ministry of ", "University of Leibniz", "ENSG Paris"]


def _case(mod: str, values: list[str]) -> str:
    return f"CASE {mod} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


view("people", f"""
    SELECT c_custkey AS respondent, c_mktsegment AS education,
           CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN n_name
                ELSE {_case("c_custkey % 8", _COUNTRIES)} END AS country,
           CASE WHEN c_custkey % 7 = 0 THEN NULL
                ELSE {_case("c_custkey % 5", _INSTITUTIONS)} || n_name END AS institution,
           CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 40 AS VARCHAR)
                ELSE {_case("c_custkey % 6", _YEARS)} END AS years,
           CASE WHEN c_custkey % 13 <> 0 THEN 1 + c_custkey % 5 END AS expertise
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")


def people(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda m, values: F.get(F.array(*[F.lit(v) for v in values]), (k % m).cast("int"))
    joined = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        k.alias("respondent"), F.col("c_mktsegment").alias("education"),
        F.when(k % 11 == 0, None).when(k % 2 == 0, F.col("n_name")).otherwise(pick(8, _COUNTRIES)).alias("country"),
        F.when(k % 7 != 0, F.concat(pick(5, _INSTITUTIONS), "n_name")).alias("institution"),
        F.when(k % 9 == 0, None).when(k % 3 == 0, (k % 40).cast("string")).otherwise(pick(6, _YEARS)).alias("years"),
        F.when(k % 13 != 0, 1 + k % 5).alias("expertise"))


# ---------------------------------------------------------------- annotation log (from events)

view("annlog", """
    SELECT CAST(user_id AS VARCHAR) AS uid, event_id, ts,
           CASE event_type WHEN 'click' THEN 'YES' WHEN 'view' THEN 'NO' WHEN 'error' THEN 'INVALID'
                WHEN 'signup' THEN 'TAK' ELSE 'NIE' END AS label
    FROM events""")


def annlog(spark, sf) -> DataFrame:
    return label_events(table(spark, sf, "events"))


def label_events(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("uid"), "event_id", "ts",
        F.when(t == "click", "YES").when(t == "view", "NO").when(t == "error", "INVALID").when(t == "signup", "TAK")
        .otherwise("NIE").alias("label"))


view("ann", """
    SELECT uid, arg_max(label, event_id) AS label, max(event_id) AS event_id FROM annlog GROUP BY uid""")


def ann(spark, sf) -> DataFrame:
    from siftwell.operators.state import latest_per_key

    return latest_per_key(annlog(spark, sf), "uid", "ts", "event_id").select("uid", "label", "event_id")


# ---------------------------------------------------------------- documents

view("docs", """
    SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS k, text, lang, source, n_chars,
           CASE WHEN doc_id % 5 = 0 THEN 'ERR' ELSE 'OK' END AS url_status FROM documents""")


def docs(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        k.cast("string").alias("uid"), k.alias("k"), "text", "lang", "source", "n_chars",
        F.when(k % 5 == 0, "ERR").otherwise("OK").alias("url_status"))


# A small weighted dictionary of words and phrases that occur in the corpus; "in" is in both lists.
POSITIVE = {"thble": 2.0, "is": 0.5, "The": 1.0, "thon": 1.5, "of the": 3.0, "in": 1.0, "and the": 2.5, "que": 1.0,
            "la": 0.5, "thtion": 4.0, "with": 0.5, "in the": 1.5}
NEGATIVE = {"in": -1.0, "der": -1.5, "en": -0.5, "thth": -2.0, "to the": -3.0, "erhe": -2.5, "ou": -1.0, "thhe": -4.0}


def _entries() -> dict:
    merged = {p.lower(): ("pos", s) for p, s in POSITIVE.items()}
    merged.update({p.lower(): ("neg", s) for p, s in NEGATIVE.items()})
    return merged


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame([(p, s, kind) for p, (kind, s) in _entries().items()],
                                 "phrase string, score double, polarity string")


view("dict", "SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', {s}::DOUBLE, '{kind}')" for p, (kind, s) in _entries().items()) + ") d(phrase, score, polarity)")
view("phrase_hits", " UNION ALL ".join(
    f"SELECT uid, '{p}' AS phrase, {s}::DOUBLE AS score, '{kind}' AS polarity FROM docs "
    rf"WHERE regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}]){p}(?:$|[^\p{{L}}\p{{N}}])')"
    for p, (kind, s) in _entries().items()))
view("runs_of_text", r"""
    SELECT uid, unnest(p) AS piece, generate_subscripts(p, 1) AS i
    FROM (SELECT uid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS p FROM docs)""")
view("phrase_ends", """
    SELECT uid, phrase, min(i) AS ends FROM (
        SELECT uid, piece AS phrase, i FROM runs_of_text WHERE piece IN (SELECT phrase FROM dict)
        UNION ALL
        SELECT * FROM (SELECT uid, lag(piece, 2) OVER w || lag(piece, 1) OVER w || piece AS phrase, i
                       FROM runs_of_text WINDOW w AS (PARTITION BY uid ORDER BY i))
        WHERE phrase IN (SELECT phrase FROM dict WHERE phrase LIKE '% %'))
    GROUP BY ALL""")
view("scored", """
    SELECT d.uid, d.k, d.lang, d.source, d.url_status, d.n_chars, COALESCE(sum(h.score), 0) AS score,
           COALESCE(string_agg(CASE WHEN polarity = 'pos' THEN phrase END, '|' ORDER BY ends, length(phrase) DESC), '') AS pos_keys,
           COALESCE(string_agg(CASE WHEN polarity = 'neg' THEN phrase END, '|' ORDER BY ends, length(phrase) DESC), '') AS neg_keys
    FROM docs d LEFT JOIN phrase_hits h USING (uid) LEFT JOIN phrase_ends USING (uid, phrase) GROUP BY ALL""")


def scored(spark, sf) -> DataFrame:
    return score_texts(docs(spark, sf), PhraseSet(_entries())).drop("text")


view("binned", """
    SELECT *, CASE WHEN score > -1 AND score <= -0.5 THEN 'bin_1' WHEN score > -0.5 AND score <= 0 THEN 'bin_2'
                   WHEN score > 0 AND score <= 0.5 THEN 'bin_3' WHEN score > 0.5 AND score <= 1 THEN 'bin_4'
                   WHEN score > 1 AND score <= 2 THEN 'bin_5' WHEN score > 2 AND score <= 5 THEN 'bin_6'
                   WHEN score > 5 AND score <= 10 THEN 'bin_7' WHEN score > 10 THEN 'bin_8' ELSE 'bin_9' END AS score_bin
    FROM (SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS k, lang, source, ((n_chars * 7) % 29 - 4) / 2.0 AS score
          FROM documents)""")


def binned(spark, sf) -> DataFrame:
    """Documents with a proxy score and its bin, for the sampling queries."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), F.col("doc_id").alias("k"), "lang", "source",
        ((F.col("n_chars") * 7 % 29 - 4) / 2).alias("score")).withColumn("score_bin", score_bin(F.col("score")))


# ---------------------------------------------------------------- labels with a proxy probability

view("lab", """
    SELECT CAST(l.doc_id AS VARCHAR) AS uid, l.quality AS label, ((d.n_chars * 11 + l.quality * 350) % 1000) / 1000.0 AS pred_proba,
           ((d.n_chars * 7) % 29 - 4) / 2.0 AS score, d.lang
    FROM labels l JOIN documents d USING (doc_id)""")


def lab(spark, sf) -> DataFrame:
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("uid"), F.col("quality").alias("label"),
        ((F.col("n_chars") * 11 + F.col("quality") * 350) % 1000 / 1000).alias("pred_proba"),
        ((F.col("n_chars") * 7 % 29 - 4) / 2).alias("score"), "lang")


# ---------------------------------------------------------------- embeddings with a fixed linear model

LINEAR = [((i * 7) % 13 - 6) / 2.0 for i in range(64)]
BIAS = -0.25

view("vec", f"""
    SELECT CAST(vec_id AS VARCHAR) AS uid, vec_id AS k, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label,
           round(1 / (1 + exp(-(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({LINEAR} AS DOUBLE[])) + {BIAS}))), 9)
               AS pred_proba,
           'u/' || CAST(vec_id AS VARCHAR) AS url, ((vec_id * 7) % 31 - 4) / 2.0 AS score
    FROM embeddings""")


def vectors(spark, sf) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        k.cast("string").alias("uid"), k.alias("k"), (F.col("label") < 3).cast("int").alias("label"), "embedding",
        F.concat(F.lit("u/"), k.cast("string")).alias("url"), ((k * 7 % 31 - 4) / 2).alias("score"))


def vec(spark, sf) -> DataFrame:
    return vectors(spark, sf).withColumn("pred_proba", F.round(linear_proba(LINEAR, BIAS), 9)).drop("embedding")


view("uncertain", """
    SELECT *, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 9) AS uncertainty
    FROM (SELECT *, greatest(least(pred_proba, 1 - 1e-10), 1e-10) AS q FROM vec)""")


def uncertain(spark, sf) -> DataFrame:
    return vec(spark, sf).withColumn("uncertainty", F.round(uncertainty(F.col("pred_proba")), 9))


MD5 = "md5('42:' || uid)"
