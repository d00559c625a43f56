"""Scalar functions and row-function replacements."""

from pyspark.sql import functions as F

from siftwell.functions import jsontext, scores, survey_text, text, urls
from siftwell.operators import learning, quality
from siftwell.plans import tables as t
from siftwell.plans.registry import query, view
from siftwell.schemas import CRITERIA_IDS, FORMAL_FLAGS, METHOD_FLAGS, SUBJECT_FLAGS, formal_response, violation_response

_BIN = """CASE WHEN score > -1 AND score <= -0.5 THEN 'bin_1' WHEN score > -0.5 AND score <= 0 THEN 'bin_2'
    WHEN score > 0 AND score <= 0.5 THEN 'bin_3' WHEN score > 0.5 AND score <= 1 THEN 'bin_4' WHEN score > 1 AND score <= 2 THEN 'bin_5'
    WHEN score > 2 AND score <= 5 THEN 'bin_6' WHEN score > 5 AND score <= 10 THEN 'bin_7' WHEN score > 10 THEN 'bin_8' ELSE 'bin_9' END"""


@query("h01_phrase_score", "SELECT uid, score, pos_keys, neg_keys FROM scored")
def h01(spark, sf):
    return t.scored(spark, sf).select("uid", "score", text.joined_keys(F.col("pos_keys")).alias("pos_keys"),
                                      text.joined_keys(F.col("neg_keys")).alias("neg_keys"))


def _parts(spark, sf):
    return t.table(spark, sf, "part").select(
        "p_partkey", F.initcap("p_name").alias("phrase"), F.col("p_size").cast("double").alias("score"))


@query("h02_dictionary_build", """
    WITH n AS (SELECT lower(p_name) AS phrase, max(-CAST(p_size AS DOUBLE)) AS score FROM part WHERE p_size = 1 GROUP BY 1),
    ps AS (SELECT lower(p_name) AS phrase, max(CAST(p_size AS DOUBLE)) AS score FROM part WHERE p_size > 1 GROUP BY 1)
    SELECT phrase, score, 'neg' AS polarity FROM n UNION ALL SELECT phrase, score, 'pos' FROM ps WHERE phrase NOT IN (SELECT phrase FROM n)""")
def h02(spark, sf):
    p = _parts(spark, sf)
    fold = lambda df, sign: df.groupBy("phrase").agg(F.max(F.col("score") * sign).alias("score"))
    return text.build_dictionary(fold(p.filter("score > 1"), 1), fold(p.filter("score = 1"), -1))


@query("h03_flatten_wide", """
    SELECT phrase, arg_max(score, pos) AS score FROM (
        SELECT p_name AS phrase, CAST(p_size AS DOUBLE) AS score, p_partkey * 3 AS pos FROM part
        UNION ALL SELECT p_type, CAST(p_size AS DOUBLE), p_partkey * 3 + 1 FROM part
        UNION ALL SELECT p_brand, CAST(p_size AS DOUBLE), p_partkey * 3 + 2 FROM part WHERE p_partkey % 3 <> 0) GROUP BY 1""")
def h03(spark, sf):
    wide = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("line"), F.col("p_name").alias("key"), F.col("p_size").cast("double").alias("score"),
        F.col("p_name").alias("en"), F.col("p_type").alias("fr"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("es"))
    return text.flatten_wide_dictionary(wide, "line")


@query("h04_phrase_key", "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS key FROM part")
def h04(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", text.phrase_key(F.initcap("p_name")).alias("key"))


@query("h05_score_category", """
    SELECT uid, CASE WHEN score = -1 THEN '-1' WHEN score = -0.5 THEN '-0.5' WHEN score = 0 THEN '0' WHEN score = 0.5 THEN '0.5' WHEN score = 1 THEN '1'
        WHEN score > 1 AND score <= 2 THEN '1 to 2' WHEN score > 2 AND score <= 5 THEN '2 to 5' WHEN score > 5 AND score <= 10 THEN '5 to 10'
        ELSE '10+' END AS category FROM binned""")
def h05(spark, sf):
    return t.binned(spark, sf).select("uid", scores.score_category(F.col("score")).alias("category"))


@query("h06_score_bin", f"SELECT uid, {_BIN} AS score_bin FROM scored")
def h06(spark, sf):
    return t.scored(spark, sf).select("uid", scores.score_bin(F.col("score")).alias("score_bin"))


@query("h07_bin_label", "SELECT uid, CASE score_bin " + " ".join(
    f"WHEN '{b}' THEN '{name}'" for b, name in scores.BIN_LABELS.items()) + " END AS label FROM binned")
def h07(spark, sf):
    return t.binned(spark, sf).select("uid", scores.bin_label(F.col("score_bin")).alias("label"))


@query("h08_normalised_url", r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/') AS url_norm FROM pages""")
def h08(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", urls.normalise_url(F.col("url")).alias("url_norm"))


@query("h09_domain", "SELECT uid, domain FROM pool_norm")
def h09(spark, sf):
    return t.pool_norm(spark, sf).select("uid", "domain")


@query("h10_host_variants", """
    SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, replace(split_part(split_part(url, '://', 2), '/', 1), 'www.', '') AS bare FROM pages""")
def h10(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.host_without_www(F.col("url")).alias("bare"))


@query("h11_url_uid", "SELECT page_id, md5(url) AS uid FROM pages")
def h11(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", urls.url_uid(F.col("url")).alias("uid"))


@query("h12_language_code", """
    SELECT uid, code, CASE code WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish'
        WHEN 'zh-cn' THEN 'Simplified Chinese' WHEN 'unknown' THEN 'Unknown' END AS name
    FROM (SELECT uid, CASE WHEN k % 9 = 0 THEN 'unknown' WHEN k % 50 < 2 THEN 'zh-cn' ELSE lang END AS code FROM docs)""")
def h12(spark, sf):
    k = F.col("k")
    raw = F.when(k % 18 == 0, F.lit(None)).when(k % 9 == 0, " ").when(k % 50 == 0, "zh-tw").when(k % 50 == 1, "zh-hk").otherwise(F.col("lang"))
    coded = t.docs(spark, sf).select("uid", text.language_code(raw).alias("code"))
    return coded.withColumn("name", text.language_name(F.col("code")))


@query("h13_country", """
    SELECT respondent, CASE WHEN country IS NULL THEN 'Unknown' WHEN trim(country) IN ('CZ', 'Czechia', 'Czech Republic') THEN 'Czechia'
        WHEN upper(trim(country)) IN ('UK', 'UNITED KINGDOM') THEN 'United Kingdom' WHEN country LIKE '%United Kingdom%' AND country LIKE '%,%' THEN 'Multi-UK'
        WHEN upper(trim(country)) = 'USA' THEN 'USA' WHEN upper(trim(country)) = 'FRANCE' THEN 'France' ELSE trim(country) END AS country_name,
        CASE WHEN upper(trim(country)) = 'UK' THEN 'UK' WHEN trim(country) IN ('CZ', 'Czechia', 'Czech Republic') THEN 'Czechia' ELSE trim(country) END AS display
    FROM people""")
def h13(spark, sf):
    c = F.col("country")
    return t.people(spark, sf).select("respondent", survey_text.country_name(c).alias("country_name"), survey_text.country_display(c).alias("display"))


view("schools", """
    SELECT respondent, CASE WHEN f IN ('uk', 'united kingdom') THEN 'UK' WHEN f IN ('cz', 'czechia', 'czech republic') THEN 'CZ'
        WHEN f IN ('germany', 'switzerland', 'austria') THEN 'DE-speak' ELSE 'Other' END AS school
    FROM (SELECT respondent, lower(trim(split_part(split_part(country, ',', 1), '/', 1))) AS f FROM people)""")


@query("h14_school", "SELECT respondent, school FROM schools")
def h14(spark, sf):
    return t.people(spark, sf).select("respondent", survey_text.school(F.col("country")).alias("school"))


@query("h15_institution", """
    SELECT respondent, CASE WHEN institution IS NULL THEN 'Not provided' WHEN lower(institution) LIKE '%leibniz%' AND lower(institution) NOT LIKE '%university%'
        THEN 'Research institute' WHEN regexp_matches(lower(institution), 'university|tu dresden|ensg|tu ') THEN 'University / higher education' ELSE 'Other' END AS kind
    FROM people""")
def h15(spark, sf):
    return t.people(spark, sf).select("respondent", survey_text.institution_class(F.col("institution")).alias("kind"))


@query("h16_years", "SELECT respondent, CAST(parsed AS DOUBLE) AS years FROM years_parsed")
def h16(spark, sf):
    return t.people(spark, sf).select("respondent", survey_text.parse_years(F.col("years")).alias("years"))


@query("h17_entropy", "SELECT uid, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS entropy FROM uncertain")
def h17(spark, sf):
    return t.vec(spark, sf).select("uid", t.r(scores.entropy(F.col("pred_proba"))).alias("entropy"))


@query("h18_margin", "SELECT uid, round(1 - 2 * abs(pred_proba - 0.5), 6) AS margin FROM vec")
def h18(spark, sf):
    return t.vec(spark, sf).select("uid", t.r(scores.margin(F.col("pred_proba"))).alias("margin"))


@query("h19_least_confident", "SELECT uid, round(1 - greatest(pred_proba, 1 - pred_proba), 6) AS least_confident FROM vec")
def h19(spark, sf):
    return t.vec(spark, sf).select("uid", t.r(scores.least_confident(F.col("pred_proba"))).alias("least_confident"))


@query("h20_buffered_size", """
    SELECT lang, count(*) AS n, CAST(floor(count(*) / (1 - 0.38::DOUBLE)) AS BIGINT) AS buffered FROM lab GROUP BY 1""")
def h20(spark, sf):
    return t.lab(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).withColumn(
        "buffered", F.floor(F.col("n") / (1 - 0.38)))


_TIER = "CASE WHEN pred_proba >= 0.8 THEN 'HIGH' WHEN pred_proba >= 0.6 THEN 'MEDIUM' WHEN pred_proba >= 0.5 THEN 'LOW' ELSE 'NEGATIVE' END"


@query("h21_confidence_tier", f"SELECT uid, {_TIER} AS tier FROM pool")
def h21(spark, sf):
    return t.pool(spark, sf).select("uid", scores.confidence_tier(F.col("pred_proba")).alias("tier"))


@query("h22_formal_criteria", f"""
    SELECT uid, TRUE AS passes_f1, passes_f3, passes_f4, passes_all,
           'F1:no condition|F3:' || CASE WHEN passes_f3 THEN 'OK' ELSE 'failed: {" and ".join(SUBJECT_FLAGS)}' END
           || '|F4:' || CASE WHEN passes_f4 THEN 'OK' ELSE 'failed: {" or ".join(METHOD_FLAGS)}' END AS details FROM cand""")
def h22(spark, sf):
    rows = quality.formal_criteria(t.cand(spark, sf).drop("passes_f3", "passes_f4", "passes_all"))
    told = F.array_join(F.transform("details", lambda d: F.concat_ws(":", d["criterion_id"], d["reason"])), "|")
    return rows.select("uid", "passes_f1", "passes_f3", "passes_f4", "passes_all", told.alias("details"))


@query("h23_truthiness", """
    SELECT k, CASE k % 4 WHEN 0 THEN TRUE WHEN 3 THEN NULL ELSE FALSE END AS flag FROM docs""")
def h23(spark, sf):
    m = F.col("k") % 4
    raw = F.when(m == 0, "True").when(m == 1, "false").when(m == 2, "maybe")
    return t.docs(spark, sf).select("k", scores.truthy(raw).alias("flag"))


@query("h24_final_flags", f"SELECT uid, {', '.join(f'COALESCE(human_{c}, disq_{c}) AS {c.lower()}' for c in CRITERIA_IDS)} FROM maps")
def h24(spark, sf):
    from siftwell.operators.filters import effective

    return t.map_flags(spark, sf).select("uid", *[effective(c).alias(c.lower()) for c in CRITERIA_IDS])


@query("h25_quality_score", "SELECT uid, quality_score, violations_count FROM maps")
def h25(spark, sf):
    return t.maps(spark, sf).select("uid", "quality_score", "violations_count")


view("school_weights", """
    SELECT school AS weight_set, criterion, (avg(rating) - 1) / 4 AS weight FROM grouped_ratings GROUP BY 1, 2""")
view("scenario_rows", """
    SELECT DISTINCT 'from_' || event_type AS scenario, event_type AS criterion FROM events
    UNION ALL SELECT 'all', event_type FROM (SELECT DISTINCT event_type FROM events)""")


def school_weights(spark, sf):
    return t.grouped_ratings(spark, sf).groupBy(F.col("school").alias("weight_set"), "criterion").agg(
        scores.severity_weight(F.avg("rating")).alias("weight"))


def scenario_rows(spark, sf):
    kinds = t.table(spark, sf, "events").select(F.col("event_type").alias("criterion")).distinct()
    names = F.explode(F.array(F.concat(F.lit("from_"), "criterion"), F.lit("all")))
    return kinds.select(names.alias("scenario"), "criterion")


@query("h26_quality_any_weights", """
    SELECT scenario, weight_set, round(60 * (1 - sum(weight) / any_value(total)), 6) AS q
    FROM scenario_rows JOIN school_weights USING (criterion) JOIN (SELECT weight_set, sum(weight) AS total FROM school_weights GROUP BY 1) USING (weight_set)
    GROUP BY 1, 2""")
def h26(spark, sf):
    return t.rounded(quality.quality_with_weights(scenario_rows(spark, sf), school_weights(spark, sf)), "q")


@query("h27_score_colour", """
    SELECT uid, CASE WHEN quality_score IS NULL THEN 'none' WHEN quality_score >= 55 THEN 'green' WHEN quality_score >= 40 THEN 'yellow'
        WHEN quality_score >= 20 THEN 'orange' ELSE 'red' END AS colour FROM maps""")
def h27(spark, sf):
    return t.maps(spark, sf).select("uid", scores.score_colour(F.col("quality_score")).alias("colour"))


@query("h28_weight_and_variation", """
    SELECT criterion, round((avg(rating) - 1) / 4, 6) AS weight, round(stddev_samp(rating) / avg(rating), 6) AS cv FROM ratings GROUP BY 1""")
def h28(spark, sf):
    g = t.ratings(spark, sf).groupBy("criterion").agg(F.avg("rating").alias("m"), F.stddev_samp("rating").alias("s"))
    return g.select("criterion", t.r(scores.severity_weight(F.col("m"))).alias("weight"), t.r(scores.variation(F.col("m"), F.col("s"))).alias("cv"))


@query("h29_effect_size", """
    SELECT respondent, round(d, 6) AS d, CASE WHEN abs(d) >= 1.2 THEN 'Very large' WHEN abs(d) >= 0.8 THEN 'Large' WHEN abs(d) >= 0.5 THEN 'Moderate'
        WHEN abs(d) >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect
    FROM (SELECT respondent, round((avg(rating) - 3) / NULLIF(stddev_samp(rating), 0), 9) AS d FROM ratings GROUP BY 1)""")
def h29(spark, sf):
    g = t.ratings(spark, sf).groupBy("respondent").agg(F.avg("rating").alias("m"), F.stddev_samp("rating").alias("s"))
    d = F.round(scores.cohen_d(F.col("m"), F.col("s")), 9)
    return g.select("respondent", t.r(d).alias("d"), scores.effect_label(d).alias("effect"))


@query("h30_strength_label", """
    SELECT uid, CASE WHEN pred_proba / 10 < 0.01 AND score / 13 > 0.8 THEN 'Very strong' WHEN pred_proba / 10 < 0.05 AND score / 13 > 0.6 THEN 'Strong'
        WHEN pred_proba / 10 < 0.1 THEN 'Moderate' ELSE 'Weak / none' END AS strength FROM pool""")
def h30(spark, sf):
    return t.pool(spark, sf).select("uid", scores.strength_label(F.col("score") / 13, F.col("pred_proba") / 10).alias("strength"))


@query("h31_json_extraction", """
    SELECT uid, k % 2 = 0 AS is_map, CASE WHEN k % 6 = 5 THEN NULL ELSE 'doc ' || uid END AS brief_description FROM docs WHERE k % 6 <> 5
    UNION ALL SELECT uid, NULL, NULL FROM docs WHERE k % 6 = 5""")
def h31(spark, sf):
    k = F.col("k") % 6
    flag = F.when(F.col("k") % 2 == 0, "true").otherwise("false")
    cut = F.concat(F.lit('{"is_map": '), flag, F.lit(', "brief_description": "doc '), "uid")
    whole = F.concat(cut, F.lit('"}'))
    raw = (F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
           .when(k == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" as you asked.")))
           .when(k == 3, cut).when(k == 4, F.concat(whole, F.lit(" and {not} more"))).otherwise("no object at all"))
    parsed = t.docs(spark, sf).select("uid", jsontext.extract_object(raw, formal_response()).alias("r"))
    return parsed.select("uid", scores.truthy(F.col("r.is_map")).alias("is_map"), "r.brief_description")


@query("h32_response_schema", f"""
    SELECT uid, {", ".join(f"CAST(disq_{c} AS VARCHAR) AS disq_{c}" for c in CRITERIA_IDS)}, disq_confidence AS confidence FROM maps
    WHERE disq_status = 'checked'""")
def h32(spark, sf):
    sent = t.map_flags(spark, sf).filter("disq_status = 'checked'").select("uid", F.to_json(F.struct(
        *[f"disq_{c}" for c in CRITERIA_IDS], F.col("disq_confidence").alias("confidence"))).alias("raw"))
    got = sent.select("uid", F.from_json("raw", violation_response()).alias("r"))
    return got.select("uid", *[f"r.disq_{c}" for c in CRITERIA_IDS], "r.confidence")


@query("h33_joined_keys", "SELECT uid, pos_keys FROM scored WHERE pos_keys <> ''")
def h33(spark, sf):
    return t.scored(spark, sf).select("uid", text.joined_keys(F.col("pos_keys")).alias("pos_keys")).filter("pos_keys <> ''")


@query("h34_fixed_length", "SELECT vec_id, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def h34(spark, sf):
    doubles = t.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return learning.fixed_length(doubles, 64).select("vec_id", F.size("embedding").cast("long").alias("dim"), t.r(total).alias("total"))


@query("h35_percent_change", """
    SELECT uid, round(CASE WHEN score > 0 THEN (pred_proba - score) / score * 100 ELSE 0 END, 6) AS change_pct,
           CASE WHEN pred_proba > score THEN 'up' WHEN pred_proba < score THEN 'down' ELSE 'same' END AS direction FROM pool""")
def h35(spark, sf):
    old, new = F.col("score"), F.col("pred_proba")
    return t.pool(spark, sf).select("uid", t.r(scores.percent_change(old, new)).alias("change_pct"), scores.direction(old, new).alias("direction"))


@query("h36_label_codes", """
    SELECT event_id, CASE WHEN label IN ('YES', 'TAK') THEN 1 WHEN label IN ('NO', 'NIE') THEN 0 ELSE -1 END AS code FROM annlog""")
def h36(spark, sf):
    return t.annlog(spark, sf).select("event_id", scores.label_code(F.col("label")).alias("code"))


@query("h37_short_text", "SELECT uid, substr(text, 1, 24) || '...' AS head FROM docs")
def h37(spark, sf):
    return t.docs(spark, sf).select("uid", scores.short_text(F.col("text"), 24).alias("head"))


# ---------------------------------------------------------------- row-function replacements

@query("l01_three_column_scoring", "SELECT uid, score, pos_keys, neg_keys FROM scored")
def l01(spark, sf):
    out = text.score_corpus(t.docs(spark, sf), t.dictionary(spark))
    return out.select("uid", "score", text.joined_keys(F.col("pos_keys")).alias("pos_keys"), text.joined_keys(F.col("neg_keys")).alias("neg_keys"))


@query("l02_element_function", "SELECT k, score_bin FROM binned")
def l02(spark, sf):
    return t.binned(spark, sf).select("k", scores.score_bin(F.col("score")).alias("score_bin"))


@query("l03_group_functions", """
    SELECT domain, count(*) AS n, count(*) FILTER (WHERE pred_proba >= 0.5) AS n_yes,
           array_to_string(array_agg(uid ORDER BY md5('42:' || uid)) FILTER (WHERE rn <= 2), ',') AS sample
    FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || uid), uid) AS rn FROM clean) GROUP BY 1""")
def l03(spark, sf):
    from siftwell.operators.sampling import cap_per_domain, draw_key

    rows = t.clean(spark, sf)
    picks = (cap_per_domain(rows, 2).groupBy("domain")
             .agg(F.array_sort(F.collect_list(F.struct(draw_key(F.col("uid")).alias("key"), "uid"))).alias("s")))
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("pred_proba") >= 0.5).alias("n_yes"))
    return counts.join(picks, "domain").select("domain", "n", "n_yes", F.array_join(F.transform("s", lambda x: x["uid"]), ",").alias("sample"))


view("tri", r"""
    SELECT k, lang, gram, count(*) AS n FROM (
        SELECT k, lang, substr(' ' || w || ' ', i, 3) AS gram FROM (
            SELECT k, lang, w, unnest(range(1, length(w) + 1)) AS i FROM (
                SELECT k, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM docs)))
    GROUP BY ALL""")
view("lang_profile", """
    SELECT lang, gram, ln((n + 1) / (total + 1)) AS weight, ln(1 / (total + 1)) AS floor_w FROM (
        SELECT lang, gram, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM tri GROUP BY 1, 2)""")


@query("l04_language_identification", """
    WITH g AS (SELECT t.k, p.lang, sum(t.n * (p.weight - p.floor_w)) AS gain, any_value(p.floor_w) AS f
               FROM tri t JOIN lang_profile p USING (gram) GROUP BY 1, 2),
    best AS (SELECT g.k, arg_min(lang, (-round(s.total * f + gain, 6), lang)) AS detected FROM g JOIN (SELECT k, sum(n) AS total FROM tri GROUP BY 1) s USING (k) GROUP BY 1)
    SELECT docs.uid, COALESCE(detected, 'unknown') AS detected FROM docs LEFT JOIN best USING (k)""")
def l04(spark, sf):
    d = t.docs(spark, sf).select("uid", "text", "lang")
    return text.identify_language(d, text.language_profiles(d))


@query("l05_text_condition", """
    SELECT uid, COALESCE(ai_is_map AND (ai_has_choropleth OR image_width >= 900), FALSE) AS passed FROM cand""")
def l05(spark, sf):
    return quality.evaluate_condition(t.cand(spark, sf), "ai_is_map and (ai_has_choropleth or image_width >= 900)",
                                      [*[f"ai_{f}" for f in FORMAL_FLAGS], "image_width", "image_height"]).select("uid", "passed")
