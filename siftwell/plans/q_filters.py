"""Projections, filters, predicates and joins."""

from pyspark.sql import functions as F

from siftwell.functions.scores import half_open_band
from siftwell.functions.text import contains_any, matches_language_rules, score_texts_by_join, wanted_not_unwanted
from siftwell.operators import filters, joins, profiles
from siftwell.operators.sampling import shuffled_positions, take_random
from siftwell.plans import tables as t
from siftwell.plans.registry import query, view
from siftwell.schemas import CRITERIA_IDS


@query("b01_present_columns", "SELECT doc_id, lang, n_chars FROM documents")
def b01(spark, sf):
    return filters.select_present(t.table(spark, sf, "documents"), ["doc_id", "missing", "lang", "score", "n_chars"])


@query("b02_keyword_filter", "SELECT uid FROM docs WHERE regexp_matches(lower(text), 'thble|stand|quel')")
def b02(spark, sf):
    return t.docs(spark, sf).filter(contains_any(F.col("text"), ["thble", "Stand", "quel"])).select("uid")


@query("b03_wanted_not_unwanted", """
    SELECT uid FROM docs WHERE regexp_matches(text, 'thtion|\\(c\\)', 'i') AND NOT regexp_matches(text, 'erhe|license', 'i')""")
def b03(spark, sf):
    keep = wanted_not_unwanted(F.col("text"), ["ThTion", "(c)"], ["erhe", "License"])
    return t.docs(spark, sf).filter(keep).select("uid")


@query("b04_language_rules", """
    SELECT uid, lang FROM docs
    WHERE regexp_matches(lower(text), CASE lang WHEN 'fr' THEN 'eaux|thon' WHEN 'de' THEN 'isch|thon' ELSE 'thon' END)
      AND NOT regexp_matches(lower(text), CASE lang WHEN 'fr' THEN 'tionqu|erhe' WHEN 'de' THEN 'ungsch|erhe' ELSE 'erhe' END)""")
def b04(spark, sf):
    rule = matches_language_rules(F.col("text"), F.col("lang"), {"en": ["thon"], "fr": ["eaux"], "de": ["isch"]},
                                  {"en": ["erhe"], "fr": ["tionqu"], "de": ["ungsch"]})
    return t.docs(spark, sf).filter(rule).select("uid", "lang")


@query("b05_sign_split", """
    SELECT CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS sign, count(*) AS n
    FROM scored WHERE url_status = 'OK' GROUP BY 1""")
def b05(spark, sf):
    return filters.sign_counts(t.scored(spark, sf))


@query("b06_sign_transitions", """
    WITH s AS (SELECT sign(score) AS a, sign(score - n_chars % 5) AS b FROM scored)
    SELECT CASE a WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS from_sign,
           CASE b WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS to_sign, count(*) AS n
    FROM s WHERE a <> b GROUP BY 1, 2""")
def b06(spark, sf):
    two = t.scored(spark, sf).withColumn("score_2", F.col("score") - F.col("n_chars") % 5)
    return filters.transition_counts(two, "score", "score_2")


@query("b07_minimum_proba", "SELECT uid, pred_proba FROM pool WHERE pred_proba >= 0.7")
def b07(spark, sf):
    return t.pool(spark, sf).filter(filters.at_least("pred_proba", 0.7)).select("uid", "pred_proba")


@query("b08_save_threshold", """
    SELECT uid, 'at' AS rule FROM pool WHERE pred_proba >= 0.5
    UNION ALL SELECT uid, 'above' FROM pool WHERE pred_proba > 0.5""")
def b08(spark, sf):
    p = t.pool(spark, sf)
    at = p.filter(filters.at_least("pred_proba", 0.5)).select("uid", F.lit("at").alias("rule"))
    return at.union(p.filter(filters.at_least("pred_proba", 0.5, inclusive=False)).select("uid", F.lit("above")))


@query("b09_half_open_bands", """
    SELECT uid, CASE WHEN pred_proba >= 0.5 AND pred_proba < 0.6 THEN '[0.50, 0.60)' WHEN pred_proba >= 0.6 AND pred_proba < 0.8
        THEN '[0.60, 0.80)' WHEN pred_proba >= 0.8 AND pred_proba < 1.01 THEN '[0.80, 1.01)' END AS band FROM pool""")
def b09(spark, sf):
    band = half_open_band(F.col("pred_proba"), [0.5, 0.6, 0.8, 1.01])
    return t.pool(spark, sf).select("uid", band.alias("band"))


@query("b10_domain_exclusion", """
    SELECT uid, domain FROM pool_norm WHERE NOT regexp_matches(domain, '^(spam-farm\\.example\\.org|m\\.ththth\\.example\\.net)$')""")
def b10(spark, sf):
    return filters.exclude_domains(t.pool_norm(spark, sf), ["spam-farm.example.org"], ["m.ththth.example.net"]).select(
        "uid", "domain")


@query("b11_valid_labels", """
    SELECT event_id, CASE WHEN label IN ('YES', 'TAK') THEN 1 ELSE 0 END AS label FROM annlog WHERE label <> 'INVALID'""")
def b11(spark, sf):
    return filters.valid_labels(t.annlog(spark, sf)).select("event_id", "label")


@query("b12_review_label", """
    SELECT event_id FROM annlog WHERE label = 'INVALID'
    UNION ALL SELECT doc_id FROM labels WHERE quality = 1""")
def b12(spark, sf):
    text = filters.with_review_label(t.annlog(spark, sf), "INVALID").select("event_id")
    number = filters.with_review_label(t.table(spark, sf, "labels"), "YES", "quality").select("doc_id")
    return text.union(number)


@query("b13_candidate_filters", """
    SELECT uid FROM cand WHERE download_status = 'success' AND ai_status = 'pass' AND ai_map_language = 'en'
      AND ai_confidence = 'high' AND passes_f3 AND uid IN (SELECT uid FROM selected)
    UNION ALL SELECT uid FROM cand WHERE download_status = 'success' AND NOT passes_f4
    UNION ALL SELECT uid FROM cand WHERE download_status = 'success' AND uid IN (SELECT uid FROM selected WHERE batch_id = 2)""")
def b13(spark, sf):
    c, s = t.cand(spark, sf), t.selected(spark, sf)
    some = [{"status": "pass", "lang": "en", "confidence": "high", "f3": "1", "selected": "1"}, {"f4": "0"}, {"batch_id": 2}]
    parts = [filters.candidate_filter(c, f, s).select("uid") for f in some]
    return parts[0].union(parts[1]).union(parts[2])


@query("b14_gallery_filters", """
    SELECT uid FROM cand WHERE download_status = 'success' AND ai_has_choropleth AND image_width >= 500
      AND image_height >= 300 AND ai_description ILIKE '%BLOG%'""")
def b14(spark, sf):
    return filters.gallery_filter(t.cand(spark, sf), {"m_choro": "1", "min_w": "500", "min_h": "300", "search": "bLog"}).select("uid")


@query("b15_builder_filters", """
    SELECT uid FROM cand WHERE download_status = 'success' AND ai_status = 'pass' AND uid NOT IN (SELECT uid FROM selected)
      AND greatest(image_width, image_height) >= 600""")
def b15(spark, sf):
    return filters.builder_filter(t.cand(spark, sf), {"min_res": "600"}, t.selected(spark, sf)).select("uid")


@query("b16_effective_violation", """
    SELECT uid FROM maps WHERE COALESCE(human_D1, disq_D1) AND NOT COALESCE(human_L3, disq_L3)""")
def b16(spark, sf):
    return filters.map_filter(t.maps(spark, sf), {"v_D1": "1", "v_L3": "0"}).select("uid")


@query("b17_review_filters", """
    SELECT 'violations' AS show, uid FROM maps WHERE disq_status = 'checked' AND disq_A2
    UNION ALL SELECT 'ok', uid FROM maps WHERE disq_status = 'checked' AND NOT disq_A2
    UNION ALL SELECT 'not_reviewed', uid FROM maps WHERE disq_status = 'checked' AND human_A2 IS NULL
    UNION ALL SELECT 'overridden', uid FROM maps WHERE disq_status = 'checked' AND human_A2 <> disq_A2""")
def b17(spark, sf):
    m = t.maps(spark, sf)
    parts = [filters.map_filter(m, {"review_criterion": "A2", "review_show": s}).select(F.lit(s).alias("show"), "uid")
             for s in ("violations", "ok", "not_reviewed", "overridden")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("b18_score_and_method_filters", """
    SELECT uid, quality_score FROM maps WHERE quality_score BETWEEN 30 AND 50
      AND (ai_has_proportional_circles OR ai_has_graduated_circles OR ai_has_structural_circles)""")
def b18(spark, sf):
    return filters.map_filter(t.maps(spark, sf), {"q_min": "30", "q_max": "50", "m_circles": "1"}).select("uid", "quality_score")


@query("b19_selected_ids", "SELECT uid, disq_status FROM maps WHERE uid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)")
def b19(spark, sf):
    ids = t.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("uid"))
    return filters.selected_ids(t.map_flags(spark, sf), ids).select("uid", "disq_status")


@query("b20_large_groups", """
    SELECT domain, n, CASE WHEN n > 3 AND m < 0.5 THEN 'suspicious' ELSE 'good' END AS kind
    FROM (SELECT domain, count(*) AS n, avg(pred_proba) AS m FROM clean GROUP BY 1)
    WHERE (n > 3 AND m < 0.5) OR (n > 4 AND m > 0.55)""")
def b20(spark, sf):
    profile = t.clean(spark, sf).groupBy("domain").agg(F.count("*").alias("n"), F.avg("pred_proba").alias("mean_proba"))
    return filters.large_groups(profile, (3, 0.5), (4, 0.55)).select("domain", "n", "kind")


@query("b21_applicable_criteria", f"""
    SELECT uid, array_to_string([c FOR c IN {CRITERIA_IDS} IF CASE c WHEN 'A1' THEN ai_has_choropleth
        WHEN 'A3' THEN ai_has_choropleth OR circles WHEN 'V2' THEN circles ELSE TRUE END], ',') AS criteria
    FROM (SELECT *, ai_has_proportional_circles OR ai_has_graduated_circles OR ai_has_structural_circles AS circles FROM maps)""")
def b21(spark, sf):
    return t.map_flags(spark, sf).select("uid", F.array_join(filters.applicable_criteria(), ",").alias("criteria"))


@query("b22_working_corpus", "SELECT uid, score FROM scored WHERE score >= -1")
def b22(spark, sf):
    return filters.working_corpus(t.scored(spark, sf)).select("uid", "score")


# ---------------------------------------------------------------- joins

@query("c01_annotated_sample", "SELECT uid, score_bin, label FROM binned JOIN ann USING (uid)")
def c01(spark, sf):
    return joins.annotated_sample(t.binned(spark, sf), t.ann(spark, sf)).select("uid", "score_bin", "label")


@query("c02_labelled_embeddings", """
    SELECT a.uid, a.label, CAST(e.embedding[1] AS DOUBLE) AS x0, s.score,
           (SELECT count(*) FROM ann WHERE uid NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE label <> 3)) AS n_missing
    FROM ann a JOIN (SELECT * FROM embeddings WHERE label <> 3) e ON a.uid = CAST(e.vec_id AS VARCHAR)
    LEFT JOIN (SELECT * FROM binned WHERE lang = 'en') s ON a.uid = s.uid""")
def c02(spark, sf):
    e = t.table(spark, sf, "embeddings").filter("label <> 3").select(F.col("vec_id").cast("string").alias("uid"), "embedding")
    joined = joins.labelled_embeddings(t.ann(spark, sf), e, t.binned(spark, sf).filter("lang = 'en'"))
    missing = joins.missing_rows(t.ann(spark, sf), e).scalar()
    return joined.select("uid", "label", F.get("embedding", F.lit(0)).cast("double").alias("x0"), "score",
                         missing.alias("n_missing"))


@query("c03_unlabelled_pool", """
    SELECT uid, pred_proba, lang FROM vec JOIN (SELECT uid, lang FROM binned) USING (uid)
    WHERE uid NOT IN (SELECT uid FROM lab)""")
def c03(spark, sf):
    return joins.unlabelled_pool(t.vec(spark, sf), t.binned(spark, sf).select("uid", "lang"), t.lab(spark, sf)).select(
        "uid", "pred_proba", "lang")


@query("c04_rows_of_keys", "SELECT uid, label FROM vec WHERE uid IN (SELECT uid FROM lab WHERE label = 1)")
def c04(spark, sf):
    return joins.rows_of_keys(t.vectors(spark, sf).select("uid", "label"), t.lab(spark, sf).filter("label = 1"))


@query("c05_rows_without", """
    SELECT uid, score_bin FROM binned WHERE uid NOT IN (SELECT uid FROM lab) AND uid NOT IN (SELECT uid FROM ann)""")
def c05(spark, sf):
    return joins.rows_without(t.binned(spark, sf), t.lab(spark, sf), t.ann(spark, sf)).select("uid", "score_bin")


@query("c06_translation", """
    SELECT p_partkey AS key, p_name, CASE WHEN s_acctbal >= 4000 THEN s_name END AS fr
    FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def c06(spark, sf):
    base = t.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name")
    tr = t.table(spark, sf, "supplier").filter("s_acctbal >= 4000").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("fr"))
    return joins.add_translation(base, tr, "fr")


@query("c07_predictions_with_metadata", """
    SELECT v.uid, v.pred_proba, p.url, p.score FROM vec v JOIN pool p USING (uid) WHERE v.pred_proba > 0.5
    UNION ALL SELECT uid, pred_proba, NULL, NULL FROM vec WHERE pred_proba > 0.5""")
def c07(spark, sf):
    p = t.vec(spark, sf).filter("pred_proba > 0.5").select("uid", "pred_proba")
    with_meta = joins.predictions_with_metadata(p, t.pool(spark, sf))
    return with_meta.unionByName(joins.predictions_with_metadata(p, None)).select("uid", "pred_proba", "url", "score")


@query("c08_backfill", """
    SELECT c.uid, COALESCE(CASE WHEN c.pred_proba < 0.5 THEN c.url END, p.url) AS url
    FROM cand c LEFT JOIN (SELECT * FROM pool WHERE score > 0) p USING (uid)""")
def c08(spark, sf):
    holes = t.cand(spark, sf).select("uid", F.when(F.col("pred_proba") < 0.5, F.col("url")).alias("url"))
    return joins.backfill(holes, t.pool(spark, sf).filter("score > 0"))


@query("c09_run_counts", """
    SELECT r.id, r.step, count(c.uid) AS candidates_count
    FROM runs r LEFT JOIN (SELECT * FROM cand WHERE batch_id <> 1) c ON c.batch_id = r.id
    WHERE step LIKE '%sample%' OR step LIKE '%add%' GROUP BY 1, 2""")
def c09(spark, sf):
    return joins.run_counts(t.runs(spark, sf), t.cand(spark, sf).filter("batch_id <> 1")).select("id", "step", "candidates_count")


@query("c10_active_batches", """
    SELECT id, name, count_requested, (SELECT count(*) FROM selected WHERE batch_id = b.id) AS current_count
    FROM batches b WHERE status = 'active'""")
def c10(spark, sf):
    return joins.active_batches(t.batches(spark, sf), t.selected(spark, sf)).drop("status")


@query("c11_in_and_not_in", """
    SELECT uid, uid IN (SELECT uid FROM selected) AS member FROM cand WHERE ai_status = 'pass'""")
def c11(spark, sf):
    passing, s = t.cand(spark, sf).filter("ai_status = 'pass'").select("uid"), t.selected(spark, sf)
    inside = joins.rows_of_keys(passing, s).withColumn("member", F.lit(True))
    return inside.union(joins.rows_without(passing, s).withColumn("member", F.lit(False)))


@query("c12_sample_with_embeddings", """
    SELECT b.uid, b.score_bin, CAST(e.embedding[1] AS DOUBLE) AS x0
    FROM binned b LEFT JOIN embeddings e ON b.uid = CAST(e.vec_id AS VARCHAR)""")
def c12(spark, sf):
    return t.binned(spark, sf).join(t.vectors(spark, sf).select("uid", "embedding"), "uid", "left").select(
        "uid", "score_bin", F.get("embedding", F.lit(0)).cast("double").alias("x0"))


view("results_by_lang", """
    SELECT lang AS model, k AS iteration, 2.0 * tp / NULLIF(2 * tp + fp + fn, 0) AS f1
    FROM (SELECT lang, k, count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp,
                 count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn
          FROM (SELECT lang, label, k, (pred_proba * (k + 2) / 2) % 1 AS p FROM lab, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY ALL)""")


def results_by_lang(spark, sf):
    """F1 per language and threshold variant, standing for model results over iterations."""
    from siftwell.operators.metrics import confusion

    rows = t.lab(spark, sf).withColumn("iteration", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    rows = rows.withColumn("pred_proba", F.col("pred_proba") * (F.col("iteration") + 2) / 2 % 1)
    return confusion(rows, groups=["lang", "iteration"]).select(F.col("lang").alias("model"), "iteration", "f1")


@query("c13_compare_models", """
    SELECT b.model, round(b.f1, 6) AS baseline, round(i.f1, 6) AS iteration, round(i.f1 - b.f1, 6) AS change,
           round(CASE WHEN b.f1 > 0 THEN (i.f1 - b.f1) / b.f1 * 100 ELSE 0 END, 6) AS change_pct,
           CASE WHEN i.f1 > b.f1 THEN 'up' WHEN i.f1 < b.f1 THEN 'down' ELSE 'same' END AS trend
    FROM results_by_lang b JOIN results_by_lang i USING (model) WHERE b.iteration = 0 AND i.iteration = 1""")
def c13(spark, sf):
    res = results_by_lang(spark, sf)
    out = joins.compare_models(res.filter("iteration = 0"), res.filter("iteration = 1"))
    return t.rounded(out, "baseline", "iteration", "change", "change_pct")


@query("c14_phrase_join", "SELECT uid, score, pos_keys, neg_keys FROM scored")
def c14(spark, sf):
    out = score_texts_by_join(t.docs(spark, sf).select("uid", "text"), t.dictionary(spark))
    return out.select("uid", "score", F.array_join("pos_keys", "|").alias("pos_keys"), F.array_join("neg_keys", "|").alias("neg_keys"))


view("indexed", "SELECT row_number() OVER (ORDER BY respondent) - 1 AS idx, respondent FROM (SELECT DISTINCT respondent FROM ratings)")
view("draws", """
    SELECT b AS iteration, CAST('0x' || substr(md5('42:' || b || ':' || idx), 1, 12) AS BIGINT) % (SELECT count(*) FROM indexed) AS idx
    FROM indexed, (SELECT unnest(range(20)) AS b)""")


def indexed_respondents(spark, sf):
    """Respondents with their position in key order, found from per-value running totals."""
    from siftwell.operators.ordering import running_totals

    keys = t.ratings(spark, sf).select("respondent").distinct().withColumn("one", F.lit(1))
    return running_totals(keys, "respondent", ["one"]).select((F.col("cum_one") - 1).alias("idx"), "respondent")


@query("c15_resample_join", """
    SELECT d.iteration, r.criterion, count(*) AS n, round(avg(r.rating), 6) AS mean
    FROM draws d JOIN indexed USING (idx) JOIN ratings r USING (respondent) GROUP BY ALL""")
def c15(spark, sf):
    rows = indexed_respondents(spark, sf)
    size = rows.agg(F.count("*").alias("n")).scalar()
    drawn = joins.resample_join(joins.hashed_draws(spark, 20, size, rows), rows)
    both = drawn.join(t.ratings(spark, sf), "respondent")
    return t.rounded(both.groupBy("iteration", "criterion").agg(
        F.sum("weight").alias("n"), (F.sum(F.col("rating") * F.col("weight")) / F.sum("weight")).alias("mean")), "mean")


view("draws_10000", """
    SELECT b AS iteration, CAST('0x' || substr(md5('42:' || b || ':' || idx), 1, 12) AS BIGINT) % (SELECT count(*) FROM indexed) AS idx
    FROM indexed, (SELECT unnest(range(10000)) AS b)""")


@query("c15_resample_join_10000", """
    SELECT d.iteration, r.criterion, count(*) AS n, round(avg(r.rating), 6) AS mean
    FROM draws_10000 d JOIN indexed USING (idx) JOIN ratings r USING (respondent) GROUP BY ALL""")
def c15_10000(spark, sf):
    per = resampled_totals(spark, sf, 10_000)
    return t.rounded(per.select("iteration", "criterion", F.col("weight").alias("n"), (F.col("total") / F.col("weight")).alias("mean")), "mean")


def resampled_totals(spark, sf, iterations):
    """Draws and sum of ratings of each (iteration, criterion)."""
    return joins.resample_totals(indexed_respondents(spark, sf), t.ratings(spark, sf), iterations)


@query("c16_group_pairs", "SELECT a.lang AS a, b.lang AS b FROM (SELECT DISTINCT lang FROM documents) a JOIN (SELECT DISTINCT lang FROM documents) b ON a.lang < b.lang")
def c16(spark, sf):
    return joins.unordered_pairs(t.table(spark, sf, "documents"), "lang")


# ---------------------------------------------------------------- sorts and pages

@query("f01_global_sort", "SELECT uid, pred_proba FROM pool")
def f01(spark, sf):
    return t.pool(spark, sf).select("uid", "pred_proba").orderBy(F.desc("pred_proba"), "uid")


@query("f02_top_predictions", """
    SELECT substr(uid, 1, 32) || '...' AS short_uid, pred_proba, score FROM pool ORDER BY pred_proba DESC, uid LIMIT 20""")
def f02(spark, sf):
    from siftwell.functions.scores import short_text
    from siftwell.operators.ordering import top_rows

    return top_rows(t.pool(spark, sf), 20, F.desc("pred_proba"), F.col("uid")).select(
        short_text(F.col("uid")).alias("short_uid"), "pred_proba", "score")


_ORDERS = {"status": "CASE ai_status WHEN 'pass' THEN 0 WHEN 'fail' THEN 1 ELSE 2 END, pred_proba DESC",
           "proba_desc": "pred_proba DESC", "proba_asc": "pred_proba ASC NULLS FIRST",
           "res_desc": "image_width * image_height DESC", "res_asc": "image_width * image_height ASC NULLS FIRST", "domain": "domain, pred_proba DESC",
           "lang": "ai_map_language ASC NULLS FIRST, pred_proba DESC"}


@query("f03_multi_key_sort", "\nUNION ALL\n".join(f"""
    SELECT '{s}' AS sort, uid, rn FROM (SELECT uid, row_number() OVER (ORDER BY {o}, uid) AS rn
        FROM cand WHERE download_status = 'success') WHERE rn <= 40""" for s, o in _ORDERS.items()))
def f03(spark, sf):
    from pyspark.sql import Window
    from siftwell.operators.sets import union_parts

    rows = filters.candidate_filter(t.cand(spark, sf), {})
    parts = []
    for s in _ORDERS:
        top = rows.orderBy(*filters.candidate_order(s)).limit(40)
        rank = F.row_number().over(Window.orderBy(*filters.candidate_order(s)))
        parts.append(top.select(F.lit(s).alias("sort"), "uid", rank.alias("rn")))
    return union_parts(*parts)


@query("f04_page", """
    SELECT uid, quality_score, (SELECT count(*) FROM maps WHERE disq_status = 'checked') AS total
    FROM maps WHERE disq_status = 'checked' ORDER BY violations_count DESC, quality_score, uid LIMIT 30 OFFSET 30""")
def f04(spark, sf):
    rows = filters.map_filter(t.maps(spark, sf), {"status": "checked"})
    return filters.page_of(rows, filters.map_order("violations"), page=2).select("uid", "quality_score", "total")


@query("f05_top_domains", "SELECT domain, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def f05(spark, sf):
    return profiles.top_groups(t.clean(spark, sf), "domain", 10)


@query("f07_random_sample", "SELECT uid, pred_proba FROM pool ORDER BY md5('42:' || uid) LIMIT 60")
def f07(spark, sf):
    return take_random(t.pool(spark, sf), 60).select("uid", "pred_proba")


@query("f08_random_preview", """
    SELECT uid, domain FROM cand WHERE ai_status = 'pass' AND uid NOT IN (SELECT uid FROM selected)
    ORDER BY md5('7:' || uid) LIMIT 30""")
def f08(spark, sf):
    return take_random(filters.builder_filter(t.cand(spark, sf), {}, t.selected(spark, sf)), 30, seed=7).select("uid", "domain")


@query("f09_review_order", "SELECT uid, score FROM binned ORDER BY score DESC, uid LIMIT 25")
def f09(spark, sf):
    return filters.review_order(t.binned(spark, sf), 25).select("uid", "score")


@query("f10_shuffle", "SELECT uid, row_number() OVER (ORDER BY md5('42:' || uid)) AS position FROM pool")
def f10(spark, sf):
    return shuffled_positions(t.pool(spark, sf).select("uid"))


@query("f13_last_runs", "SELECT id, step, items_processed FROM runs ORDER BY id DESC LIMIT 5")
def f13(spark, sf):
    from siftwell.operators.state import last_runs

    return last_runs(t.runs(spark, sf))

