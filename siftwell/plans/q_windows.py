"""Window functions, samples, splits and set operations."""

from pyspark.sql import functions as F

from siftwell.functions.scores import confidence_tier
from siftwell.operators import learning, metrics, ordering, profiles, sampling, sets
from siftwell.plans import tables as t
from siftwell.plans.q_filters import results_by_lang
from siftwell.plans.q_profiles import quotas
from siftwell.plans.registry import query


@query("e01_dedup_best", "SELECT uid, url_norm, pred_proba FROM clean")
def e01(spark, sf):
    return profiles.dedup_best(t.pool_norm(spark, sf)).select("uid", "url_norm", "pred_proba")


@query("e02_dedup_first", """
    SELECT domain, uid, part FROM (SELECT *, k % 3 AS part, row_number() OVER (PARTITION BY domain ORDER BY k % 3, uid) AS rn FROM pool_norm)
    WHERE rn = 1""")
def e02(spark, sf):
    rows = t.pool_norm(spark, sf).withColumn("part", F.col("k") % 3)
    return profiles.dedup_first(rows, "domain", F.col("part"), F.col("uid")).select("domain", "uid", "part")


@query("e03_domain_cap", """
    SELECT uid, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || uid), uid) AS rn FROM clean) WHERE rn <= 3""")
def e03(spark, sf):
    return sampling.cap_per_domain(t.clean(spark, sf), 3).select("uid", "domain")


@query("e04_ranked_domain_cap", """
    SELECT uid, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE ai_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1
        ELSE 2 END, pred_proba DESC, uid) AS rn FROM cand WHERE ai_status = 'pass') WHERE rn <= 2
    ORDER BY md5('42:' || uid) LIMIT 25""")
def e04(spark, sf):
    capped = sampling.ranked_cap_per_domain(t.cand(spark, sf).filter("ai_status = 'pass'"), 2)
    return sampling.take_random(capped, 25).select("uid", "domain")


@query("e05_stratified_sample", """
    SELECT uid, stratum, pred_proba FROM (
        SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || uid), uid) AS rn FROM (
            SELECT *, CASE WHEN pred_proba >= 0.7 AND pred_proba < 0.8 THEN '0.70-0.80' WHEN pred_proba >= 0.8 AND pred_proba < 0.9
                   THEN '0.80-0.90' WHEN pred_proba >= 0.9 AND pred_proba < 1.01 THEN '0.90-1.01' END AS stratum FROM pool) WHERE stratum IS NOT NULL)
    WHERE rn <= CASE stratum WHEN '0.70-0.80' THEN 8 WHEN '0.80-0.90' THEN 14 ELSE 18 END""")
def e05(spark, sf):
    return sampling.stratified_sample(t.pool(spark, sf), 40).select("uid", "stratum", "pred_proba")


@query("e06_minimum_per_bin", """
    WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY score_bin ORDER BY md5('42:' || uid), uid) AS rn FROM binned) WHERE rn <= 7),
    rest AS (SELECT * FROM binned WHERE uid NOT IN (SELECT uid FROM m) ORDER BY md5('42:' || uid), uid LIMIT (SELECT 120 - count(*) FROM m))
    SELECT uid, score_bin FROM m UNION ALL SELECT uid, score_bin FROM rest""")
def e06(spark, sf):
    return sampling.minimum_per_bin_sample(t.binned(spark, sf), 120, 7).select("uid", "score_bin")


@query("e07_average_rank", """
    SELECT pred_proba, count(*) AS n, min(r) + (count(*) - 1) / 2 AS avg_rank
    FROM (SELECT pred_proba, rank() OVER (ORDER BY pred_proba) AS r FROM pool) GROUP BY 1""")
def e07(spark, sf):
    return ordering.average_ranks(t.pool(spark, sf), "pred_proba")


@query("e10_best_threshold", """
    SELECT round(threshold, 6) AS optimal_threshold, round(f1, 6) AS optimal_f1
    FROM (SELECT threshold, round(2 * p * r / (p + r + 1e-10), 12) AS f1 FROM (SELECT threshold, tp / seen AS p, tp / all_pos AS r FROM curve))
    ORDER BY f1 DESC, threshold LIMIT 1""")
def e10(spark, sf):
    return t.rounded(metrics.best_threshold(t.lab(spark, sf)), "optimal_threshold", "optimal_f1")


@query("e10_precision_recall_curve", """
    SELECT threshold, round(tp / seen, 6) AS precision, round(tp / all_pos, 6) AS recall FROM curve""")
def e10b(spark, sf):
    return t.rounded(metrics.precision_recall_curve(t.lab(spark, sf)), "precision", "recall").drop("f1")


@query("e12_latest_record", "SELECT uid, label, event_id FROM ann")
def e12(spark, sf):
    return t.ann(spark, sf)


@query("e13_ratio_to_total", """
    SELECT source, lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1, 2""")
def e13(spark, sf):
    return t.rounded(profiles.category_shares(t.table(spark, sf, "documents"), "source", "lang"), "percent")


@query("e14_model_trends", """
    SELECT model, round(b, 6) AS baseline_f1, round(l, 6) AS latest_f1, round(l - b, 6) AS change,
           round(CASE WHEN b > 0 THEN (l - b) / b * 100 ELSE 0 END, 6) AS change_pct, CASE WHEN l > b THEN 'up' WHEN l < b THEN 'down' ELSE 'same' END AS trend
    FROM (SELECT model, arg_min(f1, iteration) AS b, arg_max(f1, iteration) AS l FROM results_by_lang GROUP BY 1)
    ORDER BY round(l - b, 12) DESC, model LIMIT 3""")
def e14(spark, sf):
    best = learning.most_improved(learning.model_trends(results_by_lang(spark, sf)))
    return t.rounded(best, "baseline_f1", "latest_f1", "change", "change_pct")


@query("e16_samples_of_top_groups", """
    WITH g AS (SELECT domain, count(*) AS group_size FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
    SELECT domain, group_size, uid FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || uid), uid) AS rn FROM clean JOIN g USING (domain))
    WHERE rn <= 5""")
def e16(spark, sf):
    return sampling.samples_of_top_groups(t.clean(spark, sf), "domain", 6, 5).select("domain", "group_size", "uid")


@query("f06_most_uncertain", "SELECT uid, pred_proba, uncertainty FROM uncertain ORDER BY uncertainty DESC, uid LIMIT 96")
def f06(spark, sf):
    return sampling.most_uncertain(t.vec(spark, sf), 60).select("uid", "pred_proba", "uncertainty")


@query("f11_stratified_uncertain", "SELECT uid, pred_proba, uncertainty FROM strat_sel")
def f11(spark, sf):
    return sampling.stratified_uncertain(t.vec(spark, sf), 150).select("uid", "pred_proba", "uncertainty")


@query("f12_annotation_queue", """
    SELECT uid, score_bin FROM (
        SELECT uid, score_bin, row_number() OVER (PARTITION BY score_bin ORDER BY md5('42:' || uid), uid) AS rn
        FROM binned WHERE uid NOT IN (SELECT uid FROM ann)) JOIN quotas USING (score_bin) WHERE rn <= remaining""")
def f12(spark, sf):
    return sampling.annotation_queue(t.binned(spark, sf), t.ann(spark, sf), quotas(spark, sf)).select("uid", "score_bin")


# ---------------------------------------------------------------- set operations

@query("g01_union_parts", """
    SELECT uid, pred_proba, url FROM pool UNION ALL SELECT uid, pred_proba, NULL FROM vec""")
def g01(spark, sf):
    return sets.union_parts(t.pool(spark, sf).select("uid", "pred_proba", "url"), t.vec(spark, sf).select("uid", "pred_proba"))


@query("g02_extend_training", """
    SELECT uid, label, score FROM lab UNION ALL SELECT uid, label, NULL FROM vec WHERE uid NOT IN (SELECT uid FROM lab)""")
def g02(spark, sf):
    return sets.extend_training(t.lab(spark, sf).select("uid", "label", "score"), t.vec(spark, sf).select("uid", "label"))


@query("g03_common_keys", "SELECT uid FROM lab INTERSECT SELECT uid FROM vec")
def g03(spark, sf):
    return sets.common_keys(t.lab(spark, sf), t.vec(spark, sf))


@query("g04_missing_keys", "SELECT DISTINCT uid FROM annlog WHERE uid NOT IN (SELECT uid FROM lab)")
def g04(spark, sf):
    return sets.missing_keys(t.annlog(spark, sf), t.lab(spark, sf))


@query("g05_keyword_union", r"""
    SELECT DISTINCT lower(w) AS word FROM (SELECT lang, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) WHERE lang IN ('fr', 'en')""")
def g05(spark, sf):
    words = t.table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return sets.keyword_union(words.select("lang", F.lower("w").alias("word")), "fr")


@query("g06_tier_union", "SELECT uid, CASE WHEN pred_proba >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS tier, pred_proba FROM vec WHERE pred_proba >= 0.6")
def g06(spark, sf):
    tiered = t.vec(spark, sf).select("uid", confidence_tier(F.col("pred_proba")).alias("tier"), "pred_proba")
    return sets.tiers(tiered, ["HIGH", "MEDIUM"])


@query("g07_dictionary_version", """
    SELECT p_name || ' ' || p_brand AS phrase, max(CAST(p_size AS DOUBLE)) AS score FROM part WHERE p_size < 40
        AND p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_size >= 40) GROUP BY 1
    UNION ALL SELECT p_name || ' ' || p_brand, -max(CAST(p_size AS DOUBLE)) FROM part WHERE p_size >= 45 GROUP BY 1""")
def g07(spark, sf):
    from siftwell.functions.text import edit_dictionary

    part = t.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("phrase"), F.col("p_size").cast("double").alias("score"))
    pick = lambda low, high, sign: part.filter((F.col("score") >= low) & (F.col("score") < high)).groupBy("phrase").agg(
        (F.max("score") * sign).alias("score"))
    return edit_dictionary(pick(0, 40, 1), pick(45, 1000, -1), pick(40, 45, 1))


@query("i01_stratified_split", """
    WITH c AS (SELECT label, count(*) AS n, (SELECT ceil(count(*) * 0.2::DOUBLE) FROM lab) AS want, (SELECT count(*) FROM lab) AS total FROM lab GROUP BY 1),
    q AS (SELECT label, floor(want * n / total) AS base, row_number() OVER (ORDER BY round(floor(want * n / total) - want * n / total, 9), label) AS r,
                 want - sum(floor(want * n / total)) OVER () AS rest FROM c)
    SELECT uid, label, CASE WHEN rn <= base + CASE WHEN r <= rest THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split
    FROM (SELECT uid, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || uid), uid) AS rn FROM lab) JOIN q USING (label)""")
def i01(spark, sf):
    return sampling.stratified_split(t.lab(spark, sf).select("uid", "label"))


@query("i15_samples_per_tier", """
    SELECT uid, tier FROM (SELECT uid, tier, row_number() OVER (PARTITION BY tier ORDER BY md5('42:' || uid), uid) AS rn FROM (
        SELECT uid, CASE WHEN pred_proba >= 0.8 THEN 'HIGH' WHEN pred_proba >= 0.6 THEN 'MEDIUM' WHEN pred_proba >= 0.5 THEN 'LOW' ELSE 'NEGATIVE' END AS tier FROM vec))
    WHERE rn <= 100""")
def i15(spark, sf):
    tiered = t.vec(spark, sf).withColumn("tier", confidence_tier(F.col("pred_proba")))
    return sampling.samples_per_tier(tiered, 100).select("uid", "tier")
