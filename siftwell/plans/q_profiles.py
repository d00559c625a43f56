"""Aggregations: frequency tables, histograms, band and group profiles, run statistics."""

from pyspark.sql import functions as F

from siftwell.functions.scores import score_category
from siftwell.functions.survey_text import parse_years
from siftwell.functions.text import keyword_row_counts, language_code
from siftwell.operators import filters, metrics, profiles, quality, sampling
from siftwell.plans import tables as t
from siftwell.plans.registry import query, view
from siftwell.schemas import CRITERIA_IDS, METHOD_FLAGS, SUBJECT_FLAGS
from siftwell.sources import readers
from siftwell.session import scratch_dir


@query("d01_frequency_table", """
    SELECT country, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM people), 6) AS percent
    FROM people WHERE country IS NOT NULL GROUP BY 1""")
def d01(spark, sf):
    return t.rounded(profiles.frequency_table(t.people(spark, sf), "country"), "percent")


view("lang_shares", """
    SELECT code, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent
    FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'unknown' WHEN doc_id % 50 < 2 THEN 'zh-cn' ELSE lang END AS code FROM documents)
    GROUP BY 1""")


def lang_shares(spark, sf):
    raw = (F.when(F.col("k") % 9 == 0, "  ").when(F.col("k") % 50 == 0, "zh-tw").when(F.col("k") % 50 == 1, "zh-hk")
           .otherwise(F.col("lang")))
    return profiles.category_shares(t.docs(spark, sf), language_code(raw).alias("code"))


@query("d02_language_shares", "SELECT code, n, round(percent, 6) AS percent FROM lang_shares")
def d02(spark, sf):
    return t.rounded(lang_shares(spark, sf), "percent").orderBy(F.desc("n"), "code")


@query("d03_coverage", """
    SELECT round(sum(percent) FILTER (WHERE percent >= 5), 6) AS covered, count(*) FILTER (WHERE percent >= 5) AS n_above,
           count(*) FILTER (WHERE percent < 5) AS n_below FROM lang_shares""")
def d03(spark, sf):
    return t.rounded(profiles.coverage(lang_shares(spark, sf), 5), "covered")


@query("d04_selected_languages", """
    SELECT code, n, round(percent, 6) AS percent, round(sum(percent) OVER (), 6) AS covered
    FROM lang_shares WHERE percent >= 5 AND code <> 'unknown'""")
def d04(spark, sf):
    return t.rounded(profiles.selected_categories(lang_shares(spark, sf), "code", 5), "percent", "covered")


_KEYWORDS = ["thon", "erhe", "age", "eaux", "isch", "cion", "nosuchword", "the"]


@query("d05_keyword_rows", f"""
    SELECT w AS phrase, count(*) AS n_rows FROM docs, (SELECT unnest({_KEYWORDS}) AS w)
    WHERE contains(lower(text), w) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def d05(spark, sf):
    return keyword_row_counts(t.docs(spark, sf), _KEYWORDS).orderBy(F.desc("n_rows"), "phrase").limit(10)


_PCTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("d06_describe", f"""
    SELECT count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, min(score) AS min,
           max(score) AS max, {", ".join(f"round(quantile_cont(score, {p}), 6) AS p{round(p * 100)}" for p in _PCTS)}
    FROM binned""")
def d06(spark, sf):
    out = profiles.describe(t.binned(spark, sf), "score", _PCTS)
    return t.rounded(out, "mean", "sd", *[f"p{round(p * 100)}" for p in _PCTS])


@query("d07_histogram", """
    WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
    SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
    FROM documents, s GROUP BY 1""")
def d07(spark, sf):
    return profiles.histogram(t.table(spark, sf, "documents"), "n_chars", 50)


@query("d08_category_percent", """
    SELECT c AS score_category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
    FROM (SELECT CASE WHEN score IN (-1, -0.5, 0, 0.5, 1) THEN CASE score WHEN -1 THEN '-1' WHEN -0.5 THEN '-0.5' WHEN 0 THEN '0'
                 WHEN 0.5 THEN '0.5' ELSE '1' END WHEN score > 1 AND score <= 2 THEN '1 to 2' WHEN score > 2 AND score <= 5
                 THEN '2 to 5' WHEN score > 5 AND score <= 10 THEN '5 to 10' ELSE '10+' END AS c FROM scored) GROUP BY 1""")
def d08(spark, sf):
    return t.rounded(profiles.category_shares(t.scored(spark, sf), score_category(F.col("score")).alias("score_category")), "percent")


view("binned_ann", """
    SELECT uid, score_bin, CASE WHEN label IN ('YES', 'TAK') THEN 'YES' WHEN label IN ('NO', 'NIE') THEN 'NO' ELSE 'INVALID' END AS label
    FROM binned JOIN ann USING (uid)""")


def binned_ann(spark, sf):
    return t.binned(spark, sf).join(t.ann(spark, sf), "uid")


@query("d09_label_bins", """
    SELECT score_bin, count(*) FILTER (WHERE label = 'YES') AS yes_count, count(*) FILTER (WHERE label = 'NO') AS no_count,
           count(*) FILTER (WHERE label = 'INVALID') AS invalid_count, count(*) AS total_annotated,
           round(yes_count * 100.0 / total_annotated, 6) AS yes_percent, round(no_count * 100.0 / total_annotated, 6) AS no_percent,
           round(invalid_count * 100.0 / total_annotated, 6) AS invalid_percent
    FROM binned_ann GROUP BY 1""")
def d09(spark, sf):
    return t.rounded(profiles.label_bins(binned_ann(spark, sf)), "yes_percent", "no_percent", "invalid_percent")


@query("d10_label_distribution", """
    SELECT 'all' AS scope, NULL AS bin, label AS name, count(*) AS n FROM binned_ann GROUP BY label
    UNION ALL SELECT 'valid', NULL, label, count(*) FROM binned_ann WHERE label <> 'INVALID' GROUP BY label
    UNION ALL SELECT 'bin', score_bin, label, count(*) FROM binned_ann GROUP BY score_bin, label""")
def d10(spark, sf):
    return profiles.label_distribution(binned_ann(spark, sf))


@query("d11_split_profile", """
    SELECT CASE WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS size, count(*) FILTER (WHERE v.label = 1) AS n_yes,
           count(*) FILTER (WHERE v.label = 0) AS n_no, round(avg(v.label), 6) AS class_balance, max(len(embedding)) AS dim,
           round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_sd, min(score) AS score_min, max(score) AS score_max
    FROM vec v JOIN embeddings ON vec_id = k GROUP BY 1""")
def d11(spark, sf):
    rows = t.vectors(spark, sf).withColumn("split", F.when(F.col("k") % 5 == 0, "test").otherwise("train"))
    return t.rounded(profiles.split_profile(rows), "class_balance", "score_mean", "score_sd")


@query("d12_annotation_progress", """
    SELECT CASE WHEN label IN ('YES', 'TAK') THEN 'TAK' WHEN label IN ('NO', 'NIE') THEN 'NIE' ELSE label END AS class, count(*) AS n
    FROM ann GROUP BY 1""")
def d12(spark, sf):
    return profiles.annotation_progress(t.ann(spark, sf))


@query("d13_annotated_per_bin", "SELECT score_bin, count(*) AS n_done FROM binned_ann WHERE label <> 'INVALID' GROUP BY 1")
def d13(spark, sf):
    return profiles.annotated_per_bin(t.binned(spark, sf), t.ann(spark, sf))


view("quotas", """
    SELECT score_bin, n, q + CASE WHEN rn = 1 THEN 60 - sum(q) OVER () ELSE 0 END AS quota, n_done,
           greatest(q + CASE WHEN rn = 1 THEN 60 - sum(q) OVER () ELSE 0 END - n_done, 0) AS remaining
    FROM (SELECT *, row_number() OVER (ORDER BY q DESC, n DESC, score_bin) AS rn
          FROM (SELECT score_bin, count(*) AS n, round_even(60 * (count(*) / sum(count(*)) OVER ()), 0) AS q,
                       count(*) FILTER (WHERE uid IN (SELECT uid FROM binned_ann WHERE label <> 'INVALID')) AS n_done
                FROM binned GROUP BY 1))""")


def quotas(spark, sf):
    done = profiles.annotated_per_bin(t.binned(spark, sf), t.ann(spark, sf))
    return sampling.bin_quotas(t.binned(spark, sf), 60, done)


@query("d14_bin_quotas", """
    SELECT score_bin, n, CAST(quota AS BIGINT) AS quota, n_done, CAST(remaining AS BIGINT) AS remaining FROM quotas""")
def d14(spark, sf):
    return quotas(spark, sf)


@query("d15_prediction_summary", """
    SELECT count(*) AS n, count(*) FILTER (WHERE pred_proba >= 0.5) AS n_yes, round(avg((pred_proba >= 0.5)::INT), 6) AS yes_share,
           round(avg(pred_proba), 6) AS mean_proba, round(median(pred_proba), 6) AS median_proba FROM vec""")
def d15(spark, sf):
    return t.rounded(profiles.prediction_summary(t.vec(spark, sf)), "yes_share", "mean_proba", "median_proba")


@query("d16_prediction_stats", """
    SELECT count(*) AS n, round(min(pred_proba), 6) AS min_p, round(avg(pred_proba), 6) AS mean_p, round(max(pred_proba), 6) AS max_p,
           round(stddev_samp(pred_proba), 6) AS sd_p, min(score) AS min_score, round(avg(score), 6) AS mean_score, max(score) AS max_score,
           round(quantile_cont(pred_proba, 0.25), 6) AS q25_p, round(median(pred_proba), 6) AS median_p,
           round(quantile_cont(pred_proba, 0.75), 6) AS q75_p, round(median(score), 6) AS median_score FROM vec""")
def d16(spark, sf):
    out = profiles.prediction_stats(t.vec(spark, sf))
    return t.rounded(out, "min_p", "mean_p", "max_p", "sd_p", "mean_score", "q25_p", "median_p", "q75_p", "median_score")


@query("d17_confidence_breakdown", """
    SELECT band, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM pool), 6) AS percent
    FROM (SELECT CASE WHEN pred_proba >= 0.5 AND pred_proba <= 0.6 THEN '0.5-0.6' WHEN pred_proba > 0.6 AND pred_proba <= 0.7 THEN '0.6-0.7'
                 WHEN pred_proba > 0.7 AND pred_proba <= 0.8 THEN '0.7-0.8' WHEN pred_proba > 0.8 AND pred_proba <= 0.9 THEN '0.8-0.9'
                 WHEN pred_proba > 0.9 AND pred_proba <= 1 THEN '0.9-1.0' END AS band FROM pool
          UNION ALL SELECT CASE WHEN pred_proba >= 0.8 THEN 'HIGH' WHEN pred_proba >= 0.6 THEN 'MEDIUM' WHEN pred_proba >= 0.5 THEN 'LOW' END FROM pool)
    WHERE band IS NOT NULL GROUP BY 1""")
def d17(spark, sf):
    return t.rounded(profiles.confidence_breakdown(t.pool(spark, sf)), "percent")


@query("d18_correlation", "SELECT round(corr(score, pred_proba), 6) AS correlation FROM vec")
def d18(spark, sf):
    return t.rounded(profiles.score_proba_correlation(t.vec(spark, sf)), "correlation")


@query("d19_proba_by_score_bin", """
    SELECT CASE WHEN score <= 0 THEN '[-1, 0]' WHEN score <= 1 THEN '(0, 1]' WHEN score <= 2 THEN '(1, 2]' WHEN score <= 5 THEN '(2, 5]'
                WHEN score <= 10 THEN '(5, 10]' ELSE '(10, 100]' END AS score_band, count(*) AS n, round(avg(pred_proba), 6) AS mean_proba
    FROM vec WHERE score >= -1 AND score <= 100 GROUP BY 1""")
def d19(spark, sf):
    return t.rounded(profiles.proba_by_score_bin(t.vec(spark, sf)), "mean_proba")


@query("d20_part_stats", """
    SELECT COALESCE(part, 'TOTAL') AS part, n_total, n_positive, positive_rate FROM (
        SELECT 'part_' || CAST(k % 4 AS VARCHAR) AS part, count(*) AS n_total, count(*) FILTER (WHERE pred_proba >= 0.5) AS n_positive,
               round(avg((pred_proba >= 0.5)::INT), 6) AS positive_rate FROM vec GROUP BY ROLLUP (part))""")
def d20(spark, sf):
    rows = t.vec(spark, sf).withColumn("part", F.concat(F.lit("part_"), (F.col("k") % 4).cast("string")))
    return t.rounded(profiles.part_stats(rows, "part"), "positive_rate")


@query("d20_throughput", """
    SELECT count(DISTINCT k % 4) AS n_files, count(*) AS n_total, count(*) FILTER (WHERE pred_proba >= 0.5) AS n_positive, round(avg((pred_proba >= 0.5)::INT), 6) AS positive_rate,
           TRUE AS positive, TRUE AS rows_agree, TRUE AS files_agree, TRUE AS all_written FROM vec""")
def d20_throughput(spark, sf):
    """A whole scoring run, with its speed: positive, and rows and files per time that agree with the counts and the seconds."""
    path = scratch_dir(spark, "run")
    run = profiles.scored_run(t.vec(spark, sf), path, 0.5, F.col("k") % 4)
    written = spark.read.parquet(path).agg(F.count("*").alias("n")).scalar()
    close = lambda a, b: F.abs(a - b) <= 1e-6 * b
    return t.rounded(run, "positive_rate").select(
        "n_files", "n_total", "n_positive", "positive_rate", ((F.col("rows_per_second") > 0) & (F.col("files_per_minute") > 0)).alias("positive"),
        close(F.col("rows_per_second") * F.col("seconds"), F.col("n_total")).alias("rows_agree"),
        close(F.col("files_per_minute") * F.col("seconds") / 60, F.col("n_files")).alias("files_agree"), (written == F.col("n_total")).alias("all_written"))


@query("d21_chunk_summary", """
    SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(s) AS BIGINT) AS n_saved, round(avg(s / n), 6) AS mean_save_rate,
           round(avg(m), 6) AS mean_proba, CAST(floor(sum(h) * 0.95::DOUBLE + sum(md) * 0.82::DOUBLE) AS BIGINT) AS expected_true
    FROM (SELECT k % 7 AS c, count(*) AS n, count(*) FILTER (WHERE pred_proba > 0.5) AS s, avg(pred_proba) AS m,
                 count(*) FILTER (WHERE pred_proba >= 0.8) AS h, count(*) FILTER (WHERE pred_proba >= 0.6 AND pred_proba < 0.8) AS md
          FROM vec GROUP BY 1)""")
def d21(spark, sf):
    rows = t.vec(spark, sf).withColumn("chunk", F.col("k") % 7)
    return t.rounded(profiles.chunk_summary(rows, "chunk"), "mean_save_rate", "mean_proba")


@query("d22_distinct_counts", """
    SELECT count(DISTINCT url) AS n_url, count(DISTINCT url_norm) AS n_url_norm, count(DISTINCT domain) AS n_domain FROM pool_norm""")
def d22(spark, sf):
    return profiles.distinct_counts(t.pool_norm(spark, sf), "url", "url_norm", "domain")


view("url_copies", """
    SELECT url_norm, count(*) AS copies, arg_min(domain, uid) AS domain, arg_min(url, uid) AS sample_url, avg(pred_proba) AS mean_proba
    FROM pool_norm GROUP BY 1""")


@query("d23_url_copies", """
    SELECT url_norm, copies, domain, sample_url, round(mean_proba, 6) AS mean_proba FROM url_copies ORDER BY copies DESC, url_norm LIMIT 30""")
def d23(spark, sf):
    top = profiles.url_copies(t.pool_norm(spark, sf)).orderBy(F.desc("copies"), "url_norm").limit(30)
    return t.rounded(top, "mean_proba")


@query("d23_copy_bands", """
    SELECT CASE WHEN copies = 1 THEN '1' WHEN copies <= 5 THEN '2-5' WHEN copies <= 50 THEN '6-50' ELSE '>50' END AS band,
           count(*) AS n_urls, CAST(sum(copies) AS BIGINT) AS n_rows FROM url_copies GROUP BY 1""")
def d23b(spark, sf):
    return profiles.copy_bands(profiles.url_copies(t.pool_norm(spark, sf)))


@query("d24_domain_profile", """
    SELECT domain, count(*) AS n, round(avg(pred_proba), 6) AS mean_proba, round(median(pred_proba), 6) AS median_proba,
           min(pred_proba) AS min_proba, max(pred_proba) AS max_proba FROM clean GROUP BY 1""")
def d24(spark, sf):
    return t.rounded(profiles.domain_profile(t.clean(spark, sf)), "mean_proba", "median_proba")


@query("d25_domain_bands", """
    SELECT CASE WHEN n = 1 THEN '1 image' WHEN n <= 10 THEN '2-10' WHEN n <= 50 THEN '11-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500
           THEN '101-500' WHEN n <= 1000 THEN '501-1k' WHEN n <= 10000 THEN '1k-10k' ELSE '10k+' END AS band,
           count(*) AS n_domains, CAST(sum(n) AS BIGINT) AS n_images
    FROM (SELECT domain, count(*) AS n FROM clean GROUP BY 1) GROUP BY 1""")
def d25(spark, sf):
    return profiles.domain_bands(t.clean(spark, sf).groupBy("domain").agg(F.count("*").alias("n")))


_EDGES = [0.5, 0.6, 0.7, 0.8, 0.9, 1.01]


@query("d26_proba_bands", "SELECT * FROM (SELECT CASE " + " ".join(
    f"WHEN pred_proba >= {a} AND pred_proba < {b} THEN '[{a:.2f}, {b:.2f})'" for a, b in zip(_EDGES, _EDGES[1:]))
    + " END AS band, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM clean GROUP BY 1) WHERE band IS NOT NULL")
def d26(spark, sf):
    return t.rounded(profiles.proba_bands(t.clean(spark, sf), _EDGES), "percent")


# Caps and floors sized for the test pool, so that the caps bind.
_SCENARIOS = [("A", 0.7, 2), ("B", 0.7, 3), ("C", 0.6, 3), ("D", 0.5, 5), ("H", 0.5, None)]


def _yield_sql(cells: str) -> str:
    return f"""
    SELECT *, CAST(floor(n_downloaded * 0.75::DOUBLE) AS BIGINT) AS n_pass, round(n_downloaded * 0.002::DOUBLE, 6) AS cost,
           round(n_downloaded * 0.002::DOUBLE / 1800 * 100, 6) AS budget_pct
    FROM (SELECT *, CAST(floor(n_alive * 0.97::DOUBLE) AS BIGINT) AS n_downloaded
          FROM (SELECT *, CAST(floor(n_candidates * 0.65::DOUBLE) AS BIGINT) AS n_alive FROM ({cells})))"""


def _capped_sql(name, p, cap) -> str:
    size = f"least(n, {cap})" if cap else "n"
    return (f"SELECT '{name}' AS scenario, CAST(sum({size}) AS BIGINT) AS n_candidates, count(*) AS n_domains FROM "
            f"(SELECT domain, count(*) AS n FROM clean WHERE pred_proba >= {p} GROUP BY 1)")


@query("d27_sampling_scenarios", _yield_sql(" UNION ALL ".join(_capped_sql(*s) for s in _SCENARIOS)))
def d27(spark, sf):
    return t.rounded(profiles.sampling_scenarios(t.clean(spark, sf), _SCENARIOS), "cost", "budget_pct")


@query("d28_cap_impact", """
    SELECT cap, CAST(sum(least(n, cap)) AS BIGINT) AS n_kept, count(*) FILTER (WHERE n > cap) AS domains_capped,
           CAST(sum(greatest(n - cap, 0)) AS BIGINT) AS n_lost
    FROM (SELECT domain, count(*) AS n FROM clean GROUP BY 1), (SELECT unnest([1, 2, 5, 10, 25, 50]) AS cap) GROUP BY 1""")
def d28(spark, sf):
    return profiles.cap_impact(t.clean(spark, sf), (1, 2, 5, 10, 25, 50))


@query("d29_final_plan", "SELECT *, round(1800 - cost, 6) AS budget_left FROM (" + _yield_sql(_capped_sql("final", 0.7, 3)) + ")")
def d29(spark, sf):
    return t.rounded(profiles.final_plan(t.clean(spark, sf), 0.7, 3), "cost", "budget_pct", "budget_left")


_STATES = {
    "total": "TRUE", "url_alive": "url_status = 'alive'", "url_dead": "url_status IN ('dead', 'error')",
    "url_pending": "url_status = 'pending'", "downloaded": "download_status = 'success'",
    "download_failed": "download_status IN ('failed', 'not_image')",
    "download_pending": "url_status = 'alive' AND download_status = 'pending'", "ai_pass": "ai_status = 'pass'",
    "ai_fail": "ai_status = 'fail'", "ai_error": "ai_status = 'error'",
    "ai_pending": "download_status = 'success' AND ai_status = 'pending'", "passes_all": "passes_all"}


@query("d30_status_counts", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count(*) AS n FROM cand WHERE {c}" for m, c in _STATES.items()))
def d30(spark, sf):
    return profiles.status_counts(t.cand(spark, sf))


@query("d31_resolution_profile", """
    SELECT count(*) AS n, min(image_width) AS min_w, min(image_height) AS min_h, max(image_width) AS max_w, max(image_height) AS max_h,
           round(avg(image_width), 6) AS avg_w, round(avg(image_height), 6) AS avg_h,
           count(*) FILTER (WHERE least(image_width, image_height) < 400) AS below_400,
           count(*) FILTER (WHERE least(image_width, image_height) < 600) AS below_600,
           count(*) FILTER (WHERE least(image_width, image_height) < 800) AS below_800
    FROM cand WHERE download_status = 'success'""")
def d31(spark, sf):
    return t.rounded(profiles.resolution_profile(t.cand(spark, sf)), "avg_w", "avg_h")


@query("d32_method_counts", " UNION ALL ".join(
    f"SELECT '{m}' AS method, count(*) AS n FROM cand WHERE passes_all AND ai_{m}" for m in METHOD_FLAGS))
def d32(spark, sf):
    return profiles.method_counts(t.cand(spark, sf).filter("passes_all"))


def _facet_sql(source: str, cols: dict, top: dict) -> str:
    parts = []
    for name, c in cols.items():
        tail = f" ORDER BY n DESC, value LIMIT {top[name]}" if name in top else ""
        parts.append(f"SELECT * FROM (SELECT '{name}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} "
                     f"WHERE {c} IS NOT NULL GROUP BY 2{tail})")
    return " UNION ALL ".join(parts)


_FACETS = {"status": "ai_status", "language": "ai_map_language", "confidence": "ai_confidence", "domain": "domain"}
_DOWNLOADED = "(SELECT * FROM cand WHERE download_status = 'success')"


@query("d33_facets", _facet_sql(_DOWNLOADED, _FACETS, {"domain": 50}))
def d33(spark, sf):
    return profiles.facets(filters.candidate_filter(t.cand(spark, sf), {}), _FACETS, {"domain": 50})


_EN = "(SELECT * FROM cand WHERE download_status = 'success' AND ai_map_language = 'en')"
_SIZE = ("CASE WHEN d < 400 THEN '<400px' WHEN d < 600 THEN '400-600' WHEN d < 800 THEN '600-800' WHEN d < 1200 THEN '800-1200' ELSE '1200+' END")


@query("d34_filtered_stats", _facet_sql(_EN, _FACETS, {"domain": 15}) + f"""
    UNION ALL SELECT 'resolution', {_SIZE}, count(*) FROM (SELECT greatest(image_width, image_height) AS d FROM {_EN}) GROUP BY 2
    UNION ALL SELECT 'total', 'total', count(*) FROM {_EN}
    UNION ALL """ + " UNION ALL ".join(f"SELECT 'method', '{m}', count(*) FROM {_EN} WHERE ai_{m}" for m in METHOD_FLAGS)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'f3_{s}', '{x}', count(*) FROM {_EN} WHERE {n} ai_{s}"
                                         for s in SUBJECT_FLAGS for x, n in (("yes", ""), ("no", "NOT"))))
def d34(spark, sf):
    return profiles.filtered_stats(t.cand(spark, sf), {"lang": "en"})


@query("d35_dataset_summary", _facet_sql("selected", {"language": "ai_map_language", "confidence": "ai_confidence"}, {"language": 10})
       + " UNION ALL SELECT 'total', 'total', count(*) FROM selected UNION ALL "
       + " UNION ALL ".join(f"SELECT 'method', '{m}', count(*) FROM selected WHERE ai_{m}" for m in METHOD_FLAGS))
def d35(spark, sf):
    return profiles.dataset_summary(t.selected(spark, sf))


@query("d36_available", """
    SELECT count(*) AS n FROM cand WHERE ai_status = 'pass' AND ai_has_choropleth AND uid NOT IN (SELECT uid FROM selected)""")
def d36(spark, sf):
    return filters.builder_filter(t.cand(spark, sf), {"m_choro": "1"}, t.selected(spark, sf)).agg(F.count("*").alias("n"))


@query("d37_model_violations", " UNION ALL ".join(f"""
    SELECT '{c}' AS criterion, count(*) FILTER (WHERE disq_{c}) AS n,
           round(count(*) FILTER (WHERE disq_{c}) * 100.0 / count(*) FILTER (WHERE disq_status = 'checked'), 6) AS percent FROM maps""" for c in CRITERIA_IDS))
def d37(spark, sf):
    return t.rounded(quality.model_violations(t.map_flags(spark, sf)), "percent")


_VIOLATIONS = " UNION ALL ".join(f"""
    SELECT '{c}' AS criterion, count(*) FILTER (WHERE disq_{c}) AS model, count(*) FILTER (WHERE COALESCE(human_{c}, disq_{c})) AS final,
           count(*) FILTER (WHERE human_{c} <> disq_{c}) AS overrides, count(human_{c}) AS reviewed FROM maps""" for c in CRITERIA_IDS)


@query("d38_violation_table", _VIOLATIONS)
def d38(spark, sf):
    return quality.violation_rows(t.map_flags(spark, sf))


@query("d39_quality_bands", """
    SELECT CASE WHEN quality_score < 20 THEN '0-20' WHEN quality_score < 40 THEN '20-40' WHEN quality_score < 55 THEN '40-55'
                WHEN quality_score < 60 THEN '55-60' ELSE '60' END AS band, count(*) AS n, round(avg(quality_score), 6) AS mean_quality
    FROM maps WHERE disq_status = 'checked' GROUP BY 1""")
def d39(spark, sf):
    return t.rounded(quality.quality_bands(t.maps(spark, sf)), "mean_quality")


@query("d40_quality_histogram", """
    SELECT lo, count(uid) AS n FROM (SELECT unnest(range(0, 65, 5)) AS lo)
    LEFT JOIN (SELECT * FROM maps WHERE disq_status = 'checked') ON quality_score >= lo AND quality_score < lo + 5 GROUP BY 1""")
def d40(spark, sf):
    return quality.quality_histogram(t.maps(spark, sf))


@query("d41_violation_distribution", "SELECT violations_count, count(*) AS n FROM maps WHERE disq_status = 'checked' GROUP BY 1")
def d41(spark, sf):
    return quality.violation_distribution(t.maps(spark, sf))


@query("d42_review_progress", f"SELECT criterion, reviewed, overrides FROM ({_VIOLATIONS})")
def d42(spark, sf):
    return quality.violation_rows(t.map_flags(spark, sf)).select("criterion", "reviewed", "overrides")


@query("d43_token_costs", """
    SELECT model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(cr AS BIGINT) AS cache_read, CAST(cw AS BIGINT) AS cache_write,
           round((i * ri + o * ro + cr * ri * 0.1 + cw * ri * 1.25) / 1000000, 6) AS cost, round(cr * 100.0 / (cr + cw + i), 6) AS cache_pct
    FROM (SELECT model, sum(i) AS i, sum(o) AS o, sum(cr) AS cr, sum(cw) AS cw, CASE model WHEN 'bulk' THEN 1.0 ELSE 3.0 END AS ri,
                 CASE model WHEN 'bulk' THEN 5.0 ELSE 15.0 END AS ro
          FROM (SELECT CASE WHEN conv_id % 3 = 0 THEN 'pilot' ELSE 'bulk' END AS model, length(text) AS i, length(text) // 5 AS o,
                       CASE WHEN turn > 0 THEN 200 ELSE 0 END AS cr, CASE WHEN turn = 0 THEN 200 ELSE 0 END AS cw FROM conversations) GROUP BY 1)""")
def d43(spark, sf):
    n = F.length("text")
    rows = t.table(spark, sf, "conversations").select(
        F.when(F.col("conv_id") % 3 == 0, "pilot").otherwise("bulk").alias("model"), n.alias("input_tokens"),
        F.floor(n / 5).alias("output_tokens"), F.when(F.col("turn") > 0, 200).otherwise(0).alias("cache_read"),
        F.when(F.col("turn") == 0, 200).otherwise(0).alias("cache_write"))
    return t.rounded(profiles.token_costs(rows), "cost", "cache_pct")


@query("d51_confusion", """
    SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision,
           round(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, round(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1,
           round(COALESCE(tn / NULLIF(tn + fp, 0), 0), 6) AS specificity
    FROM (SELECT count(*) FILTER (WHERE pred_proba >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE pred_proba >= 0.5 AND label = 0) AS fp,
                 count(*) FILTER (WHERE pred_proba < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE pred_proba < 0.5 AND label = 1) AS fn FROM lab)""")
def d51(spark, sf):
    return t.rounded(metrics.confusion(t.lab(spark, sf)), "accuracy", "precision", "recall", "f1", "specificity")


@query("d52_roc_auc", """
    SELECT round((sum(r) FILTER (WHERE label = 1) - max(p) * (max(p) + 1) / 2) / (max(p) * max(n)), 6) AS roc_auc
    FROM (SELECT label, rank() OVER (ORDER BY pred_proba) + (count(*) OVER (PARTITION BY pred_proba) - 1) / 2 AS r,
                 count(*) FILTER (WHERE label = 1) OVER () AS p, count(*) FILTER (WHERE label = 0) OVER () AS n FROM lab)""")
def d52(spark, sf):
    return t.rounded(metrics.roc_auc(t.lab(spark, sf)), "roc_auc")


view("curve", """
    SELECT pred_proba AS threshold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS all_pos
    FROM (SELECT pred_proba, sum(label) AS pos, count(*) AS n FROM lab GROUP BY 1)
    WINDOW w AS (ORDER BY pred_proba DESC)""")


@query("d53_average_precision", "SELECT round(sum(tp / seen * pos / all_pos), 6) AS pr_auc FROM curve")
def d53(spark, sf):
    return t.rounded(metrics.average_precision(t.lab(spark, sf)), "pr_auc")


@query("d54_selection_stats", """
    SELECT *, round(s - tr, 6) AS shift, CASE WHEN abs(s - tr) > 1 THEN 'large' WHEN abs(s - tr) > 0.5 THEN 'moderate' ELSE 'ok' END AS shift_band
           FROM (SELECT count(*) AS n, round(avg(uncertainty), 6) AS uncertainty_mean, round(stddev_samp(uncertainty), 6) AS uncertainty_sd,
                 round(avg(pred_proba), 6) AS proba_mean, round(stddev_samp(pred_proba), 6) AS proba_sd,
                 count(*) FILTER (WHERE pred_proba > 0.5) AS n_positive, round(avg((pred_proba > 0.5)::INT), 6) AS positive_share,
                 avg(score) AS s, (SELECT avg(score) FROM vec) AS p, (SELECT avg(score) FROM lab) AS tr FROM strat_sel)""".replace(
    "SELECT *,", "SELECT n, uncertainty_mean, uncertainty_sd, proba_mean, proba_sd, n_positive, positive_share, round(s, 6) AS selected_score, "
    "round(p, 6) AS pool_score, round(tr, 6) AS train_score,"))
def d54(spark, sf):
    chosen = sampling.stratified_uncertain(t.vec(spark, sf), 150)
    out = profiles.selection_stats(chosen, t.vec(spark, sf), t.lab(spark, sf))
    return t.rounded(out, *[c for c in out.columns if c not in ("n", "n_positive", "shift_band")])


@query("d55_proba_tenths", """
    SELECT CAST(least(floor(pred_proba * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
    FROM vec GROUP BY 1""")
def d55(spark, sf):
    return t.rounded(profiles.proba_tenths(t.vec(spark, sf)), "percent")


view("years_parsed", r"""
    SELECT respondent, years, CASE WHEN years IS NULL THEN NULL WHEN lower(years) LIKE '%a year%' OR lower(years) LIKE '%one year%' THEN 1
        WHEN lower(years) LIKE '%two%' THEN 2 WHEN lower(years) LIKE '%three%' THEN 3 WHEN lower(years) LIKE '%four%' THEN 4
        WHEN lower(years) LIKE '%five%' THEN 5 WHEN lower(years) LIKE '%six%' THEN 6 WHEN lower(years) LIKE '%seven%' THEN 7
        WHEN lower(years) LIKE '%eight%' THEN 8 WHEN lower(years) LIKE '%nine%' THEN 9 WHEN lower(years) LIKE '%ten%' THEN 10
        ELSE TRY_CAST(NULLIF(regexp_extract(lower(years), '(\d+(\.\d+)?)', 1), '') AS DOUBLE) END AS parsed FROM people""")


@query("d56_text_conversions", """
    SELECT trim(years) AS answer, min(respondent) AS first_seen, arg_min(parsed, respondent) AS years
    FROM years_parsed WHERE years IS NOT NULL AND TRY_CAST(years AS DOUBLE) IS NULL GROUP BY 1""")
def d56(spark, sf):
    return profiles.text_conversions(t.people(spark, sf), "years", parse_years(F.col("years")), "respondent")


@query("d57_extrapolation", """
    SELECT count(*) AS n_total, count(*) FILTER (WHERE pred_proba >= 0.5) AS n_saved,
           round(count(*) FILTER (WHERE pred_proba >= 0.5) / count(*) * 50000000 * 96.0 / 1048576, 6) AS output_mb,
           round(50000000 / 2458.2 / 3600, 6) AS hours FROM vec""")
def d57(spark, sf):
    sample = t.vec(spark, sf).agg(F.count("*").alias("n_total"), F.count_if(F.col("pred_proba") >= 0.5).alias("n_saved"))
    return t.rounded(profiles.extrapolate(sample, 2458.2, 96.0), "output_mb", "hours")


@query("d58_missing_files", "SELECT count(*) FILTER (WHERE ai_map_language = 'es') AS n_missing FROM maps")
def d58(spark, sf):
    folder = scratch_dir(spark, "files")
    m = t.map_flags(spark, sf).withColumn("local_path", F.concat(F.lit("lang="), "ai_map_language"))
    m.filter("ai_map_language <> 'es'").select("uid", F.col("ai_map_language").alias("lang")).write.partitionBy("lang").text(folder)
    stored = readers.file_listing(spark, folder).select(F.regexp_extract("path", "(lang=[a-z]+)/part-", 1).alias("path"))
    return profiles.missing_files(m, stored.distinct())


@query("d59_class_balance", """
    SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_yes, count(*) FILTER (WHERE label = 0) AS n_no,
           round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS imbalance, round(avg(label), 6) AS yes_share FROM lab""")
def d59(spark, sf):
    return t.rounded(metrics.class_balance(t.lab(spark, sf)), "imbalance", "yes_share")


@query("entry_top_domains", """
    SELECT domain, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || uid), uid) AS rn FROM clean
        WHERE domain <> 'spam-farm.example.org') WHERE rn <= 5 GROUP BY 1 ORDER BY n DESC, domain LIMIT 10""")
def entry_top_domains(spark, sf):
    kept = filters.exclude_domains(t.clean(spark, sf), ["spam-farm.example.org"])
    return profiles.top_groups(sampling.cap_per_domain(kept, 5), "domain", 10)
