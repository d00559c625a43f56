"""Survey statistics: weights, rankings, agreement, tests, resampling."""

from pyspark.sql import functions as F

from siftwell.functions.survey_text import parse_years
from siftwell.operators import joins, profiles, survey
from siftwell.plans import tables as t
from siftwell.plans.q_filters import indexed_respondents, resampled_totals
from siftwell.plans.q_functions import scenario_rows, school_weights
from siftwell.plans.registry import query, view

_ORDER = t.EVENT_CRITERIA

view("per_crit", """
    SELECT criterion, count(rating) AS n, avg(rating) AS mean, median(rating) AS median, stddev_samp(rating) AS sd, min(rating) AS min, max(rating) AS max,
           count(*) FILTER (WHERE rating = 1) AS n_1, count(*) FILTER (WHERE rating = 2) AS n_2, count(*) FILTER (WHERE rating = 3) AS n_3,
           count(*) FILTER (WHERE rating = 4) AS n_4, count(*) FILTER (WHERE rating = 5) AS n_5
    FROM ratings GROUP BY 1""")


@query("d44_per_criterion", """
    SELECT * REPLACE (round(mean, 6) AS mean, round(sd, 6) AS sd), round((mean - 1) / 4, 6) AS weight, round(sd / mean, 6) AS cv FROM per_crit""")
def d44(spark, sf):
    return t.rounded(survey.per_criterion(t.ratings(spark, sf)), "mean", "sd", "weight", "cv")


@query("d45_weight_sum", "SELECT round(sum((mean - 1) / 4), 6) AS sum_weights FROM per_crit")
def d45(spark, sf):
    return t.rounded(survey.weight_sum(survey.per_criterion(t.ratings(spark, sf))), "sum_weights")


@query("d46_category_means", """
    SELECT category, n_criteria, round(m, 6) AS mean, row_number() OVER (ORDER BY m DESC, category) AS rank, round(max(m) OVER () - min(m) OVER (), 6) AS spread
    FROM (SELECT CASE WHEN criterion IN ('click', 'view') THEN 'USE' WHEN criterion IN ('purchase', 'signup') THEN 'TRADE' ELSE 'FAULT' END AS category,
                 count(*) AS n_criteria, avg(mean) AS m FROM per_crit GROUP BY 1)""")
def d46(spark, sf):
    return t.rounded(survey.category_means(survey.per_criterion(t.ratings(spark, sf)), t.EVENT_CATEGORIES), "mean", "spread")


@query("d47_group_means", """
    SELECT school, criterion, count(DISTINCT respondent) AS n, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS sd FROM grouped_ratings GROUP BY 1, 2
    UNION ALL SELECT school, 'ALL', count(DISTINCT respondent), round(avg(rating), 6), round(stddev_samp(rating), 6) FROM grouped_ratings GROUP BY 1""")
def d47(spark, sf):
    return t.rounded(survey.group_means(t.grouped_ratings(spark, sf), "school"), "mean", "sd")


view("diag", """
    SELECT respondent, avg(rating) AS mean, stddev_samp(rating) AS sd, count(DISTINCT rating) AS n_unique, count(*) FILTER (WHERE rating = 5) AS n_5,
           count(*) FILTER (WHERE rating = 1) AS n_1 FROM ratings GROUP BY 1""")


@query("d48_respondent_diagnostics", """
    SELECT * REPLACE (round(mean, 6) AS mean, round(sd, 6) AS sd), COALESCE(sd, 0) < 0.5 OR n_unique <= 2 AS low_diversity FROM diag""")
def d48(spark, sf):
    return t.rounded(survey.respondent_diagnostics(t.ratings(spark, sf)), "mean", "sd")


@query("d49_personal_means", """
    SELECT count(*) AS n, round(min(mean), 6) AS min, round(max(mean), 6) AS max, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS sd,
           count(*) FILTER (WHERE COALESCE(sd, 0) < 0.5 OR n_unique <= 2) AS n_low_diversity FROM diag""")
def d49(spark, sf):
    out = survey.personal_mean_summary(survey.respondent_diagnostics(t.ratings(spark, sf)))
    return t.rounded(out, "min", "max", "mean", "sd")


@query("d50_years_summary", """
    SELECT count(parsed) AS answered, count(*) AS n, round(avg(parsed), 6) AS mean, round(stddev_samp(parsed), 6) AS sd, CAST(min(parsed) AS DOUBLE) AS min,
           CAST(max(parsed) AS DOUBLE) AS max, round(median(parsed), 6) AS median FROM years_parsed""")
def d50(spark, sf):
    rows = t.people(spark, sf).withColumn("parsed", parse_years(F.col("years")))
    return t.rounded(profiles.numeric_summary(rows, "parsed"), "mean", "sd", "median")


@query("d50_expertise_levels", """
    SELECT expertise, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM people), 6) AS percent FROM people WHERE expertise IS NOT NULL GROUP BY 1""")
def d50b(spark, sf):
    return t.rounded(profiles.frequency_table(t.people(spark, sf), "expertise"), "percent")


@query("e08_criterion_ranking", """
    SELECT criterion, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(mean, 12) DESC, criterion) AS rank FROM per_crit""")
def e08(spark, sf):
    ranked = survey.ranking(survey.per_criterion(t.ratings(spark, sf)), "mean", _ORDER)
    return t.rounded(ranked.select("criterion", "mean", "rank"), "mean")


@query("e09_variation_ranking", """
    SELECT criterion, round(cv, 6) AS cv, rn AS rank, CASE WHEN rn = 1 THEN 'highest' WHEN rn = count(*) OVER () THEN 'lowest' END AS agreement
    FROM (SELECT criterion, sd / mean AS cv, row_number() OVER (ORDER BY round(sd / mean, 12), criterion) AS rn FROM per_crit)""")
def e09(spark, sf):
    ranked = survey.cv_ranking(survey.per_criterion(t.ratings(spark, sf)), _ORDER)
    return t.rounded(ranked.select("criterion", "cv", "rank", "agreement"), "cv")


@query("e11_jackknife", """
    SELECT criterion, round(any_value(w), 6) AS w_full, round(min(l), 6) AS jk_min, round(max(l), 6) AS jk_max, round(max(abs(l - w)), 6) AS max_change,
           arg_min(respondent, (-round(abs(l - w), 12), respondent)) AS most_influential
    FROM (SELECT criterion, respondent, (sum(rating) OVER p / count(*) OVER p - 1) / 4 AS w, ((sum(rating) OVER p - rating) / (count(*) OVER p - 1) - 1) / 4 AS l
          FROM ratings WINDOW p AS (PARTITION BY criterion)) GROUP BY 1""")
def e11(spark, sf):
    return t.rounded(survey.jackknife_weights(t.ratings(spark, sf)), "w_full", "jk_min", "jk_max", "max_change")


@query("e15_percentile_interval", """
    SELECT criterion, round(avg(w), 6) AS boot_mean, round(stddev_pop(w), 6) AS se, round(quantile_cont(w, 0.025), 6) AS ci_lo, round(quantile_cont(w, 0.975), 6) AS ci_hi
    FROM (SELECT d.iteration, r.criterion, (avg(r.rating) - 1) / 4 AS w FROM draws d JOIN indexed USING (idx) JOIN ratings r USING (respondent) GROUP BY ALL) GROUP BY 1""")
def e15(spark, sf):
    rows = indexed_respondents(spark, sf)
    size = rows.agg(F.count("*").alias("n")).scalar()
    drawn = joins.resample_join(joins.hashed_draws(spark, 20, size, rows), rows).join(t.ratings(spark, sf), "respondent")
    return t.rounded(survey.resampled_weights(drawn), "boot_mean", "se", "ci_lo", "ci_hi")


@query("e15_percentile_interval_10000", """
    SELECT criterion, round(avg(w), 9) AS boot_mean, round(stddev_pop(w), 9) AS se, round(quantile_cont(w, 0.025), 9) AS ci_lo, round(quantile_cont(w, 0.975), 9) AS ci_hi
    FROM (SELECT d.iteration, r.criterion, (avg(r.rating) - 1) / 4 AS w FROM draws_10000 d JOIN indexed USING (idx) JOIN ratings r USING (respondent) GROUP BY ALL) GROUP BY 1""")
def e15_10000(spark, sf):
    per = resampled_totals(spark, sf, 10_000).select("iteration", "criterion", (F.col("total") / F.col("weight")).alias("rating"), "weight")
    return t.rounded(survey.resampled_weights(per), "boot_mean", "se", "ci_lo", "ci_hi", digits=9)


# ---------------------------------------------------------------- agreement and tests

view("pairable", """
    SELECT r.*, count(*) OVER (PARTITION BY respondent) AS m FROM ratings r QUALIFY m >= 2""")
view("coincidence", """
    SELECT a.rating AS c, b.rating AS k, sum(1.0::DOUBLE / (a.m - 1)) AS o
    FROM pairable a JOIN pairable b ON a.respondent = b.respondent AND a.criterion <> b.criterion GROUP BY 1, 2""")
view("marginals", "SELECT rating AS v, count(*) AS n FROM pairable GROUP BY 1")


def _alpha_sql(level: str, delta: str) -> str:
    return f"""
    SELECT '{level}' AS level, round(1 - (SELECT sum(n) - 1 FROM marginals) * (SELECT sum(o * ({delta})) FROM coincidence)
        / (SELECT sum((a.n * b.n) * ({delta})) FROM (SELECT a.v AS c, b.v AS k, a.n AS an, b.n AS bn FROM marginals a, marginals b WHERE a.v <> b.v) p
           JOIN marginals a ON a.v = p.c JOIN marginals b ON b.v = p.k), 6) AS alpha"""


_ORDINAL = ("pow((SELECT sum(n) FROM marginals WHERE v BETWEEN least(c, k) AND greatest(c, k)) - ((SELECT n FROM marginals WHERE v = c) "
            "+ (SELECT n FROM marginals WHERE v = k)) / 2, 2) * (c <> k)::INT")


@query("j01_krippendorff_alpha", " UNION ALL ".join([
    _alpha_sql("ordinal", _ORDINAL), _alpha_sql("interval", "pow(c - k, 2)"), _alpha_sql("nominal", "(c <> k)::INT")]))
def j01(spark, sf):
    ratings = t.ratings(spark, sf)
    parts = [t.rounded(survey.krippendorff_alpha(ratings, level), "alpha").withColumn("level", F.lit(level))
             for level in ("ordinal", "interval", "nominal")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _severity(spark, sf):
    return survey.respondent_severity(t.ratings(spark, sf)).join(
        t.people(spark, sf).select("respondent", parse_years(F.col("years")).alias("years"), "expertise"), "respondent")


view("severity", """
    SELECT respondent, round(avg(rating), 12) AS severity, any_value(parsed) AS years, any_value(expertise) AS expertise
    FROM ratings JOIN years_parsed USING (respondent) JOIN people USING (respondent) GROUP BY 1""")


def _spearman_sql(source: str, x: str, y: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
    return (f"SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT {rank.format(x)} AS rx, {rank.format(y)} AS ry "
            f"FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)")


def _student_sql(t: str, v: str) -> str:
    """Two-sided p of Student's t with v degrees of freedom, as the finite sums that hold for whole v."""
    c2 = f"({v} / ({v} + pow({t}, 2)))"
    total = lambda last, weight: f"(1 + coalesce(list_sum(list_transform(range(1, CAST({last} AS BIGINT) + 1), lambda j: {weight} * pow({c2}, j))), 0))"
    even = total(f"({v} - 2) / 2", "exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi())")
    odd = total(f"({v} - 3) / 2", "exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2")
    side = f"sqrt(1 - {c2})"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {v} % 2 = 0 THEN 1 - {side} * {even} "
            f"ELSE 1 - 2 / pi() * (atan(abs({t}) / sqrt({v})) + CASE WHEN {v} > 1 THEN {side} * sqrt({c2}) * {odd} ELSE 0 END) END")


def _normal_sql(z: str) -> str:
    """Two-sided p of the standard normal, by the series of its integral."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2.0::DOUBLE) - lgamma(k + 1.5) + ln(pi()) / 2 - pow({z}, 2) / 2)"
    return f"CASE WHEN {z} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 400), lambda k: {term})) END"


_T_OF_RHO = "rho * sqrt((n - 2) / nullif((1 - rho) * (1 + rho), 0))"


def _rho_p_sql(source: str, keys: str = "") -> str:
    """p of rank correlations ``n, rho`` (and keys); none below three pairs, 0 for a perfect one."""
    return f"""SELECT {keys}n, round(rho, 6) AS rho, round(CASE WHEN abs(rho) = 1 THEN 0.0 ELSE {_student_sql("t", "(n - 2)")} END, 6) AS p
    FROM (SELECT *, {_T_OF_RHO} AS t FROM (SELECT * REPLACE (CASE WHEN n >= 3 THEN greatest(least(round(rho, 12), 1.0), -1.0) END AS rho) FROM ({source})))"""


@query("j02_spearman", _spearman_sql("lab", "score", "pred_proba"))
def j02(spark, sf):
    return t.rounded(survey.spearman(t.lab(spark, sf), "score", "pred_proba").select("n", "rho"), "rho")


@query("j02_spearman_p", _rho_p_sql(_spearman_sql("lab", "score", "pred_proba").replace("round(corr(rx, ry), 6)", "corr(rx, ry)")))
def j02p(spark, sf):
    return t.rounded(survey.spearman(t.lab(spark, sf), "score", "pred_proba").select("n", "rho", "p"), "rho", "p")


@query("j03_respondent_severity", "SELECT 'years' AS trait, * FROM (" + _spearman_sql("severity", "years", "severity")
       + ") UNION ALL SELECT 'expertise', * FROM (" + _spearman_sql("severity", "expertise", "severity") + ")")
def j03(spark, sf):
    rows = _severity(spark, sf)
    parts = [survey.spearman(rows, x, "severity").select(F.lit(x).alias("trait"), "n", "rho") for x in ("years", "expertise")]
    return t.rounded(parts[0].unionByName(parts[1]), "rho")


view("group_ranks", """
    SELECT school, criterion, row_number() OVER (PARTITION BY school ORDER BY round(avg(rating), 12) DESC, criterion) AS rank FROM (
        SELECT school, criterion, rating FROM grouped_ratings UNION ALL SELECT 'overall', criterion, rating FROM grouped_ratings) GROUP BY 1, 2""")


def group_ranks(spark, sf):
    return survey.group_rank_table(t.grouped_ratings(spark, sf), "school", _ORDER).select("school", "criterion", "rank")


@query("j04_rank_agreement", """
    SELECT a.school AS a, b.school AS b, count(*) AS n, round(corr(a.rank, b.rank), 6) AS rho
    FROM group_ranks a JOIN group_ranks b ON a.school < b.school AND a.criterion = b.criterion GROUP BY 1, 2""")
def j04(spark, sf):
    ranks = group_ranks(spark, sf)
    out = survey.rank_agreement(ranks, "school", joins.unordered_pairs(ranks, "school"))
    return t.rounded(out.select("a", "b", "n", "rho"), "rho")


@query("j04_rank_agreement_p", _rho_p_sql("""
    SELECT a.school AS a, b.school AS b, count(*) AS n, corr(a.rank, b.rank) AS rho
    FROM group_ranks a JOIN group_ranks b ON a.school < b.school AND a.criterion = b.criterion GROUP BY 1, 2""", "a, b, "))
def j04p(spark, sf):
    ranks = group_ranks(spark, sf)
    out = survey.rank_agreement(ranks, "school", joins.unordered_pairs(ranks, "school"))
    return t.rounded(out.select("a", "b", "n", "rho", "p"), "rho", "p")


@query("j05_kendall_w", """
    SELECT k, n_items, round(12 * s / (k * k * (n_items * n_items * n_items - n_items)), 6) AS w,
           round(k * (n_items - 1) * 12 * s / (k * k * (n_items * n_items * n_items - n_items)), 6) AS chi2
    FROM (SELECT max(k) AS k, count(*) AS n_items, var_pop(r) * count(*) AS s FROM (
        SELECT criterion, sum(rank) AS r, count(DISTINCT school) AS k FROM group_ranks WHERE school <> 'overall' GROUP BY 1))""")
def j05(spark, sf):
    out = survey.kendall_w(group_ranks(spark, sf).filter("school <> 'overall'"), "school")
    return t.rounded(out.drop("p"), "w", "chi2")


view("resp_ranks", """
    SELECT respondent, criterion, rating, rank() OVER (PARTITION BY respondent ORDER BY rating) + (count(*) OVER (PARTITION BY respondent, rating) - 1) / 2 AS r
    FROM ratings WHERE respondent IN (SELECT respondent FROM ratings GROUP BY 1 HAVING count(*) = 5)""")


@query("j06_friedman", """
    SELECT n, round(raw / (1 - ties / (n * 5 * 24)), 6) AS chi2, 4 AS df FROM (
        SELECT n, 12 / (n * 5 * 6) * ss - 3 * n * 6 AS raw,
               (SELECT sum(c * c * c - c) FROM (SELECT count(*) AS c FROM resp_ranks GROUP BY respondent, rating)) AS ties
        FROM (SELECT max(n) AS n, sum(s * s) AS ss FROM (SELECT criterion, sum(r) AS s, count(*) AS n FROM resp_ranks GROUP BY 1)))""")
def j06(spark, sf):
    test, _ = survey.friedman(t.ratings(spark, sf), 5)
    return t.rounded(test.drop("p"), "chi2")


@query("j06_friedman_mean_ranks", "SELECT criterion, round(avg(r), 6) AS mean_rank FROM resp_ranks GROUP BY 1")
def j06b(spark, sf):
    return t.rounded(survey.friedman(t.ratings(spark, sf), 5)[1], "mean_rank")


@query("j07_one_sample_t", """
    SELECT criterion, n, round((mean - 3) / sd, 6) AS d, round((mean - 3) / (sd / sqrt(n)), 6) AS t FROM per_crit""")
def j07(spark, sf):
    return t.rounded(survey.effect_sizes(t.ratings(spark, sf)).select("criterion", "n", "d", "t"), "d", "t")


@query("j07_one_sample_t_p", f"""
    SELECT criterion, n, round(t, 6) AS t, round({_student_sql("t", "(n - 1)")}, 6) AS p_t FROM (SELECT criterion, n, (mean - 3) / nullif(sd, 0) * sqrt(n) AS t FROM per_crit)""")
def j07p(spark, sf):
    return t.rounded(survey.effect_sizes(t.ratings(spark, sf)).select("criterion", "n", "t", "p_t"), "t", "p_t")


@query("j08_wilcoxon", """
    SELECT criterion, count(*) AS n, least(COALESCE(sum(r) FILTER (WHERE x > 0), 0), COALESCE(sum(r) FILTER (WHERE x < 0), 0)) AS w
    FROM (SELECT criterion, rating - 3 AS x, rank() OVER (PARTITION BY criterion ORDER BY abs(rating - 3)) + (count(*) OVER (PARTITION BY criterion, abs(rating - 3)) - 1) / 2 AS r
          FROM ratings WHERE rating <> 3) GROUP BY 1""")
def j08(spark, sf):
    return survey.wilcoxon(t.ratings(spark, sf)).select("criterion", "n", "w")


@query("j08_wilcoxon_p", f"""
    WITH r AS (SELECT criterion, rating - 3 AS x, rank() OVER (PARTITION BY criterion ORDER BY abs(rating - 3)) + (count(*) OVER (PARTITION BY criterion, abs(rating - 3)) - 1) / 2 AS r FROM ratings WHERE rating <> 3),
    w AS (SELECT criterion, count(*)::DOUBLE AS n, least(COALESCE(sum(r) FILTER (WHERE x > 0), 0), COALESCE(sum(r) FILTER (WHERE x < 0), 0)) AS w FROM r GROUP BY 1),
    ties AS (SELECT criterion, sum(pow(k, 3) - k) AS ties FROM (SELECT criterion, abs(x), count(*) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
    z AS (SELECT criterion, n, w, (w - n * (n + 1) / 4) / nullif(sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 0) AS z FROM w JOIN ties USING (criterion))
    SELECT criterion, CAST(n AS BIGINT) AS n, w, round(z, 6) AS z, round({_normal_sql("z")}, 6) AS p_w FROM z""")
def j08p(spark, sf):
    return t.rounded(survey.wilcoxon(t.ratings(spark, sf)), "z", "p_w")


@query("j09_bootstrap_weights", """
    SELECT criterion, round((avg(rating) - 1) / 4, 6) AS weight, TRUE AS mean_close, TRUE AS se_close FROM ratings GROUP BY 1""")
def j09(spark, sf):
    ratings = t.ratings(spark, sf)
    # the standard error that resampling approaches: that of a mean, on the scale of the weights
    exact = ratings.groupBy("criterion").agg((F.stddev_pop("rating") / F.sqrt(F.count("rating")) / 4).alias("exact"))
    out = survey.bootstrap_weights(ratings, 10_000).join(exact, "criterion")
    slack = 1e-12
    return t.rounded(out.select(
        "criterion", "weight", (F.abs(F.col("boot_mean") - F.col("weight")) <= 0.05 * F.col("exact") + slack).alias("mean_close"),
        (F.abs(F.col("se") - F.col("exact")) <= 0.05 * F.col("exact") + slack).alias("se_close")), "weight")


@query("j10_bootstrap_alpha", "SELECT TRUE AS inside, TRUE AS mean_close")
def j10(spark, sf):
    out = survey.bootstrap_alpha(t.ratings(spark, sf), 1_000)
    return out.select(F.col("alpha").between(F.col("ci_lo"), F.col("ci_hi")).alias("inside"), (F.abs(F.col("boot_mean") - F.col("alpha")) < 2 * F.col("se")).alias("mean_close"))


@query("j11_bootstrap_metrics", """
    SELECT unnest(['f1', 'precision', 'recall']) AS metric, TRUE AS ordered, TRUE AS se_close""")
def j11(spark, sf):
    from siftwell.operators.metrics import confusion

    cells = confusion(t.lab(spark, sf), "label", "pred_proba").select(F.struct("tp", "fp", "tn", "fn").alias("c")).scalar()
    out = survey.bootstrap_metrics(t.lab(spark, sf), 1_000).withColumn("c", cells)
    # standard error of a share; that of F1 has no such form and is only bounded
    p = F.col("c.tp") / (F.col("c.tp") + F.when(F.col("metric") == "recall", F.col("c.fn")).otherwise(F.col("c.fp")))
    n = F.col("c.tp") + F.when(F.col("metric") == "recall", F.col("c.fn")).otherwise(F.col("c.fp"))
    close = F.when(F.col("metric") == "f1", F.col("se") < 0.5).otherwise(F.abs(F.col("se") - F.sqrt(p * (1 - p) / n)) < 0.15 * F.col("se") + 0.01)
    return out.select("metric", ((F.col("ci_lo") <= F.col("boot_mean")) & (F.col("boot_mean") <= F.col("ci_hi"))).alias("ordered"), close.alias("se_close"))


@query("j12_sensitivity", """
    WITH q AS (SELECT scenario, weight_set, 60 * (1 - sum(weight) / any_value(total)) AS q
        FROM scenario_rows JOIN school_weights USING (criterion) JOIN (SELECT weight_set, sum(weight) AS total FROM school_weights GROUP BY 1) USING (weight_set) GROUP BY 1, 2)
    SELECT scenario, round(max(q) FILTER (WHERE weight_set = 'UK'), 6) AS "UK", round(max(q) FILTER (WHERE weight_set = 'CZ'), 6) AS "CZ",
           round(max(q) FILTER (WHERE weight_set = 'Other'), 6) AS "Other", round(max(q) FILTER (WHERE weight_set = 'DE-speak'), 6) AS "DE-speak",
           round(max(q) - min(q), 6) AS "range" FROM q GROUP BY 1""")
def j12(spark, sf):
    sets = ["UK", "CZ", "Other", "DE-speak"]
    return t.rounded(survey.sensitivity(scenario_rows(spark, sf), school_weights(spark, sf), sets), *sets, "range")


#: Weight sets of the sensitivity table: the point, both ends of the bootstrap interval, and equal weights.
SURVEY_SETS, EQUAL_WEIGHT = ["point", "ci_lo", "ci_hi", "equal"], 0.7

view("survey_sets", f"""
    SELECT s.weight_set, criterion, CASE s.weight_set WHEN 'point' THEN point WHEN 'ci_lo' THEN lo WHEN 'ci_hi' THEN hi ELSE {EQUAL_WEIGHT}::DOUBLE END AS weight
    FROM (SELECT criterion, quantile_cont(w, 0.025) AS lo, quantile_cont(w, 0.975) AS hi
          FROM (SELECT d.iteration, r.criterion, (avg(r.rating) - 1) / 4 AS w FROM draws_10000 d JOIN indexed USING (idx) JOIN ratings r USING (respondent) GROUP BY ALL) GROUP BY 1)
    JOIN (SELECT criterion, (avg(rating) - 1) / 4 AS point FROM ratings GROUP BY 1) USING (criterion),
    (SELECT unnest({SURVEY_SETS}) AS weight_set) s""")


@query("j12_sensitivity_survey_sets", """
    WITH q AS (SELECT scenario, weight_set, 60 * (1 - sum(weight) / any_value(total)) AS q
        FROM scenario_rows JOIN survey_sets USING (criterion) JOIN (SELECT weight_set, sum(weight) AS total FROM survey_sets GROUP BY 1) USING (weight_set) GROUP BY 1, 2)
    SELECT scenario, """ + ", ".join(f"round(max(q) FILTER (WHERE weight_set = '{s}'), 6) AS {s}" for s in SURVEY_SETS) + """, round(max(q) - min(q), 6) AS "range"
    FROM q GROUP BY 1""")
def j12_survey(spark, sf):
    """The scenarios under the survey's own weights: point, ends of the interval of 10 000 resamples, and equal weights."""
    ratings = t.ratings(spark, sf)
    per = resampled_totals(spark, sf, 10_000).select("iteration", "criterion", (F.col("total") / F.col("weight")).alias("rating"), "weight")
    point = ratings.groupBy("criterion").agg(((F.avg("rating") - 1) / 4).alias("point"))
    ends = survey.resampled_weights(per).join(point, "criterion").withColumn("equal", F.lit(EQUAL_WEIGHT))
    sets = ends.unpivot("criterion", SURVEY_SETS, "weight_set", "weight")
    return t.rounded(survey.sensitivity(scenario_rows(spark, sf), sets, SURVEY_SETS), *SURVEY_SETS, "range")
