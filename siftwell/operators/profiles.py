"""Frequency tables, histograms, band and group profiles, and run statistics."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from siftwell.functions.scores import (
    confidence_tier, half_open_band, label_code, right_closed_band, tenth)
from siftwell.operators.filters import candidate_filter, max_dimension
from siftwell.operators.ordering import attach_row, first_per_key, quantile_columns
from siftwell.schemas import METHOD_FLAGS, SUBJECT_FLAGS


def _with_percent(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Percent of all rows; the row count is a separate scan of no columns."""
    return counts.withColumn("percent", F.col("n") * 100 / rows.agg(F.count("*").alias("n")).scalar())


def frequency_table(df: DataFrame, col: str, denominator: DataFrame | None = None) -> DataFrame:
    """Answered values with their count and percent of all rows, missing answers included in the base."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return _with_percent(counts, denominator if denominator is not None else df)


def category_shares(df: DataFrame, *cols) -> DataFrame:
    """Count and percent of all rows per category."""
    return _with_percent(df.groupBy(*cols).agg(F.count("*").alias("n")), df)


def coverage(shares: DataFrame, threshold: float) -> DataFrame:
    """How much the categories at or above a percent threshold cover, and how many are on each side."""
    above = F.col("percent") >= threshold
    return shares.agg(F.sum(F.when(above, F.col("percent")).otherwise(0.0)).alias("covered"),
                      F.count_if(above).alias("n_above"), F.count_if(~above).alias("n_below"))


def selected_categories(shares: DataFrame, col: str, threshold: float, drop: str = "unknown") -> DataFrame:
    keep = shares.filter((F.col("percent") >= threshold) & (F.col(col) != drop))
    return keep.withColumn("covered", keep.agg(F.sum("percent").alias("covered")).scalar())


def describe(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Count, mean, sample SD, min, max and exact percentiles in one row."""
    base = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
                  F.min(col).alias("min"), F.max(col).alias("max"))
    named = {f"p{round(p * 100)}": p for p in probs}
    q = quantile_columns(df, col, named)
    return attach_row(base, q)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    x = df.filter(F.col(col).isNotNull()).withColumn("_s", span)
    width = F.nullif((F.col("_s.hi") - F.col("_s.lo")) / bins, F.lit(0.0))
    place = F.coalesce(F.floor((F.col(col) - F.col("_s.lo")) / width), F.lit(0))
    return x.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- annotations

def label_bins(df: DataFrame, bin_col: str = "score_bin", label: str = "label") -> DataFrame:
    code = label_code(F.col(label))
    out = df.groupBy(bin_col).agg(
        F.count_if(code == 1).alias("yes_count"), F.count_if(code == 0).alias("no_count"),
        F.count_if(code == -1).alias("invalid_count"), F.count(label).alias("total_annotated"))
    total = F.nullif("total_annotated", F.lit(0))
    return out.withColumns({f"{k}_percent": F.col(f"{k}_count") * 100 / total for k in ("yes", "no", "invalid")})


def label_distribution(df: DataFrame, bin_col: str = "score_bin", label: str = "label") -> DataFrame:
    """Labels overall, per bin, and overall without INVALID, from one scan by grouping sets."""
    code = label_code(F.col(label))
    named = df.select(F.col(bin_col).alias("bin"), F.when(code == 1, "YES").when(code == 0, "NO")
                      .when(code == -1, "INVALID").alias("name")).filter(F.col("name").isNotNull())
    sets = (named.groupingSets([["name"], ["bin", "name"]], "bin", "name")
            .agg(F.grouping("bin").alias("g"), F.count("*").alias("n")))
    scopes = F.when(F.col("g") == 0, F.array(F.lit("bin"))).when(
        F.col("name") == "INVALID", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("valid")))
    return sets.select(F.explode(scopes).alias("scope"), "bin", "name", "n")


def split_profile(df: DataFrame, dim: str = "embedding", split: str = "split") -> DataFrame:
    """Size, class counts, balance, embedding length and score statistics per split."""
    yes = F.count_if(F.col("label") == 1)
    return df.groupBy(split).agg(
        F.count("*").alias("size"), yes.alias("n_yes"), F.count_if(F.col("label") == 0).alias("n_no"),
        (yes / F.count("*")).alias("class_balance"), F.max(F.size(dim)).alias("dim"),
        F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_sd"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"))


def annotation_progress(latest: DataFrame, label: str = "label") -> DataFrame:
    code = label_code(F.col(label))
    return (latest.groupBy(F.when(code == 1, "TAK").when(code == 0, "NIE").when(code == -1, "INVALID").alias("class"))
            .agg(F.count("*").alias("n")).filter(F.col("class").isNotNull()))


def annotated_per_bin(sample: DataFrame, latest: DataFrame, bin_col: str = "score_bin") -> DataFrame:
    valid = latest.filter(label_code(F.col("label")).isin(0, 1)).select("uid")
    return sample.join(valid, "uid").groupBy(bin_col).agg(F.count("*").alias("n_done"))


# ---------------------------------------------------------------- predictions

def prediction_summary(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    base = df.agg(F.count("*").alias("n"), F.count_if(F.col("pred_proba") >= threshold).alias("n_yes"),
                  F.avg((F.col("pred_proba") >= threshold).cast("double")).alias("yes_share"),
                  F.avg("pred_proba").alias("mean_proba"))
    return attach_row(base, quantile_columns(df, "pred_proba", {"median_proba": 0.5}))


def prediction_stats(df: DataFrame) -> DataFrame:
    base = df.agg(F.count("*").alias("n"), F.min("pred_proba").alias("min_p"), F.avg("pred_proba").alias("mean_p"),
                  F.max("pred_proba").alias("max_p"), F.stddev_samp("pred_proba").alias("sd_p"),
                  F.min("score").alias("min_score"), F.avg("score").alias("mean_score"),
                  F.max("score").alias("max_score"))
    p = quantile_columns(df, "pred_proba", {"q25_p": 0.25, "median_p": 0.5, "q75_p": 0.75})
    s = quantile_columns(df, "score", {"median_score": 0.5})
    return attach_row(attach_row(base, p), s)


def confidence_breakdown(df: DataFrame) -> DataFrame:
    """Right-closed tenths (the first holds 0.5) and left-closed tiers, each with percent of all rows."""
    names = ["0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9-1.0"]
    bands = right_closed_band(F.col("pred_proba"), [0.5, 0.6, 0.7, 0.8, 0.9, 1.0], names)
    tier = F.nullif(confidence_tier(F.col("pred_proba")), F.lit("NEGATIVE"))
    counts = (df.select(F.explode(F.array_compact(F.array(bands, tier))).alias("band"))
              .groupBy("band").agg(F.count("*").alias("n")))
    return _with_percent(counts, df)


def score_proba_correlation(df: DataFrame) -> DataFrame:
    return df.agg(F.corr("score", "pred_proba").alias("correlation"))


def proba_by_score_bin(df: DataFrame) -> DataFrame:
    names = ["[-1, 0]", "(0, 1]", "(1, 2]", "(2, 5]", "(5, 10]", "(10, 100]"]
    band = right_closed_band(F.col("score"), [-1, 0, 1, 2, 5, 10, 100], names)
    return (df.groupBy(band.alias("score_band")).agg(F.count("*").alias("n"), F.avg("pred_proba").alias("mean_proba"))
            .filter(F.col("score_band").isNotNull()))


def part_stats(df: DataFrame, part: str, threshold: float = 0.5) -> DataFrame:
    """Per part and in total: rows, positives, positive rate."""
    hit = F.count_if(F.col("pred_proba") >= threshold)
    return (df.rollup(part).agg(F.count("*").alias("n_total"), hit.alias("n_positive"),
                                (hit / F.count("*")).alias("positive_rate"))
            .withColumn(part, F.coalesce(part, F.lit("TOTAL"))))


def scored_run(scored: DataFrame, path: str, threshold: float = 0.5, part: Column | None = None) -> DataFrame:
    """Write scored rows and return the run's numbers, observed while they were written: one row
    ``n_files, n_total, n_positive, positive_rate, seconds, rows_per_second, files_per_minute``.

    Files are those of the scan, or the distinct values of ``part`` (approximate beyond some thousand); no pass over the
    rows is added.
    """
    seen, name = Observation("run"), (F.col("_metadata.file_path") if part is None else part)
    rows = scored.withColumn("_part", name)
    observed = rows.observe(seen, F.count("*").alias("n"), F.count_if(F.col("pred_proba") >= threshold).alias("positive"),
                            F.approx_count_distinct("_part", 0.01).alias("files")).drop("_part")
    start = time.monotonic()
    observed.write.parquet(path)
    seconds, got = max(time.monotonic() - start, 1e-9), seen.get
    n, positive, files = got["n"], got["positive"], got["files"]
    row = (files, n, positive, positive / n if n else 0.0, seconds, n / seconds, files / seconds * 60)
    return scored.sparkSession.createDataFrame(
        [row], "n_files long, n_total long, n_positive long, positive_rate double, seconds double, rows_per_second double, files_per_minute double")


def chunk_summary(df: DataFrame, chunk: str, threshold: float = 0.5) -> DataFrame:
    """Totals, unweighted mean of the chunk rates, and the expected number of true positives."""
    p = F.col("pred_proba")
    chunks = df.groupBy(chunk).agg(
        F.count("*").alias("n_total"), F.count_if(p > threshold).alias("n_saved"), F.avg(p).alias("mean_proba"),
        F.count_if(p >= 0.8).alias("high"), F.count_if((p >= 0.6) & (p < 0.8)).alias("medium"))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.sum("n_total").alias("n_total"), F.sum("n_saved").alias("n_saved"),
        F.avg(F.col("n_saved") / F.col("n_total")).alias("mean_save_rate"), F.avg("mean_proba").alias("mean_proba"),
        F.floor(F.sum("high") * 0.95 + F.sum("medium") * 0.82).alias("expected_true"))


def extrapolate(sample: DataFrame, rows_per_second: float, bytes_per_row: float, target: int = 50_000_000) -> DataFrame:
    """Output size and run time of ``target`` input rows, from a scored sample (n_total, n_saved)."""
    saved_share = F.col("n_saved") / F.col("n_total")
    return sample.select("n_total", "n_saved", (saved_share * target * bytes_per_row / 1048576).alias("output_mb"),
                         F.lit(target / rows_per_second / 3600).alias("hours"))


def selection_stats(selected: DataFrame, pool: DataFrame, train: DataFrame) -> DataFrame:
    """Selection means, and its shift of the mean score against training and pool."""
    base = selected.agg(
        F.count("*").alias("n"), F.avg("uncertainty").alias("uncertainty_mean"),
        F.stddev_samp("uncertainty").alias("uncertainty_sd"), F.avg("pred_proba").alias("proba_mean"),
        F.stddev_samp("pred_proba").alias("proba_sd"), F.count_if(F.col("pred_proba") > 0.5).alias("n_positive"),
        F.avg((F.col("pred_proba") > 0.5).cast("double")).alias("positive_share"), F.avg("score").alias("selected_score"))
    out = base.withColumn("pool_score", pool.agg(F.avg("score")).scalar()).withColumn(
        "train_score", train.agg(F.avg("score")).scalar())
    shift = F.col("selected_score") - F.col("train_score")
    return out.withColumn("shift", shift).withColumn(
        "shift_band", F.when(F.abs("shift") > 1.0, "large").when(F.abs("shift") > 0.5, "moderate").otherwise("ok"))


def proba_tenths(df: DataFrame) -> DataFrame:
    return _with_percent(df.groupBy(tenth(F.col("pred_proba")).alias("bin")).agg(F.count("*").alias("n")), df)


# ---------------------------------------------------------------- URLs and domains

def distinct_counts(df: DataFrame, *cols: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in cols])


def url_copies(df: DataFrame) -> DataFrame:
    """Copies per normalised URL with the first uid's domain and URL and the mean probability."""
    return df.groupBy("url_norm").agg(
        F.count("*").alias("copies"), F.min_by("domain", "uid").alias("domain"),
        F.min_by("url", "uid").alias("sample_url"), F.avg("pred_proba").alias("mean_proba"))


def copy_bands(copies: DataFrame) -> DataFrame:
    n = F.col("copies")
    band = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 50, "6-50").otherwise(">50")
    return copies.groupBy(band.alias("band")).agg(F.count("*").alias("n_urls"), F.sum("copies").alias("n_rows"))


def dedup_best(df: DataFrame, key: str = "url_norm", uid: str = "uid") -> DataFrame:
    """One row per normalised URL, the most probable one; ties go to the smaller uid."""
    return first_per_key(df, [key], F.desc("pred_proba"), F.col(uid))


def dedup_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return first_per_key(df, [key], *order)


def domain_profile(df: DataFrame) -> DataFrame:
    base = df.groupBy("domain").agg(F.count("*").alias("n"), F.avg("pred_proba").alias("mean_proba"),
                                    F.min("pred_proba").alias("min_proba"), F.max("pred_proba").alias("max_proba"))
    medians = quantile_columns(df, "pred_proba", {"median_proba": 0.5}, ["domain"])
    return base.join(medians, "domain")


def domain_bands(profile: DataFrame) -> DataFrame:
    n = F.col("n")
    edges = [(1, "1 image"), (10, "2-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1k"),
             (10000, "1k-10k")]
    band = reduce(lambda acc, e: acc.when(n <= e[0], e[1]), edges[1:], F.when(n <= edges[0][0], edges[0][1]))
    return profile.groupBy(band.otherwise("10k+").alias("band")).agg(
        F.count("*").alias("n_domains"), F.sum("n").alias("n_images"))


def proba_bands(df: DataFrame, edges: list[float]) -> DataFrame:
    counts = (df.groupBy(half_open_band(F.col("pred_proba"), edges).alias("band")).agg(F.count("*").alias("n")))
    return _with_percent(counts, df).filter(F.col("band").isNotNull())


def top_groups(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


# Sampling scenarios (name, minimum probability, cap) and pilot rates.
SCENARIOS = [
    ("A: p>=0.70, cap 50", 0.70, 50), ("B: p>=0.70, cap 100", 0.70, 100), ("C: p>=0.60, cap 100", 0.60, 100),
    ("D: p>=0.50, cap 100", 0.50, 100), ("E: p>=0.70, cap 200", 0.70, 200), ("F: p>=0.50, cap 50", 0.50, 50),
    ("G: p>=0.80, cap 100", 0.80, 100), ("H: p>=0.50, no cap", 0.50, None),
]
URL_ALIVE_RATE, DOWNLOAD_RATE, PASS_RATE = 0.65, 0.97, 0.75
COST_PER_IMAGE, BUDGET = 0.002, 1800


def sampling_scenarios(df: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Capped candidates, domains and estimated yield and cost of each scenario, from one scan.

    Each domain is counted once per distinct threshold; the fixed scenario list fans out after that.
    """
    floors = sorted({s[1] for s in scenarios})
    name = {p: f"n_{round(p * 1000)}" for p in floors}
    sizes = df.groupBy("domain").agg(*[F.count_if(F.col("pred_proba") >= p).alias(name[p]) for p in floors])
    cells = F.array(*[F.struct(F.lit(label).alias("scenario"), F.col(name[p]).alias("n"),
                               F.lit(cap).cast("long").alias("cap")) for label, p, cap in scenarios])
    rows = sizes.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("n") > 0)
    capped = rows.groupBy("scenario").agg(
        F.sum(F.least("n", F.coalesce("cap", "n"))).alias("n_candidates"), F.count("*").alias("n_domains"))
    return _yield(capped)


def _yield(capped: DataFrame) -> DataFrame:
    step = lambda c, rate: F.floor(F.col(c) * rate).cast("long")
    return (capped.withColumn("n_alive", step("n_candidates", URL_ALIVE_RATE))
            .withColumn("n_downloaded", step("n_alive", DOWNLOAD_RATE))
            .withColumn("n_pass", step("n_downloaded", PASS_RATE))
            .withColumn("cost", F.col("n_downloaded") * COST_PER_IMAGE)
            .withColumn("budget_pct", F.col("cost") / BUDGET * 100))


def final_plan(df: DataFrame, floor: float = 0.70, cap: int = 50) -> DataFrame:
    plan = sampling_scenarios(df, [("final", floor, cap)])
    return plan.withColumn("budget_left", BUDGET - F.col("cost"))


def cap_impact(df: DataFrame, caps=(10, 25, 50, 100, 200, 500)) -> DataFrame:
    """Rows kept, domains capped and rows lost for each cap."""
    sizes = df.groupBy("domain").agg(F.count("*").alias("n"))
    rows = sizes.select("n", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    return rows.groupBy("cap").agg(
        F.sum(F.least("n", "cap")).alias("n_kept"), F.count_if(F.col("n") > F.col("cap")).alias("domains_capped"),
        F.sum(F.greatest(F.col("n") - F.col("cap"), F.lit(0))).alias("n_lost"))


# ---------------------------------------------------------------- state tables

def status_counts(df: DataFrame) -> DataFrame:
    """Candidates by stage and state in one pass, one row per measure."""
    url, got, ai = F.col("url_status"), F.col("download_status"), F.col("ai_status")
    measures = {
        "total": F.lit(True), "url_alive": url == "alive", "url_dead": url.isin("dead", "error"),
        "url_pending": url == "pending", "downloaded": got == "success",
        "download_failed": got.isin("failed", "not_image"), "download_pending": (url == "alive") & (got == "pending"),
        "ai_pass": ai == "pass", "ai_fail": ai == "fail", "ai_error": ai == "error",
        "ai_pending": (got == "success") & (ai == "pending"), "passes_all": F.col("passes_all"),
    }
    return measure_rows(df.agg(*[F.count_if(c).alias(m) for m, c in measures.items()]), "measure")


def measure_rows(one_row: DataFrame, name: str, value: str = "n") -> DataFrame:
    return one_row.unpivot([], one_row.columns, name, value)


def resolution_profile(df: DataFrame) -> DataFrame:
    w, h = F.col("image_width"), F.col("image_height")
    small = [F.count_if((w < x) | (h < x)).alias(f"below_{x}") for x in (400, 600, 800)]
    return df.filter(F.col("download_status") == "success").agg(
        F.count("*").alias("n"), F.min(w).alias("min_w"), F.min(h).alias("min_h"), F.max(w).alias("max_w"),
        F.max(h).alias("max_h"), F.avg(w).alias("avg_w"), F.avg(h).alias("avg_h"), *small)


def method_counts(df: DataFrame) -> DataFrame:
    """Rows per presentation method; a row may use several."""
    return measure_rows(df.agg(*[F.count_if(F.col(f"ai_{m}")).alias(m) for m in METHOD_FLAGS]), "method")


def facets(df: DataFrame, cols: dict[str, str], top: dict[str, int] = {}) -> DataFrame:
    """Counts per value of several columns in one pass: (facet, value, n), some cut to their top k."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value"))
                      for name, c in cols.items()])
    counts = (df.select(F.explode(pairs).alias("p")).filter(F.col("p.value").isNotNull())
              .groupBy("p.facet", "p.value").agg(F.count("*").alias("n")))
    if not top:
        return counts
    parts = [counts.filter(~F.col("facet").isin(list(top)))]
    parts += [counts.filter(F.col("facet") == f).orderBy(F.desc("n"), "value").limit(k) for f, k in top.items()]
    return reduce(DataFrame.unionByName, parts)


def filtered_stats(df: DataFrame, filters: dict, selected: DataFrame | None = None) -> DataFrame:
    """Every statistic of the filtered candidates as (facet, value, n)."""
    rows = candidate_filter(df, filters, selected)
    dim = max_dimension()
    size = (F.when(dim < 400, "<400px").when(dim < 600, "400-600").when(dim < 800, "600-800")
            .when(dim < 1200, "800-1200").when(dim >= 1200, "1200+"))
    counted = facets(rows.withColumn("size_band", size), {
        "status": "ai_status", "language": "ai_map_language", "confidence": "ai_confidence", "domain": "domain",
        "resolution": "size_band"}, {"domain": 15})
    flags = {**{("method", m): F.col(f"ai_{m}") for m in METHOD_FLAGS},
             **{(f"f3_{s}", x): (F.col(f"ai_{s}") if x == "yes" else ~F.col(f"ai_{s}"))
                for s in SUBJECT_FLAGS for x in ("yes", "no")}}
    one = rows.agg(F.count("*").alias("total|total"), *[F.count_if(c).alias("|".join(k)) for k, c in flags.items()])
    tall = measure_rows(one, "key").select(
        F.split_part("key", F.lit("|"), F.lit(1)).alias("facet"), F.split_part("key", F.lit("|"), F.lit(2)).alias("value"), "n")
    return counted.unionByName(tall)


def dataset_summary(selected: DataFrame) -> DataFrame:
    """Dataset size, methods, top-10 languages and confidences as (facet, value, n)."""
    counted = facets(selected, {"language": "ai_map_language", "confidence": "ai_confidence"}, {"language": 10})
    one = selected.agg(F.count("*").alias("total|total"),
                       *[F.count_if(F.col(f"ai_{m}")).alias(f"method|{m}") for m in METHOD_FLAGS])
    tall = measure_rows(one, "key").select(
        F.split_part("key", F.lit("|"), F.lit(1)).alias("facet"), F.split_part("key", F.lit("|"), F.lit(2)).alias("value"), "n")
    return counted.unionByName(tall)


# Price per million tokens (input, output) by model kind.
TOKEN_RATES = {"bulk": (1.0, 5.0), "other": (3.0, 15.0)}


def token_costs(df: DataFrame, model: str = "model", cheap_marker: str = "bulk") -> DataFrame:
    """Tokens, estimated cost and cache-hit percent per model; the marker names the cheap models."""
    cheap = F.contains(F.col(model), F.lit(cheap_marker))
    rate = lambda i: F.when(cheap, TOKEN_RATES["bulk"][i]).otherwise(TOKEN_RATES["other"][i])
    sums = df.groupBy(model).agg(*[F.sum(c).alias(c) for c in (
        "input_tokens", "output_tokens", "cache_read", "cache_write")])
    cost = (F.col("input_tokens") * rate(0) + F.col("output_tokens") * rate(1)
            + F.col("cache_read") * rate(0) * 0.1 + F.col("cache_write") * rate(0) * 1.25) / 1_000_000
    seen = F.col("cache_read") + F.col("cache_write") + F.col("input_tokens")
    return sums.withColumn("cost", cost).withColumn(
        "cache_pct", F.coalesce(F.col("cache_read") * 100 / F.nullif(seen, F.lit(0)), F.lit(0.0)))


def missing_files(members: DataFrame, files: DataFrame, path: str = "local_path") -> DataFrame:
    """Number of members whose file is not in a listing."""
    listed = files.select(F.col("path").alias(path))
    return members.join(listed, path, "left_anti").agg(F.count("*").alias("n_missing"))


def text_conversions(answers: DataFrame, raw: str, parsed: Column, order: str) -> DataFrame:
    """Distinct text answers with their number, by first appearance; numeric answers are left out."""
    text = answers.filter(F.col(raw).isNotNull() & F.col(raw).try_cast("double").isNull())
    return (text.select(F.trim(raw).alias("answer"), parsed.alias("years"), order)
            .groupBy("answer").agg(F.min(order).alias("first_seen"), F.min_by("years", order).alias("years")))


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    base = df.agg(F.count(col).alias("answered"), F.count("*").alias("n"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("sd"), F.min(col).alias("min"), F.max(col).alias("max"))
    return attach_row(base, quantile_columns(df, col, {"median": 0.5}))
