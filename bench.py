"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, functions as F

from siftwell.operators import learning
from siftwell.plans import catalog, tables as t
from siftwell.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "entry_top_domains", "e01_dedup_best", "e03_domain_cap", "e05_stratified_sample", "e06_minimum_per_bin",
    "f06_most_uncertain", "d16_prediction_stats", "d24_domain_profile", "d27_sampling_scenarios", "d34_filtered_stats",
    "d38_violation_table", "d44_per_criterion", "d52_roc_auc", "d53_average_precision", "e12_latest_record", "h25_quality_score",
    "i01_stratified_split", "i10_metrics_at_both_thresholds", "j01_krippendorff_alpha", "j09_bootstrap_weights", "k06_human_overrides",
]

def phrase_scoring(spark, sf) -> DataFrame:
    return catalog.queries()["h01_phrase_score"](spark, sf)

def linear_scoring(spark, sf) -> DataFrame:
    p = F.round(learning.linear_proba(t.LINEAR, t.BIAS), 9)
    return learning.score_and_keep(t.vectors(spark, sf), p)

def phrase_join(spark, sf) -> DataFrame:
    return catalog.queries()["c14_phrase_join"](spark, sf)

def language_identification(spark, sf) -> DataFrame:
    return catalog.queries()["l04_language_identification"](spark, sf)

def pool_cleaning(spark, sf) -> DataFrame:
    return catalog.queries()["e03_domain_cap"](spark, sf)

RATES = {"phrase_scoring": (phrase_scoring, "documents"), "phrase_join": (phrase_join, "documents"),
         "language_identification": (language_identification, "documents"), "linear_scoring": (linear_scoring, "embeddings"),
         "pool_cleaning": (pool_cleaning, "pages")}

def seconds(fn, spark) -> float:
    start = time.perf_counter()
    fn(spark, SF).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start

def main() -> None:
    spark = local_session(CPUS, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    runs = {**{name: fn for name, (fn, _) in RATES.items()}, **{name: queries[name] for name in HEADLINE}}
    times = {}
    for name, fn in runs.items():
        seconds(fn, spark)  # warm-up
        times[name] = round(min(seconds(fn, spark) for _ in range(2)), 4)
    rates = {name: round(t.table(spark, SF, source).count() / times[name]) for name, (_, source) in RATES.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rows_per_second": rates, "sf": SF.rsplit("sf", 1)[-1].strip("/")}))

if __name__ == "__main__":
    main()
