"""Formal criteria, violation flags, quality scores, overrides and their reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.operators.filters import effective, overridden
from siftwell.schemas import CRITERIA_IDS, METHOD_FLAGS, SUBJECT_FLAGS

# Categories and weights of the ten criteria, and when each applies.
CRITERIA = {
    "D1": ("DATA", 0.87, "always"), "D2": ("DATA", 0.51, "always"), "A1": ("DATA_ANALYSIS", 0.80, "choropleth"),
    "A2": ("DATA_ANALYSIS", 0.59, "always"), "A3": ("DATA_ANALYSIS", 0.69, "graduated"),
    "V1": ("VISUALIZATION", 0.73, "always"), "V2": ("VISUALIZATION", 0.84, "circles"),
    "L1": ("LAYOUT", 0.64, "always"), "L2": ("LAYOUT", 0.86, "always"), "L3": ("LAYOUT", 0.65, "always"),
}
WEIGHTS = {c: weight for c, (_, weight, _) in CRITERIA.items()}
Q_MAX = 60.0


# ---------------------------------------------------------------- formal criteria

def _all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(f, F.lit(False)) for f in flags])


def _any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


# Pass conditions of the formal criteria; F1 is recorded only.
PASS_CONDITIONS = {
    "F1": "", "F3": " and ".join(SUBJECT_FLAGS), "F4": " or ".join(METHOD_FLAGS),
}


def formal_criteria(df: DataFrame, prefix: str = "ai_") -> DataFrame:
    """passes_f1, passes_f3, passes_f4, passes_all and per-criterion details; a missing flag is false."""
    f3 = _all_of([F.col(prefix + f) for f in SUBJECT_FLAGS])
    f4 = _any_of([F.col(prefix + f) for f in METHOD_FLAGS])
    passed = df.withColumns({"passes_f1": F.lit(True), "passes_f3": f3, "passes_f4": f4})
    reason = lambda c, cond: (F.lit("no condition") if not cond else
                              F.when(F.col(c), "OK").otherwise(f"failed: {cond}"))
    details = F.array(*[F.struct(F.lit(k).alias("criterion_id"), F.col(f"passes_{k.lower()}").alias("passed"),
                                 reason(f"passes_{k.lower()}", cond).alias("reason"))
                        for k, cond in PASS_CONDITIONS.items()])
    return passed.withColumns({"passes_all": F.col("passes_f3") & F.col("passes_f4"), "details": details})


def evaluate_condition(df: DataFrame, condition: str, allowed: list[str], name: str = "passed") -> DataFrame:
    """Evaluate a condition given as text, if it uses only allowed columns; NULL counts as false."""
    if not condition:
        return df.withColumn(name, F.lit(True))
    words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", condition)} - {"and", "or", "not", "true", "false", "null"}
    unknown = words - {a.lower() for a in allowed}
    if unknown or not re.fullmatch(r"[\w\s.()<>=!+\-*/%]*", condition):
        raise ValueError(f"condition may not use: {sorted(unknown) or condition}")
    missing = [a for a in allowed if a not in df.columns and a.lower() in words]
    padded = df.withColumns({m: F.lit(None).cast("boolean") for m in missing}) if missing else df
    return padded.withColumn(name, F.coalesce(F.expr(condition).cast("boolean"), F.lit(False))).drop(*missing)


# ---------------------------------------------------------------- quality score

def quality_columns(flags: dict[str, Column], weights: dict[str, float] = WEIGHTS, q_max: float = Q_MAX,
                    ) -> tuple[Column, Column]:
    """(score, violations).  Unchecked criteria add no penalty but stay in the weight total."""
    total = sum(weights.values())
    hit = lambda f, v: F.when(f, v).otherwise(F.lit(v) * 0)
    penalty = reduce(lambda a, b: a + b, [hit(flags[c], w) for c, w in weights.items()])
    count = reduce(lambda a, b: a + b, [hit(flags[c], 1) for c in weights])
    return F.bround(q_max * (1 - penalty / total), 2), count.cast("int")


def score_maps(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Score and violation count of every checked map, human flags first; other rows keep theirs."""
    q, n = quality_columns({c: effective(c) for c in weights}, weights)
    checked = F.col("disq_status") == "checked"
    kept = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    return df.withColumns({"quality_score": F.when(checked, q).otherwise(kept("quality_score", "double")),
                           "violations_count": F.when(checked, n).otherwise(kept("violations_count", "int"))})


def quality_with_weights(violations: DataFrame, weight_sets: DataFrame, q_max: float = Q_MAX) -> DataFrame:
    """Score of each scenario under each weight set.

    ``violations`` is (scenario, criterion), ``weight_sets`` (weight_set, criterion, weight).
    """
    totals = weight_sets.groupBy("weight_set").agg(F.sum("weight").alias("total"))
    penalty = violations.join(weight_sets, "criterion").groupBy("scenario", "weight_set").agg(
        F.sum("weight").alias("penalty"))
    return penalty.join(totals, "weight_set").select(
        "scenario", "weight_set", (q_max * (1 - F.col("penalty") / F.col("total"))).alias("q"))


# ---------------------------------------------------------------- overrides

def latest_overrides(log: DataFrame) -> DataFrame:
    """Override log (uid, criterion, value, at, seq) to one row per uid with human_<criterion> columns."""
    last = (log.groupBy("uid", "criterion")
            .agg(F.max_by(F.struct("value"), F.struct("at", "seq")).alias("v"), F.max("at").alias("at")))
    return last.groupBy("uid").agg(
        *[F.max(F.when(F.col("criterion") == c, F.col("v.value"))).alias(f"human_{c}") for c in CRITERIA_IDS],
        *[F.max(F.when(F.col("criterion") == c, F.lit(True))).alias(f"_set_{c}") for c in CRITERIA_IDS],
        F.max("at").alias("_reviewed_at"))


def apply_overrides(maps: DataFrame, log: DataFrame) -> DataFrame:
    """Write the last override of each flag into the maps and rescore them."""
    joined = maps.join(latest_overrides(log).select(
        "uid", *[F.col(f"human_{c}").alias(f"_new_{c}") for c in CRITERIA_IDS],
        *[f"_set_{c}" for c in CRITERIA_IDS]), "uid", "left")
    updated = joined.withColumns({f"human_{c}": F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}"))
                                  .otherwise(F.col(f"human_{c}")) for c in CRITERIA_IDS})
    return score_maps(updated.select(*maps.columns))


# ---------------------------------------------------------------- reports

def violation_rows(df: DataFrame) -> DataFrame:
    """One pass over the table: per-criterion counts as (criterion, measure columns)."""
    measures = {"model": lambda c: F.col(f"disq_{c}"), "final": effective, "overrides": overridden,
                "reviewed": lambda c: F.col(f"human_{c}").isNotNull()}
    one = df.agg(*[F.count_if(expr(c)).alias(f"{m}_{c}") for c in CRITERIA_IDS for m, expr in measures.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("criterion"), *[F.col(f"{m}_{c}").alias(m) for m in measures])
                      for c in CRITERIA_IDS])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def model_violations(df: DataFrame) -> DataFrame:
    """Model flags only, with percent of the checked maps."""
    checked = df.agg(F.count_if(F.col("disq_status") == "checked").alias("n")).scalar()
    return violation_rows(df).select(
        "criterion", F.col("model").alias("n"), (F.col("model") * 100 / F.nullif(checked, F.lit(0))).alias("percent"))


def quality_bands(df: DataFrame) -> DataFrame:
    """Checked maps per quality band."""
    q = F.col("quality_score")
    band = (F.when(q < 20, "0-20").when(q < 40, "20-40").when(q < 55, "40-55").when(q < 60, "55-60")
            .when(q < 61, "60"))
    return (df.filter((F.col("disq_status") == "checked") & (q >= 0)).groupBy(band.alias("band"))
            .agg(F.count("*").alias("n"), F.avg("quality_score").alias("mean_quality")))


def quality_histogram(df: DataFrame) -> DataFrame:
    """Checked maps in steps of 5 from 0 to 65, empty steps included."""
    steps = df.sparkSession.range(0, 65, 5).select(F.col("id").alias("lo"))
    counts = (df.filter((F.col("disq_status") == "checked") & F.col("quality_score").isNotNull())
              .groupBy((F.floor(F.col("quality_score") / 5) * 5).cast("long").alias("lo"))
              .agg(F.count("*").alias("n")))
    return steps.join(counts, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"))


def violation_distribution(df: DataFrame) -> DataFrame:
    return (df.filter((F.col("disq_status") == "checked") & F.col("violations_count").isNotNull())
            .groupBy("violations_count").agg(F.count("*").alias("n")))
