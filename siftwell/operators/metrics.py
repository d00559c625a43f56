"""Classifier metrics as aggregates: confusion counts, ROC-AUC, average precision, best threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.operators.ordering import per_value, running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def derived_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "specificity": _ratio(tn, tn + fp),
    }


def confusion(df: DataFrame, label: str = "label", proba: str = "pred_proba", threshold=0.5,
              groups: list[str] = ()) -> DataFrame:
    """TP, FP, TN, FN and what follows from them; undefined ratios are 0."""
    hit, real = F.col(proba) >= threshold, F.col(label) == 1
    counts = df.groupBy(*groups).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn"))
    derived = derived_metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return counts.select(*groups, "tp", "fp", "tn", "fn", *[e.alias(n) for n, e in derived.items()])


def _by_score(df: DataFrame, label: str, proba: str, groups: list[str] = ()) -> DataFrame:
    real = F.col(label) == 1
    return per_value(df, proba, groups, pos=F.count_if(real), neg=F.count_if(~real))


def roc_auc(df: DataFrame, label: str = "label", proba: str = "pred_proba", groups: list[str] = ()) -> DataFrame:
    """Rank-sum AUC with ties counted half; 0 when only one class is present."""
    cum = running_totals(_by_score(df, label, proba, groups), proba, ["pos", "neg"], groups)
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)
    pairs = F.max("all_pos") * F.max("all_neg")
    return cum.groupBy(*groups).agg(_ratio(F.sum(wins), pairs).alias("roc_auc"))


def _curve_points(df, label, proba, groups) -> DataFrame:
    cum = running_totals(_by_score(df, label, proba, groups), proba, ["pos", "neg"], groups, descending=True)
    return cum.withColumn("precision", F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).withColumn(
        "recall", _ratio(F.col("cum_pos"), F.col("all_pos")))


def average_precision(df: DataFrame, label: str = "label", proba: str = "pred_proba",
                      groups: list[str] = ()) -> DataFrame:
    """Step-sum area under the precision-recall curve, no interpolation."""
    points = _curve_points(df, label, proba, groups)
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    area = F.sum(F.col("precision") * _ratio(F.col("pos"), F.col("all_pos")))
    return points.groupBy(*groups).agg(F.when(both, area).otherwise(0.0).alias("pr_auc"))


def precision_recall_curve(df: DataFrame, label: str = "label", proba: str = "pred_proba",
                           groups: list[str] = ()) -> DataFrame:
    """(threshold, precision, recall, f1) for every distinct score."""
    p, r = F.col("precision"), F.col("recall")
    return _curve_points(df, label, proba, groups).select(
        *groups, F.col(proba).alias("threshold"), p, r, (2 * p * r / (p + r + 1e-10)).alias("f1"))


def best_threshold(df: DataFrame, label: str = "label", proba: str = "pred_proba",
                   groups: list[str] = ()) -> DataFrame:
    """Threshold of the highest F1, the lowest one on ties; 0.5 if no threshold beats the end point."""
    curve = precision_recall_curve(df, label, proba, groups).withColumn("f1", F.round("f1", 12))
    best = curve.groupBy(*groups).agg(
        F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b"))
    return best.select(*groups, F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5)
                       .alias("optimal_threshold"), F.col("b.f1").alias("optimal_f1"))


def evaluate(df: DataFrame, label: str = "label", proba: str = "pred_proba", groups: list[str] = ()) -> DataFrame:
    """All metrics at 0.5 and at the optimal threshold, one row per group (one row without groups).

    Rows are folded to distinct scores once and their running counts, from the highest score down, hold everything: the
    counts at a score are the confusion at that threshold, and both areas are sums over them.
    """
    groups = list(groups)
    points = _curve_points(df, label, proba, groups)
    p, r = F.col("precision"), F.col("recall")
    pos, neg, all_pos, all_neg = (F.col(c) for c in ("cum_pos", "cum_neg", "all_pos", "all_neg"))
    f1 = F.round(2 * p * r / (p + r + 1e-10), 12)
    wins = F.col("pos") * (all_neg - neg + F.col("neg") / 2)
    area = F.sum(p * _ratio(F.col("pos"), all_pos))
    zero = F.lit(0).cast("long")
    whole = points.groupBy(*groups).agg(
        F.coalesce(F.max("all_pos"), zero).alias("np"), F.coalesce(F.max("all_neg"), zero).alias("nn"),
        F.coalesce(F.max(F.when(F.col(proba) >= 0.5, pos)), zero).alias("tp"), F.coalesce(F.max(F.when(F.col(proba) >= 0.5, neg)), zero).alias("fp"),
        F.sum(wins).alias("wins"), area.alias("area"),
        F.min_by(F.struct(F.col(proba).alias("threshold"), f1.alias("f1"), pos.alias("tp"), neg.alias("fp")), F.struct(-f1, F.col(proba))).alias("b"))
    n1, n0 = F.col("np"), F.col("nn")
    found = F.coalesce(F.col("b.f1") > 0, F.lit(False))
    tp2, fp2 = (F.when(found, F.col(f"b.{c}")).otherwise(F.col(c)) for c in ("tp", "fp"))
    tp, fp = F.col("tp"), F.col("fp")
    plain = {"tp": tp, "fp": fp, "tn": n0 - fp, "fn": n1 - tp} | derived_metrics(tp, fp, n0 - fp, n1 - tp)
    tuned = {"tp": tp2, "fp": fp2, "tn": n0 - fp2, "fn": n1 - tp2} | derived_metrics(tp2, fp2, n0 - fp2, n1 - tp2)
    return whole.select(
        *groups, *[e.alias(c) for c, e in plain.items()], _ratio(F.col("wins"), n1 * n0).alias("roc_auc"),
        F.when((n1 > 0) & (n0 > 0), F.col("area")).otherwise(0.0).alias("pr_auc"), F.when(found, F.col("b.threshold")).otherwise(0.5).alias("optimal_threshold"),
        F.col("b.f1").alias("optimal_f1"), *[e.alias(f"optimal_{c}") for c, e in tuned.items() if c != "f1"])


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Sizes of both classes, NO:YES ratio and YES share."""
    yes, no = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.count("*").alias("n"), yes.alias("n_yes"), no.alias("n_no"),
                  (no / F.nullif(yes, F.lit(0))).alias("imbalance"),
                  (yes / F.nullif(F.count("*"), F.lit(0))).alias("yes_share"))
