"""Projections, predicates and dynamic filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.functions.scores import label_code, sign_class
from siftwell.schemas import CRITERIA_IDS


def select_present(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(*[c for c in order if c in df.columns])


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def at_least(col: str, threshold: float, inclusive: bool = True) -> Column:
    return F.col(col) >= threshold if inclusive else F.col(col) > threshold


def working_corpus(df: DataFrame, floor: float = -1.0) -> DataFrame:
    """Rows whose dictionary score reaches the floor."""
    return df.filter(F.col("score") >= floor)


# Domains never taken.
EXCLUDED_DOMAINS = ["ville-data.com", "files.airnowtech.org", "droughtmonitor.unl.edu"]


def exclude_domains(df: DataFrame, extra: list[str] = (), configured: list[str] = EXCLUDED_DOMAINS) -> DataFrame:
    """Drop the listed domains; a row without a domain stays."""
    return df.filter(~F.coalesce(F.col("domain").isin(sorted({*extra, *configured})), F.lit(False)))


def sign_counts(df: DataFrame, status: str = "OK") -> DataFrame:
    """Rows of one URL status by sign of their score."""
    return (df.filter(F.col("url_status") == status).groupBy(sign_class(F.col("score")).alias("sign"))
            .agg(F.count("*").alias("n")))


def transition_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose sign differs between two score versions."""
    before, after = sign_class(F.col(old)), sign_class(F.col(new))
    return (df.filter(before != after).groupBy(before.alias("from_sign"), after.alias("to_sign"))
            .agg(F.count("*").alias("n")))


def valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """YES/NO rows with the label as 1/0; INVALID and unknown labels are dropped."""
    return df.withColumn(label, label_code(F.col(label))).filter(F.col(label).isin(0, 1))


def with_review_label(df: DataFrame, wanted: str, label: str = "label") -> DataFrame:
    """Rows of one review label, whether labels are text or numbers."""
    return df.filter(label_code(F.col(label)) == label_code(F.lit(wanted)))


# ---------------------------------------------------------------- candidate and map filters

METHODS = {"m_choro": "ai_has_choropleth", "m_prop": "ai_has_proportional_circles",
           "m_grad": "ai_has_graduated_circles", "m_struct": "ai_has_structural_circles"}
CIRCLES = ["ai_has_proportional_circles", "ai_has_graduated_circles", "ai_has_structural_circles"]


def _equal(filters: dict, mapping: dict[str, str]) -> list[Column]:
    return [F.col(column) == filters[key] for key, column in mapping.items() if filters.get(key)]


def _methods(filters: dict) -> list[Column]:
    return [F.col(column) for key, column in METHODS.items() if filters.get(key)]


def candidate_filter(df: DataFrame, filters: dict, selected: DataFrame | None = None) -> DataFrame:
    """Downloaded candidates that meet every given filter; absent filters do not restrict."""
    keep = [F.col("download_status") == "success"]
    if filters.get("status", "all") != "all":
        keep.append(F.col("ai_status") == filters["status"])
    keep += _equal(filters, {"lang": "ai_map_language", "confidence": "ai_confidence", "domain": "domain"})
    for key, column in (("f3", "passes_f3"), ("f4", "passes_f4")):
        if filters.get(key) in ("0", "1"):
            keep.append(F.col(column) == (filters[key] == "1"))
    out = df.filter(both(keep))
    if filters.get("selected") == "1":
        out = out.join(selected.select("uid"), "uid", "left_semi")
    if filters.get("batch_id") is not None:
        members = selected.filter(F.col("batch_id") == int(filters["batch_id"]))
        out = out.join(members.select("uid"), "uid", "left_semi")
    return out


def gallery_filter(df: DataFrame, filters: dict, selected: DataFrame | None = None) -> DataFrame:
    """candidate_filter plus methods (all must hold), minimum size and a text search."""
    keep = _methods(filters)
    for key, column in (("min_w", "image_width"), ("min_h", "image_height")):
        if filters.get(key):
            keep.append(F.col(column) >= int(filters[key]))
    if filters.get("search"):
        keep.append(F.contains(F.lower("ai_description"), F.lit(filters["search"].lower())))
    return candidate_filter(df, filters, selected).filter(both(keep))


def max_dimension() -> Column:
    return F.greatest("image_width", "image_height")


def builder_filter(df: DataFrame, filters: dict, selected: DataFrame) -> DataFrame:
    """Downloaded, passing, not yet selected candidates that meet the builder's filters."""
    keep = [F.col("download_status") == "success", F.col("ai_status") == "pass"]
    keep += _equal(filters, {"lang": "ai_map_language", "confidence": "ai_confidence", "domain": "domain"})
    keep += _methods(filters)
    if filters.get("min_res"):
        keep.append(max_dimension() >= int(filters["min_res"]))
    return df.filter(both(keep)).join(selected.select("uid"), "uid", "left_anti")


def effective(criterion: str) -> Column:
    """Human flag if there is one, else the model's."""
    return F.coalesce(F.col(f"human_{criterion}"), F.col(f"disq_{criterion}"))


def overridden(criterion: str) -> Column:
    return F.col(f"human_{criterion}") != F.col(f"disq_{criterion}")


def map_filter(df: DataFrame, filters: dict) -> DataFrame:
    """Rows of the map table that meet status, language, violation, review, score and method filters."""
    keep = []
    if filters.get("status", "all") != "all":
        keep.append(F.col("disq_status") == filters["status"])
    keep += _equal(filters, {"lang": "ai_map_language", "confidence": "disq_confidence", "domain": "domain"})
    for c in CRITERIA_IDS:
        if filters.get(f"v_{c}") in ("0", "1"):
            keep.append(effective(c) == (filters[f"v_{c}"] == "1"))
    reviewed = filters.get("review_criterion")
    if reviewed in CRITERIA_IDS:
        keep.append(F.col("disq_status") == "checked")
        shows = {"violations": F.col(f"disq_{reviewed}"), "ok": ~F.col(f"disq_{reviewed}"),
                 "not_reviewed": F.col(f"human_{reviewed}").isNull(), "overridden": overridden(reviewed)}
        if filters.get("review_show") in shows:
            keep.append(shows[filters["review_show"]])
    if filters.get("q_min") is not None:
        keep.append(F.col("quality_score") >= float(filters["q_min"]))
    if filters.get("q_max") is not None:
        keep.append(F.col("quality_score") <= float(filters["q_max"]))
    if filters.get("m_choro"):
        keep.append(F.col("ai_has_choropleth"))
    if filters.get("m_circles"):
        keep.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in CIRCLES]))
    if filters.get("search"):
        keep.append(F.contains(F.lower("disq_description"), F.lit(filters["search"].lower())))
    return df.filter(both(keep))


def selected_ids(df: DataFrame, uids: DataFrame) -> DataFrame:
    return df.join(uids.select("uid"), "uid", "left_semi")


# ---------------------------------------------------------------- sorts and pages

CANDIDATE_ORDERS = {
    "status": lambda: [F.when(F.col("ai_status") == "pass", 0).when(F.col("ai_status") == "fail", 1).otherwise(2),
                       F.desc("pred_proba")],
    "proba_desc": lambda: [F.desc("pred_proba")],
    "proba_asc": lambda: [F.asc("pred_proba")],
    "res_desc": lambda: [(F.col("image_width") * F.col("image_height")).desc()],
    "res_asc": lambda: [(F.col("image_width") * F.col("image_height")).asc()],
    "domain": lambda: [F.asc("domain"), F.desc("pred_proba")],
    "lang": lambda: [F.asc("ai_map_language"), F.desc("pred_proba")],
}
MAP_ORDERS = {
    "score_asc": lambda: [F.asc("quality_score")],
    "score_desc": lambda: [F.desc("quality_score")],
    "violations": lambda: [F.desc("violations_count"), F.asc("quality_score")],
    "domain": lambda: [F.asc("domain")],
    "lang": lambda: [F.asc("ai_map_language")],
}


def candidate_order(sort: str = "status") -> list[Column]:
    return [*CANDIDATE_ORDERS.get(sort, CANDIDATE_ORDERS["proba_desc"])(), F.asc("uid")]


def map_order(sort: str = "score_asc") -> list[Column]:
    return [*MAP_ORDERS.get(sort, MAP_ORDERS["score_asc"])(), F.asc("uid")]


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 30) -> DataFrame:
    """One page in a total order, with the number of all matching rows."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", total)


def review_order(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Probability descending if there is one, else score descending."""
    lead = next((c for c in ("pred_proba", "score") if c in df.columns), None)
    ordered = df.orderBy(*([F.desc(lead)] if lead else []), F.asc("uid"))
    return ordered.limit(limit) if limit else ordered


def large_domains(profile: DataFrame) -> DataFrame:
    """Suspicious (over 100 rows, mean below 0.75) and good (over 500, mean above 0.85) domains."""
    return large_groups(profile, (100, 0.75), (500, 0.85))


def large_groups(profile: DataFrame, suspicious: tuple[int, float], good: tuple[int, float]) -> DataFrame:
    n, mean = F.col("n"), F.col("mean_proba")
    kind = (F.when((n > suspicious[0]) & (mean < suspicious[1]), "suspicious")
            .when((n > good[0]) & (mean > good[1]), "good"))
    return profile.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def applicable_criteria() -> Column:
    """Criteria to check, from the method flags; all-round criteria always apply."""
    choropleth = F.coalesce(F.col("ai_has_choropleth"), F.lit(False))
    circles = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in CIRCLES])
    needs = {"A1": choropleth, "A3": choropleth | circles, "V2": circles}
    marks = [F.when(needs[c], F.lit(c)) if c in needs else F.lit(c) for c in CRITERIA_IDS]
    return F.array_compact(F.array(*marks))
