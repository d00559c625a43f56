"""State tables: idempotent inserts, status steps, resets, batches and the run audit.

A state table is a DataFrame; a change is a new DataFrame that the caller writes as the next snapshot.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftwell.functions.scores import label_code
from siftwell.operators.filters import EXCLUDED_DOMAINS, builder_filter, exclude_domains
from siftwell.operators.sampling import cap_per_domain, ranked_cap_per_domain, stratified_sample, take_random
from siftwell.operators.ordering import first_per_key
from siftwell.schemas import CRITERIA_IDS, METHOD_FLAGS, SELECTED_COLUMNS


def new_rows(state: DataFrame, rows: DataFrame, key: str = "uid") -> DataFrame:
    """Rows whose key is not in the state yet, one per key."""
    unique = first_per_key(rows, [key], *[F.col(c).asc_nulls_last() for c in rows.columns if c != key])
    return unique.join(state.select(key), key, "left_anti")


def insert_ignore(state: DataFrame, rows: DataFrame, key: str = "uid") -> DataFrame:
    """State plus the rows with a new key; running it again adds nothing."""
    return state.unionByName(new_rows(state, rows, key), allowMissingColumns=True)


def insert_counts(state: DataFrame, rows: DataFrame, key: str = "uid") -> DataFrame:
    total = rows.agg(F.count("*").alias("n")).scalar()
    return (new_rows(state, rows, key).agg(F.count("*").alias("n_inserted"))
            .withColumn("n_skipped", total - F.col("n_inserted")))


def pending(state: DataFrame, step: str) -> DataFrame:
    """Rows whose previous step succeeded and whose own step is still open."""
    url, got, ai = F.col("url_status"), F.col("download_status"), F.col("ai_status")
    rules = {
        "url_check": (url == "pending", ["uid", "url"]),
        "download": ((url == "alive") & (got == "pending"), ["uid", "url"]),
        "ai_check": ((got == "success") & (ai == "pending"), ["uid", "local_path", "image_width", "image_height"]),
    }
    condition, columns = rules[step]
    return state.filter(condition).select(*columns)


def upsert(state: DataFrame, changes: DataFrame, key: str = "uid", order: list[Column] | None = None) -> DataFrame:
    """Replace the named columns of the changed keys; other rows and columns stay.

    Of several changes for one key the first in ``order`` counts (by default in the order of their columns).
    """
    columns = [c for c in changes.columns if c != key]
    changes = first_per_key(changes, [key], *(order or [F.col(c).asc_nulls_last() for c in columns]))
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = state.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                           if c in columns else F.col(c) for c in state.columns])


def enrich(rows: DataFrame, function: Callable[[dict], dict], result: T.StructType, partitions: int | None = None,
           attempts: int = 3, delay: float = 0.0) -> DataFrame:
    """Result columns of an outside row function, with bounded retries; status is 'error' if all fail.

    ``function`` maps a row to its result columns.  Rows are spread over ``partitions`` tasks so that the
    outside service sees at most that many callers.
    """
    names = [f.name for f in result.fields]
    schema = T.StructType([*rows.schema.fields, *result.fields, T.StructField("error", T.StringType())])

    def call(row: dict) -> dict:
        error = "max retries"
        for attempt in range(attempts):
            try:
                return {**function(row), "error": None}
            except Exception as exc:  # the outside function may fail in any way
                error = str(exc)
                if delay and attempt < attempts - 1:
                    time.sleep(delay * (attempt + 1))
        return {"status": "error", "error": error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([call(r) for r in pdf.to_dict("records")], index=pdf.index,
                               columns=[*names, "error"])
            yield pd.concat([pdf, out], axis=1)

    spread = rows.repartition(partitions) if partitions else rows
    return spread.mapInPandas(run, schema)


# ---------------------------------------------------------------- resets

def reset_check(maps: DataFrame, uids: DataFrame, human: bool = True) -> DataFrame:
    """Set the listed maps back to pending and clear their results, human flags only if asked."""
    cleared = [f"disq_{c}" for c in CRITERIA_IDS] + [
        "disq_confidence", "disq_description", "disq_raw_response", "quality_score", "violations_count"]
    if human:
        cleared += [f"human_{c}" for c in CRITERIA_IDS] + [
            "disq_checked_at", "disq_input_tokens", "disq_output_tokens", "human_reviewed_at"]
    marked = maps.join(uids.select("uid", F.lit(True).alias("_hit")).distinct(), "uid", "left")
    values = {c: F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)) for c in cleared if c in maps.columns}
    values["disq_status"] = F.when(F.col("_hit"), "pending").otherwise(F.col("disq_status"))
    return marked.withColumns(values).select(*maps.columns)


def import_selected(maps: DataFrame, selected: DataFrame) -> DataFrame:
    """Insert-select of dataset members into the map table, known uids ignored."""
    columns = ["uid", "url", "domain", "pred_proba", "image_width", "image_height", "local_path", "ai_map_language",
               *[f"ai_{m}" for m in METHOD_FLAGS]]
    rows = selected.select(*[c for c in columns if c in selected.columns], F.lit("pending").alias("disq_status"))
    return insert_ignore(maps, rows)


# ---------------------------------------------------------------- candidate loading

def load_all(predictions: DataFrame, floor: float = 0.70, exclude=(), source: str = "load_all") -> DataFrame:
    """Every candidate at or above the floor outside the excluded domains."""
    kept = exclude_domains(predictions.filter(F.col("pred_proba") >= floor), exclude, EXCLUDED_DOMAINS)
    return _candidate_rows(kept.withColumn("stratum", F.lit("all")), source)


def smart_sample(predictions: DataFrame, floor: float = 0.70, cap: int = 50, target: int = 500_000, exclude=(),
                 seed: int = 42) -> DataFrame:
    """Floor, exclusions, random cap per domain, then the strata."""
    kept = exclude_domains(predictions.filter(F.col("pred_proba") >= floor), exclude, EXCLUDED_DOMAINS)
    capped = cap_per_domain(kept, cap, seed=seed)
    return _candidate_rows(stratified_sample(capped, target, seed=seed), "sample")


def add_from_domain(predictions: DataFrame, domain: str, limit: int = 200, floor: float = 0.70,
                    seed: int = 42) -> DataFrame:
    rows = predictions.filter((F.col("domain") == domain) & (F.col("pred_proba") >= floor))
    return _candidate_rows(take_random(rows, limit, seed=seed).withColumn("stratum", F.lit("domain_add")), "domain_add")


def _candidate_rows(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("uid", "url", "domain", "pred_proba", "score", "stratum", F.lit(source).alias("source"))


# ---------------------------------------------------------------- dataset members and batches

def batch_members(candidates: DataFrame, selected: DataFrame, filters: dict, count: int, batch_id: int,
                  cap: int = 20, seed: int = 42) -> DataFrame:
    """Eligible candidates after the ranked domain cap, a random ``count`` of them, marked with the batch."""
    eligible = ranked_cap_per_domain(builder_filter(candidates, filters, selected), cap)
    present = [c for c in SELECTED_COLUMNS if c in candidates.columns]
    return take_random(eligible, count, seed=seed).select(*present, F.lit(batch_id).cast("long").alias("batch_id"))


def batch_record(members: DataFrame, batch_id: int, name: str, filters: str, requested: int) -> DataFrame:
    return members.agg(F.lit(batch_id).cast("long").alias("id"), F.lit(name).alias("name"),
                       F.lit(filters).alias("filters"), F.lit(requested).cast("long").alias("count_requested"),
                       F.count("*").alias("count_added"), F.lit("active").alias("status"))


def undo_batch(selected: DataFrame, batches: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Members without the batch, and the batches with it marked undone."""
    kept = selected.filter(~F.col("batch_id").eqNullSafe(F.lit(batch_id)))
    status = F.when(F.col("id") == batch_id, "undone").otherwise(F.col("status"))
    return kept, batches.withColumn("status", status)


def add_member(selected: DataFrame, candidates: DataFrame, uids: DataFrame) -> DataFrame:
    rows = candidates.join(uids.select("uid"), "uid", "left_semi")
    return insert_ignore(selected, rows.select(*[c for c in SELECTED_COLUMNS if c in rows.columns]))


def remove_member(table: DataFrame, uids: DataFrame) -> DataFrame:
    return table.join(uids.select("uid"), "uid", "left_anti")


# ---------------------------------------------------------------- audit

def run_record(results: DataFrame, run_id: int, step: str, ok: str, params: str | None = None) -> DataFrame:
    """Audit row of one finished step: processed, success and failed counts of its results."""
    success = F.col("status") == ok
    return results.agg(
        F.lit(run_id).cast("long").alias("id"), F.lit(step).alias("step"), F.lit(params).cast("string").alias("params"),
        F.count("*").alias("items_processed"), F.count_if(success).alias("items_success"),
        F.count_if(~F.coalesce(success, F.lit(False))).alias("items_failed"))


def last_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(k)


def wrongly_invalid(labelled: DataFrame, check: Callable[[dict], dict], partitions: int | None = None) -> DataFrame:
    """Keys of INVALID rows whose check now succeeds."""
    rows = labelled.filter(label_code(F.col("label")) == -1).select("uid", "url")
    checked = enrich(rows, check, T.StructType([T.StructField("status", T.StringType())]), partitions, attempts=1)
    return checked.filter(F.col("status") == "alive").select("uid")


def latest_per_key(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Last record per key of an append-only log."""
    return first_per_key(log, [key], *[F.desc(c) for c in order])
