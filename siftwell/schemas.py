"""Explicit schemas of every table the operators read or write."""

from pyspark.sql import types as T

_S, _D, _I, _L, _B, _TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The ten disqualification criteria in declaration order.
CRITERIA_IDS = ["D1", "D2", "A1", "A2", "A3", "V1", "V2", "L1", "L2", "L3"]

# The eight flags of a formal check.
SUBJECT_FLAGS = ["is_map", "is_statistical_map", "has_quantitative_data", "has_admin_units"]
METHOD_FLAGS = ["has_choropleth", "has_proportional_circles", "has_graduated_circles", "has_structural_circles"]
FORMAL_FLAGS = SUBJECT_FLAGS + METHOD_FLAGS

VECTOR = T.ArrayType(T.FloatType())

CORPUS = _table(uid=_S, url=_S, text=_S, original_width=_I, original_height=_I,
                clip_l14_similarity_score=T.FloatType(), sha256=_S, l14_img=VECTOR)
RAW_SAMPLE = _table(uid=_S, url=_S, text=_S, original_width=_I, original_height=_I,
                    clip_l14_similarity_score=T.FloatType(), sha256=_S, url_status=_S)
DICTIONARY = _table(phrase=_S, score=_D, polarity=_S)
SCORED = _table(uid=_S, url=_S, score=_D, pos_keys=_S, neg_keys=_S, l14_img=VECTOR)
SAMPLE = _table(uid=_S, url=_S, score=_D, pos_keys=_S, neg_keys=_S, score_bin=_S)
EMBEDDINGS = _table(uid=_S, l14_img=VECTOR)
ANNOTATIONS = _table(uid=_S, url=_S, label=_S, timestamp=_S)
LABELLED = _table(uid=_S, label=_I, l14_img=VECTOR, url=_S, score=_D)
UNLABELLED = _table(uid=_S, l14_img=VECTOR, url=_S, score=_D)
TO_ANNOTATE = _table(uid=_S, url=_S, pred_proba=_D)
PREDICTIONS = _table(uid=_S, url=_S, pred_proba=_D, score=_D)
CLEAN_POOL = _table(uid=_S, url=_S, url_norm=_S, domain=_S, pred_proba=_D, score=_D)
MODEL_RESULTS = _table(model=_S, f1=_D, precision=_D, recall=_D, accuracy=_D, roc_auc=_D, pr_auc=_D,
                       optimal_threshold=_D, optimal_f1=_D)

CANDIDATES = _table(
    uid=_S, url=_S, domain=_S, pred_proba=_D, score=_D, stratum=_S, batch_id=_L, source=_S,
    url_status=_S, url_http_code=_I, url_content_type=_S, url_checked_at=_TS,
    download_status=_S, image_width=_I, image_height=_I, image_format=_S, image_size_bytes=_L,
    local_path=_S, downloaded_at=_TS, ai_status=_S,
    **{f"ai_{flag}": _B for flag in FORMAL_FLAGS},
    ai_confidence=_S, ai_description=_S, ai_map_language=_S, ai_raw_response=_S, ai_checked_at=_TS,
    ai_input_tokens=_L, ai_output_tokens=_L,
    passes_f1=_B, passes_f3=_B, passes_f4=_B, passes_all=_B, created_at=_TS,
)
RUNS = _table(id=_L, step=_S, params=_S, started_at=_TS, finished_at=_TS,
              items_processed=_L, items_success=_L, items_failed=_L, notes=_S)
BATCHES = _table(id=_L, name=_S, filters=_S, count_requested=_L, count_added=_L, created_at=_TS, status=_S)
SELECTED_COLUMNS = [
    "uid", "url", "domain", "pred_proba", "image_width", "image_height", "local_path", "ai_status",
    *[f"ai_{flag}" for flag in FORMAL_FLAGS],
    "ai_confidence", "ai_description", "ai_map_language", "passes_f3", "passes_f4", "passes_all",
]
MAPS = _table(
    uid=_S, url=_S, domain=_S, pred_proba=_D, image_width=_I, image_height=_I, local_path=_S,
    ai_map_language=_S, **{f"ai_{flag}": _B for flag in METHOD_FLAGS},
    disq_status=_S, **{f"disq_{c}": _B for c in CRITERIA_IDS},
    disq_confidence=_S, disq_description=_S, disq_raw_response=_S, disq_checked_at=_TS,
    disq_input_tokens=_L, disq_output_tokens=_L,
    **{f"human_{c}": _B for c in CRITERIA_IDS}, human_reviewed_at=_TS,
    violations_count=_I, quality_score=_D, imported_at=_TS,
)
SURVEY_ATTRIBUTES = _table(respondent=_L, gender=_S, country=_S, institution=_S, education=_S,
                           works_maps=_S, years_maps=_S, works_stat=_S, years_stat=_S, self_expert=_I)
RATINGS = _table(respondent=_L, criterion=_S, rating=_I)


def formal_response() -> T.StructType:
    """Response schema of the formal check, built from the flag list."""
    return _table(**{flag: _S for flag in FORMAL_FLAGS}, confidence=_S, brief_description=_S, map_language=_S)


def violation_response() -> T.StructType:
    """Response schema of the violation check, built from the criteria list."""
    return _table(**{f"disq_{c}": _S for c in CRITERIA_IDS}, confidence=_S, brief_description=_S)
