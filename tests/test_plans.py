"""The physical plans that matter at scale."""

import pytest

from siftwell.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e01_dedup_best", "e03_domain_cap", "e12_latest_record", "i15_samples_per_tier"])
def test_groups_are_trimmed_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name, wanted, unwanted", [
    ("f05_top_domains", "url", "html"), ("d24_domain_profile", "url", "html"), ("d18_correlation", "embedding", "props"),
    ("i12_large_scale_scoring", "embedding", "label"), ("a01_projected_scan", "event_type", "props")])
def test_only_needed_columns_are_read(spark, name, wanted, unwanted):
    import re

    schema = " ".join(re.findall(r"ReadSchema: (\S+)", plan(QUERIES[name](spark, SF))))
    assert wanted in schema and unwanted not in schema


@pytest.mark.parametrize("name", ["h01_phrase_score", "i12_large_scale_scoring", "h06_score_bin", "h22_formal_criteria", "h25_quality_score"])
def test_row_rules_do_not_shuffle_or_leave_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text


SLOW = {n for n in QUERIES if n[:3] in {"i05", "i06", "i07", "i08", "i09", "i13"}}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_on_score_does_not_repeat_the_matching(spark):
    assert plan(QUERIES["b22_working_corpus"](spark, SF)).count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["e05_stratified_sample", "i01_stratified_split", "c14_phrase_join", "l04_language_identification"])
def test_small_sides_are_broadcast(spark, name):
    assert "BroadcastHashJoin" in plan(QUERIES[name](spark, SF))


def test_pushed_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(label), LessThan(label,5)" in plan(QUERIES["a03_pushed_scan"](spark, SF))
