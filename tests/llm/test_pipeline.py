"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
import duckdb
import pytest
from check_oracles import compare, connect
from pyspark.sql import functions as F

from siftwell.llm import catalog
from siftwell.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(catalog.queries()[name](spark, SF), connect(SF), catalog.oracle_sql()[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))
    assert duckdb.__version__


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(900).cast("long")).union(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(1).withColumn("text", F.lit("12 !")))
    now, seen = materialise(docs.union(extra), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, materialise(stage(spark, now, SF), name)
        seen.append(now.count())
        assert set(before.columns) <= set(now.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
            assert now.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        else:
            assert now.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100
    assert seen[0] == docs.count() + 3  # neither the null text nor the one without a letter


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
