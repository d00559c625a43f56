"""Runs that write, resume or resample: the annotation log, compaction, observed numbers, block draws, pruned neighbours, one-pass samples."""

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import learning, profiles, sampling, survey
from siftwell.session import fits, row_bytes, scratch_dir
from siftwell.sources import readers, writers
from siftwell.streaming import annotations, incremental

LOG = "uid string, label string, ts timestamp, event_id long"


def test_annotation_log_survives_restarts_and_folding(spark):
    """Late, repeated and null-timed records; a run without new files; a snapshot in the middle; one key that changes class thrice."""
    random.seed(4)
    root, day = scratch_dir(spark, "log"), dt.datetime(2024, 1, 1)
    rows = [(f"u{random.randrange(40)}", random.choice(["YES", "NO", "INVALID", None]), None if random.random() < 0.1 else day + dt.timedelta(hours=random.randrange(200)), i) for i in range(400)]
    rows += [("moves", label, day + dt.timedelta(days=i), 1000 + i) for i, label in enumerate(["YES", "NO", "INVALID"])]
    random.shuffle(rows)
    rows += rows[:30]
    schema = spark.createDataFrame([], LOG).schema
    for part in range(4):
        if part != 2:  # a run that finds nothing
            spark.createDataFrame(rows[part::4] + (rows[2::4] if part == 3 else []), schema).repartition(3).write.mode("append").parquet(f"{root}/log")
        annotations.follow(incremental.new_files(spark, f"{root}/log", schema), f"{root}/out", f"{root}/checkpoint")
        if part == 1:
            last = annotations.fold(spark, f"{root}/out", schema)
            assert annotations.fold(spark, f"{root}/out", schema) == last
    want = {}
    for r in rows:
        at = (r[2] is not None, r[2] or day, r[3])
        if r[0] not in want or at > want[r[0]][0]:
            want[r[0]] = (at, r)
    got = annotations.current(spark, f"{root}/out", schema).collect()
    assert sorted(map(tuple, got), key=str) == sorted((w[1] for w in want.values()), key=str)
    counts = annotations.class_counts(spark, f"{root}/out", schema)
    assert {r.label: r.n for r in counts.collect()} == collections.Counter(w[1][1] for w in want.values())
    n = collections.Counter(w[1][1] for w in want.values())
    progress = {r.label: (r.n, r.remaining) for r in annotations.progress(counts, {"YES": 1000, "NO": 1, "valid": 30, "MAYBE": 2}).collect()}
    assert progress == {"YES": (n["YES"], 1000 - n["YES"]), "NO": (n["NO"], max(0, 1 - n["NO"])), "valid": (n["YES"] + n["NO"], max(0, 30 - n["YES"] - n["NO"])), "MAYBE": (0, 2)}


def test_empty_annotation_log(spark):
    root = scratch_dir(spark, "log")
    schema = spark.createDataFrame([], LOG).schema
    spark.createDataFrame([], schema).write.parquet(f"{root}/log")
    annotations.follow(incremental.new_files(spark, f"{root}/log", schema), f"{root}/out", f"{root}/checkpoint")
    assert annotations.current(spark, f"{root}/out", schema).count() == 0 and annotations.class_counts(spark, f"{root}/out", schema).count() == 0
    assert annotations.fold(spark, f"{root}/out", schema) in (-1, 0)


def test_packing_fills_bins_in_order(spark):
    sizes = {"a": [4, 4, 4, 30, 1, 1], "b": [10], "c": [0, 0, 9, 2]}
    files = spark.createDataFrame([(f"file:/x/{n}_parts/part_{i:03d}.parquet", s) for n, of in sizes.items() for i, s in enumerate(of)], "path string, length long")
    got = collections.defaultdict(list)
    for r in writers.packed_parts(files, 10).orderBy("path").collect():
        got[r.input].append(r.bin)
    assert got == {"a": [0, 0, 1, 2, 3, 3], "b": [0], "c": [0, 0, 0, 1]}


def test_compaction_keeps_rows_order_and_bound(spark):
    root = scratch_dir(spark, "inputs")
    for name in ("one", "two"):
        for i in range(4):
            spark.range(i * 100, i * 100 + 100).coalesce(1).select("id", F.lit(name).alias("of")).write.parquet(f"{root}/in/{name}_parts/p{i}")
    plan = writers.compact_inputs(spark, f"{root}/in", f"{root}/out", 1, r"([^/]*)_parts/")
    assert plan.groupBy("input").agg(F.count_distinct("bin").alias("n")).select("n").distinct().collect()[0].n == 4
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 800 and out.filter("input <> of").count() == 0
    files = out.select("input", "bin", "id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("at"))
    assert files.select("input", "bin", "f").distinct().count() == 8
    assert all(r.id == r.bin * 100 + r["at"] for r in files.collect())


def test_numbers_of_a_run_come_from_its_own_pass(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 / 10).alias("pred_proba"))
    run = profiles.scored_run(df, scratch_dir(spark, "run"), 0.5, F.col("id") % 6).first()
    assert (run.n_files, run.n_total, run.n_positive, run.positive_rate) == (6, 1000, 500, 0.5) and run.seconds > 0
    assert run.rows_per_second == pytest.approx(1000 / run.seconds) and run.files_per_minute == pytest.approx(360 / run.seconds)
    none = profiles.scored_run(df.limit(0), scratch_dir(spark, "run"), 0.5, F.col("id")).first()
    assert (none.n_files, none.n_total, none.positive_rate, none.rows_per_second) == (0, 0, 0.0, 0.0)


def test_an_empty_confident_subset_leaves_no_folder(spark):
    from siftwell.sources.readers import path_exists

    df = spark.range(10).select((F.col("id") / 20).alias("pred_proba"))
    path = scratch_dir(spark, "high")
    assert tuple(writers.write_high_confidence(df, path).first()) == (10, 0, 0.0, None) and not path_exists(spark, path)
    row = writers.write_high_confidence(df, path, 0.4).first()
    assert (row.n_all, row.n_high, row.share, row.mean_high) == (10, 2, 0.2, pytest.approx(0.425)) and spark.read.parquet(path).count() == 2


def test_alpha_draws_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", f"c{j}", int(np.clip(round(3 + (i % 3 - 1) + rng.normal()), 1, 5))) for i in range(90) for j in range(6)]
    ratings = spark.createDataFrame(rows, "respondent string, criterion string, rating int")
    one = survey.bootstrap_alpha(ratings, 600, block_patterns=10**6).first()
    many = survey.bootstrap_alpha(ratings, 600, block_patterns=4).first()
    assert one.alpha == many.alpha and abs(one.boot_mean - many.boot_mean) < 4 * one.se / 600**0.5 * 1.5 and abs(one.se / many.se - 1) < 0.2


@pytest.mark.parametrize("pivots, block", [(12, 10_000), (5, 9), (1, 7)])
def test_neighbours_equal_brute_force(spark, pivots, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 30
    x = np.concatenate([centres[i % 6] + rng.normal(size=8) for i in range(120)]).reshape(120, 8)
    x[100:] = x[3]  # many at one place
    rows = [(f"u{i:03d}", [float(v) for v in e]) for i, e in enumerate(x)] + [("null", None)]
    df = spark.createDataFrame(rows, "uid string, embedding array<double>")
    got = collections.defaultdict(list)
    for r in learning.nearest_in_class(df, 3, pivots=pivots, block_rows=block).collect():
        got[r.uid].append((r["rank"], r.neighbour))
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0).round(9)
    for i in range(120):
        want = sorted((d[i, j], f"u{j:03d}") for j in range(120) if j != i)[:3]
        found = [name for _, name in sorted(got[f"u{i:03d}"])]
        assert found == [name for _, name in want] or [round(d[i, int(n[1:])], 6) for n in found] == [round(v, 6) for v, _ in want]


def test_few_rows_are_sent_to_other_cells(spark, monkeypatch):
    """Clustered vectors: nearly all rows are answered in their own cell."""
    rng = np.random.default_rng(5)
    rows = [(f"u{i}", [float(100 * (i % 8) + v) for v in rng.normal(size=4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "uid string, embedding array<double>")
    sent = []
    real = learning.materialise
    monkeypatch.setattr(learning, "materialise", lambda frame, name: (sent.append(name), real(frame, name))[1])
    out = learning.nearest_in_class(df, 3, pivots=24)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sent == ["class", "cells", "own"] and "others" in plan
    assert out.filter(F.substring("uid", 2, 9).cast("int") % 8 != F.substring("neighbour", 2, 9).cast("int") % 8).count() == 0


def test_top_up_from_one_histogram(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") < 4, F.lit("tiny")).when(F.col("id") < 60, F.lit("small")).when(F.col("id") < 90, F.lit(None)).otherwise("large").alias("score_bin"))
    for target, least in ((100, 20), (10, 20), (500, 3), (900, 30), (64, 20), (0, 1)):
        got = sampling.minimum_per_bin_sample(df, target, least).collect()
        counts = collections.Counter(r.score_bin for r in got)
        firsts = {b: min(least, n) for b, n in {"tiny": 4, "small": 56, None: 30, "large": 410}.items()}
        assert len(got) == len({r.uid for r in got}) == min(500, max(target, sum(firsts.values())))
        assert all(counts[b] >= n for b, n in firsts.items())


def test_stated_few_groups_need_no_job(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 2).alias("label"), (F.col("id") / 50).alias("pred_proba"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    split, strata, bins = sampling.stratified_split(df), sampling.stratified_sample(df, 10), sampling.minimum_per_bin_sample(df, 10, 2, "label")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert split.filter("split = 'test'").count() == 10 and strata.count() <= 10 and bins.count() == 10


def test_measured_sizes(spark):
    df = spark.createDataFrame([(1, "ab", [1.0, 2.0], [("x", 1)])], "a long, b string, c array<double>, d array<struct<e:string,f:long>>")
    assert df.select(row_bytes(df)).first()[0] == 16 + 8 + 18 + 32 + (16 + 16 + 17 + 8)
    wide = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits(wide, 110_000) and not fits(wide, 100_000) and fits(wide.limit(0), 0)


@pytest.mark.parametrize("shape", ["file", "folder", "both"])
def test_a_table_may_be_a_file_or_a_folder_of_parts(spark, tmp_path, shape):
    """The pattern fits a file, a folder whose parts have other names, or one of each; a later part is new to a second run."""
    src, more = tmp_path / "in", spark.range(100, 110)
    if shape != "folder":
        spark.range(40).coalesce(1).write.parquet(str(tmp_path / "one"))
        src.mkdir()
        next((tmp_path / "one").glob("part-*.parquet")).rename(src / "t.parquet")
    if shape != "file":
        spark.range(40, 60).repartition(3).write.parquet(str(src / ("t.parquet" if shape == "folder" else "u.parquet")))
    spark.range(500, 510).write.parquet(str(src / "other.parq"))
    pattern = {"file": "t.parquet", "folder": "t.parquet", "both": "[tu].parquet"}[shape]
    want = {"file": set(range(40)), "folder": set(range(40, 60)), "both": set(range(60))}[shape]
    assert {r.id for r in readers.read_parts(spark, str(src), pattern=pattern).collect()} == want
    schema, seen = more.schema, []
    for _ in range(2):
        stream = incremental.new_files(spark, str(src), schema, pattern)
        incremental.process_new_files(stream, lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        seen.append(sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()))
    assert seen == [sorted(want)] * 2
    if shape == "folder":
        more.write.mode("append").parquet(str(src / "t.parquet"))
        stream = incremental.new_files(spark, str(src), schema, pattern)
        incremental.process_new_files(stream, lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert {r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()} == want | set(range(100, 110))


def test_dictionary_file_reads_its_texts_once(spark, tmp_path, monkeypatch):
    """Words in repeated documents and repeated in one document; every text is cut into words once."""
    from siftwell.plans import q_sources

    docs = [(1, "one two two Three"), (2, "two"), (2, "two three"), (None, "two four"), (3, None), (4, "")]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", counted("text").alias("text"))
    monkeypatch.setattr(q_sources.t, "table", lambda *_: rows)
    got = {(r.phrase, r.score, r.polarity) for r in q_sources.a09(spark, "").collect()}
    assert got == {("one", -0.5, "neg"), ("two", 1.0, "pos"), ("three", 1.0, "pos"), ("four", 0.0, "pos")}
    assert seen.value == len(docs)
