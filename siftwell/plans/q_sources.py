"""Scans, sources and sinks."""

import numpy as np
from pyspark.sql import Window, functions as F

from siftwell.functions.text import WORD
from siftwell.operators import joins, profiles, state
from siftwell.operators.sampling import stratified_uncertain
from siftwell.plans import tables as t
from siftwell.plans.registry import query, view
from siftwell.schemas import ANNOTATIONS
from siftwell.session import materialise, scratch_dir
from siftwell.sources import readers, writers


@query("a01_projected_scan", "SELECT event_id, event_type, value FROM events")
def a01(spark, sf):
    return readers.read_table(spark, f"{sf}/events.parquet", ["event_id", "event_type", "value"])


@query("a02_folder_scan", "SELECT page_id, url, length(html) AS html_length FROM pages")
def a02(spark, sf):
    return readers.read_parts(spark, sf, pattern="pages.parquet").select(
        "page_id", "url", F.length("html").alias("html_length"))


@query("a03_pushed_scan", """
    SELECT vec_id, embedding[1] AS first_value FROM embeddings
    WHERE label < 5 AND vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def a03(spark, sf):
    keys = t.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    wide = t.table(spark, sf, "embeddings").filter("label < 5").select("vec_id", F.get("embedding", F.lit(0)).alias("first_value"))
    return joins.rows_of_keys(wide, keys, "vec_id")


@query("a04_batched_scan", """
    SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
    FROM embeddings""")
def a04(spark, sf):
    def norms(pdf):
        e = np.stack(pdf["embedding"].to_numpy()).astype("float64")
        return pdf[["vec_id"]].assign(norm=np.sqrt((e * e).sum(1)).round(6))

    return readers.scan_batches(t.table(spark, sf, "embeddings").select("vec_id", "embedding"), norms,
                                "vec_id long, norm double")


@query("a05_csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def a05(spark, sf):
    df = t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_dir(spark, "csv")
    writers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


def _log_lines(spark, sf):
    return t.annlog(spark, sf).select("uid", "label", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                                      "event_id")


@query("a06_jsonl_scan", """
    SELECT uid, CAST(NULL AS VARCHAR) AS url, label, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM annlog""")
def a06(spark, sf):
    path = scratch_dir(spark, "jsonl")
    _log_lines(spark, sf).drop("event_id").write.json(path)
    return readers.read_jsonl(spark, path, ANNOTATIONS)


@query("a07_tolerant_jsonl_scan", """
    SELECT uid, CAST(NULL AS VARCHAR) AS url, label, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp
    FROM annlog WHERE event_id % 7 <> 0""")
def a07(spark, sf):
    path = scratch_dir(spark, "broken")
    line = F.to_json(F.struct("uid", "label", "timestamp"))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line)
    _log_lines(spark, sf).select(broken).write.text(path)
    return readers.read_jsonl_tolerant(spark, path, ANNOTATIONS)


@query("a08_first_existing", "SELECT uid, CAST(NULL AS VARCHAR) AS url, label, CAST(NULL AS VARCHAR) AS timestamp FROM ann")
def a08(spark, sf):
    root = scratch_dir(spark, "candidates")
    t.ann(spark, sf).select("uid", "label").write.parquet(f"{root}/annotated_partial.parquet")
    paths = [f"{root}/annotated.parquet", f"{root}/annotated_partial.parquet", f"{root}/progress.jsonl"]
    return readers.read_first_existing(spark, paths, ANNOTATIONS)


_WORDS = r"""
    SELECT lower(w) AS phrase, count(DISTINCT doc_id) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY 1"""


@query("a09_dictionary_file", f"""
    SELECT phrase, CASE WHEN n % 2 = 0 THEN (n % 10) / 2.0 ELSE -(n % 10) / 2.0 END AS score,
           CASE WHEN n % 2 = 0 THEN 'pos' ELSE 'neg' END AS polarity
    FROM ({_WORDS})""")
def a09(spark, sf):
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    words = (t.table(spark, sf, "documents").select("doc_id", F.explode(found).alias("phrase"))
             .groupBy("phrase").agg(F.count_distinct("doc_id").alias("n")))
    words = materialise(words, "words")  # read for the size and for both files
    root, size = scratch_dir(spark, "dictionary"), words.agg(F.count("*").alias("n")).scalar()
    for name, parity, sign in (("positive", 0, 1), ("negative", 1, -1)):
        part = words.filter(F.col("n") % 2 == parity).select("phrase", (F.col("n") % 10 / 2 * sign).alias("score"))
        # one JSON object of a few hundred phrases per line, so no row holds the whole dictionary
        lines = part.groupBy(F.pmod(F.xxhash64("phrase"), F.greatest(F.lit(1), F.ceil(size / 500))).alias("line")).agg(
            F.to_json(F.map_from_entries(F.collect_list(F.struct("phrase", "score")))).alias("value"))
        lines.select("value").write.text(f"{root}/{name}")
    return readers.read_dictionary(spark, f"{root}/positive", f"{root}/negative")


@query("a10_wide_survey", "SELECT respondent, criterion, rating FROM ratings")
def a10(spark, sf):
    wide = t.ratings(spark, sf).groupBy("respondent").pivot("criterion", t.EVENT_CRITERIA).agg(F.first("rating"))
    path = scratch_dir(spark, "sheet")
    writers.write_csv(wide, path)
    sheet = readers.read_csv(spark, path, wide.schema)
    return readers.ratings_from_wide(sheet, t.EVENT_CRITERIA).filter("rating IS NOT NULL")


@query("a11_url_list", r"""
    SELECT md5(url) AS uid, url, 0.0::DOUBLE AS pred_proba, 0.0::DOUBLE AS score, 'manual' AS stratum,
           regexp_extract(trim(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/'), '^([^/]+)', 1) AS domain
    FROM pages WHERE page_id % 5 > 1""")
def a11(spark, sf):
    k = F.col("page_id") % 5
    line = F.when(k == 0, F.concat(F.lit("# "), "url")).when(k == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "url", F.lit("  ")))
    path = scratch_dir(spark, "urls")
    t.table(spark, sf, "pages").select(line.alias("value")).write.text(path)
    return readers.read_url_list(spark, path)


@query("a12_head_sample", """
    SELECT uid, lang FROM (SELECT uid, lang FROM docs ORDER BY k LIMIT 400) ORDER BY md5('42:' || uid) LIMIT 50""")
def a12(spark, sf):
    return readers.head_sample(t.docs(spark, sf).select("uid", "lang", "k"), 400, 50, ["k"]).select("uid", "lang")


@query("a13_pending", """
    SELECT 'url_check' AS step, uid FROM cand WHERE url_status = 'pending'
    UNION ALL SELECT 'download', uid FROM cand WHERE url_status = 'alive' AND download_status = 'pending'
    UNION ALL SELECT 'ai_check', uid FROM cand WHERE download_status = 'success' AND ai_status = 'pending'""")
def a13(spark, sf):
    c = t.cand(spark, sf)
    parts = [state.pending(c, s).select(F.lit(s).alias("step"), "uid") for s in ("url_check", "download", "ai_check")]
    return parts[0].union(parts[1]).union(parts[2])


@query("a14_insert_ignore", """
    SELECT count(DISTINCT uid) FILTER (WHERE pred_proba < 0.6) AS n_inserted,
           count(*) - count(DISTINCT uid) FILTER (WHERE pred_proba < 0.6) AS n_skipped
    FROM (SELECT uid, pred_proba FROM pool UNION ALL SELECT uid, pred_proba FROM pool WHERE score > 3)""")
def a14(spark, sf):
    rows = t.pool(spark, sf)
    return state.insert_counts(rows.filter("pred_proba >= 0.6"), rows.unionByName(rows.filter("score > 3")))


@query("a15_import_selected", """
    SELECT uid, domain, pred_proba, disq_status FROM maps WHERE ai_map_language = 'en'
    UNION ALL SELECT uid, domain, pred_proba, 'pending' FROM selected WHERE uid NOT IN (SELECT uid FROM maps WHERE ai_map_language = 'en')""")
def a15(spark, sf):
    existing = t.map_flags(spark, sf).filter("ai_map_language = 'en'")
    return state.import_selected(existing, t.selected(spark, sf)).select("uid", "domain", "pred_proba", "disq_status")


@query("a16_gzip_sink", "SELECT uid, score, pos_keys, neg_keys FROM scored")
def a16(spark, sf):
    path = scratch_dir(spark, "scored")
    writers.write_scored(t.scored(spark, sf).select("uid", "score", "pos_keys", "neg_keys"), path)
    return readers.read_table(spark, path)


@query("a17_compaction", "SELECT event_type, count(*) AS n, 1 AS n_files FROM events GROUP BY 1")
def a17(spark, sf):
    many, one = scratch_dir(spark, "many"), scratch_dir(spark, "one")
    t.table(spark, sf, "events").repartition(6).write.parquet(many)
    writers.compact(spark, many, one, 1)
    files = F.count_distinct(readers.part_name())
    return readers.read_table(spark, one).groupBy("event_type").agg(
        F.count("*").alias("n"), files.cast("int").alias("n_files"))


@query("a17_compacted_inputs", """
    SELECT 'domain_' || CAST(k % 3 AS VARCHAR) AS input, count(*) AS n, 1 AS n_files, 1 AS n_bounded, TRUE AS in_order FROM pool GROUP BY 1""")
def a17_inputs(spark, sf):
    """Three inputs of five parts each: one file per input with a large bound, and at most two parts in a file with a small one."""
    root, rows = scratch_dir(spark, "inputs"), t.pool(spark, sf).select("uid", "k", "url")
    for i in range(3):
        for j in range(5):
            part = rows.filter((F.col("k") % 3 == i) & (F.col("k") % 5 == j)).withColumn("part", F.lit(j))
            part.coalesce(1).write.parquet(f"{root}/in/domain_{i}_parts/part_{j:05d}.parquet")
    plan = writers.compact_inputs(spark, f"{root}/in", f"{root}/out", input_of=r"([^/]*)_parts/")
    longest = plan.agg(F.max("length")).first()[0]
    small = writers.compact_inputs(spark, f"{root}/in", f"{root}/small", 2 * longest, r"([^/]*)_parts/")
    bounded = small.groupBy("input", "bin").agg(F.sum("length").alias("bytes"), F.count("*").alias("parts")).groupBy("input").agg(
        ((F.max("bytes") <= 2 * longest) & (F.max("parts") > 1)).cast("int").alias("n_bounded"))
    out = spark.read.parquet(f"{root}/out").withColumn("at", F.col("_metadata.row_index"))
    ordered = out.groupBy("input", "part").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    before = F.lag("high").over(Window.partitionBy("input").orderBy("part"))
    in_order = ordered.withColumn("ok", F.coalesce(F.col("low") > before, F.lit(True))).groupBy("input").agg(F.bool_and("ok").alias("in_order"))
    counts = out.groupBy("input").agg(F.count("*").alias("n"), F.count_distinct(readers.part_name()).cast("int").alias("n_files"))
    return counts.join(bounded, "input").join(in_order, "input").select("input", "n", "n_files", "n_bounded", "in_order")


@query("a18_merge_folders", "SELECT uid, domain, pred_proba FROM pool_norm")
def a18(spark, sf):
    root, df = scratch_dir(spark, "small"), t.pool_norm(spark, sf).select("uid", "domain", "pred_proba", "k")
    parts = [f"{root}/part_{i}" for i in range(3)]
    for i, path in enumerate(parts):
        df.filter(F.col("k") % 3 == i).drop("k").write.parquet(path)
    writers.merge_folders(spark, parts, f"{root}/merged", df.drop("k").schema)
    return readers.read_table(spark, f"{root}/merged")


@query("a19_drop_wide_column", "SELECT vec_id, label FROM embeddings")
def a19(spark, sf):
    path = scratch_dir(spark, "slim")
    writers.write_without(t.table(spark, sf, "embeddings"), "embedding", path)
    return readers.read_table(spark, path)


@query("a20_tiered_sinks", """
    SELECT CASE WHEN pred_proba >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence_tier, uid, pred_proba
    FROM pool WHERE pred_proba >= 0.6""")
def a20(spark, sf):
    path = scratch_dir(spark, "tiers")
    writers.write_tiers(t.pool(spark, sf).select("uid", "pred_proba"), path)
    return writers.read_tiers(spark, path, "HIGH", "MEDIUM")


@query("a21_csv_sink", "SELECT uid, domain, ai_confidence, ai_has_choropleth, batch_id FROM selected")
def a21(spark, sf):
    df = t.selected(spark, sf).select("uid", "domain", "ai_confidence", "ai_has_choropleth", "batch_id")
    path = scratch_dir(spark, "dataset")
    writers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


@query("a22_verified_export", """
    SELECT uid, url, domain, pred_proba, score, source, image_width, image_height, local_path, ai_has_choropleth,
           ai_has_proportional_circles, ai_has_graduated_circles, ai_has_structural_circles, ai_confidence, ai_description
    FROM cand WHERE passes_all""")
def a22(spark, sf):
    path = scratch_dir(spark, "verified")
    writers.write_table(writers.verified_rows(t.cand(spark, sf)), path)
    return readers.read_table(spark, path)


@query("a23_statistics_sink", """
    SELECT count(*) AS n_total, count(*) FILTER (WHERE pred_proba >= 0.5) AS n_positive,
           round(avg(pred_proba), 6) AS mean_proba FROM pool""")
def a23(spark, sf):
    stats = profiles.prediction_summary(t.pool(spark, sf)).select(
        F.struct(F.col("n").alias("total"), F.col("n_yes").alias("positive"), t.r("mean_proba").alias("mean")).alias("samples"))
    path = scratch_dir(spark, "stats")
    writers.write_statistics(stats, path)
    back = readers.read_jsonl(spark, path, stats.schema)
    return back.select(F.col("samples.total").alias("n_total"), F.col("samples.positive").alias("n_positive"),
                       F.col("samples.mean").alias("mean_proba"))


@query("a24_append_events", "SELECT uid, label, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM annlog")
def a24(spark, sf):
    path, log = scratch_dir(spark, "log"), _log_lines(spark, sf)
    for half in (0, 1):
        writers.append_events(log.filter(F.col("event_id") % 2 == half).drop("event_id"), path)
    return readers.read_jsonl(spark, path, ANNOTATIONS).select("uid", "label", "timestamp")


@query("a25_frozen_keys", "SELECT uid FROM vec WHERE label = 1")
def a25(spark, sf):
    path = scratch_dir(spark, "keys")
    writers.write_keys(t.vectors(spark, sf).filter("label = 1"), path)
    return spark.read.text(path).withColumnRenamed("value", "uid")


@query("a26_valid_label_copy", "SELECT uid, label FROM annlog WHERE label IN ('YES', 'NO')")
def a26(spark, sf):
    root = scratch_dir(spark, "copy")
    writers.append_events(t.annlog(spark, sf).select("uid", "label"), f"{root}/all")
    writers.copy_valid_labels(spark, f"{root}/all", f"{root}/valid", ANNOTATIONS)
    return readers.read_jsonl(spark, f"{root}/valid", ANNOTATIONS).select("uid", "label")


view("strat_sel", """
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY uncertainty DESC, uid) AS rn FROM uncertain WHERE pred_proba > 0.5)
    WHERE rn <= 96
    UNION ALL
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY uncertainty DESC, uid) AS rn FROM uncertain WHERE pred_proba <= 0.5)
    WHERE rn <= 241 - least(96, (SELECT count(*) FROM uncertain WHERE pred_proba > 0.5))""")


@query("a27_iteration_package", "SELECT uid, url, pred_proba, 241 AS n_samples FROM strat_sel")
def a27(spark, sf):
    chosen = stratified_uncertain(t.vec(spark, sf), 150)
    root = scratch_dir(spark, "iterations")
    writers.write_iteration(chosen, chosen.agg(F.count("*").cast("int").alias("n_samples")), root, 1)
    meta = spark.read.schema("n_samples int").json(f"{root}/iteration=1/metadata")
    slim = readers.read_table(spark, f"{root}/iteration=1/to_annotate")
    return slim.withColumn("n_samples", meta.scalar())


@query("a28_high_confidence_sink", """
    SELECT uid, pred_proba, round((SELECT avg(CASE WHEN pred_proba >= 0.8 THEN 1.0 ELSE 0.0 END) FROM pool), 6) AS share,
           round((SELECT avg(pred_proba) FROM pool WHERE pred_proba >= 0.8), 6) AS mean_high
    FROM pool WHERE pred_proba >= 0.8""")
def a28(spark, sf):
    path = scratch_dir(spark, "high")
    stats = writers.write_high_confidence(t.pool(spark, sf).select("uid", "pred_proba"), path)
    from siftwell.operators.ordering import attach_row

    return t.rounded(attach_row(readers.read_table(spark, path), stats.select("share", "mean_high")), "share", "mean_high")
