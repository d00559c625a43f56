"""State tables, status steps and incremental runs."""

from pyspark.sql import functions as F, types as T

from siftwell.operators import quality, state
from siftwell.plans import tables as t
from siftwell.plans.registry import query, view
from siftwell.schemas import CRITERIA_IDS
from siftwell.session import scratch_dir
from siftwell.streaming import annotations, incremental


@query("k01_resumed_run", "SELECT uid, url_norm, domain FROM pool_norm")
def k01(spark, sf):
    from siftwell.functions.urls import with_domain

    schema = t.table(spark, sf, "pages").select("page_id", "url").schema
    root = scratch_dir(spark, "resume")
    for _ in range(2):  # the second run finds nothing new
        stream = incremental.new_files(spark, sf, schema, "pages.parquet")
        incremental.process_new_files(
            stream, lambda pages: with_domain(t.pool_rows(pages)).select("uid", "url_norm", "domain"),
            f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def _check_url(row: dict) -> dict:
    return {"status": "alive" if int(row["uid"]) % 3 else "dead", "code": 200 if int(row["uid"]) % 3 else 404}


_STATUS = T.StructType([T.StructField("status", T.StringType()), T.StructField("code", T.IntegerType())])


@query("k02_status_step", """
    SELECT uid, CASE WHEN url_status <> 'pending' THEN url_status WHEN k % 3 <> 0 THEN 'alive' ELSE 'dead' END AS url_status FROM cand""")
def k02(spark, sf):
    root, c = scratch_dir(spark, "steps"), t.cand(spark, sf)
    c.write.parquet(f"{root}/state")
    stream = incremental.new_files(spark, f"{root}/state", c.schema)
    incremental.step_results(stream, lambda rows: state.enrich(state.pending(rows, "url_check"), _check_url, _STATUS),
                             f"{root}/results", f"{root}/checkpoint")
    results = spark.read.parquet(f"{root}/results").select("uid", F.col("status").alias("url_status"))
    return state.upsert(spark.read.schema(c.schema).parquet(f"{root}/state"), results).select("uid", "url_status")


@query("k03_latest_annotation_stream", "SELECT uid, label, event_id FROM ann")
def k03(spark, sf):
    root, log = scratch_dir(spark, "latest"), t.annlog(spark, sf)
    for half in (0, 1):
        log.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/log")
        stream = incremental.new_files(spark, f"{root}/log", log.schema)
        incremental.keep_latest(stream, "uid", ["ts", "event_id"], f"{root}/out", f"{root}/checkpoint")
    return incremental.read_latest(spark, f"{root}/out", "uid").select("uid", "label", "event_id")


# Targets of annotated rows per class; "valid" counts YES and NO together.
TARGETS = {"YES": 40, "NO": 400, "INVALID": 5, "valid": 120}


@query("k03_annotation_progress", """
    WITH c AS (SELECT label, count(*) AS n FROM ann GROUP BY 1),
    w(label, target) AS (VALUES """ + ", ".join(f"('{k}', {n}::BIGINT)" for k, n in TARGETS.items()) + """)
    SELECT label, CAST(n AS BIGINT) AS n, target, CAST(greatest(target - n, 0) AS BIGINT) AS remaining FROM (
        SELECT w.label, target, COALESCE(CASE WHEN w.label = 'valid' THEN (SELECT sum(n) FROM c WHERE label IN ('YES', 'NO')) ELSE c.n END, 0) AS n
        FROM w LEFT JOIN c ON c.label = w.label)""")
def k03_progress(spark, sf):
    """The log in three parts: a run, a snapshot, and runs that resume from the checkpoint."""
    root, log = scratch_dir(spark, "annotations"), t.annlog(spark, sf)
    for part in range(3):
        log.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{root}/log")
        stream = incremental.new_files(spark, f"{root}/log", log.schema)
        annotations.follow(stream, f"{root}/out", f"{root}/checkpoint")
        if part == 0:
            annotations.fold(spark, f"{root}/out", log.schema)
    return annotations.progress(annotations.class_counts(spark, f"{root}/out", log.schema), TARGETS)


@query("k03_folded_log", "SELECT uid, label, event_id FROM ann")
def k03_folded(spark, sf):
    root, log = scratch_dir(spark, "annotations"), t.annlog(spark, sf)
    for part in range(2):
        log.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/log")
        annotations.follow(incremental.new_files(spark, f"{root}/log", log.schema), f"{root}/out", f"{root}/checkpoint")
        annotations.fold(spark, f"{root}/out", log.schema)
    return annotations.current(spark, f"{root}/out", log.schema).select("uid", "label", "event_id")


def _flaky(row: dict) -> dict:
    if int(row["uid"]) % 10 == 0:
        raise ValueError("no answer")
    return _check_url(row)


@query("k04_enrichment", """
    SELECT uid, CASE WHEN k % 10 = 0 THEN 'error' WHEN k % 3 <> 0 THEN 'alive' ELSE 'dead' END AS status,
           CASE WHEN k % 10 = 0 THEN 'no answer' END AS error FROM pool""")
def k04(spark, sf):
    rows = t.pool(spark, sf).select("uid", "url")
    return state.enrich(rows, _flaky, _STATUS, partitions=4).select("uid", "status", "error")


@query("k05_reset", """
    SELECT uid, CASE WHEN disq_confidence = 'low' THEN 'pending' ELSE disq_status END AS disq_status, CASE WHEN disq_confidence IS DISTINCT FROM 'low' THEN quality_score END AS quality_score,
           CASE WHEN disq_confidence IS DISTINCT FROM 'low' THEN disq_A1 END AS disq_A1, human_A1 FROM maps""")
def k05(spark, sf):
    m = t.maps(spark, sf)
    out = state.reset_check(m, m.filter("disq_confidence = 'low'"), human=False)
    return out.select("uid", "disq_status", "quality_score", "disq_A1", "human_A1")


@query("k05_full_reset", """
    SELECT uid, CASE WHEN disq_confidence = 'low' THEN 'pending' ELSE disq_status END AS disq_status, CASE WHEN disq_confidence IS DISTINCT FROM 'low' THEN violations_count END AS violations_count,
           CASE WHEN disq_confidence IS DISTINCT FROM 'low' THEN human_A1 END AS human_A1 FROM maps""")
def k05b(spark, sf):
    m = t.maps(spark, sf)
    return state.reset_check(m, m.filter("disq_confidence = 'low'")).select("uid", "disq_status", "violations_count", "human_A1")


view("overrides", f"""
    SELECT CAST(user_id AS VARCHAR) AS uid, {CRITERIA_IDS}[1 + (event_id % 10)] AS criterion, value > 10 AS value, ts AS at, event_id AS seq FROM events""")


def overrides(spark, sf):
    names = F.array(*[F.lit(c) for c in CRITERIA_IDS])
    return t.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("uid"), F.get(names, (F.col("event_id") % 10).cast("int")).alias("criterion"),
        (F.col("value") > 10).alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


view("new_flags", "SELECT uid, " + ", ".join(
    f"arg_max(value, seq) FILTER (WHERE criterion = '{c}') AS new_{c}" for c in CRITERIA_IDS) + " FROM overrides GROUP BY 1")


@query("k06_human_overrides", "SELECT uid, " + ", ".join(f"COALESCE(new_{c}, human_{c}) AS human_{c}" for c in CRITERIA_IDS)
       + ", CASE WHEN disq_status = 'checked' THEN " + t._q_sql(lambda c: f"COALESCE(new_{c}, human_{c}, disq_{c})")
       + " END AS quality_score FROM map_flags LEFT JOIN new_flags USING (uid)")
def k06(spark, sf):
    out = quality.apply_overrides(t.map_flags(spark, sf), overrides(spark, sf))
    return out.select("uid", *[f"human_{c}" for c in CRITERIA_IDS], "quality_score")


@query("k07_recomputed_scores", "SELECT uid, quality_score, violations_count FROM maps")
def k07(spark, sf):
    stale = t.map_flags(spark, sf).withColumns({
        "quality_score": F.when(F.col("disq_status") == "checked", 1.0), "violations_count": F.lit(None).cast("int")})
    return quality.score_maps(stale).select("uid", "quality_score", "violations_count")


view("batch_eligible", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE ai_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
        pred_proba DESC, uid) AS rn FROM cand WHERE ai_status = 'pass' AND uid NOT IN (SELECT uid FROM selected)) WHERE rn <= 3""")


@query("k08_batch_add", """
    SELECT uid, domain, 9 AS batch_id, (SELECT count(*) FROM (SELECT * FROM batch_eligible LIMIT 20)) AS count_added
    FROM batch_eligible ORDER BY md5('42:' || uid) LIMIT 20""")
def k08(spark, sf):
    members = state.batch_members(t.cand(spark, sf), t.selected(spark, sf), {}, 20, 9, cap=3)
    record = state.batch_record(members, 9, "batch 9", "{}", 20)
    return members.select("uid", "domain", F.col("batch_id").cast("int").alias("batch_id")).withColumn(
        "count_added", record.select("count_added").scalar())


@query("k08_batch_undo", """
    SELECT 'member' AS kind, uid AS id, CAST(batch_id AS VARCHAR) AS state FROM selected WHERE batch_id <> 2
    UNION ALL SELECT 'batch', CAST(id AS VARCHAR), CASE WHEN id = 2 THEN 'undone' ELSE status END FROM batches""")
def k08b(spark, sf):
    kept, marked = state.undo_batch(t.selected(spark, sf), t.batches(spark, sf), 2)
    left = kept.select(F.lit("member").alias("kind"), F.col("uid").alias("id"), F.col("batch_id").cast("string").alias("state"))
    return left.union(marked.select(F.lit("batch"), F.col("id").cast("string"), "status"))


@query("k09_member_changes", """
    SELECT uid FROM cand WHERE (uid IN (SELECT uid FROM selected) OR (ai_status = 'pass' AND ai_has_graduated_circles)) AND ai_map_language <> 'fr' """)
def k09(spark, sf):
    c, s = t.cand(spark, sf), t.selected(spark, sf)
    added = state.add_member(s, c, c.filter("ai_status = 'pass' AND ai_has_graduated_circles"))
    return state.remove_member(added, c.filter("ai_map_language = 'fr'")).select("uid")


@query("k10_run_record", """
    SELECT 7 AS id, 'url_check' AS step, count(*) AS items_processed, count(*) FILTER (WHERE k % 10 <> 0 AND k % 3 <> 0) AS items_success,
           count(*) FILTER (WHERE k % 10 = 0 OR k % 3 = 0) AS items_failed FROM pool""")
def k10(spark, sf):
    results = state.enrich(t.pool(spark, sf).select("uid", "url"), _flaky, _STATUS)
    return state.run_record(results, 7, "url_check", "alive").drop("params").withColumn("id", F.col("id").cast("int"))


@query("k11_add_from_domain", """
    SELECT uid, domain, 'domain_add' AS stratum, 'domain_add' AS source
    FROM (SELECT * FROM pool_norm WHERE domain = 'blog.tionsh.example.net' AND pred_proba >= 0.3 ORDER BY md5('42:' || uid) LIMIT 10)
    WHERE uid NOT IN (SELECT uid FROM selected)""")
def k11(spark, sf):
    rows = state.add_from_domain(t.pool_norm(spark, sf), "blog.tionsh.example.net", 10, 0.3)
    return state.new_rows(t.selected(spark, sf), rows).select("uid", "domain", "stratum", "source")


@query("k12_load_all", "SELECT uid, 'load_all' AS source FROM clean WHERE pred_proba >= 0.4 AND domain <> 'spam-farm.example.org'")
def k12(spark, sf):
    return state.load_all(t.clean(spark, sf), 0.4, ["spam-farm.example.org"]).select("uid", "source")


@query("k12_smart_sample", """
    WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || uid), uid) AS rn FROM clean
               WHERE pred_proba >= 0.7 AND domain <> 'spam-farm.example.org') WHERE rn <= 2),
    s AS (SELECT *, CASE WHEN pred_proba < 0.8 THEN '0.70-0.80' WHEN pred_proba < 0.9 THEN '0.80-0.90' ELSE '0.90-1.01' END AS stratum FROM c)
    SELECT uid, stratum FROM (SELECT uid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || uid), uid) AS r2 FROM s)
    WHERE r2 <= CASE stratum WHEN '0.70-0.80' THEN 4 WHEN '0.80-0.90' THEN 7 ELSE 9 END""")
def k12b(spark, sf):
    return state.smart_sample(t.clean(spark, sf), 0.7, 2, 20, ["spam-farm.example.org"]).select("uid", "stratum")


@query("k13_wrongly_invalid", "SELECT uid FROM annlog JOIN pool USING (uid) WHERE label = 'INVALID' AND pool.k % 3 <> 0")
def k13(spark, sf):
    labelled = t.annlog(spark, sf).join(t.pool(spark, sf).select("uid", "url"), "uid")
    return state.wrongly_invalid(labelled, _check_url)
