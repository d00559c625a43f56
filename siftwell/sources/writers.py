"""Table writers.  All write through Spark's committer, so a lost executor leaves no partial output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from siftwell.functions.scores import confidence_tier
from siftwell.functions.text import joined_keys
from siftwell.session import fits, materialise


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Gzip-compressed Parquet."""
    df.write.mode(mode).option("compression", "gzip").parquet(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Scored corpus with keyword lists as pipe-joined text."""
    flat = df.withColumns({k: joined_keys(F.col(k)) for k in ("pos_keys", "neg_keys")})
    write_table(flat, path)


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Many part files into ``files`` files; narrow, so rows are not shuffled."""
    write_table(spark.read.parquet(source).coalesce(files), target)


PART_OF = r"([^/]*)_parts/[^/]*$"


def part_files(spark: SparkSession, source: str, pattern: str = "*.parquet") -> DataFrame:
    """``path, length`` of the part files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))


def packed_parts(files: DataFrame, max_bytes: int, input_of: str = PART_OF) -> DataFrame:
    """Part files with the output they go to: ``path, length, input, bin``.

    The input is named by the folder ``<input>_parts`` (or what the pattern's first group finds).  In the order of
    their names an input's files fill one bin after the other, so every bin but one of a single larger file holds at
    most ``max_bytes`` and outputs keep the order of the parts.  A task sees the names and sizes of an input's files only.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path", ignore_index=True)
        bins, used, at = [], 0, 0
        for size in rows["length"]:
            if used and used + size > max_bytes:
                used, at = 0, at + 1
            used += int(size)
            bins.append(at)
        return rows.assign(bin=bins)

    named = files.select("path", "length", F.regexp_extract("path", input_of, 1).alias("input"))
    return named.groupBy("input").applyInPandas(fill, "path string, length long, input string, bin long")


def compact_inputs(spark: SparkSession, source: str, target: str, max_bytes: int = 512 << 20, input_of: str = PART_OF, schema=None) -> DataFrame:
    """Part files of many inputs into one file per input, or several of at most ``max_bytes`` of parts each, in one job.

    Outputs are ``target/input=<name>/bin=<n>``, each written by one task, all of them at once.  Returns the plan of
    ``packed_parts``.  The parts are left alone; remove them when the outputs are complete.
    """
    plan = materialise(packed_parts(part_files(spark, source), max_bytes, input_of), "packing")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    rows = (reader.schema(schema) if schema else reader).parquet(source)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    side = plan.select(F.col("path").alias("_path"), "input", "bin")
    joined = placed.join(F.broadcast(side) if fits(side) else side, "_path")
    outputs = plan.select("input", "bin").distinct().count()
    dealt = joined.repartition(max(1, outputs), "input", "bin").sortWithinPartitions("input", "bin", "_path", "_at").drop("_path", "_at")
    dealt.write.option("compression", "gzip").partitionBy("input", "bin").parquet(target)
    return plan


def merge_folders(spark: SparkSession, sources: list[str], target: str, schema, rows_per_file: int = 1_000_000) -> None:
    """Concatenate many small files under one schema; the reader packs them into large splits."""
    spark.read.schema(schema).parquet(*sources).write.option("maxRecordsPerFile", rows_per_file).option(
        "compression", "gzip").parquet(target)


def write_without(df: DataFrame, wide_column: str, path: str) -> None:
    write_table(df.drop(wide_column), path)


def write_tiers(df: DataFrame, path: str, final: float = 0.6) -> None:
    """One folder per confidence tier; a tier without rows leaves no folder.

    All and final predictions are reads of the same folders, so no row is written twice.
    """
    tiered = df.withColumn("confidence_tier", confidence_tier(df["pred_proba"], final))
    tiered.write.partitionBy("confidence_tier").parquet(path)


def read_tiers(spark: SparkSession, path: str, *tiers: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("confidence_tier").isin(*tiers)) if tiers else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


VERIFIED_COLUMNS = [
    "uid", "url", "domain", "pred_proba", "score", "stratum", "source", "image_width", "image_height", "image_format",
    "local_path", "ai_has_choropleth", "ai_has_proportional_circles", "ai_has_graduated_circles",
    "ai_has_structural_circles", "ai_confidence", "ai_description",
]


def verified_rows(candidates: DataFrame) -> DataFrame:
    """Rows that passed every formal criterion, most probable first."""
    present = [c for c in VERIFIED_COLUMNS if c in candidates.columns]
    return candidates.filter("passes_all").select(*present).orderBy(F.desc("pred_proba"), "uid")


def write_statistics(stats: DataFrame, path: str) -> None:
    """A statistics frame of a few rows as JSON."""
    stats.coalesce(1).write.json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_keys(df: DataFrame, path: str, key: str = "uid") -> None:
    df.select(F.col(key).cast("string")).write.text(path)


def copy_valid_labels(spark: SparkSession, source: str, target: str, schema) -> None:
    """JSON lines with only the YES and NO rows."""
    spark.read.schema(schema).json(source).filter(F.col("label").isin("YES", "NO")).write.json(target)


def write_iteration(selected: DataFrame, metadata: DataFrame, root: str, iteration: int) -> None:
    """Slim table for annotators, full table and metadata of one active-learning iteration."""
    base = f"{root}/iteration={iteration}"
    selected.select("uid", "url", "pred_proba").write.parquet(f"{base}/to_annotate")
    selected.write.parquet(f"{base}/to_annotate_full")
    write_statistics(metadata, f"{base}/metadata")


def high_confidence_share(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    high = F.col("pred_proba") >= threshold
    return df.agg(F.count("*").alias("n_all"), F.count_if(high).alias("n_high"),
                  F.avg(high.cast("double")).alias("share"),
                  F.avg(F.when(high, F.col("pred_proba"))).alias("mean_high"))


def write_high_confidence(df: DataFrame, path: str, threshold: float = 0.8) -> DataFrame:
    """Write the confident subset and return its share and mean, from one pass; an empty subset leaves no folder.

    The pass writes the subset beside its numbers, observed on the way; a subset of no rows is then taken away.
    """
    spark, seen = df.sparkSession, Observation("high confidence")
    high = F.col("pred_proba") >= threshold
    observed = df.observe(seen, F.count("*").alias("n_all"), F.count_if(high).alias("n_high"), F.sum(F.when(high, F.col("pred_proba"))).alias("total"))
    observed.filter(high).write.parquet(path)
    got = seen.get
    n_all, n_high = got["n_all"], got["n_high"]
    if not n_high:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    row = (n_all, n_high, n_high / n_all if n_all else None, got["total"] / n_high if n_high else None)
    return spark.createDataFrame([row], "n_all long, n_high long, share double, mean_high double")
