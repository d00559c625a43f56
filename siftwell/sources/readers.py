"""Table readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftwell.functions.text import build_dictionary
from siftwell.functions.urls import domain_of, normalise_url, url_uid


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, on any file system Spark can reach."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def names_folder(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob names a folder, as a table of several part files is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return any(status.isDirectory() for status in found or [])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan of a file or folder of part files; only the named columns are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_parts(spark: SparkSession, folder: str, schema: T.StructType | None = None,
               pattern: str = "*.parquet") -> DataFrame:
    """All part files of a folder, and all files of its part folders; a missing or empty folder is an error."""
    parts = f"{folder.rstrip('/')}/{pattern}"
    if not path_exists(spark, parts):
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    reader = spark.read.schema(schema) if schema else spark.read
    if names_folder(spark, parts):  # the pattern is that of the folders, not of the files inside
        return reader.parquet(parts)
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header.  Files with line breaks inside quotes need ``multi_line`` and are then read whole by one task each."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType, required=("uid",)) -> DataFrame:
    """JSON lines without the malformed ones; absent optional columns are NULL, absent required ones an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good = lines.select(F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    parsed = good.select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
                           for f in schema.fields])
    present = parsed.agg(*[F.count(c).alias(c) for c in required]).first()
    missing = [c for c in required if not present[c]]
    if missing:
        raise ValueError(f"no rows with the required columns {missing}")
    return parsed


def read_first_existing(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of several candidate inputs that exists, Parquet or JSON lines by its name."""
    for path in paths:
        if path_exists(spark, path):
            return read_jsonl(spark, path, schema) if ".jsonl" in path else spark.read.schema(schema).parquet(path)
    raise FileNotFoundError(f"none of {paths} exists")


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON objects phrase -> score as rows: one object in a file over several lines, or one per line."""
    lines = spark.read.text(path).withColumn("whole", F.col("value").startswith("{") & F.rtrim("value").endswith("}"))
    pairs = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
    if lines.filter("NOT whole AND trim(value) <> ''").limit(1).count():
        lines = spark.read.text(path, wholetext=True)
    return lines.select(F.explode(pairs).alias("phrase", "score"))


def read_dictionary(spark: SparkSession, positive_path: str, negative_path: str) -> DataFrame:
    return build_dictionary(read_phrases(spark, positive_path), read_phrases(spark, negative_path))


def ratings_from_wide(sheet: DataFrame, criteria: list[str], respondent: str = "respondent") -> DataFrame:
    """Wide survey sheet to (respondent, criterion, rating)."""
    return sheet.unpivot(respondent, criteria, "criterion", "rating")


def urls_from_lines(lines: DataFrame) -> DataFrame:
    """Manual URL list: trimmed lines without blanks and comments, as candidate rows."""
    url = F.trim("value")
    kept = lines.filter((url != "") & ~F.col("value").startswith("#")).select(url.alias("url"))
    return kept.select(url_uid(F.col("url")).alias("uid"), "url", domain_of(normalise_url(F.col("url"))).alias("domain"),
                       F.lit(0.0).alias("pred_proba"), F.lit(0.0).alias("score"), F.lit("manual").alias("stratum"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return urls_from_lines(spark.read.text(path))


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the files in a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def part_name() -> Column:
    """Name of the input file of each row of a file scan."""
    return F.col("_metadata.file_name")


def scan_batches(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """Apply a pandas function to bounded batches of rows.

    The session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds a batch.
    """

    def run(batches):
        for pdf in batches:
            yield function(pdf)

    return df.mapInPandas(run, schema)


def head_sample(df: DataFrame, head: int, n: int, order: list[str], uid: str = "uid", seed: int = 42) -> DataFrame:
    """A seeded random n of the first ``head`` rows in the given order."""
    from siftwell.operators.sampling import take_random

    return take_random(df.orderBy(*order).limit(head), n, uid, seed)
