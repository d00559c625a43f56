"""Incremental runs on Structured Streaming: each call handles the files that are new since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from siftwell.sources.readers import names_folder


def new_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
              fmt: str = "parquet") -> DataFrame:
    """Files of a folder whose names fit the pattern; where it fits folders, all files inside them."""
    reader, parts = spark.readStream.format(fmt).schema(schema), f"{folder.rstrip('/')}/{pattern}"
    if names_folder(spark, parts):
        return reader.load(parts)
    return reader.option("pathGlobFilter", pattern).load(folder)


def run_to_end(query) -> None:
    query.awaitTermination()


def process_new_files(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str,
                      checkpoint: str) -> None:
    """Transform inputs not processed yet and append the results; a rerun resumes from the checkpoint."""
    run_to_end(transform(stream).writeStream.format("parquet").option("path", output)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def keep_latest(stream: DataFrame, key: str, order: list[str], output: str, checkpoint: str) -> None:
    """Append the changed last record per key of every micro-batch under ``batch=<id>``.

    Spark's state store keeps one record per key.  A repeated batch overwrites its own folder, so the
    log stays exact after a failure.
    """
    columns = [c for c in stream.columns if c != key]
    last = stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, "last.*").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    run_to_end(last.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
               .foreachBatch(write).trigger(availableNow=True).start())


def read_latest(spark: SparkSession, output: str, key: str) -> DataFrame:
    """Current record per key from the batches written by keep_latest."""
    w = Window.partitionBy(key).orderBy(F.desc("batch"))
    rows = spark.read.parquet(output)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "batch")


def step_results(stream: DataFrame, step: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """Run one status step per micro-batch and log its result rows under ``batch=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    run_to_end(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
               .trigger(availableNow=True).start())
