"""A running annotation log: the last write of each key wins, and counts per class are kept against their targets.

State (one record per key) lives in a RocksDB state store, so it is bounded by disk and not by executor memory, and
survives a restart with the checkpoint.  Each micro-batch writes what changed under ``changes/batch=<id>``: the key's new
record and the label that it replaces.  A repeated batch overwrites its own folder.  ``fold`` turns the batches so far
into one snapshot, after which readers open the snapshot and the batches that came later, not every batch ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from siftwell.operators.ordering import first_per_key
from siftwell.streaming.incremental import run_to_end

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PREVIOUS = "previous_label"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; a store that the session has chosen stays."""
    chosen = spark.conf.get(PROVIDER, None)
    own = chosen is None or chosen.endswith("HDFSBackedStateStoreProvider")
    if own:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if own:
            spark.conf.unset(PROVIDER) if chosen is None else spark.conf.set(PROVIDER, chosen)


class LastWrite(StatefulProcessor):
    """Keeps the last record per key, in the order of some columns, and reports when it changes.

    Null values of the order columns come first; of equal records the one already kept stays.
    """

    def __init__(self, key: str, record: T.StructType, places: list[str], label: str) -> None:
        self.key, self.record, self.places, self.label = key, record, places, label

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.record)

    def _place(self, values: tuple) -> list[tuple]:
        found = [values[self.record.fieldNames().index(c)] for c in self.places]
        return [(v is not None, 0 if v is None else v) for v in found]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.record.fieldNames()
        kept = tuple(self.last.get()) if self.last.exists() else None
        best = kept
        for row in rows:
            values = tuple(row[c] for c in names)
            if best is None or self._place(values) > self._place(best):
                best = values
        if best is not kept:
            self.last.update(best)
            before = None if kept is None else kept[names.index(self.label)]
            shown = {c: v for c, v in zip(names, best, strict=True) if c not in self.places}
            yield Row(**{self.key: key[0], **shown, "replaces": kept is not None, PREVIOUS: before})

    def close(self) -> None:
        pass


def follow(log: DataFrame, output: str, checkpoint: str, key: str = "uid", label: str = "label", order: tuple[str, ...] = ("ts", "event_id")) -> None:
    """Take in the log rows that are new since the last call with this checkpoint.

    Times are compared as microseconds, so that a kept record and a new one compare whatever the session's time zone.
    """
    kept = [f for f in log.schema.fields if f.name != key]
    out = T.StructType([log.schema[key], *kept, T.StructField("replaces", T.BooleanType()), T.StructField(PREVIOUS, log.schema[label].dataType)])
    timed = (T.TimestampType, T.TimestampNTZType, T.DateType)
    places = [f"_place_{c}" for c in order]
    placed = log.withColumns({p: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(log.schema[c].dataType, timed) else F.col(c) for p, c in zip(places, order, strict=True)})
    record = T.StructType([f for f in placed.schema.fields if f.name != key])
    changes = placed.groupBy(key).transformWithState(LastWrite(key, record, places, label), outputStructType=out, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/changes/batch={batch_id}")

    with rocksdb_state(log.sparkSession):
        run_to_end(changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start())


def _folders(spark: SparkSession, pattern: str) -> list[int]:
    """Numbers n of the folders ``...=n`` of a pattern that are complete."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _later(spark: SparkSession, output: str) -> tuple[int, list[int]]:
    """The last folded batch (-1: none), and the batches after it."""
    folded = max(_folders(spark, f"{output}/snapshots/upto=*/_SUCCESS"), default=-1)
    return folded, [b for b in _folders(spark, f"{output}/changes/batch=*/_SUCCESS") if b > folded]


def current(spark: SparkSession, output: str, schema: T.StructType, key: str = "uid") -> DataFrame:
    """The current record of each key, with the columns of the log's schema."""
    folded, later = _later(spark, output)
    kinds = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    parts = [spark.read.schema(schema).parquet(f"{output}/snapshots/upto={folded}").withColumn("batch", F.lit(folded).cast("long"))] if folded >= 0 else []
    parts += [spark.read.schema(schema).parquet(f"{output}/changes/batch={b}").withColumn("batch", F.lit(b).cast("long")) for b in later]
    rows = spark.createDataFrame([], kinds)
    for part in parts:
        rows = rows.unionByName(part)
    return first_per_key(rows, [key], F.desc("batch")).drop("batch")


def fold(spark: SparkSession, output: str, schema: T.StructType, key: str = "uid") -> int:
    """Write the snapshot of all batches so far; returns the last batch in it.  Older folders are left to their owner's retention."""
    folded, later = _later(spark, output)
    if not later:
        return folded
    current(spark, output, schema, key).write.mode("overwrite").parquet(f"{output}/snapshots/upto={later[-1]}")
    return later[-1]


def class_counts(spark: SparkSession, output: str, schema: T.StructType, label: str = "label") -> DataFrame:
    """Annotated keys per class, from the snapshot's counts and the changes since: ``label, n``.

    A change adds one to its class and takes one from the class that it replaces, so no key is looked up again.
    """
    folded, later = _later(spark, output)
    parts = []
    if folded >= 0:
        parts.append(spark.read.schema(schema).parquet(f"{output}/snapshots/upto={folded}").groupBy(label).agg(F.count("*").alias("n")))
    kinds = T.StructType([*schema.fields, T.StructField("replaces", T.BooleanType()), T.StructField(PREVIOUS, schema[label].dataType)])
    for batch in later:
        rows = spark.read.schema(kinds).parquet(f"{output}/changes/batch={batch}")
        moves = F.array(F.struct(F.col(label).alias("of"), F.lit(1).alias("by")), F.when(F.col("replaces"), F.struct(F.col(PREVIOUS).alias("of"), F.lit(-1).alias("by"))))
        parts.append(rows.select(F.inline(F.filter(moves, lambda m: m.isNotNull()))).groupBy(F.col("of").alias(label)).agg(F.sum("by").alias("n")))
    total = spark.createDataFrame([], T.StructType([schema[label], T.StructField("n", T.LongType())]))
    for part in parts:
        total = total.unionByName(part)
    return total.groupBy(label).agg(F.sum("n").alias("n")).filter(F.col("n") > 0)


def progress(counts: DataFrame, targets: dict[str, int], label: str = "label") -> DataFrame:
    """Each class with a target: ``label, n, target, remaining``, and the row ``valid`` for YES and NO together if it has one."""
    spark = counts.sparkSession
    valid = counts.filter(F.col(label).isin("YES", "NO")).agg(F.lit("valid").alias(label), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    wanted = spark.createDataFrame(list(targets.items()), f"{label} string, target long")
    joined = wanted.join(counts.unionByName(valid), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(label, "n", "target", F.greatest(F.col("target") - F.col("n"), F.lit(0)).alias("remaining"))
