"""Session helpers and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_local_roots: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftwell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor must see.

    Only a local-mode session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="siftwell-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Redistribute a frame read in fewer pieces than the session has cores.

    Parquet cannot be split below a row group, so a small input would leave cores idle in a stage of
    heavy expressions.  A large input has more pieces than that and is returned as it is, unshuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame once to shared storage and read it back, cutting its lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, limit: int = 32 << 20) -> None:
    """Let Arrow batches end at a size too, so that long texts do not fill a worker; a set value stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """A stored frame with a broadcast hint if its counted rows fit the limit, otherwise as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        total = F.lit(16)
        for f in kind.fields:
            total = total + _bytes_of(value[f.name], f.dataType)
        return total
    if isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType))
        if fixed:
            return 16 + 8 * F.coalesce(F.size(value), F.lit(0))
        sizes = F.transform(value, lambda x: _bytes_of(x, kind.elementType))
        return 16 + F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(0))
    if isinstance(kind, T.MapType):
        return 16 + F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row with the columns of ``df``."""
    total = F.lit(16)
    for f in df.schema.fields:
        total = total + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    return total


def fits(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether the rows of a stored frame, measured, take at most ``limit`` bytes."""
    return (df.agg(F.sum(row_bytes(df).cast("long"))).first()[0] or 0) <= limit
