"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftwell.session import bounded_batches, materialise, scratch_dir  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A frame without the columns that an operator is about to add, whatever their case."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3; remainder 1 is held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out; a null id counts as held out."""
    return F.coalesce(fold(doc_id) == 1, F.lit(True))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(batch: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """Cut a text array into runs of rows of at most ``limit`` bytes, or of one longer row."""
    start, total = 0, 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
        if k > start and total + size > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if len(batch) > start:
        yield batch.slice(start)


def add_columns(
    df: DataFrame, text: str, new: T.StructType, make: Callable[[Iterator[pa.Array]], Iterator[list[pa.Array]]], keep: Sequence[str] | None = None
) -> DataFrame:
    """Map a text column batch by batch to new columns beside the kept ones.

    ``make`` runs once per task: it takes the batches of the text column and yields the new arrays of each.
    """
    bounded_batches(df.sparkSession)
    kept = without(df, new.names) if keep is None else df.select(*[F.col(f"`{c}`") for c in keep])
    names = kept.columns
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(fresh(kept, "text_of_row")))
    schema = T.StructType(kept.schema.fields + new.fields)
    arrow_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                held.append(batch)
                yield batch.column(len(names))

        for arrays in make(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + arrays, names=arrow_names)

    return source.mapInArrow(run, schema)
