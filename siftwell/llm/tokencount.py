"""Token counts of flat, unindexed token files by a vectorised separator scan.

A file is nothing but token ids of two or four bytes, with an end-of-document id after each document.  Blocks
of a file are searched independently; a document that crosses blocks is stitched from each block's last
separator, carried forward by a prefix scan over the blocks of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from siftwell.llm.common import add_columns, materialise, scratch_dir, table

BLOCK_BYTES = 4 << 20
KEY_TOKENS = 5
"""Ids below 2^15 that spell a document's key in front of its tokens; none of them can be the separator."""
NO_KEY = 1 << 14
"""Bit of the last of these ids that marks a null key; a key's own bits end below it."""


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end_of_document: int, key: str = "doc_id", text: str = "text") -> None:
    """Write each whole text as ``key, token ids, separator`` to flat files of little-endian 16-bit ids.

    Null texts have no tokens, and a null key is marked as such, so every row has its document, repeated rows and keys
    too; other columns are not read.  An empty table gives a folder without documents.  Spark's text writer puts the bytes and the separator
    (as its line separator) wherever the folder is, so no file is held in memory and a lost task is redone.
    """
    if not 0x7FFF < end_of_document < 0x10000 or end_of_document & 0xFF == 0 or end_of_document >> 8 == 0:
        raise ValueError("the separator must be a 16-bit id of at least 2^15 without a zero byte")

    def make(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        import tiktoken

        from siftwell.llm.bpe import read_ranks

        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        for batch in texts:
            yield [pa.array([coder.encode_to_numpy(v.as_py() or "", disallowed_special=()).astype("<u2").tobytes() for v in batch], pa.binary())]

    coded = add_columns(docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")), "text", T.StructType([T.StructField("ids", T.BinaryType())]), make, ["key"])
    known = F.coalesce("key", F.lit(0).cast("long"))
    digit = [F.shiftrightunsigned(known, 15 * i).bitwiseAND(F.lit(0x7FFF)) for i in range(KEY_TOKENS)]
    digit[-1] = digit[-1].bitwiseOR(F.when(F.col("key").isNull(), NO_KEY).otherwise(0))
    hexed = F.concat(*[F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)) for h in (F.lpad(F.hex(d), 4, "0") for d in digit)])
    line = F.concat(F.unhex(hexed), F.col("ids")).cast("string")
    separator = end_of_document.to_bytes(2, "little").decode("latin-1")
    coded.select(line.alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(folder)


def scan_token_files(spark: SparkSession, folder: str, end_of_document: int, width: int = 2, head: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, start, n_tokens, head`` for each document of all files in a folder.

    ``start`` counts ids from the file's beginning; ``head`` holds the first ids of a document (at most
    ``head`` of them).  Two separators in a row enclose an empty document.  Ids after the last separator form
    a last document; a file that ends in a separator has none.  Empty files and a trailing part of an id
    give nothing.  The files must be in a store that pyarrow reads by byte range (a shared file system,
    HDFS, S3, GCS).
    """
    kind, block = np.dtype(f"<u{width}"), block_bytes // width * width
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") >= width).select("path", "length")
    blocks = files.select("path", F.floor(F.col("length") / width).alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, total, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)
                first = b * block // width
                with store.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(min(block + head * width, (total - first) * width), first * width), kind)
                own = min(block // width, total - first)
                ends = np.flatnonzero(ids[:own] == end_of_document)
                opens = np.concatenate(([-1] if not b else [], ends)) + 1  # where documents start, as far as this block knows
                opens = opens[opens + first < total].astype(np.int64)
                heads = []
                for at in opens.tolist():
                    some = ids[at : at + head]
                    stop = np.flatnonzero(some == end_of_document)
                    heads.append((some[: stop[0]] if len(stop) else some).astype(np.int32))
                starts, ends = (opens + first).tolist(), (ends + first).tolist()
                closes = ends if not b else ends[1:]
                row = ([path], [total], [b], [ends[0] if ends and b else None], [starts], [closes], [heads])
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["path", "total", "block", "first", "starts", "ends", "heads"])

    schema = "path string, total long, block long, first long, starts array<long>, ends array<long>, heads array<array<int>>"
    found = materialise(blocks.repartition("path", "block").mapInArrow(run, schema), "separators")
    # the prefix scan: where the document that is open at a block's beginning has started
    last = found.select("path", "total", "block", "first", F.try_element_at("starts", F.lit(-1)).alias("open"), F.try_element_at("heads", F.lit(-1)).alias("open_head"), F.size("starts").alias("s"), F.size("ends").alias("e"))
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("*", F.last("open", True).over(before).alias("carry"), F.last("open_head", True).over(before).alias("carry_head"), F.lead("block").over(order).isNull().alias("final"))
    crossing = carried.where("first IS NOT NULL").select("path", F.col("carry").alias("start"), (F.col("first") - F.col("carry")).alias("n_tokens"), F.col("carry_head").alias("head"))
    tail = carried.where("final").select("path", "total", F.coalesce("open", "carry").alias("start"), F.coalesce("open_head", "carry_head").alias("head"), ((F.col("s") > F.col("e")) & F.col("open").isNotNull() | F.col("open").isNull() & F.col("first").isNull()).alias("unfinished"))
    tail = tail.where("unfinished AND start < total").select("path", "start", (F.col("total") - F.col("start")).alias("n_tokens"), "head")
    inside = found.select("path", F.explode(F.arrays_zip(F.slice("starts", F.lit(1), F.size("ends")).alias("start"), F.col("ends").alias("end"), F.slice("heads", F.lit(1), F.size("ends")).alias("head"))).alias("d"))
    inside = inside.select("path", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.head")
    return inside.unionByName(crossing).unionByName(tail)


def key_of(head: Column) -> Column:
    """The key that a document's first ids spell, null if marked so."""
    key = F.aggregate(F.transform(head, lambda x, i: F.call_function("shiftleft", x.cast("long"), i * 15)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.when(F.get(head, F.lit(KEY_TOKENS - 1)).bitwiseAND(F.lit(NO_KEY)) == 0, key)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document to flat token files, then count each one's tokens by scanning them."""
    import public_tokenizers

    folder, end = scratch_dir(spark, "tokens"), 50_256
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end)
    found = scan_token_files(spark, folder, end, head=KEY_TOKENS)
    return found.select(key_of(F.col("head")).alias("doc_id"), (F.col("n_tokens") - KEY_TOKENS).alias("n_tokens"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
