"""A prefix trie of conversations: what they share, node by node.

Turns are encoded by a 16-byte digest of role and text, so texts are read once and never shuffled.  Equal sequences of turns
are counted before anything else, so a conversation that was copied often is one row.  Distinct sequences are range-sorted
and cut into shards of neighbouring ones; each shard writes its turns as numbers of its own dictionary and inserts its
sequences, medians first, into a ternary search tree.  One iterative traversal lists the trie's nodes in order, and a pass
backwards over the list accumulates members, leaves and savings.

A prefix that continues in a neighbouring shard lies on the path of the shard's first or last sequence.  Nodes of these two
paths are boundary nodes: they are merged by their prefix's digest, and what lies below them is summed along the shards'
paths, each merged node being counted by the least shard that holds it.  All other nodes are whole in their shard.

A conversation is one row of 16 bytes and a word count for each turn; only its length bounds that row.  The ends of a node
are hashed as a stream of pieces, so a node where very many conversations end needs no more memory than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwell.llm.common import bounded_batches, materialise, table
from siftwell.llm.quality import words_of
from siftwell.llm.sqltools import CRC_TABLE, crc32_sql

CODE = 16
SHARD_TURNS = 200_000
"""Turns after which a task begins a new shard; the result does not depend on it."""
PIECE = 1 << 16
"""Characters of one piece of a node's ends."""
FAMILY, HEADS = 20, 4
NO_ENDS = hashlib.sha256().hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ---------------------------------------------------------------- sequences


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: an array of ``code`` (hex) and ``words`` of each conversation, by turn (null first), then role, then code.

    Null roles and texts are empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE)
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), code.alias("code"), F.size(words_of(text)).alias("words")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words"))).alias("turns"))


def shared_head(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Each conversation with its first ``shared_head`` turns replaced by those of its family's first conversation."""
    first = turns.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEADS - 1).alias("given"))
    h = shared_head(F.col("conv_id"))
    joined = turns.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "first", "left")
    head = F.coalesce(F.slice("given", F.lit(1), h), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def ends_of(sequences: DataFrame) -> DataFrame:
    """``seq, ends``: the SHA-256 of the ascending conv_ids, comma-joined, of each sequence's conversations.

    Ids are range-sorted and written in pieces of text; the pieces of a sequence are hashed one after the other.
    """
    dealt = sequences.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "first", "part"]
        seq, first, held, size = None, None, [], 0
        for batch in batches:
            done: list[tuple] = []
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != seq or size > PIECE:
                    if held:
                        done.append((seq, first, ",".join(held)))
                    seq, first, held, size = s, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([first]), pa.array([",".join(held)])], names=names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "ends"]
        seq, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for s, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s == seq:
                    state.update(b"," + part.encode())
                    continue
                if state:
                    done.append((seq, state.hexdigest()))
                seq, state = s, hashlib.sha256(part.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], names=names)

    parts = dealt.mapInArrow(pieces, "seq string, first long, part string")
    return parts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digests, "seq string, ends string")


# ---------------------------------------------------------------- one shard


class TernaryTree:
    """A ternary search tree over sequences of numbers; node 0 is the root, every other node one distinct prefix."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.parent, self.words = [-1], [0], [0], [0], [-1], [0]

    def _new(self, code: int, parent: int, words: int) -> int:
        for column, value in ((self.code, code), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent), (self.words, words)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, sequence: list[int], words: list[int]) -> list[int]:
        """Add a sequence; the nodes on its path, the root first."""
        path, code = [0], self.code
        for k, c in enumerate(sequence):
            at, link, slot = self.down[path[-1]], self.down, path[-1]
            while at and code[at] != c:
                link, slot = (self.low if c < code[at] else self.high), at
                at = link[slot]
            if not at:
                at = link[slot] = self._new(c, path[-1], words[k])
            path.append(at)
        return path

    def in_order(self) -> list[int]:
        """All nodes, each before those below it, siblings ascending."""
        out, stack = [], [(0, True)]
        while stack:
            at, whole = stack.pop()
            if whole:
                if self.high[at]:
                    stack.append((self.high[at], True))
                stack.append((at, False))
                if self.low[at]:
                    stack.append((self.low[at], True))
            else:
                out.append(at)
                if self.down[at]:
                    stack.append((self.down[at], True))
        return out


def median_order(n: int) -> Iterator[int]:
    """0 to n-1, the middle of each part before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += [(middle + 1, high), (low, middle)]


PART = "shard long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string"
_PART_TYPES = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]


def shard_nodes(shard: int, rows: list[tuple]) -> list[tuple]:
    """The nodes of a shard of sorted distinct sequences ``(codes, words, n, least conv_id, ends)``, as rows of ``PART``.

    Boundary nodes have a key, and their children, leaves and savings leave out those of boundary nodes; nodes below a
    boundary node have its key as ``parent_key`` and no ``parent_conv_id``.
    """
    cut = [[blob[k : k + CODE] for k in range(0, len(blob), CODE)] for blob, *_ in rows]
    number = {code: i for i, code in enumerate(sorted({c for s in cut for c in s}))}
    tree, last, edge = TernaryTree(), {}, {}
    for i in median_order(len(rows)):
        path = tree.insert([number[c] for c in cut[i]], rows[i][1])
        last[path[-1]] = rows[i]
        if i in (0, len(rows) - 1):
            state = hashlib.sha256()
            for node, code in zip(path, [b"", *cut[i]], strict=True):
                state.update(code)
                edge[node] = state.digest()
    size = len(tree.code)
    members, least, children, leaves, saved, depth = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    order = tree.in_order()
    for node in order[1:]:
        depth[node] = depth[tree.parent[node]] + 1
    for node in reversed(order):
        if node in last:
            _, _, n, conv, _ = last[node]
            members[node] += n
            least[node] = conv if least[node] is None else min(conv, least[node])
        if node not in edge:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.words[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            if node not in edge:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    out = []
    for node in order:
        up = tree.parent[node]
        out.append((
            shard, edge.get(node), edge.get(up), depth[node], least[node], least[up] if up >= 0 and up not in edge else None, members[node],
            children[node], leaves[node], saved[node], tree.words[node], last[node][4] if node in last else None,
        ))
    return out


def shards(sequences: DataFrame) -> DataFrame:
    """The nodes of all shards; ``sequences`` has ``blob, words, n, conv_id, ends``."""
    bounded_batches(sequences.sparkSession)
    dealt = sequences.select("blob", "words", "n", "conv_id", "ends").repartitionByRange("blob").sortWithinPartitions("blob")
    limit = SHARD_TURNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PART.split(", ")]
        shard, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(found), 50_000):
                columns = zip(*found[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_TYPES, strict=True)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                turns += len(row[1]) + 1
                if turns >= limit:
                    yield from rows(shard_nodes(shard, held))
                    shard, held, turns = shard + 1, [], 0
        if held:
            yield from rows(shard_nodes(shard, held))

    return dealt.mapInArrow(run, PART)


# ---------------------------------------------------------------- merging


def _owned_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """For the boundary nodes of one shard: what the nodes that it owns add to themselves and to those above them."""
    rows = rows.sort_values("depth", ascending=False)
    leaves, saved = {}, {}
    for key, up, owned, n, s in zip(rows["key"], rows["parent_key"], rows["owned"], rows["own_leaves"], rows["own_saved"], strict=True):
        for total, own in ((leaves, n), (saved, s)):
            total[key] = total.get(key, 0) + (int(own) if owned else 0)
            if up is not None:
                total[up] = total.get(up, 0) + total[key]
    return pd.DataFrame({"key": list(leaves), "n_leaves": list(leaves.values()), "saved_tokens": [saved[k] for k in leaves]})


def merge_boundaries(parts: DataFrame) -> DataFrame:
    """All nodes with ``COLUMNS`` from the stored nodes of the shards."""
    edge = parts.where("key IS NOT NULL")
    merged = edge.groupBy("key").agg(
        F.min("shard").alias("owner"), F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.first("words").alias("words"), F.max("ends").alias("ends"),
    )
    merged = materialise(merged, "boundary")
    below = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    whole = merged.join(below, "key", "left").select(
        "key", "owner", "depth", "parent_key", "conv_id", "n_convs", children.alias("n_children"), "ends",
        (F.col("n_leaves") + (children == 0).cast("long")).alias("own_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("own_saved"),
    )
    whole = materialise(whole, "whole")
    paths = edge.select("shard", "key", "parent_key", "depth").join(whole.select("key", "owner", "own_leaves", "own_saved", F.col("conv_id").alias("least")), "key")
    paths = materialise(paths.withColumn("owned", F.col("shard") == F.col("owner")), "paths")
    sums = paths.select("shard", "key", "parent_key", "depth", "owned", "own_leaves", "own_saved").groupBy("shard").applyInPandas(_owned_sums, "key binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    shared = whole.join(sums, "key").join(above, "parent_key", "left").select(*COLUMNS[:-1], ends)
    near = paths.select("shard", F.col("key").alias("parent_key"), "least")
    inner = parts.where("key IS NULL").withColumnRenamed("saved", "saved_tokens")
    deep = inner.where("parent_key IS NULL").select(*COLUMNS[:-1], ends)
    top = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(near, ["shard", "parent_key"]).withColumnRenamed("least", "parent_conv_id").select(*COLUMNS[:-1], ends)
    return shared.unionByName(deep).unionByName(top)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes, with ``COLUMNS``, of the trie over ``conv_id, turns`` (array of ``code``, ``words``), one row per conversation.

    Conversations without turns end in the root.  No conversations give no nodes.
    """
    blob = F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), ""))
    rows = materialise(turns.select("conv_id", blob.alias("blob"), F.transform("turns", lambda t: t["words"]).alias("words")), "sequences")
    distinct = rows.groupBy("blob").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ends = materialise(ends_of(rows.select(F.sha2("blob", 256).alias("seq"), "conv_id")), "ends")
    distinct = materialise(distinct.withColumn("seq", F.sha2("blob", 256)).join(ends, "seq").drop("seq"), "distinct")
    return merge_boundaries(materialise(shards(distinct), "nodes"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table ``conv_id, turn, role, text`` whose conversations share heads; other columns take no part.

    Equal rows are turns of their own; turns of equal number are ordered by role and digest, null numbers come first.
    """
    return prefix_trie(with_shared_heads(turns_of(conversations)))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


_HEX = 2 * CODE
QUERIES = {"op11_conversation_prefix_trie": op11_conversation_prefix_trie}
ORACLES = {
    "op11_conversation_prefix_trie": rf"""
WITH RECURSIVE {CRC_TABLE},
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (
  SELECT conv_id, turn, role, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)[1:{_HEX}] AS code,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM rows),
own AS (SELECT conv_id, list(code ORDER BY turn NULLS FIRST, role, code) AS codes, list(words ORDER BY turn NULLS FIRST, role, code) AS words FROM coded GROUP BY conv_id),
heads AS (SELECT own.*, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM own, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.codes[1:c.h], []), c.codes[c.h+1:]) AS codes, list_concat(coalesce(b.words[1:c.h], []), c.words[c.h+1:]) AS words
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
member AS (SELECT conv_id, unnest(range(0, len(codes) + 1)) AS depth, codes, words FROM rebuilt),
keyed AS (SELECT conv_id, depth, array_to_string(codes[1:depth], '') AS key, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS w, len(codes) = depth AS ends FROM member),
node AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends
  FROM keyed GROUP BY depth, key),
child AS (SELECT depth - 1 AS depth, key[1:{_HEX} * (depth - 1)] AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (depth, key)),
below AS (SELECT unnest(range(0, depth + 1)) AS up, key AS whole, n, w, n_children FROM full_node),
sums AS (SELECT up AS depth, whole[1:{_HEX} * up] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n - 1) * w) AS BIGINT) AS saved FROM below GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sums s USING (depth, key) LEFT JOIN full_node p ON p.depth = f.depth - 1 AND p.key = f.key[1:{_HEX} * (f.depth - 1)]"""
}
