"""Exact substring deduplication: run-length Burrows-Wheeler indexes of the places where texts can repeat.

A 200-byte string is owned by the smallest 48-byte gram hash inside it (its anchor), so equal strings have equal
anchors.  1. Every anchor sends its hash and a fingerprint of all the bytes its strings cover; anchors that
occur once are done, and where all occurrences have the same bytes, all their strings repeat.  2. The remaining
contexts, at the edges of repeats, are indexed group by group: a run-compressed transform with sampled run ends, from which
matching statistics are streamed in text order; strings that match another for 200 bytes are marked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwell.llm.common import bounded_batches, fresh, materialise, slices, table, without
from siftwell.llm.wordhash import _BYTES, _DOWN, _UP, mix
from siftwell.session import broadcast_if_small

LENGTH, GRAM = 200, 48
PIECE = 1 << 19
"""Starts of one piece of a long text; pieces overlap by the length of a string."""
BUCKET_ENTRIES = 2_000_000
CHUNK = 2 << 20
"""Bytes of contexts in one index."""
PART = 1 << 20
"""Bytes of one anchor's contexts beyond which they are dealt over tiles that cover all their pairs."""


def _anchors(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """For pieces ``[start, end)`` of at most 2^20 bytes in all: piece, first and last owned string start, hash, fingerprint."""
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _UP[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * _DOWN[: n + 1 - GRAM])
    # the leftmost smallest gram of each string: the place stands in the low bits
    width = LENGTH - GRAM + 1
    low = gram & ~np.uint64(0xFFFFF) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    place = (low & np.uint64(0xFFFFF)).astype(np.int64)
    piece = np.full(len(place), -1)
    for k in np.flatnonzero(end - start >= LENGTH).tolist():
        piece[start[k] : end[k] - LENGTH + 1] = k
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    fine = piece[first] >= 0
    first, last = first[fine], last[fine]
    at = place[first]
    print_ = mix((total[last + LENGTH] - total[first]) * _DOWN[first] + mix(((at - first) << 10 | (last - first)).astype(np.uint64)))
    return piece[first], first, last, gram[at], print_


def _pieces(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Concatenated pieces of texts: bytes, starts, ends, text number, offset in the text."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0
    for k, value in enumerate(values):
        for offset in range(0, max(1, len(value) - LENGTH + 1), PIECE):
            part = value[offset : offset + PIECE + LENGTH - 1]
            if parts and size + len(part) > _UP.size - 1:
                yield _joined(parts)
                parts, size = [], 0
            parts.append((part, k, offset))
            size += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), ends - sizes, ends, np.array([p[1] for p in parts]), np.array([p[2] for p in parts])


def _text_anchors(values: list[bytes]) -> tuple[np.ndarray, ...]:
    """All anchors of some texts, in order: text, first and last start in it, hash, fingerprint."""
    out = []
    for raw, start, end, text, offset in _pieces(values):
        piece, first, last, gram, print_ = _anchors(raw, start, end)
        shift = offset[piece] - start[piece]
        out.append((text[piece], first + shift, last + shift, gram, print_))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _anchors(np.zeros(0, np.uint8), np.zeros(0), np.zeros(0))


def _blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _codes(rows: DataFrame, entries: int) -> DataFrame:
    """``rid, codes`` of texts with an anchor that occurs again: a byte per anchor of the text, in order.

    0: the anchor occurs once; 1: all its occurrences have the same bytes; n > 1: its contexts are to be compared, dealt
    over n - 1 parts.  A batch sends equal anchors once, so one that is everywhere makes no hot bucket.
    """
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    names = ["grp", "unit", "bucket", "a", "b", "c"]
    schema = "grp long, unit long, bucket long, a binary, b binary, c binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                rids = batch.column(0).slice(at, len(part)).to_numpy()
                at += len(part)
                unit += 1
                text, first, last, gram, print_ = _text_anchors([(v.as_py() or "").encode("utf-8") for v in part])
                bucket = (gram >> np.uint64(20)) % np.uint64(buckets)
                order = np.lexsort((print_, gram, bucket))
                bucket, gram, print_, size = bucket[order], gram[order], print_[order], (last - first + LENGTH)[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (print_[1:] != print_[:-1])
                entry = np.empty(len(gram), np.int32)
                entry[order] = np.cumsum(new) - 1
                starts = np.flatnonzero(new)
                several = np.diff(np.append(starts, len(gram))) > 1
                cuts = np.searchsorted(bucket[starts], np.arange(buckets + 1).astype(np.uint64))
                for b in range(buckets):
                    if cuts[b] < cuts[b + 1]:
                        pick = starts[cuts[b] : cuts[b + 1]]
                        yield row(b, unit, b, _blob(gram[pick]), _blob(print_[pick]), _blob((size[pick] << 1 | several[cuts[b] : cuts[b + 1]]).astype(np.uint16)))
                yield row(-unit, unit, -1, _blob(rids), _blob(np.bincount(text, minlength=len(part)).astype(np.int64)), _blob(entry))

    def count(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            return rows
        gram, print_, size = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in rows.column(c)]) for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.uint16)))
        order = np.lexsort((print_, gram))
        g, p = gram[order], print_[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        n = np.bincount(group, (1 + (size[order] & 1)).astype(np.int64))
        distinct = np.ones(len(g), bool)
        distinct[1:] = new[1:] | (p[1:] != p[:-1])
        mixed = np.bincount(group, distinct) > 1
        parts = np.clip(-(-np.bincount(group, (size[order] >> 1).astype(np.int64)) // PART), 1, 250)
        code = np.where(n < 2, 0, np.where(mixed, parts + 1, 1)).astype(np.uint8)
        out = np.empty(len(g), np.uint8)
        out[order] = code[group]
        ends = np.cumsum([len(v.as_py()) // 8 for v in rows.column("a")]).tolist()
        found = [out[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]
        none = [None] * len(found)
        return pa.table([pa.array(x, k) for x, k in zip(([0] * len(found), rows.column("unit").to_pylist(), rows.column("bucket").to_pylist(), found, none, none), kinds, strict=True)], names=names)

    def settle(rows: pa.Table) -> pa.Table:
        by_bucket = dict(zip(rows.column("bucket").to_pylist(), range(len(rows)), strict=True))
        meta = by_bucket.pop(-1)
        rids, sizes, entry = (np.frombuffer(rows.column(c)[meta].as_buffer(), t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.int32)))
        code = np.concatenate([np.frombuffer(rows.column("a")[by_bucket[b]].as_buffer(), np.uint8) for b in sorted(by_bucket)] or [np.zeros(0, np.uint8)])[entry]
        ends = np.cumsum(sizes)
        found = [(r, code[e - n : e]) for r, e, n in zip(rids.tolist(), ends.tolist(), sizes.tolist(), strict=True)]
        found = [(r, c.tobytes()) for r, c in found if c.any()]
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["rid", "codes"])

    sent = rows.mapInArrow(send, schema).groupBy("grp").applyInArrow(count, schema)
    return sent.groupBy("unit").applyInArrow(settle, "rid long, codes binary")


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of texts that end in symbol 0, by prefix doubling; ``left`` is the length up to that end.

    Suffixes that are equal up to their end stand in text order.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key[: n - j] |= np.where(left[: n - j] > j, symbols[j:], 0)
    depth, longest = 7, int(left.max(initial=0))
    while True:
        order = np.argsort(key)
        ordered = key[order]
        step = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if depth >= longest or step[-1] == n - 1:
            break
        key = rank * (n + 1)
        key[: n - depth] += np.where(left[: n - depth] > depth, rank[depth:] + 1, 0)
        depth *= 2
    return np.argsort(rank * n + np.arange(n))


def matching_statistics(symbols: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """In text order, how far each suffix agrees with the one before it in suffix order.

    The transform is cut into runs of equal symbols.  Only at the sampled run ends (where a run begins, or a text) are
    suffixes compared; inside a run a suffix agrees with its neighbour for one symbol less than the suffix
    one place earlier in the text did, so the other values are streamed from the samples.
    """
    n = len(symbols)
    before = symbols[order - 1]
    sampled = np.ones(n, bool)
    sampled[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    rows = np.flatnonzero(sampled)
    a, b = order[rows], order[np.maximum(rows - 1, 0)]
    most = np.where(rows > 0, np.minimum(left[a], left[b]), 0)
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate((np.maximum(symbols - 1, 0), np.zeros(16, np.int64))).astype(np.uint64)
    for j in range(8):
        words |= padded[j : j + n + 8] << np.uint64(8 * j)
    agree, active, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
    while len(active):
        active = active[most[active] > at]
        differ = words[np.minimum(a[active] + at, n)] ^ words[np.minimum(b[active] + at, n)]
        same = differ == 0
        odd = differ[~same]
        lowest = odd & (~odd + np.uint64(1))
        bits = np.log2(lowest.astype(np.float64)).astype(np.int64)
        agree[active[~same]] = at + bits // 8
        agree[active[same]] = at + 8
        active, at = active[same], at + 8
    agree = np.minimum(agree, most)
    sample = np.zeros(n, np.int64)
    sample[a] = agree
    where = np.zeros(n, np.int64)
    where[a] = a
    where = np.maximum.accumulate(where)
    return np.maximum(sample[where] - (np.arange(n) - where), 0)


def repeated_starts(contexts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For distinct contexts, the starts of their strings of ``length`` bytes that occur again, in another context or,
    where the weight is over 1, in a copy of the same."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.int64) + 1
    raw[ends - 1] = 0
    owner = np.repeat(np.arange(len(contexts)), sizes)
    left = ends[owner] - 1 - np.arange(len(raw))
    order = suffix_order(raw, left)
    agree = matching_statistics(raw, left, order)
    group = np.empty(len(raw), np.int64)
    group[order] = np.cumsum(agree[order] < length)
    whole = left >= length
    n = np.bincount(group[whole], weights[owner[whole]], minlength=int(group.max(initial=0)) + 1)
    marked = whole & (n[group] > 1)
    return [np.flatnonzero(marked[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cuts + 1))].tolist(), starts[np.concatenate((cuts, [len(starts) - 1]))].tolist(), strict=True)) if len(starts) else []


RANGES = "rid long, low long, high long"


def repeated_ranges(docs: DataFrame, text: str = "text") -> DataFrame:
    """``rid, low, high``: ranges of starts of strings of ``LENGTH`` bytes that occur elsewhere, in any text or the same.

    ``rid`` is ``monotonically_increasing_id`` over the frame, which must give the same rows when read again.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    codes = broadcast_if_small(materialise(_codes(rows, size // 75), "codes"), 80)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                rids, flags = (batch.column(c).slice(at, len(part)).to_pylist() for c in (0, 2))
                at += len(part)
                values = [v.as_py().encode("utf-8") for v in part]
                doc, first, last, gram, _ = _text_anchors(values)
                code = np.frombuffer(b"".join(flags), np.uint8)
                out: list[tuple] = []
                for k in np.flatnonzero(code > 1).tolist():
                    value = values[doc[k]]
                    out.append((rids[doc[k]], int(first[k]), int(last[k]), int(gram[k].view(np.int64)), int(code[k]) - 1, value[first[k] : last[k] + LENGTH]))
                same = np.flatnonzero(code == 1)
                if len(same):  # neighbours join to one range
                    d, f, e = doc[same], first[same], last[same]
                    new = np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] != e[:-1] + 1)))
                    stop = np.append(np.flatnonzero(new)[1:], len(same)) - 1
                    out += [(rids[x], int(y), int(z), 0, 0, None) for x, y, z in zip(d[new].tolist(), f[new].tolist(), e[stop].tolist(), strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["rid", "low", "high", "gram", "parts", "context"])

    shipped = materialise(rows.join(codes, "rid").select("rid", "text", "codes").mapInArrow(ship, f"{RANGES}, gram long, parts int, context binary"), "contexts")
    dealt = shipped.where("parts > 0").withColumn("sub", F.pmod(F.xxhash64("context"), F.col("parts")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    order = ["gram", "i", "j"]
    dealt = dealt.select("gram", F.least("sub", "t").alias("i"), F.greatest("sub", "t").alias("j"), "rid", "low", "context")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, dict[tuple[int, int], None]] = {}
        size, now = 0, None

        def finish() -> pa.RecordBatch:
            found = repeated_starts(list(seen), np.array([len(m) for m in seen.values()]))
            out = [(rid, low + s, low + e) for starts, members in zip(found, seen.values(), strict=True) for s, e in _runs(starts) for rid, low in members]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["rid", "low", "high"])

        for batch in batches:
            for gram, i, j, rid, low, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > CHUNK and now != (gram, i, j):
                    yield finish()
                    seen, size = {}, 0
                now = (gram, i, j)
                if context not in seen:
                    seen[context] = {}
                    size += len(context)
                seen[context][rid, low] = None
        if seen:
            yield finish()

    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(index, RANGES)
    return found.union(shipped.where("parts = 0").select("rid", "low", "high"))


def remove_repeats(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``kept`` (bytes), ``n_bytes``, ``n_removed`` and ``spans`` (start and end of the maximal removed runs).

    Every byte of the UTF-8 text that lies in a 200-byte string occurring elsewhere goes; all are judged on the input.
    Null and short texts have nothing removed (null: no bytes).  Repeated rows repeat each other, so all
    their long texts go.  Columns of these names are replaced.
    """
    new = ["kept", "n_bytes", "n_removed", "spans"]
    rid, whole, low, high = (fresh(docs, c) for c in ("rid", "text_of_row", "low", "high"))
    ranges = repeated_ranges(docs, text).groupBy(F.col("rid").alias(rid)).agg(F.collect_list("low").alias(low), F.collect_list("high").alias(high))
    kept = without(docs, new).columns if keep is None else list(keep)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(whole), F.monotonically_increasing_id().alias(rid))
    joined = source.join(broadcast_if_small(materialise(ranges, "ranges"), 80), rid, "left").select(*[F.col(f"`{c}`") for c in kept], whole, low, high)
    n = len(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, low, high in zip(*(batch.column(n + i) for i in range(3)), strict=True):
                raw = (value.as_py() or "").encode("utf-8")
                if not low.is_valid:
                    out.append((raw, len(raw), 0, []))
                    continue
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, low.values.to_numpy(), 1)
                np.add.at(change, high.values.to_numpy() + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                out.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), edges.tolist()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], names=[*kept, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:n])
    return joined.mapInArrow(cut, f"{fields}{', ' * (n > 0)}kept binary, n_bytes long, n_removed long, spans array<long>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that occur again."""
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES: dict[str, str] = {}
