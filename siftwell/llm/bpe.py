"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's possible merges wait in one bucket per merge rank; a bucket holds the linked-list positions
where that merge could start.  Two levels of wide words mark the buckets in use, so the next rank is found
by two find-first-set steps however long the pre-token is.  Entries whose pair has changed
meanwhile are stale and skipped when their bucket is opened.  A pre-token of n bytes costs O(n) queue
operations, which keeps very long ones (a megabyte without a break) linear.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftwell.llm.common import add_columns, slices, table

CACHE_ENTRIES = 120_000
"""Bound of each worker's memo of encoded pieces; a full one is kept as the older half of the next, results never depend on it."""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_BIT = [1 << i for i in range(256)]


class Merger:
    """Encodes one pre-token at a time by the ranks of a vocabulary.

    The bitmap has two levels of 256-bit words (ranks up to 65 536 per level pair; the upper word grows with
    the vocabulary).  The queue is written out inside the loop: calls would cost more than its operations.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)

    def encode(self, piece: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equal ones, until no pair is in the vocabulary."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        get, low, bit = ranks.get, self.low, _BIT
        n, top = len(piece), 0
        buckets: dict[int, list[int]] = {}
        after, before = [*range(1, n + 2)], [*range(-1, n)]
        waits: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]  # rank of the pair starting here
        waits.append(None)
        for i, rank in enumerate(waits):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    low[word] |= bit[rank & 255]
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1  # find first set: the word, then the rank in it
            bits = low[word]
            first = bits & -bits
            low[word] = bits = bits ^ first
            if not bits:
                top &= top - 1
            rank = (word << 8) + first.bit_length() - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for k, i in enumerate(positions):
                if waits[i] != rank:  # stale
                    continue
                j = after[i]
                after[i] = end = after[j]
                waits[j] = None
                fresh = ()
                if end < n:
                    before[end] = i
                    waits[i] = r = get(piece[i : after[end]])
                    if r is not None:
                        fresh = ((r, i),)
                else:
                    waits[i] = None
                if i:
                    h = before[i]
                    waits[h] = r = get(piece[h:end])
                    if r is not None:
                        fresh = (*fresh, (r, h))
                again = False
                for r, p in fresh:
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        buckets[r] = [p]
                        word = r >> 8
                        low[word] |= bit[r & 255]
                        top |= 1 << word
                    if r <= rank:
                        again = True
                if again and k + 1 < len(positions):  # an earlier merge became possible: the rest waits again
                    if rank in buckets:
                        buckets[rank] += positions[k + 1 :]
                    else:
                        buckets[rank] = positions[k + 1 :]
                        low[rank >> 8] |= bit[rank & 255]
                        top |= 1 << (rank >> 8)
                    break
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of token ids whose bytes together are a token: sorted keys, and that token."""
    get = ranks.get
    pairs = [(a << 20 | b, whole) for token, whole in ranks.items() for cut in range(1, len(token)) if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None]
    keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    order = np.argsort(keys)
    return keys[order], values[order]


class BatchMerger:
    """The same queue over many short pre-tokens at once: a bucket's positions are merged by array operations.

    Positions index the concatenated pre-tokens.  An opened bucket merges the leftmost position of each
    pre-token; further ones wait in the bucket, so each pre-token sees the order of :class:`Merger`.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]):
        self.keys, self.wholes = pairs
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.wholes[at], -1)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(np.frombuffer(ids, "<i4").tolist()) for ids in self.packed(pieces)]

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, four bytes an id."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        word = np.repeat(np.arange(len(pieces)), sizes)
        symbol = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        waits = np.full(n, -1)
        inner = np.flatnonzero(after >= 0)
        waits[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        low, bit, buckets, top = self.low, _BIT, {}, 0

        def push(rank: np.ndarray, position: np.ndarray) -> None:
            nonlocal top
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, start, end in zip(rank[starts].tolist(), starts, [*starts[1:], len(rank)], strict=True):
                if r in buckets:
                    buckets[r].append(position[start:end])
                else:
                    buckets[r] = [position[start:end]]
                    low[r >> 8] |= bit[r & 255]
                    top |= 1 << (r >> 8)

        inner = inner[waits[inner] >= 0]
        push(waits[inner], inner)
        while top:
            block = (top & -top).bit_length() - 1
            bits = low[block]
            first = bits & -bits
            low[block] = bits ^ first
            if bits == first:
                top &= top - 1
            rank = (block << 8) + first.bit_length() - 1
            held = buckets.pop(rank)
            i = np.concatenate(held) if len(held) > 1 else held[0]
            i = np.unique(i[waits[i] == rank])  # without stale entries
            owner = word[i]
            leftmost = np.ones(len(i), bool)
            leftmost[1:] = owner[1:] != owner[:-1]
            more = i[~leftmost]
            i = i[leftmost]
            j = after[i]
            end = after[j]
            symbol[i], after[i], waits[i], waits[j] = rank, end, -1, -1
            i_end = i[end >= 0]
            end = end[end >= 0]
            before[end] = i_end
            h = before[i]
            h = h[h >= 0]
            left, right = np.concatenate((i_end, h)), np.concatenate((end, after[h]))
            new = self._ranks(symbol[left], symbol[right])
            waits[left] = new
            found = new >= 0
            push(np.concatenate((new[found], np.full(len(more), rank))), np.concatenate((left[found], more)))
        alive = np.zeros(n, bool)
        at = ends - sizes
        while len(at):  # walk all lists in step
            alive[at] = True
            at = after[at]
            at = at[at >= 0]
        ids = symbol[alive].astype("<i4").tobytes()
        bounds = (4 * np.concatenate(([0], np.cumsum(np.bincount(word[alive], minlength=len(pieces)))))).tolist()
        return [ids[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]


class Encoder:
    """Encodes batches of texts; remembers the ids of pieces between single spaces, packed into bytes.

    A single space between two characters that are no white space always starts a match of the pattern, so
    such pieces are encoded alone; a text with other spaces is matched as a whole.
    """

    LONG = 64  # bytes from which a pre-token has a queue of its own

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks, self.single = ranks, Merger(ranks)
        self.many = BatchMerger(ranks, pairs or pair_table(ranks))
        #: Packed ids of pieces, None for one that cannot stand alone; the memo before this one lends what it has.
        self.pieces: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        #: Only a pattern with the optional space before each kind of run allows the split.
        self.splits = all(x in pattern for x in (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces, self.older = {}, self.pieces
        split, wanted = [], set()
        for text in texts:
            first, *rest = text.split(" ") if self.splits else [text]
            if first and first[-1].isspace():
                first, rest = text, []
            split.append((self.find(first), rest))
            wanted.update(rest)
        heads = {token for head, _ in split for token in head}
        ids, known = self._learn(wanted.difference(self.pieces), heads), self.pieces
        out = []
        for text, (head, rest) in zip(texts, split, strict=True):
            try:
                packed = b"".join([*map(ids.__getitem__, head), *map(known.__getitem__, rest)])
            except TypeError:  # a space beside white space: the text is matched as a whole
                tokens = self.find(text)
                packed = b"".join(map(self._packed({*tokens}).__getitem__, tokens))
            out.append(np.frombuffer(packed, "<i4"))
        return out

    def _learn(self, pieces: set[str], tokens: set[str]) -> dict[str, bytes]:
        """Remember new pieces; the packed ids of the tokens."""
        known, older, alone, several = self.pieces, self.older, [], []
        for piece in pieces:
            if piece in older:
                known[piece] = older[piece]
            elif piece.isalpha() and (piece.isascii() or max(piece) < "\u0250"):
                alone.append(piece)  # one run of letters: one match
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                known[piece] = None
            else:
                several.append((piece, self.find(" " + piece)))
        ids = self._packed({" " + piece for piece in alone}.union(tokens, *(found for _, found in several)))
        for piece in alone:
            known[piece] = ids[" " + piece]
        for piece, found in several:
            known[piece] = b"".join(map(ids.__getitem__, found))
        return ids

    def _packed(self, tokens: set[str]) -> dict[str, bytes]:
        ids: dict[str, bytes] = {}
        short: dict[str, bytes] = {}
        for token in tokens:
            raw = token.encode("utf-8")
            if raw in self.ranks:
                ids[token] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > self.LONG:
                ids[token] = np.array(self.single.encode(raw), "<i4").tobytes()
            else:
                short[token] = raw
        if short:
            ids.update(zip(short, self.many.packed(list(short.values())), strict=True))
        return ids


def _ids_of(encoder: Encoder, texts: pa.Array) -> pa.Array:
    ids = encoder.encode([value or "" for value in texts.to_pylist()])
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _bytes_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and where each id begins."""
    tokens = [b""] * (max(ranks.values(), default=0) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def _bytes_of(lists: pa.Array, data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    lists = pc.fill_null(lists, []) if lists.null_count else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(flat) and (flat.min() < 0 or flat.max() >= len(bounds) - 1 or (bounds[flat + 1] == bounds[flat]).any()):
        raise ValueError("an id is not in the vocabulary")
    parts = [np.zeros(0, np.uint8)]
    for at in range(0, len(flat), 1 << 18):  # gather the bytes of many tokens at once
        some = flat[at : at + (1 << 18)]
        size = bounds[some + 1] - bounds[some]
        ends = np.cumsum(size)
        parts.append(data[np.repeat(bounds[some] - ends + size, size) + np.arange(ends[-1])])
    sums = np.concatenate(([0], np.cumsum(bounds[flat + 1] - bounds[flat])))
    offsets = sums[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate(parts).tobytes())])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "ids", keep: Sequence[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add the token ids of each whole text as ``array<int>``; null and empty texts have no ids.

    Each match of ``pattern`` is encoded separately, without special tokens.  Rows are independent, so nothing
    is shuffled; repeated rows stay repeated.  A column named like ``into`` is replaced.  The vocabulary is
    broadcast: its size is fixed by the tokenizer, not by the data.  With ``decoded``, a column of that name holds what
    the ids decode to, as :func:`decode` gives it, in the same pass over the rows.
    """
    shared = df.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks), _bytes_table(ranks) if decoded else None))
    new = [T.StructField(into, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]

    def make(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        known, pairs, table = shared.value
        encoder = Encoder(known, pattern, pairs)
        for batch in texts:
            parts = [_ids_of(encoder, some) for some in slices(batch, 2 << 20)] or [_ids_of(encoder, batch)]
            back = [pa.concat_arrays([_bytes_of(ids, *table) for ids in parts])] if table else []
            yield [pa.concat_arrays(parts), *back]

    return add_columns(df, text, T.StructType(new), make, keep)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the bytes that the token ids stand for; null ids give empty bytes, an unknown id is an error."""
    shared = df.sparkSession.sparkContext.broadcast(_bytes_table(ranks))

    def make(lists: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for batch in lists:
            yield [_bytes_of(batch, *shared.value)]

    return add_columns(df, ids, T.StructType([T.StructField(into, T.BinaryType())]), make, keep)


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the public byte-level vocabulary, or of another rank file."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    ranks, pattern = vocabulary()
    both = encode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, pattern, keep=["doc_id"], decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def normalise_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their token ids, and the text as its ids decode."""
    ranks, pattern = vocabulary()
    back = encode(docs, ranks, pattern, decoded="decoded", keep=[c for c in docs.columns if c != "text"])
    added = back.withColumns({"text": F.col("decoded").cast("string"), "n_tokens": F.size("ids").cast("long")})
    return added.select(*[F.col(f"`{c}`") for c in docs.columns], "ids", "n_tokens")


QUERIES = {"op3_byte_level_bpe": op3_byte_level_bpe}
ORACLES: dict[str, str] = {}
