"""Line deduplication by a segment-partition edit join, in DataFrame functions but for counts of characters.

A line has ``edits`` + 1 segments of a size that its class of lengths fixes: the first ones are measured from its
beginning, the others from its end.  Of two lines within that many edits, some segment i has no edit, exactly i
edits before and at most ``edits`` - i after it.  So it moves by at most i places from the beginning, or ``edits`` - i
from the end, whatever the lengths: a line is looked up by (edits + 1)^2 / 2 substrings, and by those of the class
below only near its border.  Where many lines share a segment and one edit is allowed, the rest is cut in halves,
one of which has no edit either, until few lines share all but a rest.  Where more edits are allowed, the counts of
a line's characters are cut in 2 edits + 1 groups, one of which no edit touches; such lines meet only if they also
share a group, if no more characters are new in the longer one than edits are allowed, and if they are not linked
already by the line of their crowd that is in most crowds, with which each is compared first.  Candidates are verified
by a banded bit-parallel automaton.  Lines are shuffled as hashes; only the texts of candidate lines are fetched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftwell.llm.common import fresh, materialise, table, without
from siftwell.llm.components import components
from siftwell.session import fits

EDITS = 1
SHORTEST = 20
"""Code points from which a line takes part; shorter ones repeat by nature and are never removed."""
BY_LENGTH = ((20, 1), (40, 3), (80, 4))
"""``(code points from which, edits)``: what the pipeline uses, so that a changed word in a long line is found as well."""

STEPS = 2
"""Classes of lengths from one length to its double."""
MANY = 32
"""Lines that may share a segment before the rest of each is cut further; rows do not depend on it."""
FEW = 8
"""The same where more edits are allowed, before lines are told apart by their characters; rows do not depend on it."""
KINDS, PLACES, MOST = 32, 3, 127
"""Classes of characters that are counted, places where lines are parted, and where counts end: cut counts differ by no more than whole ones."""
SPANS = sorted({int(2 ** (k / 4)) for k in range(4, 100)})
"""Numbers of characters that are compared from both ends: the largest that a line has, mostly the same for one a few characters longer."""
OWN, SINGLE, LAST = 1, 2, 4
"""Low bits of a key: a segment of the line itself; one edit is allowed; the segment at the end of such a line."""


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _bands(edits: int | Sequence[tuple[int, int]], shortest: int) -> list[tuple[int, int | None, int]]:
    """``(from, to, edits)``: the lengths that share a number of edits; the last band has no end."""
    steps = [(shortest, edits)] if isinstance(edits, int) else sorted(edits)
    return [(low, high, n) for (low, n), (high, _) in zip(steps, [*steps[1:], (None, 0)], strict=True)]


def _within(length: Column, low: int, high: int | None) -> Column:
    return (length >= low) if high is None else (length >= low) & (length < high)


def _class(length: Column, least: int) -> Column:
    """The smallest length of a length's class: ``STEPS`` classes from ``least`` to its double, and so on."""
    octave = F.pow(F.lit(2), F.length(F.bin(F.floor(length / least))) - 1).cast("bigint") * least
    return F.floor(F.floor(length * STEPS / octave) * octave / STEPS).cast("int")


def _size(length: Column, least: int, edits: int) -> Column:
    """Length of a segment."""
    return F.floor(_class(length, least) / (edits + 1)).cast("int")


def _keys(line: Column, length: Column, bands: list[tuple[int, int | None, int]]) -> Column:
    """``array<bigint>``: hashes of the own segments, and of the other substrings by which this line finds shorter or equal ones.

    The number of edits is that of the shorter line, so a line is looked up in each class that a shorter one may have,
    once per class.  The lowest bits of a key say what it is.
    """
    found, none = [], F.array().cast("array<bigint>")
    for least, most, edits in bands:
        for delta in range(edits + 1):
            shorter = length - delta
            size, keys = _size(shorter, least, edits), []
            for i in range(edits + 1):
                first, reach = (size * i, i) if i <= edits // 2 else (length - size * (edits + 1 - i), edits - i)
                for shift in range(-reach, reach + 1):
                    mark = (OWN if delta == 0 and shift == 0 else 0) + ((SINGLE + LAST * i) if edits == 1 else 0)
                    key = F.xxhash64(_class(shorter, least), F.lit(i), F.substr(line, (first + (shift + 1)).cast("int"), size))
                    keys.append(key.bitwiseAND(F.lit(~7)).bitwiseOR(F.lit(mark)))
            here = _within(shorter, least, most)
            if delta:
                here = here & (~_within(shorter + 1, least, most) | (_class(shorter, least) != _class(shorter + 1, least)))
            found.append(F.when(here, F.array(*keys)).otherwise(none))
    return F.concat(*found)


def _has(bit: int) -> Column:
    return F.col("k").bitwiseAND(F.lit(bit)) != 0


def _rest(bands: list[tuple[int, int | None, int]]) -> Column:
    """What a line has beside the shared segment of key ``k``, where one edit is allowed."""
    looked_up = F.col("length") - F.when(_has(OWN), 0).otherwise(1)
    size = F.coalesce(*[F.when(_within(looked_up, least, most), _size(looked_up, least, edits)) for least, most, edits in bands if edits == 1])
    return F.when(_has(LAST), F.substr("line", F.lit(1), (F.col("length") - size).cast("int"))).otherwise(F.substr("line", size + 1))


def _halves() -> Column:
    """``array<struct<key, own, rest>>``: the halves of a rest as keys within the group so far, own ones and those of a rest shorter by one."""
    found, n = [], F.length("rest")
    for delta in (0, 1):
        half, far = F.floor((n - delta) / 2).cast("int"), (n - delta - F.floor((n - delta) / 2)).cast("int")
        left, right = F.substr("rest", F.lit(1), half), F.substr("rest", n - far + 1)
        for side, piece, rest in ((0, left, F.substr("rest", half + 1)), (1, right, F.substr("rest", F.lit(1), n - far))):
            key = F.xxhash64("key", n - delta, F.lit(side), piece)
            found.append(F.when(n >= delta, F.struct(key.alias("key"), F.lit(delta == 0).alias("own"), rest.alias("rest"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


@F.arrow_udf(T.ArrayType(T.ByteType()))
def _counts(line: pa.Array) -> pa.Array:
    """How many characters of each class a line has, cut at ``MOST``, ``1 + PLACES`` times ``KINDS`` counts.

    First of the whole line, by the code point modulo ``KINDS``; then, for each place that parts the line's span (``SPANS``),
    of as many characters from the beginning and of the rest of the span from the end, each by half as many classes.
    """
    spans = np.array(SPANS)
    found = np.zeros((1 + PLACES, len(line), KINDS), dtype="int64")
    for start in range(0, len(line), 1024):
        part = line.slice(start, 1024).to_pylist()
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("int64")
        sizes = np.array([len(x) for x in part])
        row = np.repeat(np.arange(len(part)), sizes)
        before = np.arange(len(points)) - (sizes.cumsum() - sizes)[row]
        after, span = sizes[row] - before, spans[np.searchsorted(spans, sizes, "right") - 1][row]

        def sums(where, kind):
            return np.bincount(row[where] * KINDS + kind[where], minlength=len(part) * KINDS).reshape(-1, KINDS)

        here = slice(start, start + len(part))
        found[0, here] = sums(slice(None), points % KINDS)
        for place in range(1, PLACES + 1):
            cut = span * place // (PLACES + 1)
            found[place, here] = sums(before < cut, points % (KINDS // 2)) + sums(after <= span - cut, points % (KINDS // 2) + KINDS // 2)
    flat = np.minimum(found, MOST).astype("int8").transpose(1, 0, 2).ravel()
    return pa.FixedSizeListArray.from_arrays(pa.array(flat), (1 + PLACES) * KINDS).cast(pa.list_(pa.int8()))


def _span_column(length: Column) -> Column:
    return F.array_max(F.filter(F.array(*[F.lit(x) for x in SPANS]), lambda x: x <= length))


def _alike(bands: list[tuple[int, int | None, int]]) -> Column:
    """``array<bigint>``: keys within a key, by the groups of ``counts``: an edit changes two counts at most, so one group stays."""
    groups = 2 * max(edits for _, _, edits in bands) + 1
    return F.array(*[F.xxhash64("key", F.lit(j), *[F.get("counts", F.lit(c)) for c in range(j, KINDS, groups)]) for j in range(groups)])


def _may_link(a: str, b: str, allowed: Column) -> Column:
    """Whether two lines may be linked, by their counts: each character that ``b`` has and ``a`` has not takes an edit.

    So does each on either side of a place: the first characters of both lines, the same number, differ by no more
    than the edits among them, and the last ones by no more than the edits there.
    """
    def new(part: int) -> Column:
        x, y = (F.slice(c, part * KINDS + 1, KINDS) for c in (a, b))
        return F.aggregate(F.zip_with(x, y, lambda x, y: F.greatest(y.cast("int") - x.cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)

    sides = [new(place) <= allowed for place in range(1, PLACES + 1)]
    return (new(0) <= allowed) & ((F.col("a_span") != F.col("b_span")) | reduce(lambda x, y: x & y, sides))


def _to_middle(many: DataFrame, counted: DataFrame, allowed: Column) -> DataFrame:
    """``a, b``: each line of a crowded key with that line of it which is in most such keys, if their counts allow a link."""
    weight = many.groupBy("h").agg(F.count("*").alias("w"))
    middle = many.join(weight, "h").groupBy("key").agg(F.max(F.struct("w", "h", "length")).alias("m")).select("key", F.col("m.h").alias("h"), F.col("m.length").alias("length"))
    one = F.struct("length", "h", "span", "counts")
    middle = _if_small(materialise(middle.join(counted, ["h", "length"]).select("key", one.alias("m")), "middle"))
    both = many.join(counted, ["h", "length"]).select("key", one.alias("x")).join(middle, "key").where("x.h <> m.h")
    both = both.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).withColumns({f"{x}_{c}": F.col(f"{x}.{c}") for x in "ab" for c in ("length", "span")})
    near = (F.col("b_length") <= F.col("a_length") + allowed) & _may_link("a.counts", "b.counts", allowed)
    return both.where(near).select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()


def _pairs(rows: DataFrame, allowed: Column) -> DataFrame:
    """``a, b``: lines that share a key by which ``a``, not the longer, is found; of equal lengths the smaller hash is ``a``.

    Where rows have ``counts``, only those of different ``root`` that may be linked by their counts, once.
    """
    counted = ["counts", "span", "root", "alike", "j"] if "counts" in rows.columns else []
    own = rows.where("own").select("key", F.col("h").alias("a"), F.col("length").alias("a_length"), *[F.col(c).alias(f"a_{c}") for c in counted])
    probe = rows.select("key", F.col("h").alias("b"), F.col("length").alias("b_length"), *[F.col(c).alias(f"b_{c}") for c in counted])
    near = F.col("b_length").between(F.col("a_length"), F.col("a_length") + allowed) & ((F.col("b_length") > F.col("a_length")) | (F.col("a") < F.col("b")))
    if counted:
        near = near & (F.col("a_root") != F.col("b_root")) & _may_link("a_counts", "b_counts", allowed)
        near = near & (F.array_position(F.zip_with("a_alike", "b_alike", lambda x, y: x == y), True) == F.col("a_j") + 1)
    return own.join(probe, "key").where(near).select("a", "b")


def _crowded(rows: DataFrame, enough: Column | None = None, many: Column | int = MANY) -> DataFrame:
    """``key``: the keys that more than ``many`` rows share, stored."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), *([] if enough is None else [F.max(enough).alias("cut")]))
    return materialise(sizes.where(F.col("n") > many).where("true" if enough is None else "cut").select("key"), "crowded")


def _if_small(df: DataFrame) -> DataFrame:
    """A stored frame with a broadcast hint if its measured rows fit."""
    return F.broadcast(df) if fits(df) else df


def _texts(rows: DataFrame, distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, line`` of the wanted hashes, each read at its first place, stored."""
    places = materialise(distinct.join(wanted, "h").select("h", F.col("first.rid").alias("rid"), F.col("first.pos").alias("pos")), "places")
    return materialise(rows.join(_if_small(places), "rid").select("h", F.get(_split(F.col("text")), F.col("pos")).alias("line")), "texts")


def _candidates(rows: DataFrame, distinct: DataFrame, bands: list[tuple[int, int | None, int]]) -> DataFrame:
    """``a, b``: hashes of lines that share a segment; where many do, also all but a rest that few share, or most characters.

    Pairs that links among the others already join are left out.
    """
    allowed = reduce(lambda other, band: F.when(_within(F.col("a_length"), *band[:2]), band[2]).otherwise(other), bands, F.lit(-1))
    keyed = distinct.select("h", "length", F.explode("keys").alias("k"))
    keyed = keyed.select("h", "length", "k", F.col("k").bitwiseAND(F.lit(~OWN)).alias("key"), _has(OWN).alias("own"))
    crowded = _crowded(keyed, many=F.when(F.col("key").bitwiseAND(F.lit(SINGLE)) != 0, MANY).otherwise(FEW))
    found = [_pairs(keyed.join(crowded, "key", "left_anti"), allowed)]
    several = crowded.where(F.col("key").bitwiseAND(F.lit(SINGLE)) == 0)
    if not several.isEmpty():
        many = materialise(keyed.join(several, "key").select("h", "length", "key", "own"), "several")
        texts = _texts(rows, distinct, many.select("h").distinct())
        counted = materialise(texts.select("h", F.length("line").alias("length"), _counts("line").alias("counts")), "counted")
        counted = counted.withColumn("span", _span_column(F.col("length")))
        links = _links(_to_middle(many, counted, allowed), texts, bands)
        roots = components(links).withColumnRenamed("node", "h")
        counted = materialise(counted.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "rooted")
        # a line is in one crowd, whatever the number of crowded keys it shares, and a pair is found by its first common group
        crowds = components(many, "h", "key").select(F.col("node").alias("h"), F.col("root").alias("key"))
        parts = counted.join(crowds, "h").withColumn("alike", _alike(bands)).drop("key").select("*", F.lit(True).alias("own"), F.posexplode("alike").alias("j", "key"))
        found += [_pairs(parts, allowed), links]
    crowded = crowded.where(F.col("key").bitwiseAND(F.lit(SINGLE)) != 0)
    if not crowded.isEmpty():
        many = materialise(keyed.join(crowded, "key"), "many")
        texts = _texts(rows, distinct, many.select("h").distinct())
        state = materialise(many.join(texts, "h").where(F.length("line") == F.col("length")).select("h", "length", "key", _rest(bands).alias("rest")), "rest")
        while True:
            cut = materialise(state.select("h", "length", F.explode(_halves()).alias("x")).select("h", "length", "x.*"), "halves")
            crowded = _crowded(cut, F.length("rest") > 2)  # a longer rest gets shorter each time
            found.append(materialise(_pairs(cut.join(crowded, "key", "left_anti"), allowed), "few"))
            if crowded.isEmpty():
                break
            state = cut.join(crowded, "key").drop("own")
    return materialise(reduce(DataFrame.union, found).distinct(), "pairs")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shared(a: Column, b: Column) -> Column:
    """Number of equal elements at the beginning of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are at most ``edits`` insertions, deletions and substitutions apart.

    What they share at beginning and end is left out.  On the rest, bit d of state k after j characters of ``b``
    says that the first j + d - edits characters of ``a`` are at most k edits from them: a band of 2 edits + 1
    diagonals in one word, for all of which a step is a few bit operations.  An empty state stays empty.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def chars(x: Column) -> Column:
        return F.filter(F.split(x, ""), lambda c: c != "")  # an empty line has no character

    def step(own: Column):
        def of(state: Column, c: Column) -> Column:
            equal = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.get(own, state["j"] + (d - edits)) == c, 1 << d).otherwise(0) for d in range(width)])
            rows: list[Column] = []
            for k in range(edits + 1):
                now = state[f"r{k}"].bitwiseAND(equal)
                if k:
                    before = state[f"r{k - 1}"]
                    now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(rows[k - 1], 1)).bitwiseAND(F.lit(mask))
                rows.append(now)
            return F.when(state[f"r{edits}"] == 0, state).otherwise(F.struct((state["j"] + 1).alias("j"), *[r.alias(f"r{k}") for k, r in enumerate(rows)]))

        return of

    def automaton(core: Column) -> Column:
        start = F.struct(F.lit(0).alias("j"), *[F.lit(sum(1 << (edits + x) for x in range(k + 1))).alias(f"r{k}") for k in range(edits + 1)])
        gap = F.size(core["a"]) - F.size(core["b"])
        end = F.aggregate(core["b"], start, step(core["a"]), lambda s: s[f"r{edits}"])
        return (F.abs(gap) <= edits) & (F.get(F.array(*[F.lit(1 << d) for d in range(width)]), gap + edits).bitwiseAND(end) != 0)

    def cut(x: Column) -> Column:
        q = F.least(x["q"], F.least(F.size(x["a"]), F.size(x["b"])) - x["p"])
        return F.struct(*[F.slice(x[c], x["p"] + 1, F.size(x[c]) - x["p"] - q).alias(c) for c in "ab"])

    both = F.struct(chars(a).alias("a"), chars(b).alias("b"))
    ends = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _shared(x["a"], x["b"]).alias("p"), _shared(F.reverse(x["a"]), F.reverse(x["b"])).alias("q"))
    return F.coalesce(_let(both, lambda x: _let(ends(x), lambda y: _let(cut(y), automaton))), F.lit(False))


def _links(pairs: DataFrame, texts: DataFrame, bands: list[tuple[int, int | None, int]]) -> DataFrame:
    """``a, b``: the pairs that are within as many edits as the shorter line allows, stored."""
    left, right = (texts.select(F.col("h").alias(x), F.col("line").alias(f"{x}_line")) for x in "ab")
    shorter = F.least(F.length("a_line"), F.length("b_line"))
    close = [_within(shorter, *band[:2]) & within_edits(F.col("a_line"), F.col("b_line"), band[2]) for band in bands]
    return materialise(pairs.join(left, "a").join(right, "b").where(reduce(lambda x, y: x | y, close)).select("a", "b"), "links")


def _lines(rows: DataFrame, shortest: int, short_repeats: bool) -> DataFrame:
    """Each line that takes part: ``rid, id, pos, line, length, h, h2``."""
    takes_part = F.col("line").rlike(r"(?U)\S") | (F.col("length") >= shortest) if short_repeats else F.col("length") >= shortest
    line = rows.select("rid", "id", F.posexplode(_split(F.col("text"))).alias("pos", "line")).withColumn("length", F.length("line")).where(takes_part)
    return line.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int | Sequence[tuple[int, int]] = EDITS, shortest: int = SHORTEST, short_repeats: bool = False) -> DataFrame:
    """``rid, removed``: for each row with lines to remove, its row number and their positions (from 0).

    Lines are what ``\\n`` separates.  Those of at least ``shortest`` code points that are equal, or linked by
    steps of at most ``edits`` edits, form a group; its first occurrence (by key, row, position; null keys first)
    stays and all others go.  ``edits`` may also be ``(code points from which, edits)`` steps, the shorter line of two
    deciding; they replace ``shortest`` for near copies.  With ``short_repeats``, lines below ``shortest`` that are not
    blank take part as well, as exact repeats only.  Null texts have no lines.  The frame must give the same rows in the same order
    when read again, as a table does: ``rid`` is ``monotonically_increasing_id`` over it.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    bands = _bands(edits, shortest)
    lines = _lines(rows, min(shortest, bands[0][0]), short_repeats)
    # one row per distinct line, combined per task first: a line in a third of all rows is no hot key
    first = F.struct("id", "rid", "pos")
    distinct = materialise(lines.groupBy("h", "h2", "length").agg(F.count("*").alias("n"), F.min(first).alias("first"), F.first(_keys(F.col("line"), F.col("length"), bands)).alias("keys")), "lines")
    pairs = _candidates(rows, distinct, bands)
    links = _links(pairs, _texts(rows, distinct, pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()), bands)
    # groups of linked lines by the first hash: lines that share it are linked to the same group only if it collides
    group = components(links).select(F.col("node").alias("h"), "root")
    some = distinct.select("h", "h2", "length", "n", "first").join(group, "h", "left").where("n > 1 OR root IS NOT NULL")
    heads = some.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("head"))
    decided = some.join(heads, "root", "left").select("h", "h2", "length", F.coalesce("head", "first").alias("head"))
    decided = _if_small(materialise(decided, "decided"))
    gone = lines.join(decided, ["h", "h2", "length"]).where((F.col("rid") != F.col("head.rid")) | (F.col("pos") != F.col("head.pos")))
    return gone.groupBy("rid").agg(F.array_sort(F.collect_list("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int | Sequence[tuple[int, int]] = EDITS, shortest: int = SHORTEST, short_repeats: bool = False) -> DataFrame:
    """The documents with repeated lines removed from ``text``, and ``n_lines`` and ``n_removed`` before it.

    See :func:`repeated_lines`.  All other columns stay; columns of the new names are replaced; null texts stay null.
    """
    rid, gone = fresh(docs, "rid"), fresh(docs, "removed")
    removed = materialise(repeated_lines(docs, key, text, edits, shortest, short_repeats), "removed").select(F.col("rid").alias(rid), F.col("removed").alias(gone))
    numbered = without(docs, ["n_lines", "n_removed"]).withColumn(rid, F.monotonically_increasing_id())
    joined = numbered.join(_if_small(removed), rid, "left")
    column = F.col(f"`{text}`")
    kept = F.array_join(F.filter(_split(column), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    counts = {"n_lines": F.when(column.isNull(), 0).otherwise(F.size(_split(column))).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return joined.withColumns(counts).withColumn(text, F.when(F.col(gone).isNull(), column).otherwise(kept)).drop(rid, gone)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines against all lines of all documents."""
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated lines, short ones too; one that had nothing else goes."""
    out = dedup_lines(docs, edits=BY_LENGTH, short_repeats=True)
    return out.where("n_removed < n_lines OR n_removed = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
),
d AS (SELECT line, min(doc_id * 10000000 + i) AS head FROM l WHERE length(line) >= {SHORTEST} GROUP BY line),
e AS (
  SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON length(b.line) - length(a.line) BETWEEN -{EDITS} AND {EDITS} AND a.line <> b.line
  WHERE (left(a.line, {SHORTEST // 2 - EDITS}) = left(b.line, {SHORTEST // 2 - EDITS}) OR right(a.line, {SHORTEST // 2 - EDITS}) = right(b.line, {SHORTEST // 2 - EDITS}))
    AND levenshtein(a.line, b.line) <= {EDITS}
),
r(a, b) AS (SELECT line, line FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT r.a AS line, min(d.head) AS head FROM r JOIN d ON r.b = d.line GROUP BY r.a)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.head <> l.doc_id * 10000000 + l.i) AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.head IS NULL OR g.head = l.doc_id * 10000000 + l.i), '')) AS kept_sha256
FROM l LEFT JOIN g USING (line) GROUP BY l.doc_id"""
}
