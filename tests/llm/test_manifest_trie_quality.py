"""The Merkle manifest, the conversation trie and the quality rules against plain computations on messy rows."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import convtrie, merkle, quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["digest", "RANK", "key", "path", "score", "kept", "counts_", "words", "model_", "n_words", "bucket"]


def crc(value):
    return zlib.crc32(str(value).encode())


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def stored(spark, rows, schema, folder, clash=()):
    path = str(folder / "t.parquet")
    df = spark.createDataFrame(rows, schema)
    df.select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def odd_documents():
    random.seed(5)
    words = ["alpha", "Beta", "été", "日本", "of", "the", "x1", "%%", "a|b"]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randrange(0, 40))), random.choice(["en", None]), "hot" if i % 3 == 0 else f"s{i % 7}", i) for i in range(700)]
    rows += [(None, None, None, None, None), (None, "", "", "", 0), (3, "UP", "en", "hot", 1), (9000, "alone", "en", "single", 2), (-5, "q" * 300_000, "en", "s1", 3), (77, " \n\t", "x", None, 4)]
    return rows + [rows[10]] * 40


# ---------------------------------------------------------------- 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, tampered):
    def leaf(doc_id, text, lang, source, n_chars):
        return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def siblings(tree, rank):
        for nodes in tree[:-1]:
            low = rank - rank % 16
            yield nodes[low:rank], nodes[rank + 1 : low + 16]
            rank //= 16

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in names}
    trees = {s: levels([leaf(*r) for r in ordered[s]]) for s in names}
    upper = levels([trees[s][-1][0] for s in names]) if names else []
    for k, s in enumerate(names):
        for rank, (doc_id, text, *rest) in enumerate(ordered[s]):
            path = [*siblings(trees[s], rank), *siblings(upper, k)]
            own = leaf(doc_id, text, *rest)
            now = own
            if text is not None and tampered(doc_id):
                now = leaf(doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), text), *rest)
            for left, right in path:
                now = H(*left, now, *right)
            yield doc_id, own, trees[s][-1][0], upper[-1][0], H(*[x for left, right in path for x in left + right]), now, now == upper[-1][0]


def tampered(doc_id):
    return doc_id is not None and crc(doc_id) % 5 == 0


@pytest.mark.parametrize("rows", ["odd", "one", "none", "one_source"])
def test_manifest(spark, tmp_path, rows):
    data = {"odd": odd_documents(), "one": odd_documents()[5:6], "none": [], "one_source": [(i, f"T {i}", "en", None, 1) for i in range(258)]}[rows]
    docs = stored(spark, data, DOCS, tmp_path, CLASH)
    want = list(brute_manifest(data, tampered))
    same(merkle.verify(docs, merkle.every_fifth(F.col("doc_id"))).collect(), want)
    if rows == "odd":
        assert {w[-1] for w in want} == {True, False}


def test_manifest_store_and_single_requests(spark, tmp_path):
    """Each record's key is the hash of its children, and asking for some leaves gives the proofs that asking for all gives."""
    docs = stored(spark, odd_documents(), DOCS, tmp_path)
    manifest = merkle.build_manifest(merkle.leaves_of(docs), ["doc_id"])
    records = manifest.records().collect()
    assert len({r.digest for r in records}) == len(records) and all(H(*r.children) == r.digest for r in records)
    assert manifest.root().first().root in {r.digest for r in records}
    every = merkle.descend(manifest)
    assert every.select(merkle.fold(F.col("leaf"), F.col("path")).alias("r")).distinct().collect() == manifest.root().collect()
    wanted = spark.createDataFrame([("=hot", 0), ("=hot", 17), ("=single", 0), ("", 1), ("=hot", 10**6)], "key string, rank long")
    some = merkle.descend(manifest, wanted).collect()
    assert len(some) == 4
    proofs = {(r.doc_id, r.leaf): r for r in every.collect()}
    assert all(proofs[r.doc_id, r.leaf].path == r.path or r.doc_id == 10 for r in some)


def test_ranks_with_equal_rows(spark, tmp_path):
    rows = [("a", 1)] * 50 + [("b", i % 5) for i in range(30)] + [("c", None)]
    df = stored(spark, rows, "key string, o long", tmp_path)
    got = merkle.ranked(df, "key", ["o"]).collect()
    for k, n in (("a", 50), ("b", 30), ("c", 1)):
        of = sorted((r["rank"], r["o"] or 0) for r in got if r["key"] == k)
        assert [x[0] for x in of] == list(range(n)) and [x[1] for x in of] == sorted(x[1] for x in of)


# ---------------------------------------------------------------- 11


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0, role, code), (role, text)))
    own = {c: [x[1] for x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    rebuilt = {c: own.get(int(c - np.fmod(c, 20)), [])[: crc(c) % 4] + own[c][crc(c) % 4 :] for c in own}
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    below = collections.defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    for node, convs in members.items():
        children = [n for n in below[node] if len(n) == len(node) + 1]
        leaf = [n for n in below[node] if len(below[n]) == 1]
        saved = sum((len(members[n]) - 1) * len(SPACE.findall(n[-1][1])) for n in below[node] if n)
        ends = hashlib.sha256(",".join(str(c) for c in convs if len(rebuilt[c]) == len(node)).encode()).hexdigest()
        yield convs[0], len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaf), saved, ends


def odd_conversations():
    random.seed(9)
    rows = []
    for c in [*range(-45, 130), 10**15]:
        turns = random.choice([1, 2, 3, 5, 8])
        rows += [(c, t, random.choice(["user", "assistant", None]), random.choice(["a b", "a  b", "", None, "hello there you"])) for t in range(turns)]
    rows += [(c, t, "user", "copied text") for c in range(200, 260) for t in range(4)]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "eit"), (7, None, "user", "first"), (7, 0, "user", "tie"), (None, 0, "user", "x"), (300, None, None, None), (301, 1, "user", "w " * 100_000)]
    rows += [(302, t, "user", f"turn {t % 3}") for t in range(400)] + [(303, t, "user", f"turn {t % 3}") for t in range(390)]
    return rows


@pytest.mark.parametrize("turns, piece", [(200_000, 1 << 16), (9, 20), (1, 1)])
def test_trie(spark, tmp_path, monkeypatch, turns, piece):
    monkeypatch.setattr(convtrie, "SHARD_TURNS", turns)
    monkeypatch.setattr(convtrie, "PIECE", piece)
    rows = odd_conversations()
    df = stored(spark, rows, "conv_id long, turn long, role string, text string", tmp_path, ["blob", "N", "ends", "turns", "first", "words"])
    same(convtrie.conversation_trie(df).collect(), brute_trie(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_trie_without_conversations(spark, tmp_path, rows):
    df = stored(spark, rows, "conv_id long, turn long, role string, text string", tmp_path)
    assert convtrie.conversation_trie(df).collect() == []


def test_trie_of_one_turnless_conversation(spark, tmp_path):
    """Conversation 1 takes over its first turns from conversation 0, which is absent."""
    assert crc(1) % 4 > 0
    df = stored(spark, [(1, 0, "user", "gone")], "conv_id long, turn long, role string, text string", tmp_path)
    none = hashlib.sha256(b"1").hexdigest()
    assert [tuple(r) for r in convtrie.conversation_trie(df).collect()] == [(1, 0, None, 1, 0, 1, 0, none)]


def test_ternary_tree_is_balanced_by_medians():
    tree = convtrie.TernaryTree()
    for i in convtrie.median_order(1023):
        tree.insert([i], [1])
    depth = [0] * len(tree.code)
    for node in range(1, len(tree.code)):
        for child in (tree.low[node], tree.high[node]):
            depth[child] = depth[node] + 1 if child else 0
    assert max(depth) == 9 and [tree.code[n] for n in tree.in_order()] == list(range(-1, 1023))


# ---------------------------------------------------------------- 12


def brute_counts(text):
    text = text or ""
    words, seen, lines = SPACE.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def brute_quality(docs, labels):
    def buckets(text):
        codes = [crc(w) for w in SPACE.findall(text or "")]
        return [c % quality.BUCKETS for c in codes] + [(a * quality.MIX + b) % quality.BUCKETS for a, b in zip(codes, codes[1:])]

    marks = collections.defaultdict(list)
    for doc_id, mark in labels:
        if doc_id is not None and crc(doc_id) % 3 != 1:
            marks[doc_id].append(mark)
    good = {d: min(x for x in m if x is not None) for d, m in marks.items() if any(x is not None for x in m)}
    good = {d: m == 1 for d, m in good.items() if m in (0, 1)}
    cut = min(1 << 32, (quality.TRUSTED << 32) // max(1, sum(good.values())))
    raw, target = collections.Counter(), collections.Counter()
    for doc_id, text in docs:
        raw.update(buckets(text))
        if good.get(doc_id) and crc(doc_id) < cut:
            target.update(buckets(text))
    total_raw, total_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = {b: round(float(np.log(((target[b] + 1) / total_target) / ((n + 1) / total_raw))) * quality.UNIT) for b, n in raw.items()}
    scores = []
    for _, text in docs:
        found = buckets(text)
        scores.append(sum(weight[b] for b in found) // len(found) if found else None)
    means = []
    for kind in (True, False):
        own = [s for (d, _), s in zip(docs, scores) if s is not None and good.get(d) is kind]
        means.append(Fraction(sum(own), len(own)) if own else None)
    least = None if None in means else sum(means) / 2
    for (doc_id, text), score in zip(docs, scores):
        n, chars, symbols, lines, repeats = brute_counts(text)
        failed = n < 10 or 100 * repeats > 20 * n
        yield doc_id, n, chars, symbols, lines, repeats, failed, bool(not failed and (least is None or score >= least))


def labels_of(rows):
    random.seed(2)
    marks = [(r[0], 0 if "%%" in (r[1] or "") and random.random() < 0.9 else 1) for r in rows if random.random() < 0.7]
    return [*marks, (1, 0), (1, 1), (2, None), (None, 1), (4, None), (4, 1), (10**9, 1)]


@pytest.mark.parametrize("case", ["odd", "none", "no_bad_labels", "few_trusted"])
def test_quality(spark, tmp_path, monkeypatch, case):
    line = "one two three four five six seven\n"
    rows = [] if case == "none" else [*odd_documents(), (5000, line * 3 + "\n \n" + line, "en", "s", 1), (5001, "w " * 50_000, "en", "s", 1), (5002, "a b c d e f g a b c d e x y z q", "en", "s", 1)]
    marks = labels_of(rows)
    if case == "no_bad_labels":
        marks = [(d, 1) for d, _ in marks]
    if case == "few_trusted":
        monkeypatch.setattr(quality, "TRUSTED", 40)
    docs = stored(spark, rows, DOCS, tmp_path, CLASH)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.judge(docs, labels).select("doc_id", *quality.NEW[:-1]).collect()
    want = list(brute_quality([(r[0], r[1]) for r in rows], marks))
    same(got, want)


def test_quality_finds_held_out_junk(spark):
    """Documents whose labels were not learned from: bad ones go, good ones that pass the counts stay."""
    from siftwell.llm.common import held_out, table

    judged = quality.judge(table(spark, SF.replace("0.001", "0.01"), "documents", "doc_id", "text"), table(spark, SF.replace("0.001", "0.01"), "labels", "doc_id", "quality"))
    labels = table(spark, SF.replace("0.001", "0.01"), "labels", "doc_id", "quality").where(held_out(F.col("doc_id")))
    found = {(r.quality, r.kept): r.n for r in judged.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert found.get((1, False), 0) <= 0.02 * found[1, True] and found.get((0, True), 0) <= 0.2 * found[0, False]
