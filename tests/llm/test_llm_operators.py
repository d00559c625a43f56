"""Each operator against a plain computation, on messy rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from siftwell.llm import bpe, chat, components, decontaminate, jaccard, language, lines, substrings, tokencount, topk, toxicity

SF = "/root/testdata/sf0.001"
EXTRA = ["score", "ids", "rid", "__rid", "key", "__text", "LANG_PRED", "removed", "N_Words", "items", "spans", "kept", "class", "h", "decoded", "n_lines", "evidence"]


def _rows():
    random.seed(11)
    words = ["alpha", "Beta", "gamma", "delta", "été", "zürich", "of", "the", "x1", "日本"]
    base = [" ".join(random.choice(words) for _ in range(n)) for n in (1, 3, 5, 8, 60, 90, 400)]
    near = base[5].split(" ")
    near[40] = "changed"
    line = "a line that is long enough to be compared"
    texts = [None, "", " ", "\n\n", "12 34 !!", *base, *base[:5], " ".join(near), f"{line}\nshort\nother", f"{line}!\nshort\n{line}", line, "\0 odd \x1c\x85 bytes", "word " * 60_000, "q" * 200_000, "😀" * 90]
    rows = [(i, t, random.choice(["en", "fr", None]), "s", 1) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, base[4], "en", None, None), (None, None, None, None, None), (-3, base[6], "de", "s", 2)]


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    """A stored table of odd rows with columns named like those that the operators add or use inside."""
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    df = spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    df.select("*", *[F.lit(1).alias(c) for c in EXTRA]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(messy, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    messy.where("false").write.parquet(path)
    return spark.read.schema(messy.schema).parquet(path)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


# 1


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    group = list(range(len(rows)))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted_rows((rows[i][0], len(sets[i]), least[group[i]], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("limits", [{}, {"GROUP": 2, "TILE_BYTES": 600, "HEAVY": 3, "BUCKET_ENTRIES": 400}])
def test_near_duplicates(messy, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.near_duplicates(messy).collect()
    assert sorted_rows(got) == brute_components([(r.doc_id, r.text) for r in messy.collect()])


def test_near_duplicates_of_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted_rows(jaccard.near_duplicates(docs).collect()) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_trie_join_with_sides():
    rng = np.random.default_rng(4)
    base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
    sets = list({s.tobytes(): s for s in (np.unique(np.concatenate((rng.permutation(base)[: rng.integers(45, 60)], rng.choice(10_000, rng.integers(0, 8)).astype(np.uint64)))) for _ in range(40))}.values())
    weights, side = rng.integers(1, 4, len(sets)), rng.integers(0, 2, len(sets))
    for sides in (None, side):
        degree, label = jaccard.trie_join(sets, weights, sides)
        want = np.zeros(len(sets), np.int64)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                n = len(np.intersect1d(a, b))
                if i != j and 100 * n >= 80 * (len(a) + len(b) - n) and (sides is None or side[i] != side[j]):
                    want[i] += weights[j]
                    assert label[i] == label[j]
        assert degree.tolist() == want.tolist()


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 3), (9, 8), (8, 10), (None, 3), (7, 7), (10, 2), (5, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 7, 2: 2, 8: 2, 9: 2, 10: 2}


# 2


def test_decontamination(spark, messy, monkeypatch):
    items = spark.createDataFrame([(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "ZÜRICH été"), (4, " ".join(["word"] * 30)), (5, "!!"), (6, "q" * 200_000)], "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = []
    for r in messy.collect():
        own, hit, found, spans = words(r.text), set(), set(), []
        for item in items.collect():
            w = words(item.text)
            n = min(10, len(w))
            for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ():
                for i in range(len(own) - n + 1):
                    if tuple(own[i : i + n]) == window:
                        hit.update(range(i, i + n))
                        found.add("" if item.item_id is None else str(item.item_id))
        want.append((r.doc_id, len(own), len(hit), tuple(sorted(found)), r.source))
    for limit in (decontaminate.AUTOMATON_WINDOWS, 2):
        monkeypatch.setattr(decontaminate, "AUTOMATON_WINDOWS", limit)
        got = decontaminate.find_leaks(messy, items).collect()
        assert sorted_rows((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.source) for r in got) == sorted_rows(want)
        for r in got:
            raw = (r.text or "").encode()
            assert sum(len(words(raw[s:e].decode())) for s, e in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_hit


# 3


def test_bpe_is_exact_and_reversible(messy):
    ranks, pattern = bpe.vocabulary()
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.decode(bpe.encode(messy, ranks, pattern), ranks).collect():
        assert r.ids == exact.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_on_random_pieces():
    ranks, pattern = bpe.vocabulary()
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(5)
    texts = ["".join(random.choice("ab cde  \n\t'sé日🙂123!?. \x1c\x85  th") for _ in range(random.randint(0, 60))) for _ in range(1500)]
    assert [t.tolist() for t in bpe.Encoder(ranks, pattern).encode(texts)] == [exact.encode_ordinary(t) for t in texts]


def test_bpe_with_a_pair_of_lower_rank_than_its_parts():
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 300, b"abc": 3, b"bc": 400, b"ca": 2, b"aa": 5, b"aaa": 1}
    exact = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks={k: v for k, v in ranks.items()}, special_tokens={})
    pieces = ["".join(random.choice("abc") for _ in range(n)) for n in range(1, 60)]
    many = bpe.BatchMerger(ranks, bpe.pair_table(ranks))
    for piece in pieces:
        assert bpe.Merger(ranks).encode(piece.encode()) == exact.encode_ordinary(piece)
    longer = [p.encode() for p in pieces if p.encode() not in ranks]
    assert [list(t) for t in many.encode(longer)] == [exact.encode_ordinary(p.decode()) for p in longer]


# 4


def test_toxicity_learns_and_explains(spark, messy):
    docs = spark.createDataFrame([(i, f"the day was {'vile' if i % 4 == 0 else 'fine'} and number{i} long") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit_joined(docs.where("doc_id < 300"), labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((out[i].score >= 0.7) == (i % 4 == 0) and 0 <= out[i].score <= 1 for i in range(300, 400))
    assert all(k % 4 == 0 for k in out[304].evidence) and out[304].closeness == sorted(out[304].closeness, reverse=True)
    odd = toxicity.score(messy, model).collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd)
    every = toxicity.score(docs, model).collect()
    assert all(r.doc_id not in r.evidence for r in every) and sum(len(r.evidence) > 0 for r in every) > 300
    unkeyed = {r.doc_id: r for r in toxicity.score(docs, model, key="no_such_column").collect()}
    assert sum(i in unkeyed[i].evidence for i in range(300)) > 20
    nothing = toxicity.fit_joined(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(messy, nothing).collect()} == {0.0}


def test_own_labels_do_not_change_a_score(spark):
    """Turning round the label of a learned document, whose id stands twice, leaves its own score as it is."""
    rows = [(i, f"the day was {'vile' if i % 4 == 0 else 'fine'} and so on") for i in range(80)] + [(8, "the day was vile indeed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(80)]
    seen = []
    for own in (1, 0):
        model = toxicity.fit_joined(docs, spark.createDataFrame([(i, own if i == 8 else y) for i, y in labels], "doc_id long, toxic int"))
        index, keys = toxicity.BlockMaxIndex(model.vectors, len(model.terms)), toxicity.rows_of_keys(model.keys)
        near = index.nearest(*toxicity.Vectors(model.terms, model.idf).of("the day was vile and so on"), 15, keys[8])
        seen.append(8 in [model.keys[i] for i in near[0]])
        assert len(keys[8]) == 2
    assert seen == [False, False]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        ids = np.unique(rng.integers(0, 80, rng.integers(0, 12)))
        w = rng.random(len(ids))
        vectors.append((ids, w / np.sqrt((w * w).sum()) if len(ids) else w))
    dense = np.zeros((500, 80))
    for row, (ids, w) in enumerate(vectors):
        dense[row, ids] = w
    index = toxicity.BlockMaxIndex(vectors, 80)
    for row in range(0, 500, 7):
        scores = dense @ dense[row]
        scores[row] = -1
        _, close = index.nearest(*vectors[row], 10, [row])
        assert np.allclose(close, sorted(scores[scores > 0], reverse=True)[:10], atol=1e-5)


# 5


def test_token_counts(spark, messy):
    folder = tokencount.scratch_dir(spark, "tokens")
    path, end = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_256
    tokencount.write_token_files(messy, folder, path, public_tokenizers.PATTERN, end)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted(len(exact.encode_ordinary(r.text or "")) + tokencount.KEY_TOKENS for r in messy.collect())
    for block in (64, 1 << 20):
        assert sorted(r.n_tokens for r in tokencount.scan_token_files(spark, folder, end, head=5, block_bytes=block).collect()) == want


def test_token_counts_keep_their_keys(spark, tmp_path):
    """Null keys, -1, the largest keys, repeated rows, a clashing column name, and an empty table."""
    path, end = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_256
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [(None, "no key"), (-1, "minus one here"), (0, None), (7, "twice"), (7, "twice"), (2**63 - 1, "a b c d"), (-(2**63), "x" * 50), (50256, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(5)).withColumn("ids", F.lit("x"))
    folder = tokencount.scratch_dir(spark, "tokens")
    tokencount.write_token_files(docs, folder, path, public_tokenizers.PATTERN, end)
    found = tokencount.scan_token_files(spark, folder, end, head=tokencount.KEY_TOKENS, block_bytes=16)
    got = found.select(tokencount.key_of(F.col("head")), F.col("n_tokens") - tokencount.KEY_TOKENS).collect()
    assert sorted_rows(got) == sorted_rows((k, len(exact.encode_ordinary(t or ""))) for k, t in rows)
    folder = tokencount.scratch_dir(spark, "tokens")
    tokencount.write_token_files(docs.limit(0), folder, path, public_tokenizers.PATTERN, end)
    assert tokencount.scan_token_files(spark, folder, end, head=5).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan_over_blocks(spark, tmp_path, width):
    random.seed(width)
    want = []
    for f in range(6):
        ids = [random.choice([7, 50256, 50256, 1]) if random.random() < 0.4 else 3 for _ in range([0, 1, 40, 64, 65, 200][f])]
        np.array(ids, f"<u{width}").tofile(tmp_path / f"f{f}.bin")
        start = 0
        for i, x in enumerate(ids):
            if x == 50256:
                want.append((f, start, i - start, tuple(ids[start:i][:2])))
                start = i + 1
        if start < len(ids):
            want.append((f, start, len(ids) - start, tuple(ids[start:][:2])))
    got = tokencount.scan_token_files(spark, str(tmp_path), 50256, width=width, head=2, block_bytes=16).collect()
    assert sorted((int(r.path[-5]), r.start, r.n_tokens, tuple(r.head)) for r in got) == sorted(want)


# 6


def test_language(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    found = language.identify(docs, language.learn_profiles(learn)).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    odd = {r.doc_id: r for r in language.identify(messy, language.learn_profiles(messy)).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in range(5)) and odd[8].lang_pred in ("en", "fr", "de")
    assert {r.lang_pred for r in language.identify(messy, language.learn_profiles(empty)).collect()} == {"und"}


def plain_grams(text):
    counts = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        word = "".join(c for c in word if c.isalpha())
        if word:
            padded = f"_{word}_"
            counts.update(word)
            counts.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return counts


def test_language_by_plain_ranks(spark, messy):
    """Every prediction and score against ranks and distances of plain dictionaries."""
    def number(gram):
        return sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))

    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [r for r in messy.select("doc_id", "text", "lang").collect()]
    rows += [spark.createDataFrame([(1000, "½ x² ²½ 3a ǅ 日本", "odd")], "doc_id long, text string, lang string").first()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sums = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None:
            sums[r.lang].update(plain_grams(r.text))
    ranks = {name: {g: i for i, g in enumerate(sorted(n, key=lambda g: (-n[g], number(g)))[: language.RANKS])} for name, n in sums.items()}
    want = []
    for r in rows:
        own = plain_grams(r.text)
        first = sorted(own, key=lambda g: (-own[g], number(g)))[: language.RANKS]
        if not first:
            want.append((r.doc_id, "und", 0.0))
            continue
        far = sorted((sum(abs(i - ranks[name][g]) if g in ranks[name] else language.RANKS for i, g in enumerate(first)), name) for name in ranks)
        want.append((r.doc_id, far[0][1], round(1 - far[0][0] / far[1][0], 9) if far[1][0] else 0.0))
    got = language.identify(docs, language.learn_profiles(docs, per_language=10**9)).collect()
    assert sorted_rows((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == sorted_rows(want)


# 7


def test_chat_events(spark):
    log = [
        (1, 1, "a", "message", "user", "hi <|im_end|>\n&amp;"), (1, 2, "b", "delta", "assistant", "he"), (1, 3, "b", "delta", None, "llo"), (1, 5, "b", "regenerate", None, None),
        (1, 6, "b", "delta", None, "again"), (1, 4, "a", "edit", None, "hi <|im_start|>"), (1, 7, "c", "message", "user", "gone"), (1, 8, "c", "delete", None, None),
        (2, None, "x", "message", None, None), (2, 1, "y", None, "assistant", "&lt;|"), (None, 1, "z", "message", "sys\ntem", "\n"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    out = chat.render(chat.fold_events(events)).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()}
    assert got == {1: [("user", "hi <|im_start|>"), ("assistant", "again")], 2: [("", ""), ("assistant", "&lt;|")], None: [("sys\ntem", "\n")]}
    assert chat.render(chat.fold_events(events.where("false"))).count() == 0


def test_chat_orders_turns_over_chunks(spark):
    rows = spark.range(300).select((F.col("id") % 2).alias("conv_id"), (F.col("id") * 37 % 300).alias("seq"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    for r in chat.render(rows).withColumn("turns", chat.parse(F.col("formatted"))).collect():
        assert [int(t.text) for t in r.turns] == sorted((i for i in range(300) if i % 2 == r.conv_id), key=lambda i: i * 37 % 300)


# 8


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "HEAD", 30)
    monkeypatch.setattr(topk, "PACK", 64)
    monkeypatch.setattr(topk, "QUERY_PACK", 8)
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(size=24) * (5 if i % 9 == 0 else 1)]) for i in range(400)]
    data += [(i, data[3][1]) for i in range(400, 460)] + [(500, None), (520, [1.0, None]), (540, [float("nan")]), (560, [float("inf")]), (580, [1.0, 2.0]), (600, []), (20, data[7][1])]
    vectors = topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    queries = vectors.where("vec_id % 20 = 0")
    for r in topk.top_products(vectors, queries.union(queries.where("vec_id IN (20, 40)")), 7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ints = [(r.vec_id, np.pad(np.array(r.ints, np.int64), (0, 24 - len(r.ints)))) for r in vectors.collect()]
    for own, q in ints:
        if own % 20 == 0:  # 20 has two vectors, so two lists; rows that stand twice are one query
            want = [(k + 1, i, -s) for v in {tuple(c) for i, c in ints if i == own} for k, (s, i) in enumerate(sorted((-int(np.array(v) @ c), i) for i, c in ints if i != own)[:7])]
            assert sorted(got[own]) == sorted(want)
    none = vectors.where("false")
    assert topk.top_products(none, none).count() == 0


# 9


def brute_repeats(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + n] for b in raw if len(b) < 50_000 for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        if len(b) >= 50_000:
            continue
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((hashlib.sha256(b).hexdigest(), len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"PART": 600, "CHUNK": 900, "BUCKET_ENTRIES": 5, "PIECE": 300}])
def test_substrings(messy, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(substrings, name, value)
    rows = messy.where("length(text) < 20000 OR text IS NULL")
    got = [(hashlib.sha256((r.text or "").encode()).hexdigest(), r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(rows).collect()]
    assert sorted(got) == brute_repeats([r.text for r in rows.collect()])


def test_substrings_of_long_texts(messy):
    got = {r.doc_id: r for r in substrings.remove_repeats(messy.where("length(text) > 20000")).collect()}
    assert all(r.n_bytes == r.n_removed and r.spans == [0, r.n_bytes] for r in got.values()) and len(got) == 2


def test_run_length_index():
    random.seed(2)
    for _ in range(150):
        base = [bytes(random.choice(b"ab") for _ in range(12)) for _ in range(3)]
        contexts = list({b"".join(random.choice(base) for _ in range(random.randint(1, 4)))[random.randint(0, 3) :] for _ in range(random.randint(1, 8))})
        weights, n = np.array([random.choice([1, 1, 2]) for _ in contexts]), random.randint(3, 14)
        seen = collections.Counter()
        for x, k in zip(contexts, weights, strict=True):
            for i in range(len(x) - n + 1):
                seen[x[i : i + n]] += k
        assert [g.tolist() for g in substrings.repeated_starts(contexts, weights, n)] == [[i for i in range(len(x) - n + 1) if seen[x[i : i + n]] > 1] for x in contexts]


# 10


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within_edits(spark, edits):
    random.seed(edits)
    pairs = []
    for _ in range(300):
        a = [random.choice("abé") for _ in range(random.randint(0, 14))]
        b = list(a)
        for _ in range(random.randint(0, edits + 1)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 1)] = random.choice([[], ["a"], ["é"]])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("*", lines.within_edits(F.col("a"), F.col("b"), edits).alias("near"))
    assert all(r.near == (edit_distance(r.a, r.b) <= edits) for r in df.collect())


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, messy, edits, tmp_path):
    random.seed(edits)
    line = [random.choice("abcd ") for _ in range(30)]
    extra = []
    for i in range(60):
        own = list(line)
        for _ in range(random.randint(0, 4)):
            at = random.randint(0, len(own) - 1)
            own[at : at + random.randint(0, 1)] = random.choice([[], ["x"], ["y"]])
        extra.append((1000 + i // 3, "\n".join(["".join(own), "tail", "".join(own)]), None, None, None))
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "d.parquet")
    messy.unionByName(more, allowMissingColumns=True).where("length(text) < 20000 OR text IS NULL").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = docs.collect()
    places = [((r.doc_id is not None, r.doc_id or 0), k, i, x) for k, r in enumerate(rows) if r.text is not None for i, x in enumerate(r.text.split("\n")) if len(x) >= lines.SHORTEST]
    distinct = sorted({p[3] for p in places})
    group = {x: x for x in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if group[a] != group[b] and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                old = group[a]
                group = {x: group[b] if g == old else g for x, g in group.items()}
    head = {}
    for p in sorted(places):
        head.setdefault(group[p[3]], p)
    gone = {(p[1], p[2]) for p in places if head[group[p[3]]] != p}
    want = [(r.doc_id, None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if (k, i) not in gone)) for k, r in enumerate(rows)]
    got = lines.dedup_lines(docs, edits=edits).collect()
    assert sorted_rows((r.doc_id, r.text) for r in got) == sorted_rows(want)


@pytest.mark.parametrize("length", [31, 40, 47])
def test_lines_that_share_much(spark, tmp_path, length):
    """Many variants of one line: halves of halves until few share all but a rest; links are those of brute force."""
    random.seed(length)
    line = [random.choice("abcd ") for _ in range(length)]
    found = {"".join(line)}
    for _ in range(150):  # most are several edits from each other, some one
        own = list(line)
        at = random.randint(0, length - 3)
        own[at : at + random.randint(2, 3)] = random.choices("xyz", k=random.choice([2, 3, 3, 4]))
        found.add("".join(own))
    found |= {x[:at] + random.choice(["", "q", "qq"]) + x[at + 1 :] for x in sorted(found)[::5] for at in (0, length // 2, length - 4)}
    texts = sorted(found)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    group = {x: x for x in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if group[a] != group[b] and abs(len(a) - len(b)) <= 1 and edit_distance(a, b) <= 1:
                old = group[a]
                group = {x: group[b] if g == old else g for x, g in group.items()}
    first = {}
    for k, x in enumerate(texts):
        first.setdefault(group[x], k)
    got = lines.dedup_lines(spark.read.parquet(path)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {k: int(first[group[x]] != k) for k, x in enumerate(texts)}
    assert 5 < len(first) < len(texts) - 5


@pytest.mark.parametrize("length", [60, 130])
def test_crowds_of_near_copies(spark, tmp_path, monkeypatch, length):
    """Many copies of one line, most of them several changes apart: few pairs are compared, and links are those of all pairs."""
    random.seed(length)
    line = "".join(random.choice("abcdefgh ") for _ in range(length))
    found, short = {line}, [line]
    for _ in range(200):
        own = list(line)
        for _ in range(random.randint(2, 3)):
            at = random.randint(0, len(own) - 6)
            own[at : at + random.randint(0, 5)] = random.choices("ijklmnopé", k=random.randint(4, 6))
        short.append("".join(own))
    for x in short:
        found.add(x)
    for x in short[::4]:
        for n in (1, 2, 3, 4, 5):
            own = list(x)
            for at in random.sample(range(len(own)), n):
                own[at] = random.choice(["X", "YZ", ""])
            found.add("".join(own))
    texts = sorted(found)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    least = F.least(F.length("a.text"), F.length("b.text"))
    allowed = F.when(least >= 80, 4).when(least >= 40, 3).otherwise(1)
    near = rows.alias("a").join(rows.alias("b"), (F.col("a.doc_id") < F.col("b.doc_id")) & (F.levenshtein("a.text", "b.text") <= allowed))
    root = list(range(len(texts)))
    for a, b in near.select("a.doc_id", "b.doc_id").collect():
        if root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    pairs, candidates = [], lines._candidates

    def counted(*args):
        out = candidates(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(lines, "_candidates", counted)
    got = lines.dedup_lines(rows, edits=lines.BY_LENGTH).collect()
    assert {r.doc_id: r.n_removed for r in got} == {k: int(root[k] != k) for k in range(len(texts))}
    assert len(texts) // 4 < len(set(root)) < len(texts) - 50
    assert sum(pairs) < 12 * len(texts)


def test_lines_in_the_pipeline(spark, tmp_path):
    """The number of edits follows the length, and short lines go where they repeat exactly; blank ones stay."""
    random.seed(3)
    texts = ["短い文です。\n \n\n", "\u3000\n短い文です。\n}\n \n", "}\nab", "ac"]
    for length in (19, 20, 22, 38, 39, 40, 41, 43, 60, 78, 79, 80, 81, 84, 110):
        line = [random.choice("abcdefg ") for _ in range(length)]
        for n in (0, 1, 2, 3, 4, 5):
            own = list(line)
            for at in random.sample(range(length), n):
                own[at] = random.choice(["X", "YZ", ""])
            texts.append("\n".join(["".join(own), f"own line {length} {n}"]))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    places = [(k, i, x) for k, text in enumerate(texts) for i, x in enumerate(text.split("\n")) if x.strip()]
    group = {x: x for x in {p[2] for p in places}}

    def allowed(n):
        return max((edits for least, edits in lines.BY_LENGTH if n >= least), default=0)

    for a in sorted(group):
        for b in sorted(group):
            n = allowed(min(len(a), len(b)))
            if a < b and group[a] != group[b] and abs(len(a) - len(b)) <= n and edit_distance(a, b) <= n:
                old = group[a]
                group = {x: group[b] if g == old else g for x, g in group.items()}
    head = {}
    for p in places:
        head.setdefault(group[p[2]], p)
    stay = ["\n".join(x for i, x in enumerate(text.split("\n")) if not x.strip() or head[group[x]] == (k, i, x)) for k, text in enumerate(texts)]
    gone = {k for k, text in enumerate(texts) if all(x.strip() and head[group[x]] != (k, i, x) for i, x in enumerate(text.split("\n")))}
    got = lines.remove_repeated_lines(spark, spark.read.parquet(path), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(k, x) for k, x in enumerate(stay) if k not in gone]
    assert max(edit_distance(a, b) for a in group for b in group if group[a] == group[b]) >= 4


# tables without rows, and extra columns


def test_empty_tables(spark, empty):
    ranks, pattern = bpe.vocabulary()
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert bpe.decode(bpe.encode(empty, ranks, pattern), ranks).count() == 0
    assert language.identify(empty, language.learn_profiles(empty)).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit_joined(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_other_columns_stay(messy):
    ranks, pattern = bpe.vocabulary()
    for out, new in ((bpe.encode(messy, ranks, pattern), {"ids"}), (lines.dedup_lines(messy), {"n_lines", "n_removed"}), (substrings.remove_repeats(messy), {"kept", "n_bytes", "n_removed", "spans"})):
        assert {c for c in messy.columns if c.lower() not in new} <= set(out.columns)
