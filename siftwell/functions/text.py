"""Phrase dictionaries, whole-word phrase scoring, keyword filters and language profiles."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.session import fits, materialise, spread

ALNUM = r"\p{L}\p{N}"
WORD = f"[{ALNUM}]+"
# Above this many phrases the dictionary is joined instead of being inlined into the plan; the rows are the same.
INLINE_PHRASES = 20_000


# ---------------------------------------------------------------- dictionaries

def build_dictionary(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """One row per lower-cased phrase; a phrase of both polarities is negative."""
    both = positive.select("phrase", "score", F.lit("pos").alias("polarity")).unionByName(
        negative.select("phrase", "score", F.lit("neg").alias("polarity")))
    best = (both.filter(F.col("phrase").isNotNull())
            .withColumn("phrase", F.lower("phrase"))
            .groupBy("phrase")
            .agg(F.min_by(F.struct("score", "polarity"),
                          F.struct(F.col("polarity") != "neg", F.col("score"))).alias("best")))
    return best.select("phrase", "best.score", "best.polarity")


def flatten_wide_dictionary(wide: DataFrame, row_order: str) -> DataFrame:
    """Wide (key, score, one column per language) to phrase and score; the later cell wins."""
    languages = [c for c in wide.columns if c not in ("key", "score", row_order)]
    cells = wide.select(row_order, "score", F.posexplode(F.array(*languages)).alias("col_no", "phrase"))
    return (cells.filter(F.col("phrase").isNotNull()).groupBy("phrase")
            .agg(F.max_by("score", F.struct(row_order, "col_no")).alias("score")))


def phrase_key(phrase: Column) -> Column:
    return F.lower(F.replace(phrase, F.lit(" "), F.lit("_")))


def edit_dictionary(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Next dictionary version: drop the removed phrases, then let added ones win."""
    kept = base.join(removed.select("phrase"), "phrase", "left_anti").join(
        added.select("phrase"), "phrase", "left_anti")
    return kept.unionByName(added.select(*base.columns))


# ---------------------------------------------------------------- phrase scoring

@dataclass(frozen=True)
class PhraseSet:
    """A dictionary small enough to be compiled into an expression."""

    entries: dict[str, tuple[str, float]]

    @property
    def width(self) -> int:
        return max((len(re.findall(r"[^\W_]+", p)) for p in self.entries), default=1) or 1

    def of_polarity(self, polarity: str) -> list[str]:
        return sorted(p for p, (kind, _) in self.entries.items() if kind == polarity)

    def score_classes(self) -> dict[float, list[str]]:
        classes = defaultdict(list)
        for phrase, (_, score) in sorted(self.entries.items()):
            classes[score].append(phrase)
        return classes


def phrase_set(dictionary: DataFrame, limit: int = INLINE_PHRASES) -> PhraseSet | None:
    """The dictionary as a PhraseSet, or None when it is too large to inline."""
    rows = dictionary.select("phrase", "polarity", "score").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return PhraseSet({r.phrase: (r.polarity, float(r.score)) for r in rows})


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, not again inside every lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in(values: list[str]):
    return lambda x: x.isin(values)


def _pieces(text: Column) -> Column:
    """word, separator, word, ... of the lower-cased text, starting at its first word."""
    lead = F.regexp_replace(F.lower(text), f"^[^{ALNUM}]+", "")
    return F.regexp_extract_all(lead, F.lit(f"[{ALNUM}]+|[^{ALNUM}]+"), F.lit(0))


def _candidates(pieces: Column, width: int, first_words: dict[int, list[str]] | None) -> Column:
    """Raw n-grams up to ``width`` words, by end word and then longest first.

    An n-gram equal to a phrase is a whole-word match, because it starts and ends at a word edge.
    """
    count = F.floor((F.size(pieces) + 1) / 2).cast("int")

    def ending_at(end):
        grams = []
        for words in range(width, 1, -1):
            start = 2 * (end - (words - 1))
            opens = start >= 0
            if first_words is not None:
                if words not in first_words:
                    continue
                opens = opens & F.get(pieces, start).isin(first_words[words])
            grams.append(F.when(opens, F.array_join(F.slice(pieces, start + 1, F.lit(2 * words - 1)), "")))
        return F.array(*grams, F.get(pieces, 2 * end))

    grams = F.flatten(F.transform(F.sequence(F.lit(0), count - 1), ending_at))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))


def _has_word_edges(phrase: str) -> bool:
    return phrase[:1].isalnum() and phrase[-1:].isalnum()


def _edge_pattern(phrase: Column) -> Column:
    quoted = F.regexp_replace(phrase, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.concat(F.lit(f"(?<![{ALNUM}])"), quoted, F.lit(f"(?![{ALNUM}])"))


def matched_phrases(text: Column, phrases: PhraseSet) -> Column:
    """Distinct whole-word phrases of the text in match order."""
    plain = sorted(p for p in phrases.entries if _has_word_edges(p))
    edged = sorted(p for p in phrases.entries if p and not _has_word_edges(p))
    first_words = defaultdict(set)
    for phrase in plain:
        words = re.findall(r"[^\W_]+", phrase)
        if len(words) > 1:
            first_words[len(words)].add(words[0])
    openers = {n: sorted(words) for n, words in first_words.items()}
    empty = F.array().cast("array<string>")
    width = max(openers, default=1)
    grams = _let(_pieces(text), lambda pieces: F.filter(_candidates(pieces, width, openers), _in(plain)))
    found = F.array_distinct(grams) if plain else empty
    if edged:
        # Phrases with a symbol at an edge are no n-grams: look each of them up, then restore the order.
        lower = F.lower(text)
        extra = F.filter(F.array(*[F.lit(p) for p in edged]), lambda p: F.rlike(lower, _edge_pattern(p)))
        ends = F.transform(F.concat(found, extra), lambda p: F.struct(
            (F.regexp_instr(lower, _edge_pattern(p)) + F.length(p)).alias("at"),
            (-F.length(p)).alias("shorter"), p.alias("phrase")))
        ordered = F.transform(F.array_sort(ends), lambda e: e["phrase"])
        found = F.when(F.size(extra) > 0, ordered).otherwise(found)
    return F.coalesce(found, empty)


def score_texts(docs: DataFrame, phrases: PhraseSet, text: str = "text") -> DataFrame:
    """Add score, pos_keys and neg_keys without a shuffle: the dictionary is part of the expression.

    Each distinct phrase counts once, so the score is the number of hits per score class times its value.
    The three columns come out of a one-row generator: a filter on the score then runs on its output,
    where a plain column would be computed again inside the filter.
    """

    def result(found):
        score = F.lit(0.0)
        for value, members in phrases.score_classes().items():
            score = score + F.size(F.filter(found, _in(members))) * F.lit(value)
        return F.struct(score.alias("score"), F.filter(found, _in(phrases.of_polarity("pos"))).alias("pos_keys"),
                        F.filter(found, _in(phrases.of_polarity("neg"))).alias("neg_keys"))

    return docs.select(*docs.columns, F.inline(F.transform(F.array(matched_phrases(F.col(text), phrases)), result)))


def dictionary_width(dictionary: DataFrame) -> int:
    """The number of words of the longest phrase."""
    return dictionary.agg(F.max(F.size(F.regexp_extract_all("phrase", F.lit(WORD), F.lit(0))))).first()[0] or 1


# Words of 64 bits in the filter of n-grams: 32 bits for each entry, between these bounds.
FEWEST_WORDS, MOST_WORDS = 64, 1 << 20
HEAVY_SHARE = 1000
"""A core with more than one in so many of the n-grams that passed the filter is joined by itself."""


def _cores(dictionary: DataFrame) -> DataFrame:
    """Phrases with their core, from first to last word, and the symbols at its edges; none without a word."""
    inner = f"[{ALNUM}](?:.*[{ALNUM}])?"
    return dictionary.withColumn("core", F.regexp_extract("phrase", f"(?s){inner}", 0)).filter("core <> ''").select(
        "phrase", "score", "polarity", "core",
        F.regexp_extract("phrase", f"(?s)^[^{ALNUM}]*", 0).alias("left"), F.regexp_extract("phrase", f"(?s)[^{ALNUM}]*$", 0).alias("right"))


def _core_hash(core: Column) -> Column:
    return F.xxhash64(core)


def _opener_hash(word: Column, words) -> Column:
    """Hash of a first word with the number of words of its phrase; 0 stands for any number."""
    return F.xxhash64(word, F.lit(words) if isinstance(words, int) else words)


def core_filter(cores: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of cores and of first words, as one row of 64-bit words, and how many words it has."""
    found = F.regexp_extract_all("core", F.lit(WORD), F.lit(0))
    named = cores.select("core", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("words"))
    wanted = 3 * 32 * named.count() // 64
    size = FEWEST_WORDS
    while size < min(wanted, MOST_WORDS):
        size *= 2
    several = F.when(F.col("words") > 1, _opener_hash(F.col("first"), F.col("words")))
    entries = named.select(F.explode(F.array(_core_hash(F.col("core")), _opener_hash(F.col("first"), 0), several)).alias("h"))
    slots = entries.filter("h IS NOT NULL").select(_filter_word(F.col("h"), size).alias("at"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"))
    slots = slots.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = cores.sparkSession.range(size).select(F.col("id").cast("int").alias("at")).join(slots, "at", "left")
    pairs = F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(pairs, lambda p: p["bits"]).alias("bits")), size


def _filter_word(h: Column, size: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")


def _placed_grams(text: Column, width: int, bits: Column, size: int) -> Column:
    """The n-grams up to ``width`` words that pass the filter, with the separators around, their end word and their text.

    Each word is looked up once, as the first of a phrase; an n-gram is put together only if its first word opens a
    phrase of its length, and kept only if it may be a core.  A separator is NULL at the beginning or end of the text.
    """
    lower = F.lower(text)
    lead = F.nullif(F.regexp_extract(lower, f"^[^{ALNUM}]+", 0), F.lit(""))
    count = lambda p: F.floor((F.size(p) + 1) / 2).cast("int")

    def of(v):
        p, filter_ = v["p"], v["bits"]

        def known(h):
            return F.getbit(F.get(filter_, _filter_word(h, size)), h.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

        def gram(start, words):
            core = F.get(p, 2 * start) if words == 1 else F.array_join(F.slice(p, 2 * start + 1, F.lit(2 * words - 1)), "")
            end, after = start + (words - 1), 2 * (start + (words - 1)) + 1
            before = F.when(start > 0, F.get(p, 2 * start - 1)).otherwise(v["lead"])
            row = F.struct(core.alias("core"), before.alias("before"), F.get(p, after).alias("after"), (start == 0).alias("first"),
                           (after + 1 >= F.size(p)).alias("last"), end.alias("end"))
            possible = end < count(p)
            if words > 1:
                possible = possible & known(_opener_hash(F.get(p, 2 * start), words))
            return F.when(possible & known(_core_hash(core)), row)

        opens = F.transform(F.sequence(F.lit(0), count(p) - 1), lambda s: _opener_hash(F.get(p, 2 * s), 0))
        starts = _let(opens, lambda hashes: F.array_compact(F.transform(hashes, lambda h, s: F.when(known(h), s))))
        rows = F.flatten(F.transform(starts, lambda s: F.array(*[gram(s, words) for words in range(1, width + 1)])))
        return F.when(count(p) > 0, F.filter(rows, lambda r: r.isNotNull()))

    return _let(F.struct(_pieces(text).alias("p"), lead.alias("lead"), bits.alias("bits")), of)


def phrase_matches(docs: DataFrame, dictionary: DataFrame, uid: str = "uid", text: str = "text",
                   width: int | None = None, limit: int = 64 << 20) -> DataFrame:
    """Phrase-text join for dictionaries of any size: (uid, phrase, score, polarity, at), once per uid and phrase.

    A phrase is joined by its core, the part from its first to its last word; symbols at its edges are then
    compared with the separators around the n-gram.  The text itself is never shuffled, and a filter of the cores
    drops nearly all n-grams before a row is made of them.  A dictionary of at most ``limit`` bytes is broadcast to the
    n-grams.  With a larger one the n-grams are stored; the few cores that many of them have meet a broadcast of
    their phrases where they are, and the others are shuffled.
    ``width`` is the longest phrase in words, read from the dictionary if not given; ``at`` orders matches by
    their end, longer ones first.  Phrases without a letter or digit never match.
    """
    width = width or dictionary_width(dictionary)
    cored = materialise(_cores(dictionary), "cores")
    bits, size = core_filter(cored)
    # rows carry their number, so spreading an input of few pieces over the cores moves no row away from it
    placed = spread(docs.select(uid, text)).withColumn("_bits", bits.scalar()).select(uid, _placed_grams(F.col(text), width, F.col("_bits"), size).alias("_g"))
    # outer: an inner explode would put a filter on the array below, which finds all n-grams once more
    grams = placed.select(uid, F.explode_outer("_g").alias("g")).filter("g IS NOT NULL").select(uid, "g.*")
    if fits(cored, limit):
        met = grams.join(F.broadcast(cored), "core")
    else:
        grams = materialise(grams, "grams")
        counts = materialise(grams.groupBy("core").agg(F.count("*").alias("n")), "counts")
        least = (counts.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE
        heavy = F.broadcast(counts.filter(F.col("n") > least).select("core"))  # fewer than HEAVY_SHARE cores
        few = F.broadcast(cored.join(heavy, "core", "left_semi"))
        met = grams.join(few, "core").unionByName(grams.join(heavy, "core", "left_anti").join(cored.join(heavy, "core", "left_anti"), "core"))
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    # beyond the edge symbols there must be no letter or digit: more of the separator, or an end of the text
    ends = (F.endswith(before, F.col("left")) & ((F.length("left") == 0) | (F.length("left") < F.length(before)) | F.col("first"))
            & F.startswith(after, F.col("right")) & ((F.length("right") == 0) | (F.length("right") < F.length(after)) | F.col("last")))
    at = F.struct("end", F.length("right").alias("beyond"), (-F.length("phrase")).alias("shorter"))
    return met.filter(ends).groupBy(uid, "phrase").agg(F.first("score").alias("score"), F.first("polarity").alias("polarity"), F.min(at).alias("at"))


def score_texts_by_join(docs: DataFrame, dictionary: DataFrame, uid: str = "uid", text: str = "text",
                        width: int | None = None, keep: list[str] = ()) -> DataFrame:
    """Scores as score_texts gives them, for a dictionary too large to inline.

    Every row is scored by itself, also where uids repeat: rows meet by their number in ``docs``, which must
    give the same rows when read again.  Only numbers, hits and kept columns are shuffled, never the text.
    """
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    hits = phrase_matches(docs, dictionary, "_row", text, width)
    per_doc = hits.groupBy("_row").agg(
        F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("at", "phrase", "polarity"))).alias("hits"))
    keys = lambda kind: F.transform(F.filter("hits", lambda h: h["polarity"] == kind), lambda h: h["phrase"])
    empty = F.array().cast("array<string>")
    slim = per_doc.select("_row", "score", keys("pos").alias("pos_keys"), keys("neg").alias("neg_keys"))
    return docs.select("_row", uid, *keep).join(slim, "_row", "left").select(
        uid, *keep, F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("pos_keys", empty).alias("pos_keys"), F.coalesce("neg_keys", empty).alias("neg_keys"))


def score_corpus(docs: DataFrame, dictionary: DataFrame, uid: str = "uid", text: str = "text",
                 keep: list[str] = ()) -> DataFrame:
    """(uid, kept columns, score, keys): by expression when the dictionary fits into the plan, else by join."""
    phrases = phrase_set(dictionary)
    if phrases is not None:
        return score_texts(docs.select(uid, *keep, text), phrases, text).drop(text)
    return score_texts_by_join(docs, dictionary, uid, text, None, keep)


def joined_keys(keys: Column) -> Column:
    """Keyword list as the pipe-joined text of the sink format."""
    return F.array_join(keys, "|")


# ---------------------------------------------------------------- keyword filters

def alternation(keywords: list[str]) -> str:
    return "|".join(re.escape(k.lower()) for k in sorted(keywords))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Any keyword is a substring of the lower-cased text; NULL text and an empty list are false."""
    if not keywords:
        return F.lit(False)
    return F.coalesce(F.lower(text).rlike(alternation(keywords)), F.lit(False))


def wanted_not_unwanted(text: Column, wanted: list[str], unwanted: list[str]) -> Column:
    return contains_any(text, wanted) & ~contains_any(text, unwanted)


def matches_language_rules(text: Column, lang: Column, wanted: dict[str, list[str]],
                           unwanted: dict[str, list[str]], fallback: str = "en") -> Column:
    """Rules of the row's language united with the fallback's; unknown languages use the fallback."""

    def rule(words):
        # one literal pattern per language, compiled once
        branch, expr = contains_any(text, words[fallback]), None
        for code in sorted(words):
            found = contains_any(text, sorted(set(words[code]) | set(words[fallback])))
            expr = F.when(lang == code, found) if expr is None else expr.when(lang == code, found)
        return branch if expr is None else expr.otherwise(branch)

    return rule(wanted) & ~rule(unwanted)


def keyword_row_counts(docs: DataFrame, keywords: list[str], uid: str = "uid", text: str = "text") -> DataFrame:
    """Rows (not occurrences) that contain each keyword; keywords without rows are absent."""
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k))
    return docs.select(F.explode(F.array_distinct(hits)).alias("phrase")).groupBy("phrase").agg(
        F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- languages

# Language codes and names.
LANGUAGE_NAMES = {
    "en": "English", "fr": "French", "de": "German", "ko": "Korean", "ru": "Russian", "es": "Spanish",
    "tl": "Filipino", "it": "Italian", "nl": "Dutch", "unknown": "Unknown", "sw": "Swahili", "ja": "Japanese",
    "zh-cn": "Simplified Chinese", "pt": "Portuguese", "id": "Indonesian", "ca": "Catalan", "ro": "Romanian",
    "pl": "Polish", "no": "Norwegian", "af": "Afrikaans", "vi": "Vietnamese", "sl": "Slovenian", "da": "Danish",
    "bg": "Bulgarian", "sv": "Swedish", "so": "Somali", "tr": "Turkish", "ar": "Arabic", "et": "Estonian",
    "hu": "Hungarian", "cy": "Welsh", "cs": "Czech", "hr": "Croatian", "fi": "Finnish", "mk": "Macedonian",
    "lt": "Lithuanian", "sk": "Slovak", "el": "Greek", "fa": "Persian", "sq": "Albanian", "uk": "Ukrainian",
    "he": "Hebrew", "lv": "Latvian", "th": "Thai", "bn": "Bengali", "ta": "Tamil", "ur": "Urdu", "hi": "Hindi",
    "ne": "Nepali", "mr": "Marathi",
}


def language_code(code: Column) -> Column:
    """Fold the Chinese variants together; blank or missing codes are unknown."""
    trimmed = F.trim(code)
    return (F.when(trimmed.isNull() | (trimmed == ""), "unknown")
            .when(trimmed.isin("zh-tw", "zh-hk"), "zh-cn").otherwise(trimmed))


def language_name(code: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def _word_trigrams(words: DataFrame, *keep: str) -> DataFrame:
    """One row per trigram of each padded word."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(padded, i, F.lit(3)))
    return words.select(*keep, F.explode(grams).alias("gram"))


def language_profiles(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Smoothed log-probability of each trigram per language: (lang, gram, weight, floor)."""
    words = (labelled.select(lang, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
             .groupBy(lang, "word").agg(F.count("*").alias("n")))
    counts = _word_trigrams(words, lang, "n").groupBy(lang, "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(lang).agg(F.sum("n").alias("total"))
    return counts.join(totals, lang).select(
        lang, "gram", F.log((F.col("n") + 1) / (F.col("total") + 1)).alias("weight"),
        F.log(1 / (F.col("total") + 1)).alias("floor"))


FREQUENT_SHARE = 100_000
"""A word with more than one in so many of all words counts as frequent."""


def word_gains(words: DataFrame, profiles: DataFrame, languages: list[str], lang: str = "lang") -> DataFrame:
    """What one occurrence of each word adds in each language: columns ``g0``, ``g1``, ... in the order of the languages.

    A gain is the sum of (weight - floor) over the word's trigrams that the language knows, NULL if it knows none.
    """
    gain = F.col("weight") - F.col("floor")
    pivoted = profiles.groupBy("gram").agg(*[F.max(F.when(F.col(lang).eqNullSafe(F.lit(name)), gain)).alias(f"g{i}") for i, name in enumerate(languages)])
    grams = materialise(pivoted, "profiles")
    if fits(grams):
        grams = F.broadcast(grams)
    keep = [c for c in words.columns if c != "word"]
    sums = [F.sum(f"g{i}").alias(f"g{i}") for i in range(len(languages))]
    return _word_trigrams(words, "word", *keep).join(grams, "gram").groupBy("word", *keep).agg(*sums)


def identify_language(docs: DataFrame, profiles: DataFrame, uid: str = "uid", text: str = "text",
                      lang: str = "lang", limit: int = 64 << 20) -> DataFrame:
    """Most likely language per document: (uid, detected); no letters, or no known trigram, gives unknown.

    score(lang) = trigrams * floor(lang) + sum of (weight - floor) over the trigrams the profile knows, for each
    language that knows one.  Each distinct word is scored once, with a column per language, and a document sums up its
    words' columns.  Up to ``limit`` bytes of words are broadcast.  Beyond, frequent words (fewer than
    FREQUENT_SHARE) are still broadcast, so that only occurrences of rare words are shuffled to them.  Every row is
    detected by itself: rows meet by their number in ``docs``, which must give the same rows when read again.
    """
    profiles = materialise(profiles, "profile")
    floors = {r[lang]: r["floor"] for r in profiles.groupBy(lang).agg(F.max("floor").alias("floor")).collect()}  # one row per language
    languages = sorted(floors, key=lambda name: (name is not None, name))
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    # outer: an inner explode would put a filter on the array below, which splits every text once more
    words = spread(docs.select("_row", text)).select("_row", F.explode_outer(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).filter("word IS NOT NULL")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    by_word = materialise(word_gains(counts, profiles, languages, lang), "words")
    gains = [f"g{i}" for i in range(len(languages))]
    if fits(by_word, limit):
        met = words.join(F.broadcast(by_word.drop("n")), "word", "left")
    else:
        least = (by_word.agg(F.sum("n")).first()[0] or 0) // FREQUENT_SHARE
        frequent = F.broadcast(by_word.filter(F.col("n") > least).withColumn("_known", F.lit(True)).drop("n"))
        placed = words.join(frequent, "word", "left")
        rare = by_word.filter(F.col("n") <= least).drop("n")
        met = placed.filter("_known").drop("_known").unionByName(placed.filter("_known IS NULL").select("_row", "word").join(rare, "word", "left"))
    sums = met.groupBy("_row").agg(F.sum(F.length("word")).alias("grams"), *[F.sum(g).alias(g) for g in gains])
    costs = [F.when(F.col(g).isNotNull(), F.struct((-F.round(F.col("grams") * F.lit(floors[name]) + F.col(g), 6)).alias("cost"), F.lit(name).alias("lang")))
             for g, name in zip(gains, languages, strict=True)]
    best = F.array_min(F.filter(F.array(*costs), lambda c: c.isNotNull()))["lang"] if costs else F.lit(None).cast("string")
    slim = sums.select("_row", best.alias("detected"))
    return docs.select("_row", uid).join(slim, "_row", "left").select(
        uid, F.coalesce("detected", F.lit("unknown")).alias("detected"))
