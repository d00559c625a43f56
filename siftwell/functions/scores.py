"""Score categories and bins, uncertainty, tiers, effect sizes and other scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _chain(branches, otherwise=None) -> Column:
    expr = None
    for condition, value in branches:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


# Score categories; '10+' is also what every unlisted score becomes.
def score_category(score: Column) -> Column:
    exact = [(-1.0, "-1"), (-0.5, "-0.5"), (0.0, "0"), (0.5, "0.5"), (1.0, "1")]
    ranges = [(1, 2, "1 to 2"), (2, 5, "2 to 5"), (5, 10, "5 to 10")]
    return _chain([(score == v, name) for v, name in exact]
                  + [((score > lo) & (score <= hi), name) for lo, hi, name in ranges], "10+")


# Right-closed edges of the score bins.
SCORE_EDGES = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 5.0, 10.0, float("inf")]
SCORE_BINS = [f"bin_{i}" for i in range(1, 10)]
BIN_LABELS = {
    "bin_1": "-0.5", "bin_2": "0.0", "bin_3": "0.5", "bin_4": "1.0", "bin_5": "1.5-2.0",
    "bin_6": "2.5-5.0", "bin_7": "5.5-10.0", "bin_8": "10.5+", "bin_9": "-1.0",
}


def score_bin(score: Column) -> Column:
    """bin_1..bin_8 are right-closed; everything else (-1 and below, NaN, NULL) is bin_9."""
    pairs = zip(SCORE_EDGES, SCORE_EDGES[1:], SCORE_BINS)
    return _chain([((score > lo) & (score <= hi) & ~F.isnan(score), name) for lo, hi, name in pairs], "bin_9")


def bin_label(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in BIN_LABELS.items() for x in pair]), name)


def sign_class(score: Column) -> Column:
    return _chain([(score > 0, "positive"), (score < 0, "negative"), (score == 0, "neutral")])


def half_open_band(value: Column, edges: list[float], names: list[str] | None = None) -> Column:
    """[lo, hi) bands; values outside are NULL."""
    names = names or [f"[{lo:.2f}, {hi:.2f})" for lo, hi in zip(edges, edges[1:])]
    return _chain([((value >= lo) & (value < hi), n) for lo, hi, n in zip(edges, edges[1:], names)])


def right_closed_band(value: Column, edges: list[float], names: list[str]) -> Column:
    """(lo, hi] bands, the first one also holding its lower edge."""
    triples = list(zip(edges, edges[1:], names))
    first = triples[0]
    return _chain([((value >= first[0]) & (value <= first[1]), first[2])]
                  + [((value > lo) & (value <= hi), n) for lo, hi, n in triples[1:]])


def confidence_tier(proba: Column, final: float = 0.6) -> Column:
    return _chain([(proba >= 0.8, "HIGH"), (proba >= final, "MEDIUM"), (proba >= 0.5, "LOW")], "NEGATIVE")


def tenth(proba: Column) -> Column:
    """Histogram bin 0..9 of width 0.1 with the last one closed."""
    return F.least(F.floor(proba * 10), F.lit(9)).cast("int")


# ---------------------------------------------------------------- uncertainty

def entropy(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-10)), F.lit(1e-10))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def margin(p: Column) -> Column:
    return 1 - 2 * F.abs(p - 0.5)


def least_confident(p: Column) -> Column:
    return 1 - F.greatest(p, 1 - p)


UNCERTAINTY = {"entropy": entropy, "margin": margin, "least_confident": least_confident}


def uncertainty(p: Column, strategy: str = "entropy") -> Column:
    if strategy not in UNCERTAINTY:
        raise ValueError(f"unknown strategy: {strategy}")
    return UNCERTAINTY[strategy](p)


def buffered_size(n: int, invalid_rate: float) -> int:
    return int(n / (1 - invalid_rate))


# ---------------------------------------------------------------- labels

# Label spellings.
LABEL_CODES = {"YES": 1, "TAK": 1, "NO": 0, "NIE": 0, "INVALID": -1}


def label_code(label: Column) -> Column:
    """1, 0 or -1 from a text label, or from a number written as text; anything else is NULL."""
    text = label.cast("string")
    return _chain([(text.isin([k for k, v in LABEL_CODES.items() if v == code] + [str(code)]), code)
                   for code in (1, 0, -1)])


def truthy(value: Column) -> Column:
    """Flag from text: 'true' in any case is true, other text false, NULL stays NULL."""
    return F.lower(value.cast("string")) == "true"


# ---------------------------------------------------------------- survey scalars

def severity_weight(mean: Column) -> Column:
    return (mean - 1) / 4


def variation(mean: Column, sd: Column) -> Column:
    return sd / F.nullif(mean, F.lit(0.0))


def cohen_d(mean: Column, sd: Column, mid: float = 3.0) -> Column:
    return (mean - mid) / F.nullif(sd, F.lit(0.0))


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return _chain([(a >= 1.2, "Very large"), (a >= 0.8, "Large"), (a >= 0.5, "Moderate"), (a >= 0.2, "Small")],
                  "Negligible")


def strength_label(rho: Column, p: Column) -> Column:
    return _chain([((p < 0.01) & (rho > 0.8), "Very strong"), ((p < 0.05) & (rho > 0.6), "Strong"),
                   (p < 0.1, "Moderate")], "Weak / none")


def score_colour(q: Column) -> Column:
    return _chain([(q.isNull(), "none"), (q >= 55, "green"), (q >= 40, "yellow"), (q >= 20, "orange")], "red")


def percent_change(base: Column, new: Column) -> Column:
    return F.when(base > 0, (new - base) / F.nullif(base, F.lit(0.0)) * 100).otherwise(0.0)


def direction(base: Column, new: Column) -> Column:
    return _chain([(new > base, "up"), (new < base, "down")], "same")


def short_text(text: Column, length: int = 32) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))
