"""Survey statistics on a long table (respondent, criterion, rating): weights, agreement, tests, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.functions.scores import cohen_d, effect_label, severity_weight, strength_label, variation
from siftwell.functions.tails import chi2_p, normal_p, student_p
from siftwell.operators.joins import unordered_pairs
from siftwell.operators.ordering import average_rank_within, average_ranks, first_per_key, per_value, quantile_columns
from siftwell.session import materialise

LEVELS = [1, 2, 3, 4, 5]


def criterion_order(col: str, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in order]), F.col(col)) - 1


def counts_by_rating(ratings: DataFrame, groups: list[str]) -> DataFrame:
    return (ratings.filter(F.col("rating").isNotNull()).groupBy(*groups, "rating").agg(F.count("*").alias("n")))


def per_criterion(ratings: DataFrame) -> DataFrame:
    """n, mean, median, sample SD, min, max, counts of 1..5, weight and coefficient of variation."""
    r = F.col("rating")
    base = ratings.filter(r.isNotNull()).groupBy("criterion").agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min(r).alias("min"),
        F.max(r).alias("max"), *[F.count_if(r == k).alias(f"n_{k}") for k in LEVELS])
    medians = counts_by_rating(ratings, ["criterion"]).groupBy("criterion").agg(
        F.expr("percentile(rating, 0.5, n)").alias("median"))
    return (base.join(medians, "criterion")
            .withColumn("weight", severity_weight(F.col("mean"))).withColumn("cv", variation(F.col("mean"), F.col("sd"))))


def weight_sum(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("weight").alias("sum_weights"))


def ranking(stats: DataFrame, by: str, order: list[str], descending: bool = True, groups: list[str] = ()) -> DataFrame:
    """Ordinal rank per group over the criteria; ties follow the declaration order."""
    lead = F.round(by, 12).desc() if descending else F.round(by, 12).asc()
    w = Window.partitionBy(*groups).orderBy(lead, criterion_order("criterion", order))
    return stats.withColumn("rank", F.row_number().over(w))


def category_means(stats: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Mean of the criterion means per category, ranked, with the high-low difference."""
    pairs = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    means = stats.groupBy(F.try_element_at(pairs, F.col("criterion")).alias("category")).agg(
        F.count("*").alias("n_criteria"), F.avg("mean").alias("mean"))
    everything = Window.partitionBy()
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "category"))).withColumn(
        "spread", F.max("mean").over(everything) - F.min("mean").over(everything))


def cv_ranking(stats: DataFrame, order: list[str]) -> DataFrame:
    """Criteria by coefficient of variation, best agreement first."""
    ranked = ranking(stats, "cv", order, descending=False)
    last = F.max("rank").over(Window.partitionBy())
    return ranked.withColumn("agreement", F.when(F.col("rank") == 1, "highest").when(F.col("rank") == last, "lowest"))


def group_means(ratings: DataFrame, group: str) -> DataFrame:
    """Mean and SD per group and criterion, and per group over all cells (criterion NULL)."""
    sets = ratings.groupingSets([[group, "criterion"], [group]], group, "criterion")
    return sets.agg(F.grouping("criterion").alias("g"), F.count_distinct("respondent").alias("n"),
                    F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("sd")).withColumn(
        "criterion", F.when(F.col("g") == 1, "ALL").otherwise(F.col("criterion"))).drop("g")


def respondent_diagnostics(ratings: DataFrame) -> DataFrame:
    r = F.col("rating")
    out = ratings.groupBy("respondent").agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.count_distinct(r).alias("n_unique"),
        F.count_if(r == 5).alias("n_5"), F.count_if(r == 1).alias("n_1"))
    return out.withColumn("low_diversity", (F.coalesce("sd", F.lit(0.0)) < 0.5) | (F.col("n_unique") <= 2))


def personal_mean_summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.count("*").alias("n"), F.min("mean").alias("min"), F.max("mean").alias("max"),
                           F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"),
                           F.count_if("low_diversity").alias("n_low_diversity"))


# ---------------------------------------------------------------- tests and correlations

def _weighted_corr(n: Column, x: Column, y: Column) -> Column:
    sn, sx, sy = F.sum(n), F.sum(n * x), F.sum(n * y)
    cov = sn * F.sum(n * x * y) - sx * sy
    spread = F.sqrt((sn * F.sum(n * x * x) - sx * sx) * (sn * F.sum(n * y * y) - sy * sy))
    return cov / F.nullif(spread, F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of complete pairs with two-sided p; NULL below three pairs.

    Equal pairs are folded first, so ranks are joined to distinct values only.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(pairs, x).select(x, F.col("avg_rank").alias("rx"))
    ry = average_ranks(pairs, y).select(y, F.col("avg_rank").alias("ry"))
    folded = pairs.groupBy(x, y).agg(F.count("*").alias("w")).join(rx, x).join(ry, y)
    n = F.col("w").cast("double")
    out = folded.agg(F.sum("w").alias("n"), _weighted_corr(n, F.col("rx"), F.col("ry")).alias("rho"))
    return _with_p(out)


def _with_p(out: DataFrame) -> DataFrame:
    rho = F.when(F.col("n") >= 3, F.least(F.greatest(F.round("rho", 12), F.lit(-1.0)), F.lit(1.0)))
    t = rho * F.sqrt((F.col("n") - 2) / F.nullif((1 - rho) * (1 + rho), F.lit(0.0)))
    done = out.withColumn("rho", rho).withColumn("_t", t)
    return done.withColumn("p", F.when(F.abs("rho") == 1, 0.0).otherwise(student_p(
        "_t", (F.col("n") - 2).cast("double")))).drop("_t")


def respondent_severity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("respondent").agg(F.round(F.avg("rating"), 12).alias("severity"))


def rank_agreement(ranks: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """Spearman between the criterion ranks of each pair (a, b) of groups, with its strength label."""
    a = ranks.select(F.col(group).alias("a"), "criterion", F.col("rank").alias("ra"))
    b = ranks.select(F.col(group).alias("b"), "criterion", F.col("rank").alias("rb"))
    both = pairs.join(a, "a").join(b, ["b", "criterion"])
    one = F.lit(1.0)
    out = both.groupBy("a", "b").agg(F.count("*").alias("n"), _weighted_corr(
        one, F.col("ra").cast("double"), F.col("rb").cast("double")).alias("rho"))
    done = _with_p(out)
    return done.withColumn("strength", strength_label(F.col("rho"), F.col("p")))


def group_rank_table(ratings: DataFrame, group: str, order: list[str], overall: str = "overall") -> DataFrame:
    """Criterion ranks of every group and of all respondents together."""
    cells = ratings.groupingSets([[group, "criterion"], ["criterion"]], group, "criterion").agg(
        F.grouping(group).alias("g"), F.avg("rating").alias("mean"))
    named = cells.withColumn(group, F.when(F.col("g") == 1, overall).otherwise(F.col(group))).drop("g")
    return ranking(named, "mean", order, groups=[group])


def kendall_w(ranks: DataFrame, judge: str, item: str = "criterion", rank: str = "rank") -> DataFrame:
    """Coefficient of concordance without tie correction, chi-square and p."""
    sums = ranks.groupBy(item).agg(F.sum(rank).alias("r"), F.count_distinct(judge).alias("k"))
    out = sums.agg(F.max("k").alias("k"), F.count("*").alias("n_items"),
                   (F.var_pop("r") * F.count("*")).alias("s"))
    k, n = F.col("k"), F.col("n_items")
    out = out.withColumn("w", 12 * F.col("s") / F.nullif(k * k * (n * n * n - n), F.lit(0)))
    out = out.withColumn("chi2", k * (n - 1) * F.col("w"))
    return out.withColumn("p", chi2_p("chi2", (n - 1).cast("double"))).drop("s")


def friedman(ratings: DataFrame, n_criteria: int) -> tuple[DataFrame, DataFrame]:
    """(test, mean ranks) over respondents who rated every criterion; ranks and ties per respondent.

    A respondent has at most one row per criterion, so each window partition is that small.
    """
    asked = Window.partitionBy("respondent")
    full = (ratings.filter(F.col("rating").isNotNull()).withColumn("_n", F.count("*").over(asked))
            .filter(F.col("_n") == n_criteria))
    ranked = full.withColumn("r", average_rank_within(["respondent"], "rating"))
    means = ranked.groupBy("criterion").agg(F.avg("r").alias("mean_rank"), F.sum("r").alias("rank_sum"),
                                            F.count("*").alias("n"))
    ties = (full.groupBy("respondent", "rating").agg(F.count("*").alias("t"))
            .agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties")).scalar())
    k, n = F.lit(n_criteria), F.col("n")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    test = (means.agg(F.max("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"))
            .withColumn("ties", ties)
            .withColumn("chi2", raw / (1 - F.col("ties") / (n * k * (k * k - 1))))
            .withColumn("df", k - 1))
    test = test.withColumn("p", chi2_p("chi2", F.col("df").cast("double")))
    return test.select("n", "chi2", "df", "p"), means.select("criterion", "mean_rank")


def effect_sizes(ratings: DataFrame, mid: float = 3.0) -> DataFrame:
    """Mean, SD, Cohen's d with label, one-sample t with p."""
    stats = ratings.filter(F.col("rating").isNotNull()).groupBy("criterion").agg(
        F.count("*").alias("n"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("sd"))
    d = cohen_d(F.col("mean"), F.col("sd"), mid)
    out = stats.withColumn("d", d).withColumn("t", F.col("d") * F.sqrt(F.col("n")))
    return out.withColumn("effect", effect_label(F.col("d"))).withColumn(
        "p_t", student_p("t", (F.col("n") - 1).cast("double")))


def wilcoxon(ratings: DataFrame, mid: float = 3.0) -> DataFrame:
    """Signed-rank test per criterion: zeros dropped, normal approximation with tie correction.

    Differences are folded to (criterion, |d|) first; ranks follow from those few rows.
    """
    diff = F.col("rating") - mid
    folded = ratings.filter(F.col("rating").isNotNull() & (diff != 0)).groupBy(
        "criterion", F.abs(diff).alias("size")).agg(F.count_if(diff > 0).alias("up"), F.count("*").alias("t"))
    w = Window.partitionBy("criterion").orderBy("size")
    ranked = folded.withColumn("r", F.sum("t").over(w) - (F.col("t") - 1) / 2)
    out = ranked.groupBy("criterion").agg(
        F.sum("t").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"),
        F.sum((F.col("t") - F.col("up")) * F.col("r")).alias("w_minus"),
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    out = out.withColumn("w", F.least("w_plus", "w_minus")).withColumn(
        "z", (F.col("w") - n * (n + 1) / 4) / F.nullif(se, F.lit(0.0)))
    return out.select("criterion", "n", "w", "z", normal_p("z", "z").alias("p_w"))


# ---------------------------------------------------------------- Krippendorff's alpha

def _unit_patterns(ratings: DataFrame, unit: str, values: list[int]) -> DataFrame:
    """Distinct value-count vectors of the units with how often each occurs."""
    counts = ratings.filter(F.col("rating").isNotNull()).groupBy(unit).agg(
        *[F.count_if(F.col("rating") == v).alias(f"c{v}") for v in values])
    return counts.groupBy(*[f"c{v}" for v in values]).agg(F.count("*").alias("units"))


def _delta(level: str, a: str, b: str, marginals: dict[int, Column], values: list[int]) -> Column:
    i, j = values.index(int(a)), values.index(int(b))
    if level == "nominal":
        return F.lit(0.0 if i == j else 1.0)
    if level == "interval":
        return F.lit(float(values[i] - values[j]) ** 2)
    low, high = min(i, j), max(i, j)
    between = sum((marginals[v] for v in values[low:high + 1]), F.lit(0.0))
    return F.pow(between - (marginals[values[low]] + marginals[values[high]]) / 2, F.lit(2))


def alpha_from_patterns(patterns: DataFrame, level: str, values: list[int] = LEVELS,
                        groups: list[str] = ()) -> DataFrame:
    """Alpha from weighted value-count vectors (columns c<value>, units).

    Units with fewer than two values do not count.  Coincidences are plain sums, so this is one aggregation.
    """
    c = {v: F.col(f"c{v}").cast("double") for v in values}
    m = sum(c.values(), F.lit(0.0))
    usable = patterns.withColumn("_m", m).filter(F.col("_m") >= 2)
    pairs = [(a, b) for a in values for b in values]
    cell = lambda a, b: F.col("units") * c[a] * (c[b] - (1 if a == b else 0)) / (F.col("_m") - 1)
    sums = usable.groupBy(*groups).agg(
        *[F.sum(cell(a, b)).alias(f"o_{a}_{b}") for a, b in pairs],
        *[F.sum(F.col("units") * c[v]).alias(f"m_{v}") for v in values])
    return alpha_of_sums(sums, level, values, groups)


def alpha_of_sums(sums: DataFrame, level: str, values: list[int] = LEVELS, groups: list[str] = ()) -> DataFrame:
    """Alpha from coincidences (columns o_<a>_<b>) and marginals (m_<value>)."""
    pairs = [(a, b) for a in values for b in values]
    marg = {v: F.col(f"m_{v}") for v in values}
    total = sum(marg.values(), F.lit(0.0))
    observed = sum((F.col(f"o_{a}_{b}") * _delta(level, a, b, marg, values) for a, b in pairs), F.lit(0.0))
    expected = sum((marg[a] * (marg[b] - (1 if a == b else 0)) * _delta(level, a, b, marg, values)
                    for a, b in pairs), F.lit(0.0))
    return sums.select(*groups, (1 - (total - 1) * observed / F.nullif(expected, F.lit(0.0))).alias("alpha"))


def krippendorff_alpha(ratings: DataFrame, level: str = "ordinal", unit: str = "respondent",
                       values: list[int] = LEVELS) -> DataFrame:
    """Alpha with the chosen unit; the default takes respondents as units and criteria as coders."""
    return alpha_from_patterns(_unit_patterns(ratings, unit, values), level, values)


# ---------------------------------------------------------------- jackknife and bootstrap

def jackknife_weights(ratings: DataFrame) -> DataFrame:
    """Leave-one-out weights per criterion in closed form, with the most influential respondent.

    The weight after leaving out a rating depends on its value only, so values are folded first.
    """
    folded = ratings.filter(F.col("rating").isNotNull()).groupBy("criterion", "rating").agg(
        F.count("*").alias("n"), F.min("respondent").alias("respondent"))
    w = Window.partitionBy("criterion")
    total, count = F.sum(F.col("n") * F.col("rating")).over(w), F.sum("n").over(w)
    loo = folded.withColumns({"w_full": severity_weight(total / count),
                              "w_loo": severity_weight((total - F.col("rating")) / F.nullif(count - 1, F.lit(0)))})
    change = F.round(F.abs(F.col("w_loo") - F.col("w_full")), 12)
    return loo.withColumn("change", change).groupBy("criterion").agg(
        F.max("w_full").alias("w_full"), F.min("w_loo").alias("jk_min"), F.max("w_loo").alias("jk_max"),
        F.max("change").alias("max_change"),
        F.min_by("respondent", F.struct(-F.col("change"), F.col("respondent"))).alias("most_influential"))


CHUNK = 500


def multinomial_resamples(groups: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """Resampled counts of folded groups: (key, iteration, counts).

    ``groups`` is (key long, counts array<long>), the category sizes of the rows to resample.  A
    resample with replacement of N rows falls into the categories as one multinomial draw, so the
    work is iterations x categories and does not grow with N.  Each chunk of iterations has its own
    seed, so a repeated task draws the same numbers.
    """
    chunks = -(-iterations // CHUNK)
    spread = groups.select("key", "counts", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def draw(batches):
        for pdf in batches:
            for key, counts, chunk in zip(pdf["key"], pdf["counts"], pdf["chunk"]):
                c = np.asarray(counts, dtype="float64")
                rng = np.random.default_rng([seed, int(key) & 0xFFFFFFFF, int(chunk)])
                first = int(chunk) * CHUNK
                size = min(CHUNK, iterations - first)
                drawn = rng.multinomial(int(c.sum()), c / c.sum(), size=size)
                yield pd.DataFrame({"key": key, "iteration": np.arange(first, first + size, dtype="int32"), "counts": list(drawn)})

    return spread.repartition("key", "chunk").mapInPandas(draw, "key long, iteration int, counts array<long>")


def _interval(values: DataFrame, col: str, groups: list[str]) -> DataFrame:
    """Mean, population SD and 95 % percentile interval over the iterations of each group."""
    return values.groupBy(*groups).agg(
        F.avg(col).alias("boot_mean"), F.stddev_pop(col).alias("se"),
        F.expr(f"percentile({col}, 0.025)").alias("ci_lo"), F.expr(f"percentile({col}, 0.975)").alias("ci_hi"))


def bootstrap_weights(ratings: DataFrame, iterations: int = 10_000, seed: int = 42) -> DataFrame:
    """Bootstrap SE and 95 % interval of each criterion's weight."""
    sizes = ratings.filter(F.col("rating").isNotNull()).groupBy("criterion").agg(
        *[F.count_if(F.col("rating") == v).alias(f"c{v}") for v in LEVELS])
    keyed = sizes.select(F.xxhash64("criterion").alias("key"), "criterion",
                         F.array(*[f"c{v}" for v in LEVELS]).alias("counts"))
    n = sum((F.col("counts")[i] for i in range(5)), F.lit(0))
    total = sum((F.col("counts")[i] * LEVELS[i] for i in range(5)), F.lit(0))
    drawn = multinomial_resamples(keyed, iterations, seed).withColumn("w", severity_weight(total / n))
    point = keyed.select("key", "criterion", severity_weight(total / n).alias("weight"))
    return _interval(drawn, "w", ["key"]).join(point, "key").drop("key")


BLOCK_PATTERNS = 1_000
"""Patterns whose weights are drawn together."""


def bootstrap_alpha(ratings: DataFrame, iterations: int = 1_000, seed: int = 42, level: str = "ordinal",
                    unit: str = "respondent", block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """Bootstrap of alpha over units, folded to distinct value-count vectors (patterns), which stay distributed.

    Patterns are cut into blocks.  The units of a resample fall into the blocks as one multinomial draw, and those of a
    block into its patterns as another.  Coincidences are linear in a pattern's units, so a block turns its matrix of
    weights (iterations x patterns) into partial sums per iteration, which are then added up.  A row holds one block's
    patterns at most, or the blocks' sizes.
    """
    cols = [f"c{v}" for v in LEVELS]
    patterns = materialise(_unit_patterns(ratings, unit, LEVELS), "patterns")
    blocks = max(1, -(-patterns.count() // block_patterns))
    placed = patterns.withColumn("block", F.pmod(F.xxhash64(*cols), F.lit(blocks)))
    sizes = placed.groupBy("block").agg(F.sum("units").alias("units"))
    packed = sizes.agg(F.array_sort(F.collect_list(F.struct("block", "units"))).alias("b"))
    drawn = multinomial_resamples(packed.select(F.lit(0).cast("long").alias("key"), F.transform("b", lambda x: x["units"]).alias("counts")), iterations, seed)
    shares = drawn.withColumn("b", packed.scalar()).select("iteration", F.explode(F.arrays_zip("counts", "b")).alias("z")).select(
        F.col("z.b.block").alias("block"), F.floor(F.col("iteration") / CHUNK).alias("chunk"), "iteration", F.col("z.counts").alias("n"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-iterations // CHUNK) - 1).cast("long")))
    weighed = shares.groupBy("block", "chunk").cogroup(placed.select("*", chunks.alias("chunk")).groupBy("block", "chunk"))
    names = [*[f"o_{a}_{b}" for a in LEVELS for b in LEVELS], *[f"m_{v}" for v in LEVELS]]

    def block_sums(draws: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if draws.empty or rows.empty:
            return pd.DataFrame({c: [] for c in ["iteration", *names]})
        draws, rows = draws.sort_values("iteration"), rows.sort_values(cols)
        counts, units = rows[cols].to_numpy("float64"), rows["units"].to_numpy("float64")
        rng = np.random.default_rng([seed, int(rows["block"].iat[0]), int(draws["chunk"].iat[0]), 1])
        weights = rng.multinomial(draws["n"].to_numpy("int64"), units / units.sum())
        m = counts.sum(1)
        usable = m >= 2
        pairs = counts[:, :, None] * (counts[:, None, :] - np.eye(len(cols)))
        pairs = np.where(usable[:, None, None], pairs / np.maximum(m - 1, 1)[:, None, None], 0)
        sums = weights @ np.concatenate((pairs.reshape(len(rows), -1), np.where(usable[:, None], counts, 0)), axis=1)
        return pd.DataFrame(sums, columns=names).assign(iteration=draws["iteration"].to_numpy())[["iteration", *names]]

    partial = weighed.applyInPandas(block_sums, "iteration int, " + ", ".join(f"{c} double" for c in names))
    sums = partial.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in names])
    alphas = alpha_of_sums(sums, level, LEVELS, ["iteration"]).filter(F.col("alpha").isNotNull())
    out = _interval(alphas.withColumn("g", F.lit(0)), "alpha", ["g"]).drop("g")
    return out.withColumn("alpha", alpha_from_patterns(patterns, level).scalar())


def bootstrap_metrics(predictions: DataFrame, iterations: int = 1_000, seed: int = 42, label: str = "label",
                      proba: str = "pred_proba") -> DataFrame:
    """Bootstrap of F1, precision and recall: resamples of the four confusion cells."""
    from siftwell.operators.metrics import confusion, derived_metrics

    cells = confusion(predictions, label, proba)
    keyed = cells.select(F.lit(0).cast("long").alias("key"), F.array("tp", "fp", "tn", "fn").alias("counts"))
    drawn = multinomial_resamples(keyed, iterations, seed)
    m = derived_metrics(*[F.col("counts")[i] for i in range(4)])
    long = drawn.select("iteration", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), m[k].alias("value"))
                                                         for k in ("f1", "precision", "recall")])).alias("x"))
    return _interval(long.select("x.*"), "value", ["metric"]).withColumn("unstable", F.col("se") > 0.1)


def resampled_weights(resampled: DataFrame) -> DataFrame:
    """Interval of the weights from explicit resamples (iteration, criterion, rating, weight)."""
    per = resampled.groupBy("iteration", "criterion").agg(
        severity_weight(F.sum(F.col("rating") * F.col("weight")) / F.sum("weight")).alias("w"))
    return _interval(per, "w", ["criterion"])


# Sensitivity scenarios.
SENSITIVITY_SCENARIOS = {
    "Missing L3": ["L3"], "Missing D2 + A1": ["D2", "A1"], "Missing D1": ["D1"], "Missing L1 + L3": ["L1", "L3"],
    "Missing V1 + V2": ["V1", "V2"], "Missing D1 + L2 + V2": ["D1", "L2", "V2"],
}


def sensitivity(scenarios: DataFrame, weight_sets: DataFrame, sets: list[str]) -> DataFrame:
    """Scenario scores under each weight set side by side, with their range."""
    from siftwell.operators.quality import quality_with_weights

    q = quality_with_weights(scenarios, weight_sets)
    wide = q.groupBy("scenario").pivot("weight_set", sets).agg(F.first("q"))
    cols = [F.col(s) for s in sets]
    return wide.withColumn("range", F.greatest(*cols) - F.least(*cols))
