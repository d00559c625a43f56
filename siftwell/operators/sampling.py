"""Seeded exact samples, caps, strata, quotas and splits.

The random order is the md5 of seed and uid: the same rows are drawn on any cluster and on retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.functions.scores import buffered_size, uncertainty
from siftwell.operators.ordering import per_value, running_totals, top_per_group

HEX = 4


def draw_key(uid: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), uid.cast("string")))


def shuffled(df: DataFrame, uid: str = "uid", seed: int = 42) -> DataFrame:
    return df.orderBy(draw_key(F.col(uid), seed), uid)


def shuffled_positions(df: DataFrame, uid: str = "uid", seed: int = 42) -> DataFrame:
    """Add each row's 1-based position in the shuffled order, without a one-task sort."""
    slot = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    keyed = df.withColumn("_key", draw_key(F.col(uid), seed)).withColumn("_slot", slot)
    starts = running_totals(per_value(keyed, "_slot"), "_slot", ["n"]).select(
        "_slot", (F.col("cum_n") - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slot").orderBy("_key", uid))
    return keyed.join(starts, "_slot").withColumn("position", inside + F.col("_before")).select(*df.columns, "position")


def take_random(df: DataFrame, n: int, uid: str = "uid", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement."""
    if n <= 1000:
        return shuffled(df, uid, seed).limit(n)
    return _picked(_mark_first(df, F.lit(n), uid, seed))


def _picked(marked: DataFrame) -> DataFrame:
    return marked.filter("_pick").drop("_pick")


def _keyed(df: DataFrame, uid: str, seed: int) -> DataFrame:
    return df.withColumn("_key", draw_key(F.col(uid), seed)).withColumn("_slot", F.substring("_key", 1, HEX))


def _mark_first(df: DataFrame, quota: Column, uid: str, seed: int) -> DataFrame:
    """Add ``_pick`` for the first ``quota`` rows in hash order, by the cut described at mark_quotas."""
    keyed = _keyed(df, uid, seed)
    upto = F.sum("n").over(Window.orderBy("_slot"))  # over at most 16**HEX rows
    cut = (keyed.groupBy("_slot").agg(F.count("*").alias("n"))
           .withColumn("_before", upto - F.col("n")).withColumn("_quota", quota)
           .filter((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("n") >= F.col("_quota")))
           .agg(F.max(F.struct(F.col("_slot").alias("slot"), (F.col("_quota") - F.col("_before")).alias("left"))).alias("c")))
    placed = keyed.withColumn("_c", cut.scalar()).select(
        "*", F.col("_c.slot").alias("_cut"), F.col("_c.left").alias("_left"), (quota > 0).alias("_open"))
    return _mark(placed, df.columns, [], uid)


def _mark(placed: DataFrame, columns: list[str], groups: list[str], uid: str) -> DataFrame:
    """Rows off the cut slot are decided by comparison; only the rows of the cut slot are ordered."""
    at_cut = F.coalesce(F.col("_slot") == F.col("_cut"), F.lit(False))
    before = F.col("_cut").isNull() | (F.col("_slot") < F.col("_cut"))
    sure = placed.filter(~at_cut).select(*columns, F.coalesce(F.col("_open") & before, F.lit(False)).alias("_pick"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_slot").orderBy("_key", uid))
    edge = placed.filter(at_cut).select(*columns, (F.col("_open") & (rank <= F.col("_left"))).alias("_pick"))
    return sure.unionAll(edge)


MAX_BROADCAST_GROUPS = 50_000


def mark_quotas(df: DataFrame, group: str, quotas: DataFrame, uid: str = "uid", seed: int = 42, few_groups: bool | None = None) -> DataFrame:
    """Add ``_pick``: true for exactly min(quota, rows) random rows of each group, false elsewhere.

    ``quotas`` is (group, quota).  A histogram of hash slots finds the slot where each quota ends; rows
    before it are picked by comparison and only the rows of that slot are ordered.  No group, however
    large, is shuffled or sorted as a whole.  The limits are one row per group.  With ``few_groups`` the caller
    states that groups are few by nature (strata, score bins, labels): limits are broadcast and no job runs while the
    plan is built.  Without it they are counted first, and broadcast up to MAX_BROADCAST_GROUPS.
    """
    quotas = quotas.select(F.col(group).alias("_group"), F.col("quota").cast("long").alias("quota"))
    few = few_groups if few_groups is not None else quotas.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    keyed = _keyed(df, uid, seed)
    same = F.col(group).eqNullSafe(F.col("_group"))  # a NULL group is a group
    counts = keyed.groupBy(group, "_slot").agg(F.count("*").alias("n"))
    histogram = counts.join(F.broadcast(quotas) if few else quotas, same).select("_group", "quota", "_slot", "n")
    upto = Window.partitionBy("_group").orderBy("_slot")
    cuts = (histogram.withColumn("_before", F.sum("n").over(upto) - F.col("n"))
            .filter((F.col("_before") < F.col("quota")) & (F.col("_before") + F.col("n") >= F.col("quota")))
            .select(F.col("_group").alias("_of"), F.col("_slot").alias("_cut"), (F.col("quota") - F.col("_before")).alias("_left")))
    limits = quotas.join(cuts, F.col("_group").eqNullSafe(F.col("_of")), "left").select("_group", "_cut", "_left", (F.col("quota") > 0).alias("_open"))
    placed = keyed.join(F.broadcast(limits) if few else limits, same, "left").drop("_group")
    return _mark(placed, df.columns, [group], uid)


def quota_sample(df: DataFrame, group: str, quotas: DataFrame, uid: str = "uid", seed: int = 42, few_groups: bool | None = None) -> DataFrame:
    """Exactly min(quota, rows) rows of each group; groups without a quota give none."""
    return _picked(mark_quotas(df, group, quotas, uid, seed, few_groups))


def literal_quotas(df: DataFrame, group: str, quotas: dict[str, int]) -> DataFrame:
    rows = [(str(name), int(n)) for name, n in quotas.items()]
    return df.sparkSession.createDataFrame(rows, f"{group} string, quota long")


def cap_per_domain(df: DataFrame, k: int, domain: str = "domain", uid: str = "uid", seed: int = 42) -> DataFrame:
    """At most k random rows per domain."""
    return top_per_group(df, [domain], k, draw_key(F.col(uid), seed), F.col(uid))


def ranked_cap_per_domain(df: DataFrame, k: int, domain: str = "domain", uid: str = "uid") -> DataFrame:
    """At most k rows per domain: high, medium, other confidence, then probability."""
    rank = F.when(F.col("ai_confidence") == "high", 0).when(F.col("ai_confidence") == "medium", 1).otherwise(2)
    return top_per_group(df, [domain], k, rank, F.col("pred_proba").desc(), F.col(uid))


# Default strata (low, high, share of the target).
STRATA = [(0.70, 0.80, 0.20), (0.80, 0.90, 0.35), (0.90, 1.01, 0.45)]


def stratified_sample(df: DataFrame, target: int, strata=STRATA, uid: str = "uid", seed: int = 42) -> DataFrame:
    """int(target * share) rows of each disjoint probability stratum, or all of them if fewer."""
    p, label, quotas = F.col("pred_proba"), F.lit(None).cast("string"), {}
    for low, high, share in reversed(strata):
        name = f"{low:.2f}-{high:.2f}"
        label = F.when((p >= low) & (p < high), name).otherwise(label)
        quotas[name] = int(target * share)
    marked = df.withColumn("stratum", label).filter(F.col("stratum").isNotNull())
    return quota_sample(marked, "stratum", literal_quotas(df, "stratum", quotas), uid, seed, few_groups=True)


def minimum_per_bin_sample(df: DataFrame, target: int, minimum: int, bin_col: str = "score_bin",
                           uid: str = "uid", seed: int = 42) -> DataFrame:
    """At least ``minimum`` rows per bin (all if fewer), topped up at random to ``target``.

    One histogram of (bin, hash slot) decides both: where each bin's minimum ends, and, over what then remains in the
    slots of all bins, where the top-up ends.  One pass marks the rows; only those of the slots at these ends are ordered.
    Bins are few by nature, so their limits are broadcast.
    """
    keyed = _keyed(df, uid, seed)
    taken_of = lambda quota, upto, n: F.least(F.greatest(quota - (upto - n), F.lit(0)), n)
    upto = F.sum("n").over(Window.partitionBy(bin_col).orderBy("_slot"))
    slots = keyed.groupBy(bin_col, "_slot").agg(F.count("*").alias("n")).withColumn("_got", taken_of(F.lit(minimum), upto, F.col("n")))
    last = lambda got: F.max(F.when(F.col(got) > 0, F.struct(F.col("_slot").alias("slot"), F.col(got).alias("left"))))
    firsts = slots.groupBy(F.col(bin_col).alias("_bin")).agg(last("_got").alias("_first"))
    rest = slots.groupBy("_slot").agg(F.sum(F.col("n") - F.col("_got")).alias("n"), F.sum("_got").alias("_g"))
    over = F.sum("n").over(Window.orderBy("_slot"))  # over at most 16**HEX rows
    more = rest.withColumn("_more", taken_of(target - F.sum("_g").over(Window.partitionBy()), over, F.col("n")))
    placed = keyed.join(F.broadcast(firsts), F.col(bin_col).eqNullSafe(F.col("_bin")), "left").withColumn("_topup", more.agg(last("_more").alias("t")).scalar())
    before = lambda cut: F.coalesce(F.col("_slot") < F.col(f"{cut}.slot"), F.lit(False))
    at = lambda cut: F.coalesce(F.col("_slot") == F.col(f"{cut}.slot"), F.lit(False))
    edge = at("_first") | at("_topup")
    sure = placed.filter(~edge & (before("_first") | before("_topup"))).select(*df.columns)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by, "_slot").orderBy("_key", uid))
    ends = placed.filter(edge).withColumn("_rn", rank(bin_col)).withColumn("_own", before("_first") | at("_first") & (F.col("_rn") <= F.col("_first.left")))
    ends = ends.withColumn("_rn", rank("_own"))
    return sure.unionAll(ends.filter(F.col("_own") | before("_topup") | at("_topup") & (F.col("_rn") <= F.col("_topup.left"))).select(*df.columns))


def bin_quotas(df: DataFrame, target: int, done: DataFrame, bin_col: str = "score_bin") -> DataFrame:
    """Annotation quota per bin: half-even rounded share, remainder to the largest quota, minus done."""
    sizes = df.groupBy(bin_col).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    shares = sizes.withColumn("quota", F.bround(target * (F.col("n") / F.sum("n").over(everything))).cast("long"))
    largest = Window.orderBy(F.desc("quota"), F.desc("n"), bin_col)
    fixed = (shares.withColumn("_rest", target - F.sum("quota").over(everything))
             .withColumn("_first", F.row_number().over(largest) == 1)
             .withColumn("quota", F.col("quota") + F.when(F.col("_first"), F.col("_rest")).otherwise(0)))
    return fixed.join(done, bin_col, "left").select(
        bin_col, "n", "quota", F.coalesce("n_done", F.lit(0)).alias("n_done"),
        F.greatest(F.col("quota") - F.coalesce("n_done", F.lit(0)), F.lit(0)).cast("long").alias("remaining"))


def annotation_queue(df: DataFrame, annotated: DataFrame, quotas: DataFrame, bin_col: str = "score_bin",
                     uid: str = "uid", seed: int = 42) -> DataFrame:
    """Next rows to annotate: random within the bins that still have quota, annotated ones left out."""
    open_rows = df.join(annotated.select(uid), uid, "left_anti")
    return quota_sample(open_rows, bin_col, quotas.select(bin_col, F.col("remaining").alias("quota")), uid, seed, few_groups=True)


def most_uncertain(df: DataFrame, n: int, strategy: str = "entropy", invalid_rate: float = 0.38,
                   uid: str = "uid") -> DataFrame:
    """The n/(1-invalid_rate) most uncertain rows."""
    u = F.round(uncertainty(F.col("pred_proba"), strategy), 9)
    return df.withColumn("uncertainty", u).orderBy(F.desc("uncertainty"), uid).limit(buffered_size(n, invalid_rate))


def stratified_uncertain(df: DataFrame, n: int, strategy: str = "entropy", invalid_rate: float = 0.38,
                         positive_ratio: float = 0.4, uid: str = "uid") -> DataFrame:
    """Uncertain rows from both sides of 0.5; missing positives are replaced by negatives, not vice versa."""
    size = buffered_size(n, invalid_rate)
    u = F.round(uncertainty(F.col("pred_proba"), strategy), 9)
    scored = df.withColumn("uncertainty", u)
    order = [F.desc("uncertainty"), F.col(uid)]
    positive = scored.filter(F.col("pred_proba") > 0.5).orderBy(*order).limit(int(size * positive_ratio))
    negative = scored.filter(F.col("pred_proba") <= 0.5).orderBy(*order).limit(size)
    taken = positive.agg(F.count("*").alias("n")).scalar()
    rank = F.row_number().over(Window.orderBy(*order))  # over at most `size` rows
    rest = negative.withColumn("_rn", rank).filter(F.col("_rn") <= size - taken).drop("_rn")
    return positive.unionByName(rest)


def samples_per_tier(df: DataFrame, k: int, tier: str = "tier", uid: str = "uid", seed: int = 42) -> DataFrame:
    return top_per_group(df, [tier], k, draw_key(F.col(uid), seed), F.col(uid))


def samples_of_top_groups(df: DataFrame, group: str, top: int, k: int, uid: str = "uid", seed: int = 42) -> DataFrame:
    """k random rows of each of the largest groups."""
    largest = (df.groupBy(group).agg(F.count("*").alias("group_size"))
               .orderBy(F.desc("group_size"), group).limit(top))
    return top_per_group(df.join(largest, group), [group], k, draw_key(F.col(uid), seed), F.col(uid))


def proportional_quotas(df: DataFrame, group: str, share: float) -> DataFrame:
    """(group, quota) that sum to ceil(share * rows)."""
    everything = Window.partitionBy()  # one row per group
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(everything))
    wanted = F.ceil(F.col("_all") * share)
    exact = sizes.withColumn("_want", wanted).withColumn("_exact", F.col("_want") * F.col("n") / F.col("_all"))
    based = exact.withColumn("_base", F.floor("_exact")).withColumn("_rest", F.col("_want") - F.sum("_base").over(everything))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("_base") - F.col("_exact"), 9), group))
    return based.select(group, (F.col("_base") + F.when(rank <= F.col("_rest"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_split(df: DataFrame, test_share: float = 0.2, label: str = "label", uid: str = "uid",
                     seed: int = 42) -> DataFrame:
    """Add split = train/test, the same on every run.

    ceil(share * rows) test rows in all, spread over the labels in proportion, the largest remainders
    first.
    """
    marked = mark_quotas(df, label, proportional_quotas(df, label, test_share), uid, seed, few_groups=True)
    return marked.withColumn("split", F.when(F.col("_pick"), "test").otherwise("train")).drop("_pick")
