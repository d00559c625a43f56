"""Distributed running totals, exact quantiles, ranks and top-k without a one-task global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 256


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns).alias("row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col(f"_row.{c}") for c in one_row.columns])


def per_value(df: DataFrame, by: str, groups: list[str] = (), **aggs: Column) -> DataFrame:
    """One row per distinct value, so a value shared by many rows is folded before any ordering."""
    aggs = aggs or {"n": F.count("*")}
    return (df.filter(F.col(by).isNotNull()).groupBy(*groups, by)
            .agg(*[expr.alias(name) for name, expr in aggs.items()]))


def running_totals(values: DataFrame, by: str, sums: list[str], groups: list[str] = (),
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum ordered by ``by``) and ``all_<s>`` (group total).

    ``values`` holds one row per (groups, by).  Rows are spread over value buckets that hold about as many
    values each, whatever their distribution (their bounds are percentiles of the values); each bucket is
    ordered in its own task and shifted by the totals of the buckets before it, so neither a large group nor
    the whole table is ever sorted in one task.  The totals are at most BUCKETS rows per group.
    """
    groups = list(groups)
    # the filter names every column, so that the values are folded once and their exchange serves the bounds too
    known = values.where(F.xxhash64(*groups, *sums) != 0) if groups or sums else values
    bounds = known.agg(F.percentile_approx(by, [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("bounds")).scalar()
    sign = -1 if descending else 1
    below = F.size(F.filter(F.coalesce("_bounds", F.array(F.col(by))), lambda b: b <= F.col(by)))
    placed = values.withColumn("_bounds", bounds).withColumn("_bucket", (sign * below).cast("long")).drop("_bounds")
    order = F.col(by).desc() if descending else F.col(by).asc()
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order)
    upto = Window.partitionBy(*groups).orderBy("_bucket")
    whole = Window.partitionBy(*groups)
    local = placed.select("*", *[F.sum(s).over(inside).alias(f"_cum_{s}") for s in sums])
    last = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(F.col(by).asc() if descending else F.col(by).desc())) == 1
    totals = local.withColumn("_last", last).filter("_last").select(*groups, "_bucket", *[F.col(f"_cum_{s}").alias(f"_t_{s}") for s in sums])
    totals = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"),
        *[(F.sum(f"_t_{s}").over(upto) - F.col(f"_t_{s}")).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums])
    match = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(totals, match).select(
        *values.columns,
        *[(F.col(f"_cum_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], groups: list[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles as (groups, prob, value), exact at any size."""
    cum = running_totals(per_value(df, col, groups), col, ["n"], groups)
    at = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    spots = cum.select("*", at).withColumn("_pos", F.col("prob") * (F.col("all_n") - 1))
    first, last = F.floor("_pos"), F.ceil("_pos")
    covers = lambda i: (i >= F.col("cum_n") - F.col("n")) & (i < F.col("cum_n"))
    share = F.col("_pos") - first
    part = (F.when(covers(first), F.col(col) * (1 - share)).otherwise(0.0)
            + F.when(covers(last), F.col(col) * share).otherwise(0.0))
    return (spots.filter(covers(first) | covers(last))
            .groupBy(*groups, "prob").agg(F.sum(part).alias("value")))


def quantile_columns(df: DataFrame, col: str, named: dict[str, float], groups: list[str] = ()) -> DataFrame:
    """The same quantiles as one column each."""
    q = exact_quantiles(df, col, sorted(set(named.values())), groups)
    return q.groupBy(*groups).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
                                    for name, p in named.items()])


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """Rank of each distinct value with ties averaged: (value column, n, avg_rank)."""
    cum = running_totals(per_value(df, col), col, ["n"])
    return cum.select(col, "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("avg_rank"))


def average_rank_within(partition: list[str], col: str) -> Column:
    """Average rank inside small partitions (one respondent, one judge)."""
    ordered = Window.partitionBy(*partition).orderBy(col)
    tied = Window.partitionBy(*partition, col)
    return F.rank().over(ordered) + (F.count("*").over(tied) - 1) / 2


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order.

    Spark keeps one row per key and input partition before it shuffles, so hot keys stay small.
    """
    return top_per_group(df, keys, 1, *order)


def top_per_group(df: DataFrame, groups: list[str], k: int, *order: Column, rank: str | None = None) -> DataFrame:
    """At most k rows per group.  Up to 1000 Spark trims each input partition before the shuffle;
    beyond that a salted first round trims hot groups in parallel."""
    if k > 1000:
        salts = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
              .withColumn("_rn", F.row_number().over(salts)).filter(F.col("_rn") <= k).drop("_rn", "_salt"))
    w = Window.partitionBy(*groups).orderBy(*order)
    name = rank or "_rn"
    kept = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
