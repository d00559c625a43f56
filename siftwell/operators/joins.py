"""Joins of samples, annotations, embeddings, metadata and results.

No side is hinted unless its counted rows fit: Spark broadcasts a side only when its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.session import broadcast_if_small, materialise, spread


def annotated_sample(sample: DataFrame, annotations: DataFrame) -> DataFrame:
    return sample.join(annotations, "uid")


def labelled_embeddings(annotations: DataFrame, embeddings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Annotations with their embedding and, where known, their score."""
    return annotations.join(embeddings, "uid").join(metadata.select("uid", "score"), "uid", "left")


def missing_rows(left: DataFrame, right: DataFrame, key: str = "uid") -> DataFrame:
    """One row: how many left rows have no partner."""
    return left.join(right.select(key), key, "left_anti").agg(F.count("*").alias("n_missing"))


def unlabelled_pool(embeddings: DataFrame, metadata: DataFrame, annotated: DataFrame) -> DataFrame:
    return embeddings.join(metadata, "uid").join(annotated.select("uid"), "uid", "left_anti")


def rows_of_keys(wide: DataFrame, keys: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of a large table whose key is in a key set; the key side is reduced to its keys."""
    return wide.join(keys.select(key), key, "left_semi")


def rows_without(df: DataFrame, *taken: DataFrame, key: str = "uid") -> DataFrame:
    for other in taken:
        df = df.join(other.select(key), key, "left_anti")
    return df


def add_translation(base: DataFrame, translation: DataFrame, column: str) -> DataFrame:
    return base.join(translation.select("key", column), "key", "left")


def predictions_with_metadata(predictions: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Inner join with url and score; without any metadata both are NULL."""
    if metadata is None:
        return predictions.withColumns({"url": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    return predictions.join(metadata.select("uid", "url", "score"), "uid")


def backfill(df: DataFrame, source: DataFrame, column: str = "url", key: str = "uid") -> DataFrame:
    """Fill NULLs of a column from another table."""
    filler = source.select(key, F.col(column).alias("_fill"))
    return df.join(filler, key, "left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def run_counts(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates per sampling or adding run, runs without any included."""
    wanted = runs.filter(F.col("step").contains("sample") | F.col("step").contains("add"))
    counts = candidates.groupBy(F.col("batch_id").alias("id")).agg(F.count("uid").alias("candidates_count"))
    return wanted.join(counts, "id", "left").withColumn("candidates_count", F.coalesce("candidates_count", F.lit(0)))


def active_batches(batches: DataFrame, selected: DataFrame) -> DataFrame:
    """Active batches with their present number of members."""
    counts = selected.groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("current_count"))
    return (batches.filter(F.col("status") == "active").join(counts, "id", "left")
            .withColumn("current_count", F.coalesce("current_count", F.lit(0))))


def compare_models(baseline: DataFrame, iteration: DataFrame, metric: str = "f1") -> DataFrame:
    """Same model in two result sets: both values, difference and percent."""
    from siftwell.functions.scores import direction, percent_change

    b = baseline.select("model", F.col(metric).alias("baseline"))
    i = iteration.select("model", F.col(metric).alias("iteration"))
    old, new = F.col("baseline"), F.col("iteration")
    return b.join(i, "model").select(
        "model", old, new, (new - old).alias("change"), percent_change(old, new).alias("change_pct"),
        direction(old, new).alias("trend"))


def unordered_pairs(groups: DataFrame, name: str) -> DataFrame:
    """All pairs of a bounded list of groups (schools, judges): each name meets the later ones once."""
    rows = groups.select(name).distinct().agg(F.array_sort(F.collect_set(name)).alias("names"))
    lefts = rows.select(F.posexplode("names").alias("i", "a"), "names")
    return lefts.select("a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))


def hashed_draws(spark, iterations: int, size: Column | int, rows: DataFrame, seed: int = 42) -> DataFrame:
    """(iteration, index) of resamples with replacement, index taken from a hash of seed, iteration and draw.

    ``rows`` is (iteration-independent) one row per index; the result is iterations x rows by definition.
    """

    its = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")
    draws = rows.select(F.col("idx").alias("draw"), its)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("iteration"), F.col("draw")))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return draws.select("iteration", F.pmod(number, size).alias("idx"))


def resample_join(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """Drawn rows with their multiplicity, folded before the join."""
    weights = draws.groupBy("iteration", "idx").agg(F.count("*").alias("weight"))
    return weights.join(rows, "idx")


WIDE_CRITERIA = 64
"""Criteria whose sums are columns of one row; more of them are summed as rows."""


def resample_totals(rows: DataFrame, ratings: DataFrame, iterations: int, wide: int = WIDE_CRITERIA) -> DataFrame:
    """(iteration, criterion, weight, total): number and sum of the known ratings in every resample of ``rows``.

    ``rows`` is one row per (idx, respondent), ``ratings`` (respondent, criterion, rating).  The draws, iterations x rows
    of them, are made on all cores and summed where they are made; a draw meets its respondent's ratings as one row.
    """
    rows = materialise(rows, "respondents")
    size = rows.agg(F.count("*").alias("n")).scalar()
    draws = hashed_draws(rows.sparkSession, iterations, size, spread(rows.select("idx"), 8))
    own = materialise(rows.join(ratings, "respondent").select("idx", "criterion", "rating"), "own")
    criteria = [r[0] for r in own.select("criterion").distinct().limit(wide + 1).collect()]
    if not 0 < len(criteria) <= wide:
        folded = materialise(own.groupBy("idx").agg(F.collect_list(F.struct("criterion", "rating")).alias("own")), "folded")
        each = draws.join(folded, "idx").select("iteration", F.inline("own"))
        return each.groupBy("iteration", "criterion").agg(F.count("rating").alias("weight"), F.sum("rating").alias("total"))
    of = [F.col("criterion").eqNullSafe(F.lit(c)) for c in criteria]
    known = F.col("rating").isNotNull().cast("long")
    folded = own.groupBy("idx").agg(  # NULL where the respondent has no row of the criterion
        *[F.sum(F.when(c, known)).alias(f"n{i}") for i, c in enumerate(of)], *[F.sum(F.when(c, F.col("rating"))).alias(f"s{i}") for i, c in enumerate(of)])
    folded = broadcast_if_small(materialise(folded, "folded"), 32 + 16 * len(criteria))
    sums = draws.join(folded, "idx").groupBy("iteration").agg(*[F.sum(c).alias(c) for c in folded.columns if c != "idx"])
    kind = own.schema["criterion"].dataType
    cells = [F.struct(F.lit(c).cast(kind).alias("criterion"), F.col(f"n{i}").alias("weight"), F.col(f"s{i}").alias("total")) for i, c in enumerate(criteria)]
    return sums.select("iteration", F.inline(F.array(*cells))).filter(F.col("weight").isNotNull())
