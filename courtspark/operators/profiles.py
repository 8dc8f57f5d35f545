"""Aggregations over logs: latest rows, groups, streaks, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, pearson, ratio
from courtspark.plans.history import with_history
from courtspark.plans.products import pairwise_correlations
from courtspark.plans.sizes import row_count


def newest_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows per key.

    Spark cuts a ``row_number() <= n`` window to n rows per key before the shuffle as well, so
    a hot key sends at most n rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(newest)).where(col("_k") <= n).drop("_k")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, as an aggregate that combines before the shuffle."""
    row = F.struct(*[col(c) for c in df.columns])
    best = F.max_by(row, F.struct(*[col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def last_n_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str], n: int = 3
) -> DataFrame:
    newest = newest_n(df.select(*[col(c) for c in dict.fromkeys([*keys, *order, *names])]), keys, order, n)
    return newest.groupBy(*keys).agg(*[F.avg(col(c)).alias(c) for c in names])


def by_position(df: DataFrame, stats: Sequence[str], position: str = "mapped_pos") -> DataFrame:
    out = []
    for s in stats:
        out.append(F.round(F.avg(col(s)), 2).alias(f"{s}_mean"))
        out.append(F.round(F.stddev_samp(col(s)), 2).alias(f"{s}_std"))
    return df.groupBy(position).agg(*out)


def by_month(df: DataFrame, stats: Sequence[str], date: str = "Date") -> DataFrame:
    month = F.date_format(col(date), "yyyy-MM").alias("month")
    out = []
    for s in stats:
        out += [F.avg(col(s)).alias(f"{s}_mean"), F.count(col(s)).alias(f"{s}_count")]
    return df.groupBy(month).agg(*out)


def by_opponent(df: DataFrame, stats: Sequence[str]) -> DataFrame:
    return df.groupBy("Opp").agg(*[F.round(F.avg(col(s)), 3).alias(s) for s in stats])


def player_consistency(
    df: DataFrame, key: str = "Player", stat: str = "PTS", at_least: int = 10, top: int = 10
) -> DataFrame:
    """Coefficient of variation per player; the ``top`` lowest and highest."""
    cv = (
        df.groupBy(key)
        .agg(
            F.count("*").alias("games"),
            F.avg(col(stat)).alias("mean"),
            F.stddev_samp(col(stat)).alias("std"),
        )
        .where((col("games") >= at_least) & (col("mean") > 0))
        .withColumn("cv", ratio(col("std"), col("mean")))
        .where(col("cv").isNotNull())
    )
    low = cv.orderBy(col("cv"), col(key)).limit(top).withColumn("side", F.lit("most_consistent"))
    high = cv.orderBy(F.desc("cv"), col(key)).limit(top).withColumn("side", F.lit("least_consistent"))
    return low.unionByName(high)


WIDE_PAIRS = 8  # pairs whose states are kept side by side
PAIRS = 60  # pairs that are worth an expression each; more of them take one matrix product


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r of many column pairs, as rows (a, b, r), from one aggregate or one matrix product."""
    if len(pairs) > PAIRS:
        names = list(dict.fromkeys(n for pair in pairs for n in pair))
        at = {n: i for i, n in enumerate(names)}
        r = pairwise_correlations(df, names)
        values = [(a, b, float(r[at[a], at[b]])) for a, b in pairs]  # one number per pair
        rows = [(a, b, None if math.isnan(v) else v) for a, b, v in values]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    if len(pairs) > WIDE_PAIRS:  # so many states in one aggregate are not compiled: a row per pair instead
        each = F.array(*[F.struct(F.lit(i).alias("_i"), col(a).cast("double").alias("_a"), col(b).cast("double").alias("_b")) for i, (a, b) in enumerate(pairs)])
        found = df.select(F.inline(each)).groupBy("_i").agg(pearson(col("_a"), col("_b")).alias("r"))
        every = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "_i int, a string, b string")
        return every.join(found, "_i", "left").select("a", "b", "r")
    row = df.agg(*[pearson(col(a), col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(f"_{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.inline(items))


def strong_pairs(df: DataFrame, stats: Sequence[str], above: float = 0.7) -> DataFrame:
    """Pairs with |r| above the limit and r below 1, in both directions.

    A hair below 1 counts as 1, since the last digit of r depends on the order of the sums.
    """
    stats = list(stats)
    pairs = [(a, b) for i, a in enumerate(stats) for b in stats[i + 1 :]]
    one = correlations(df, pairs).where((F.abs("r") > above) & (col("r") < 1 - 1e-9))
    both = one.unionByName(one.select(col("b").alias("a"), col("a").alias("b"), "r"))
    return both.orderBy(F.desc("r"), "a", "b")


def longest_streak(
    df: DataFrame,
    flag: str = "double_double",
    key: str = "Player",
    order: Sequence[str] = ("Date", "game_id"),
    task_rows: int | None = None,
) -> DataFrame:
    """Longest run of ones per player, with the games played.

    A run that ends at a row is its position minus the position of the last zero before it.
    """
    none = lambda w: {}
    df = df.select(key, *[c for c in order if c != key], flag)
    rows = row_count(df)
    df = with_history(df, [key], order, none, 0, {"_at": ("count", F.lit(1))}, task_rows, rows)
    df = with_history(
        df, [key], order, none, 0, {"_miss": ("max", F.when(col(flag) == 0, col("_at") + 1))}, task_rows, rows
    )
    run = F.when(col(flag) == 1, col("_at") + 1 - F.coalesce(col("_miss"), F.lit(0))).otherwise(0)
    return df.groupBy(key).agg(
        F.max(run).alias("longest_streak"), F.count("*").alias("games")
    )


def top_streaks(streaks: DataFrame, n: int = 10, key: str = "Player") -> DataFrame:
    return streaks.orderBy(F.desc("longest_streak"), col(key)).limit(n)


def dataset_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("Team").alias("teams"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.avg("PTS").alias("mean_pts"),
        F.min("PTS").alias("min_pts"),
        F.max("PTS").alias("max_pts"),
    ).withColumn("columns", F.lit(len(df.columns)))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, positives, negatives, rate, unknown, and the share of each class."""
    x = col(target)
    return df.agg(
        F.count("*").alias("games"),
        F.coalesce(F.sum(x), F.lit(0)).alias("positives"),
        F.count(F.when(x == 0, 1)).alias("negatives"),
        F.avg(x).alias("rate"),
        F.count(F.when(x.isNull(), 1)).alias("missing"),
    ).withColumns(
        {
            "share_positive": ratio(col("positives"), col("games") - col("missing")),
            "share_negative": ratio(col("negatives"), col("games") - col("missing")),
        }
    )


def feature_coverage(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Per expected feature: whether it is a column and how many of its values are known.

    Columns are tested while the plan is built; the counts are one aggregate.
    """
    pairs = [(g, f) for g, names in groups.items() for f in names]
    have = {f for _, f in pairs if f in df.columns}
    known = df.agg(
        F.count("*").alias("_rows"), *[F.count(col(f)).alias(f"_n_{f}") for f in sorted(have)]
    )
    items = F.array(
        *[
            F.struct(
                F.lit(g).alias("feature_group"),
                F.lit(f).alias("feature"),
                F.lit(int(f in have)).alias("present"),
                (col(f"_n_{f}") if f in have else F.lit(0)).cast("long").alias("known"),
                col("_rows").alias("rows"),
            )
            for g, f in pairs
        ]
    )
    return known.select(F.inline(items))


def group_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("feature_group").agg(
        F.count("*").alias("expected"),
        F.sum("present").alias("existing"),
        F.avg("present").alias("coverage"),
    )


def importance_rollup(scores: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Mean importance per feature over models, with rank and cumulative share.

    One row per feature, so the ordered window is bounded by the width of the model input.
    """
    mean = scores.groupBy("feature").agg(F.avg("importance").alias("importance"))
    if groups is not None:
        mean = mean.join(groups, "feature", "left")
    order = [F.desc("importance"), col("feature")]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return mean.select(
        "*",
        F.row_number().over(Window.orderBy(*order)).alias("place"),
        ratio(F.sum("importance").over(upto), F.sum("importance").over(whole)).alias("cumulative"),
    )


def top_features(scores: DataFrame, n: int, by: str = "importance") -> DataFrame:
    return scores.orderBy(F.desc(by), "feature").limit(n)


def newest_events(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The n newest rows of the whole table: a top-k, not a global sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def missing_share(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Share of missing values per column, as numbers on the driver."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return {c: 1 - row[f"c{i}"] / row["_n"] if row["_n"] else 1.0 for i, c in enumerate(names)}


def drop_sparse_columns(df: DataFrame, names: Sequence[str], known_share: float = 0.5) -> DataFrame:
    """Drop the named columns with fewer known values than the share of rows."""
    shares = missing_share(df, names)
    return df.drop(*[c for c, missing in shares.items() if 1 - missing < known_share])


def bucket(x: Column, low: float, width: float) -> Column:
    return F.floor((x - low) / width) * width + low
