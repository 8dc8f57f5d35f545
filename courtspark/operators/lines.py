"""Statistics against betting lines: shares, confidence, windows, opponents, players.

Per-line counts are conditional aggregates of one pass, so rows are not multiplied by lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions.scalars import col, flag, with_scalar
from courtspark.operators.loading import recent_days
from courtspark.operators.profiles import newest_events


def lines_of(target: str) -> tuple[float, ...]:
    if target not in fixed.TARGET_LINES:
        raise ValueError(f"no lines for {target}")
    return tuple(float(x) for x in fixed.TARGET_LINES[target])


def over_line_flags(df: DataFrame, target: str, lines: Sequence[float] | None = None) -> DataFrame:
    """One row per game and line, with 1 when the value is over the line; unknown counts as 0."""
    lines = lines_of(target) if lines is None else lines
    items = F.array(
        *[
            F.struct(F.lit(float(x)).alias("line"), flag(col(target) > float(x)).alias("over"))
            for x in lines
        ]
    )
    return df.select("*", F.inline(items))


def nearest_line(x: Column, lines: Sequence[float]) -> dict[str, Column]:
    """Nearest line (the lower one of two equally near) and, unless exact, its two neighbours."""
    lines = sorted(float(v) for v in lines)
    near = F.array_min(
        F.array(*[F.struct(F.abs(x - v).alias("gap"), F.lit(v).alias("line")) for v in lines])
    ).getField("line")
    table = F.array(*[F.lit(v) for v in lines])
    at = F.array_position(table, near).cast("int")
    exact = near == x
    return {
        "closest_line": F.when(x.isNotNull(), near),
        "upper_line": F.when(~exact & (at < len(lines)), F.try_element_at(table, at + 1)),
        "lower_line": F.when(~exact & (at > 1), F.try_element_at(table, F.greatest(at - 1, F.lit(1)))),
    }


Pairs = Sequence[tuple[str, float]]


def line_pairs(targets: str | Sequence[str], lines: Sequence[float] | None = None) -> list[tuple[str, float]]:
    """(target, line) pairs: the usual lines of each target unless lines are given."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    return [(t, float(x)) for t in targets for x in (lines_of(t) if lines is None else lines)]


def _rows(pairs: Pairs, make) -> Column:
    """Array of structs (target, line, ...): one per pair."""
    return F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.lit(x).alias("line"), *make(i))
            for i, (t, x) in enumerate(pairs)
        ]
    )


def line_shares(df: DataFrame, pairs: Pairs, by: Sequence[str] = ()) -> DataFrame:
    """Rows and overs per target and line (and group), all from one aggregate."""
    aggs = [F.count(F.when(col(t) > x, 1)).alias(f"_o{i}") for i, (t, x) in enumerate(pairs)]
    counted = df.groupBy(*by).agg(F.count("*").alias("samples"), *aggs)
    items = _rows(pairs, lambda i: [col(f"_o{i}").alias("overs")])
    return counted.select(*by, "samples", F.inline(items))


def recent_windows(
    df: DataFrame, pairs: Pairs, order: Sequence[str] = ("Date", "game_id")
) -> DataFrame:
    """max(m, 1-m) over the newest 3, 5, 10 and 20 rows of all players together.

    Only the 20 newest rows reach the ordered window.
    """
    most = max(fixed.RECENT_WINDOWS)
    names = dict.fromkeys([*order, *[t for t, _ in pairs]])
    newest = newest_events(df.select(*[col(n) for n in names]), most, order)
    placed = newest.withColumn("_k", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))
    over = lambda t, x: flag(col(t) > x).cast("double").alias("over")
    items = F.array(
        *[F.struct(F.lit(t).alias("target"), F.lit(x).alias("line"), over(t, x)) for t, x in pairs]
    )
    aggs = []
    for w in fixed.RECENT_WINDOWS:
        m = F.avg(F.when(col("_k") <= w, col("over")))
        aggs.append(F.when(F.count("*") >= w, F.greatest(m, 1 - m)).alias(f"window_{w}"))
    return placed.select("_k", F.inline(items)).groupBy("target", "line").agg(*aggs)


def window_consistency() -> Column:
    """Average of the known windows, weighted by 1 / window."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for w in fixed.RECENT_WINDOWS:
        m = col(f"window_{w}")
        top = top + F.coalesce(m / w, F.lit(0.0))
        bottom = bottom + F.when(m.isNotNull(), 1.0 / w).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def line_confidence(
    df: DataFrame,
    targets: str | Sequence[str],
    lines: Sequence[float] | None = None,
    lookback_days: int = 60,
    min_samples: int = 30,
    order: Sequence[str] = ("Date", "game_id"),
) -> DataFrame:
    """Confidence of every line over the recent rows: raw, volatility, windows, adjusted.

    All targets and lines come from one pass over the log and one top-20.
    """
    pairs = line_pairs(targets, lines)
    recent = recent_days(df, lookback_days)
    shares = line_shares(recent, pairs).where(col("samples") >= min_samples)
    p = col("overs") / col("samples")
    n = col("samples")
    shares = shares.withColumns(
        {
            "over_share": p,
            "under_share": 1 - p,
            "prediction": F.when(p >= 0.5, "over").otherwise("under"),
            "confidence": F.greatest(p, 1 - p),
            "volatility": F.when(n > 1, F.sqrt(n * p * (1 - p) / (n - 1))).otherwise(0.5),
        }
    )
    joined = shares.join(recent_windows(recent, pairs, order), ["target", "line"], "left")
    base = col("confidence") * F.when(
        col("volatility") > 0.3, 1 - (col("volatility") - 0.3)
    ).otherwise(1.0)
    steady = window_consistency()
    adjusted = F.when(steady.isNotNull(), 0.7 * base + 0.3 * steady).otherwise(base)
    return joined.withColumn("adjusted_confidence", adjusted)


def confident_lines(confidence: DataFrame, at_least: float = 0.96) -> DataFrame:
    return confidence.where(col("adjusted_confidence") >= at_least)


def line_by_opponent(
    df: DataFrame, target: str | Sequence[str], lines: Sequence[float] | None = None, at_least: int = 3
) -> DataFrame:
    shares = line_shares(df, line_pairs(target, lines), ["Opp"]).where(col("samples") >= at_least)
    p = col("overs") / col("samples")
    return shares.withColumn("consistency", F.greatest(p, 1 - p))


def player_vs_lines(
    df: DataFrame,
    target: str | Sequence[str],
    lines: Sequence[float] | None = None,
    lookback_days: int = 60,
    at_least: float = 0.96,
    min_rows: int = 30,
    min_games: int = 10,
    key: str = "Player",
) -> DataFrame:
    """Lines that a player beats or misses often enough, over the recent rows: one aggregate for the lines of all
    targets. With several targets a column ``target`` says which."""
    pairs = line_pairs(target, lines)
    targets = list(dict.fromkeys(t for t, _ in pairs))
    recent = recent_days(df, lookback_days)
    size = recent.agg(F.count("*").alias("_rows"))
    about = {"avg_value": F.avg, "std_value": F.stddev_samp, "min_value": F.min, "max_value": F.max}
    players = recent.groupBy(key).agg(
        F.count("*").alias("num_games"),
        *[make(col(t)).alias(f"_{name}_{i}") for i, t in enumerate(targets) for name, make in about.items()],
        *[F.count(F.when(col(t) > x, 1)).alias(f"_o{i}") for i, (t, x) in enumerate(pairs)],
    )
    # the numbers of a target go along with each of its lines
    own = lambda i: [col(f"_{name}_{targets.index(pairs[i][0])}").cast("double").alias(name) for name in about]
    items = _rows(pairs, lambda i: [*own(i), col(f"_o{i}").alias("_overs")])
    p = col("_overs") / col("num_games")
    out = (
        with_scalar(players, size)
        .where((col("num_games") >= min_games) & (col("_rows") >= min_rows))
        .select(key, "num_games", F.inline(items))
        .withColumns(
            {
                "over_rate": p,
                "confidence": F.greatest(p, 1 - p),
                "prediction": F.when(p >= 0.5, "over").otherwise("under"),
            }
        )
        .where(col("confidence") >= at_least)
    )
    return out.drop("_overs", *(["target"] if isinstance(target, str) else []))


def player_line_summary(df: DataFrame, found: DataFrame, lookback_days: int = 60, key: str = "Player") -> DataFrame:
    """Players seen in the recent rows, players with a confident line, and confident lines."""
    seen = recent_days(df, lookback_days).agg(F.count_distinct(key).alias("players_analyzed"))
    hits = found.agg(
        F.count_distinct(key).alias("players_with_high_confidence"),
        F.count("*").alias("total_high_confidence_lines"),
    )
    return with_scalar(seen, hits)
