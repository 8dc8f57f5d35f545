"""Imputing, winsorizing, transforming and aligning numeric columns.

Statistics are fitted on one table and applied to another, so that a test set never shapes its
own filling; medians and quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions.scalars import clip, col, finite, ratio, with_scalar
from courtspark.plans.ordering import average_rank_share, exact_quantiles

Fills = Mapping[str, float | str]
Bounds = Mapping[str, tuple[float | None, float | None]]


def medians(df: DataFrame, names: Sequence[str], limit: int | None = None) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, names, [0.5], limit).items()}


def fills_by_name(
    df: DataFrame, names: Sequence[str], pace: bool = False, limit: int | None = None
) -> dict[str, float]:
    """Fixed values for percent and point columns (and pace, if asked), else median, else 0."""
    out, others = {}, []
    for c in names:
        low = c.lower()
        if "pct" in low or "%" in low:
            out[c] = fixed.NAME_FILL_PERCENT
        elif "pts" in low or "score" in low:
            out[c] = fixed.NAME_FILL_POINTS
        elif pace and "pace" in low:
            out[c] = fixed.NAME_FILL_PACE
        else:
            others.append(c)
    found = medians(df, others, limit) if others else {}
    return out | {c: 0.0 if v is None else v for c, v in found.items()}


def fills_by_median(df: DataFrame, names: Sequence[str], limit: int | None = None) -> dict[str, float]:
    """Median of the finite values, or 0 when a column has none.

    A mean exists only where a median does, so the chain median, mean, 0 needs no mean.
    """
    clean = df.select(*[finite(col(c).cast("double")).alias(c) for c in names])
    return {c: 0.0 if v is None else v for c, v in medians(clean, names, limit).items()}


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column; the smallest one wins a tie.

    Counted per value before anything is gathered, since ``mode`` keeps all values in one state.
    """
    if not names:
        return {}
    texts = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("v")) for c in names])
    counts = df.select(F.inline(texts)).where("v IS NOT NULL").groupBy("name", "v").count()
    best = counts.groupBy("name").agg(F.min_by("v", F.struct(-col("count"), col("v"))).alias("v"))
    found = {r["name"]: r["v"] for r in best.collect()}  # one row per column
    return {c: found.get(c, "0") for c in names}


def fill_missing(df: DataFrame, fills: Fills) -> DataFrame:
    """Apply fitted values; infinities and NaN count as missing."""
    columns = {}
    for c, v in fills.items():
        x = col(c) if isinstance(v, str) else finite(col(c).cast("double"))
        columns[c] = F.coalesce(x, F.lit(v))
    return df.withColumns(columns) if columns else df


def quantile_bounds(
    df: DataFrame, names: Sequence[str], low: float = 0.01, high: float = 0.99, limit: int | None = None
) -> dict[str, tuple[float | None, float | None]]:
    return {c: (q[0], q[1]) for c, q in exact_quantiles(df, names, [low, high], limit).items()}


def iqr_bounds(
    df: DataFrame, names: Sequence[str], factor: float = 3.0, limit: int | None = None
) -> dict[str, tuple[float | None, float | None]]:
    out = {}
    for c, (a, b) in exact_quantiles(df, names, [0.25, 0.75], limit).items():
        out[c] = (None, None) if a is None else (a - factor * (b - a), b + factor * (b - a))
    return out


def zscore_bounds(
    df: DataFrame, names: Sequence[str], factor: float = 3.0
) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population deviation; only values beyond the bounds are moved to them."""
    row = df.agg(
        *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    out = {}
    for i, c in enumerate(names):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (None, None) if m is None else (m - factor * s, m + factor * s)
    return out


def winsorize(df: DataFrame, bounds: Bounds) -> DataFrame:
    columns = {
        c: clip(col(c).cast("double"), F.lit(a), F.lit(b)) for c, (a, b) in bounds.items() if a is not None
    }
    return df.withColumns(columns) if columns else df


def sanitize(x: Column, infinite: float = 1000.0, limit: float | None = 1e6) -> Column:
    """NaN and null to 0, infinities to +-``infinite``, then limited."""
    x = x.cast("double")
    safe = (
        F.when(x.isNull() | F.isnan(x), 0.0)
        .when(x == F.lit(float("inf")), infinite)
        .when(x == F.lit(float("-inf")), -infinite)
        .otherwise(x)
    )
    return safe if limit is None else clip(safe, -limit, limit)


def sanitize_matrix(df: DataFrame, names: Sequence[str], scaled: bool = False) -> DataFrame:
    """Feature columns made safe for a model; after scaling infinities become +-1."""
    safe = (lambda c: sanitize(c, 1.0, None)) if scaled else sanitize
    return df.withColumns({c: safe(col(c)) for c in names})


def clip_predictions(x: Column, low: float, high: float, default: float) -> Column:
    value = x.cast("double")
    known = value.isNotNull() & ~F.isnan(value)
    return F.when(known, clip(value, low, high)).otherwise(F.lit(default))


# ------------------------------------------------------------------ transforms


def transforms(name: str) -> dict[str, Column]:
    """Row-wise transforms of one column, negative values taken as 0."""
    x = F.greatest(col(name).cast("double"), F.lit(0.0))
    x = F.when(col(name).isNotNull(), x)
    return {
        f"{name}_sqrt": F.sqrt(x),
        f"{name}_log2": F.log2(x + 1),
        f"{name}_log": F.log1p(x),
        f"{name}_log10": F.log10(x + 1),
        f"{name}_yj": 2 * F.sqrt(x + 1) - 2,
        f"{name}_boxcox": (F.sqrt(x + 1) - 1) / 0.5,
        f"{name}_power2": x * x,
        f"{name}_power3": x * x * x,
        f"{name}_inv": 1 / (x + 1e-8),
    }


def per_minute(name: str, minutes: str = "MP") -> Column:
    return col(name) / F.greatest(col(minutes), F.lit(1.0))


def average_ratio(short: str, long: str) -> Column:
    return col(short) / F.greatest(col(long), F.lit(1.0))


def product(a: str, b: str, square_a: bool = False, square_b: bool = False) -> Column:
    x, y = col(a).cast("double"), col(b).cast("double")
    return (x * x if square_a else x) * (y * y if square_b else y)


def scaled_transforms(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """z-score, min-max and rank of one column, from one aggregate and one ranking."""
    x = F.when(col(name).isNotNull(), F.greatest(col(name).cast("double"), F.lit(0.0)))
    df = df.withColumn("_x", x)
    stats = df.agg(
        F.avg("_x").alias("_mean"),
        F.stddev_samp("_x").alias("_std"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.count("_x").alias("_n"),
    )
    ranked = with_scalar(average_rank_share(df, "_x", "_rank", limit), stats)
    v, span = col("_x"), col("_max") - col("_min")
    return ranked.withColumns(
        {
            f"{name}_norm": F.when(col("_std") > 0, (v - col("_mean")) / col("_std")).otherwise(0.0),
            f"{name}_minmax": F.when(span > 0, (v - col("_min")) / span).otherwise(0.5),
            f"{name}_rank": F.when(
                col("_n") > 1, ratio(col("_rank") * col("_n") - 1, col("_n") - 1)
            ).otherwise(0.5),
        }
    ).drop("_x", "_mean", "_std", "_min", "_max", "_n", "_rank")


def default_for(feature: str, target: str = "") -> float:
    low = feature.lower()
    if target == "win" or any(k in low for k in ("pct", "rate", "ratio")):
        return 0.5
    if any(k in low for k in ("log", "sqrt")):
        return 1.0
    return 0.0


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), target: str = "") -> DataFrame:
    """The given features in the given order: missing columns made or defaulted, all finite doubles.

    A missing transform of a column that is present is computed, otherwise a neutral value is
    used. Decided from the column names while the plan is built.
    """
    have = set(df.columns)
    out = [col(c) for c in keep]
    for f in features:
        base = f.split("_")[0]
        made = transforms(base) if base in have else {}
        if f in have:
            x = col(f).cast("double")
        elif f in made:
            x = made[f]
        else:
            x = F.lit(default_for(f, target))
        out.append(F.coalesce(finite(x.cast("double")), F.lit(0.0)).alias(f))
    return df.select(*out)
