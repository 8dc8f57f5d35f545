"""Feature lists: by priority, by correlation, by combined scores, for betting lines.

Numbers come from Spark aggregates; only the small matrix of coefficients is walked on the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, flag
from courtspark.operators.cleaning import fill_missing, fills_by_median, medians
from courtspark.operators.features import SAME_GAME
from courtspark.operators.loading import numeric_columns
from courtspark.operators.profiles import correlations, missing_share, newest_events
from courtspark.plans.ordering import exact_quantiles

# --- fixed values: columns that are never model input -----------------------------------------
IDENTIFIERS = ("Team", "Player", "Date", "Away", "Opp", "Result", "MP", "GS", "game_id", "ts")
BOX_SCORE = ("FG", "FGA", "FG%", "2P", "2PA", "2P%", "3P", "3PA", "3P%", "FT", "FTA", "FT%",
             "PTS", "ORB", "DRB", "TRB", "AST", "STL", "BLK", "TOV", "PF")
HELPERS = ("day_of_week", "month", "days_rest", "is_home", "is_away_numeric")
DOUBLE_HELPERS = ("day_of_week", "month", "days_rest", "days_into_season", "is_home", "is_started",
                  "Height_Inches", "Weight", "BMI")
KNOWN_COLLINEAR = (
    "ultimate_scoring_projection", "ensemble_projection_v1", "total_direct_projection",
    "efficiency_volume_interaction", "high_confidence_projection", "master_projection",
    "final_master_prediction", "projection_confidence_score", "certainty_factor",
    "matchup_offensive_edge", "matchup_defensive_edge", "vs_opp_total_history", "win_pct_3g",
    "win_pct_7g", "volume_efficiency_quality_interaction", "projection_context_interaction",
)

# --- fixed values: keyword groups of the win model with their caps ------------------------------
WIN_GROUPS = (
    (8, ("team_win_rate_5g", "team_win_rate_10g", "weighted_win_rate_5g", "weighted_win_rate_10g",
         "home_win_rate_10g", "away_win_rate_10g", "win_momentum_5g", "win_momentum_10g")),
    (8, ("pts_hist_avg_5g", "pts_hist_avg_10g", "pts_opp_hist_avg_5g", "pts_opp_hist_avg_10g",
         "point_diff_hist_avg_5g", "point_diff_hist_avg_10g", "pts_consistency_5g",
         "pts_consistency_10g")),
    (6, ("fg_pct_hist_avg_5g", "fg_pct_hist_avg_10g", "3p_pct_hist_avg_5g", "3p_pct_hist_avg_10g",
         "ft_pct_hist_avg_5g", "ft_pct_hist_avg_10g")),
    (4, ("is_weekend", "is_back_to_back", "home_advantage", "rest_advantage")),
    (4, ("opponent_recent_form", "opponent_season_record", "last_vs_opp_result",
         "revenge_motivation")),
)
WIN_CRITICAL = ("home_win_rate_10g", "away_win_rate_10g")

# --- fixed values: fixed order, keyword groups and critical names of the double-double model ----
DOUBLE_TOP = (
    "team_rebounding_importance", "overall_consistency", "team_scoring_importance",
    "ast_trend_factor", "trb_dd_proximity", "ast_consistency_5g", "usage_consistency_5g",
    "pts_above_avg", "trb_above_avg", "weighted_dd_rate_5g", "starter_boost", "pts_trend_factor",
    "mp_hist_avg_5g", "total_impact_5g", "is_forward",
)
DOUBLE_GROUPS = (
    (8, ("dd_rate_5g", "dd_momentum_5g", "dd_potential_score", "dd_form_trend", "dd_proximity",
         "pts_dd_proximity", "trb_dd_proximity", "ast_dd_proximity"), ("dd_",)),
    (8, ("consistency_5g", "stability", "hist_avg_5g", "trend_factor"),
     ("consistency", "stability", "hist_avg")),
    (6, ("starter_boost", "is_center", "is_guard", "is_forward", "versatility_index"),
     ("is_", "starter_", "versatility")),
)
DOUBLE_CRITICAL = ("starter_boost", "pts_above_avg", "weighted_dd_rate_5g", "overall_consistency")
MAX_FEATURES = 30

# --- fixed values: names looked for by betting features -----------------------------------------
POSITIONAL = {
    "PTS": ("is_guard", "is_forward", "is_center", "height", "weight", "usage_rate",
            "scoring_efficiency", "shooter_rating"),
    "TRB": ("is_forward", "is_center", "height", "weight", "wingspan", "rebounding_rate",
            "box_out_rating", "vertical_leap"),
    "AST": ("is_guard", "is_point_guard", "playmaking_rating", "assist_to_turnover",
            "ball_handling_rating"),
    "3P": ("is_guard", "is_wing", "is_shooter", "three_point_rating", "3P%_mean_10", "3P_volume"),
}


def feature_columns(df: DataFrame, target: str, same_game: bool = False, critical: Sequence[str] = ()) -> list[str]:
    """Model input for 'win', 'points', 'total' or 'double': numeric columns without identifiers,
    same-game statistics, targets and helpers. Raises below 20 columns for 'double'."""
    drop = set(IDENTIFIERS) | set(BOX_SCORE) | {f"{c}_Opp" for c in BOX_SCORE}
    drop |= {f"{s}_double" for s in ("PTS", "TRB", "AST", "STL", "BLK")}
    drop |= {"is_win", "double_double", "triple_double", "total_points", "total_score"}
    if target == "win":
        drop |= set(HELPERS)
    if target == "double":
        drop |= set(DOUBLE_HELPERS)
    if target == "points":
        drop |= {"team_scoring_tier", "team_tier_adjusted_projection"}
    if not same_game:
        drop |= SAME_GAME
    names = [c for c in numeric_columns(df) if c not in drop]
    names += [c for c in critical if c in df.columns and c not in names]
    if target == "double" and len(names) < 20:
        raise ValueError(f"only {len(names)} feature columns, at least 20 are needed")
    return names


def win_priority(names: Sequence[str], top: int | None = MAX_FEATURES, groups=WIN_GROUPS) -> list[str]:
    """Keyword groups in order, each with its cap, at most ``top`` in all (30 by the given rule)."""
    chosen: list[str] = []
    for cap, words in groups:
        hits = [n for n in names if any(w in n for w in words)][:cap]
        chosen += [n for n in hits if n not in chosen]
    return chosen[:top]


def double_priority(names: Sequence[str], top: int | None = MAX_FEATURES, groups=DOUBLE_GROUPS) -> list[str]:
    """Fixed top list, keyword groups that stop at their caps, critical names kept; at most ``top``
    names (30 by the given rule)."""
    chosen = [n for n in DOUBLE_TOP if n in names]
    for cap, words, counted in groups:
        for n in names:
            if n in chosen or not any(w in n for w in words):
                continue
            chosen.append(n)
            if sum(any(k in c for k in counted) for c in chosen) >= cap:
                break
    chosen = chosen[:top]
    for n in DOUBLE_CRITICAL:
        if n in names and n not in chosen:
            if top is None or len(chosen) < top:
                chosen.append(n)
            else:
                chosen[-1] = n
    return chosen


# ------------------------------------------------------------------ correlation


def correlate_with_target(df: DataFrame, target: str, names: Sequence[str] | None = None, top: int | None = 20) -> DataFrame:
    """|Pearson r| with the target, largest first; columns without a value are left out."""
    if names is None:
        names = [c for c in numeric_columns(df) if c not in (*IDENTIFIERS, target)]
    found = correlations(df, [(n, target) for n in names]).select(
        col("a").alias("feature"), F.abs("r").alias("correlation")
    )
    found = found.where(col("correlation").isNotNull() & ~F.isnan("correlation"))
    found = found.orderBy(F.desc("correlation"), "feature")
    return found if top is None else found.limit(top)


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """Pearson matrix of the columns, missing values filled by medians first."""
    names = list(names)
    filled = fill_missing(df.select(*[col(n) for n in names]), fills_by_median(df, names))
    vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(
        filled.select(*[col(n).cast("double").alias(n) for n in names])
    )
    return Correlation.corr(vectors, "_v").first()[0].toArray().tolist()


def drop_weaker(names: Sequence[str], strength: Mapping[str, float], matrix, above: float = 0.95) -> list[str]:
    """Of every pair above the limit, drop the one less correlated with the target."""
    removed = set()
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            if abs(matrix[i][j]) > above:
                b = names[j]
                removed.add(b if strength.get(a, 0) >= strength.get(b, 0) else a)
    return [n for n in names if n not in removed]


def select_by_correlation(
    df: DataFrame, target: str, names: Sequence[str], at_least: float = 0.08, above: float = 0.95, top: int = 30
) -> list[str]:
    """Correlated with the target, not collinear with a stronger feature, the 30 strongest."""
    rows = correlate_with_target(df, target, names, None).where(col("correlation") >= at_least).collect()
    strength = {r["feature"]: r["correlation"] for r in rows}  # one number per column
    kept = [n for n in names if n in strength and n not in KNOWN_COLLINEAR]
    if len(kept) > 1:
        kept = drop_weaker(kept, strength, correlation_matrix(df, kept), above)
    if len(kept) > top:
        kept = sorted(kept, key=lambda n: -strength[n])[:top]
    return kept


def drop_collinear_both(df: DataFrame, names: Sequence[str], above: float = 0.8, top: int | None = None) -> list[str]:
    """Drop every feature that is part of a pair above the limit; keep the first ``top`` others, or all.

    Coefficients use the rows where both features are known.
    """
    names = list(names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    hits = correlations(df, pairs).where(F.abs("r") > above).collect()
    bad = {n for r in hits for n in (r["a"], r["b"])}
    return [n for n in names if n not in bad][:top]


# ------------------------------------------------------------------ combined scores


def f_scores(df: DataFrame, label: str, names: Sequence[str]) -> dict[str, float]:
    """One-way F statistic of each column for a 0/1 label, from group counts, means, squares."""
    x = lambda n: col(n).cast("double")
    aggs = [F.count("*").alias("n")]
    for i, n in enumerate(names):
        aggs += [F.avg(x(n)).alias(f"m{i}"), F.var_pop(x(n)).alias(f"v{i}")]
    groups = df.where(col(label).isNotNull()).groupBy(label).agg(*aggs).collect()  # one row per class
    size, k, out = sum(g["n"] for g in groups), len(groups), {}
    for i, n in enumerate(names):
        grand = sum(g["n"] * g[f"m{i}"] for g in groups) / size
        between = sum(g["n"] * (g[f"m{i}"] - grand) ** 2 for g in groups)
        within = sum(g["n"] * g[f"v{i}"] for g in groups)
        degrees = max(k - 1, 1), max(size - k, 1)
        out[n] = (between / degrees[0]) / (within / degrees[1]) if within > 0 else 0.0
    return out


def binned_information(df: DataFrame, label: str, names: Sequence[str], bins: int = 10) -> dict[str, float]:
    """Mutual information (nats) of decile-binned columns with the label.

    A binned estimate; the nearest-neighbour estimator of other libraries gives other numbers.
    """
    edges = exact_quantiles(df, names, [i / bins for i in range(1, bins)])
    cells = []
    for n in names:
        place = F.lit(0)
        for e in sorted({v for v in edges[n] if v is not None}):
            place = place + flag(col(n) > e)
        cells.append(F.struct(F.lit(n).alias("feature"), place.alias("bin")))
    joint = (
        df.select(col(label).alias("y"), F.inline(F.array(*cells)))
        .groupBy("feature", "bin", "y")
        .count()
        .collect()  # features x bins x classes rows
    )
    by: dict[str, list] = {}
    for r in joint:
        by.setdefault(r["feature"], []).append((r["bin"], r["y"], r["count"]))
    out = {}
    for n, rows in by.items():
        size = sum(c for _, _, c in rows)
        pb: dict = {}
        py: dict = {}
        for b, y, c in rows:
            pb[b] = pb.get(b, 0) + c
            py[y] = py.get(y, 0) + c
        out[n] = sum(c / size * math.log(c * size / (pb[b] * py[y])) for b, y, c in rows)
    return out


def combined_scores(parts: Sequence[Mapping[str, float]]) -> dict[str, float]:
    """Mean over the methods that scored a feature; the F scores are divided by their maximum."""
    first, *others = parts
    peak = max([1.0, *first.values()])
    scaled = [{n: v / peak for n, v in first.items()}, *others]
    names = dict.fromkeys(n for p in scaled for n in p)
    return {n: sum(p[n] for p in scaled if n in p) / sum(n in p for p in scaled) for n in names}


def top_scores(scores: Mapping[str, float], n: int = 30) -> list[str]:
    return sorted(scores, key=lambda f: (-scores[f], f))[:n]


# ------------------------------------------------------------------ betting features


def betting_features(
    df: DataFrame,
    target: str,
    line: float,
    base: Sequence[str],
    at_least: float = 0.2,
    known_share: float = 0.7,
) -> list[str]:
    """Line names, the ten base features most correlated with 'over', then positional, matchup
    and consistency names, without repeats and without columns that miss 30 % or more."""
    text = f"{line:g}"
    present = lambda names: [n for n in names if n in df.columns]
    base = present(base)
    over = df.withColumn("_over", flag(col(target) > float(line)))
    numeric = [n for n in base if n in numeric_columns(df)]
    strong = correlate_with_target(over, "_over", numeric, None).where(col("correlation") >= at_least)
    strongest = [r["feature"] for r in strong.limit(10).collect()]
    on_line = [f"{target}_over_{text}_{s}" for s in ("prob_5", "prob_10", "book_prob", "line_diff", "value_rating")]
    matchup = [
        f"opp_{target}_allowed_mean_5", f"opp_{target}_rank", f"matchup_{target}_advantage",
        f"{target}_vs_opp_history", "opp_defensive_rating", f"favorable_matchup_{target}",
    ]
    steady = [f"{target}_consistency_score", f"{target}_volatility_5", f"{target}_momentum_10", f"{target}_upward_trend"]
    ordered = [*present(on_line), *strongest, *present(POSITIONAL.get(target, ())), *present(matchup), *present(steady)]
    names = list(dict.fromkeys([*ordered, *base]))
    shares = missing_share(df, names) if names else {}
    return [n for n in names if shares[n] < 1 - known_share]


def high_confidence_columns(
    df: DataFrame,
    target: str,
    order: Sequence[str],
    at_least: float = 0.9,
    newest: int = 20,
    fallback: float = 0.8,
) -> list[str]:
    """Probability columns of a target whose median and recent mean reach the limit, with the
    columns that share their base name; once more with the lower limit when none does."""
    probs = [c for c in df.columns if "_prob_" in c and target in c]
    if not probs:
        return []
    middle = medians(df, probs)
    means = [F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(probs)]
    recent = newest_events(df, newest, order).agg(*means).first()  # one row
    for limit in dict.fromkeys([at_least, min(at_least, fallback)]):
        found: list[str] = []
        for i, c in enumerate(probs):
            if (middle[c] or 0) >= limit and (recent[f"c{i}"] or 0) >= limit:
                base = c.split("_prob_")[0]
                found += [c, *[o for o in df.columns if base in o]]
        if found:
            return list(dict.fromkeys(found))
    return []
