"""Feature tables for the four targets: team win, team points, game total, double-double.

All windows of one key share one exchange and one sort. Columns built from the current game's
own box score are listed in ``SAME_GAME`` so that a model can leave them out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.functions import rolling, shooting, situation
from courtspark.functions.scalars import col, fill, flag, with_scalar
from courtspark.plans.history import with_history
from courtspark.plans.ordering import average_rank_share, exact_quantiles
from courtspark.plans.sizes import even_parts, row_count
from courtspark.sources.staging import stage

TEAM, PLAYER = ("Team",), ("Player",)
ORDER = ("Date", "game_id")

SAME_GAME = frozenset(
    {
        "team_possessions", "opp_possessions", "real_possessions", "opp_real_possessions",
        "team_true_shooting_approx", "opp_true_shooting_approx", "team_efg_approx",
        "opp_efg_approx", "team_conversion_efficiency", "opp_conversion_efficiency",
        "team_direct_scoring_projection", "team_total_shot_volume", "opp_total_shot_volume",
        "team_weighted_shot_volume", "team_expected_shots", "opp_expected_shots",
        "team_mathematical_projection", "team_hybrid_projection", "team_scoring_pressure",
        "team_pace_efficiency_interaction", "team_quality_efficiency_interaction",
        "team_pressure_quality", "team_enhanced_projection", "team_stability_adjustment",
        "team_final_projection", "team_final_prediction", "team_prediction_confidence",
        "team_low_scoring_efficiency", "team_mid_scoring_efficiency",
        "team_high_scoring_efficiency", "possessions", "true_shooting_pct",
        "opp_true_shooting_pct", "efg_pct", "opp_efg_pct", "conversion_efficiency",
        "combined_conversion_efficiency", "direct_scoring_projection",
        "opp_direct_scoring_projection", "total_direct_projection", "total_shot_volume",
        "weighted_shot_volume", "total_expected_shots", "total_game_pace",
        "mathematical_total_projection", "hybrid_scoring_projection",
        "pace_efficiency_interaction", "quality_efficiency_interaction", "final_projection",
        "final_prediction", "prediction_confidence", "usage_rate_approx", "pts_efficiency",
        "pts_above_historical_5g", "pts_above_historical_10g", "trb_above_historical_5g",
        "trb_above_historical_10g", "ast_above_historical_5g", "ast_above_historical_10g",
    }
)


def season_day(df: DataFrame, date: str = "Date") -> DataFrame:
    """Weekday, month, weekend flag and the days since the first date of the whole table."""
    first = df.agg(F.min(date).alias("_first"))
    days = {"days_into_season": F.datediff(col(date), col("_first"))}
    return (
        with_scalar(df, first).withColumns(situation.calendar(col(date)) | days).drop("_first")
    )


def expanding_mean(df: DataFrame, name: str, default: Column | None = None) -> DataFrame:
    """Turn the pair of running columns made by ``running_mean`` into a mean."""
    mean = col(f"_{name}_sum") / F.when(col(f"_{name}_n") > 0, col(f"_{name}_n"))
    if default is not None:
        mean = F.coalesce(mean, default)
    return df.withColumn(name, mean).drop(f"_{name}_sum", f"_{name}_n")


def running_mean(name: str, x: Column) -> dict[str, tuple[str, Column]]:
    x = x.cast("double")
    return {f"_{name}_sum": ("sum", x), f"_{name}_n": ("count", x)}


def _add(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


# ------------------------------------------------------------------ team win


def win_history(w) -> dict[str, Column]:
    out = {"days_rest": rolling.days_rest(w)}
    for n in (5, 10):
        scored, allowed = rolling.rolled(w, col("PTS"), n), rolling.rolled(w, col("PTS_Opp"), n)
        out[f"pts_hist_avg_{n}g"] = scored
        out[f"pts_opp_hist_avg_{n}g"] = allowed
        out[f"point_diff_hist_avg_{n}g"] = scored - allowed
        out[f"pts_consistency_{n}g"] = rolling.consistency(w, col("PTS"), n)
        for stat, label in (("FG%", "fg_pct"), ("3P%", "3p_pct"), ("FT%", "ft_pct")):
            out[f"{label}_hist_avg_{n}g"] = rolling.rolled(w, col(stat), n)
        out[f"team_win_rate_{n}g"] = rolling.win_rate(w, n)
    out["weighted_win_rate_5g"] = rolling.weighted_rate(w, col("is_win"))
    out["win_momentum_5g"] = rolling.rate_momentum(w, col("is_win"))
    out["home_win_rate_10g"] = rolling.venue_rate(w, 0.05)
    out["away_win_rate_10g"] = rolling.venue_rate(w, -0.05)
    return out


def opponent_form(
    df: DataFrame, order=ORDER, task_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    """Form and season record seen from the opponent's side; net rating when recorded."""
    rating = "game_net_rating" in df.columns

    def build(w):
        form = rolling.rolled(w, col("is_win"), 5, "mean", 2)
        out = {"opponent_recent_form": 1 - fill(form, 0.5)}
        if rating:
            power = rolling.rolled(w, col("game_net_rating"), 10, "mean", 3)
            out["opponent_power_rating"] = fill(power, 0.0)
        return out

    out = with_history(
        df,
        ["Opp"],
        order,
        build,
        10,
        running_mean("opponent_season_record", col("is_win")),
        task_rows,
        rows,
    )
    out = expanding_mean(out, "opponent_season_record", F.lit(0.5))
    return out.withColumn("opponent_season_record", 1 - col("opponent_season_record"))


def last_meeting(
    df: DataFrame,
    keys,
    flag_name: str,
    name: str,
    default: float,
    order=ORDER,
    task_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Flag of the previous game against the same opponent."""
    return with_history(
        df,
        [*keys, "Opp"],
        order,
        lambda w: {name: rolling.last_result(w, flag_name, default)},
        1,
        task_rows=task_rows,
        rows=rows,
    )


def win_features(games: DataFrame, order=ORDER, task_rows: int | None = None) -> DataFrame:
    """Features of the win model. Needs ``is_win`` and ``is_home``."""
    if "is_win" not in games.columns:
        raise ValueError("is_win is required")
    rows = row_count(games)
    df = season_day(games)
    df = with_history(df, TEAM, order, win_history, 10, task_rows=task_rows, rows=rows)
    df = last_meeting(df, TEAM, "is_win", "last_vs_opp_result", 0.5, order, task_rows, rows)
    df = opponent_form(df, order, task_rows, rows)
    df = df.withColumn("is_back_to_back", situation.back_to_back())
    return _add(
        df,
        situation.home_factors("win")
        | {
            "energy_factor": situation.energy("win"),
            "altitude_advantage": situation.altitude("win"),
            "rest_advantage": situation.rest_advantage("win"),
            "season_fatigue_factor": situation.month_fatigue("win"),
            "revenge_motivation": rolling.revenge(col("last_vs_opp_result"), 0.04, -0.01),
        },
    )


# ------------------------------------------------------------------ opponent strength


def opponent_averages(
    df: DataFrame, order=ORDER, task_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    def build(w):
        return {
            "_opp_allowed": rolling.rolled(w, col("PTS_Opp"), 10, "mean", 3),
            "_opp_scored": rolling.rolled(w, col("PTS"), 10, "mean", 3),
        }

    return with_history(df, ["Opp"], order, build, 10, task_rows=task_rows, rows=rows)


def opponent_strength(
    df: DataFrame,
    offence_share: float,
    defence: str = "opponent_def_strength",
    offence: str = "opponent_off_strength",
    order=ORDER,
    task_rows: int | None = None,
    games: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Average-rank percentile of the opponents' averages over the whole table.

    Averages and ranks are worked out on a narrow table (row id, opponent, points) taken from
    ``games``, written once since both rankings read it, and joined back by the row id, the last
    column of ``order``. The wide table takes part in that one join only.
    """
    key = order[-1]
    names = dict.fromkeys(["Opp", *order, "PTS", "PTS_Opp"])
    narrow = (df if games is None else games).select(*[col(n) for n in names])
    averages = opponent_averages(narrow, order, task_rows, rows)
    averaged = stage(averages.select(key, "_opp_allowed", "_opp_scored"), "opponents")
    ranked = average_rank_share(averaged, "_opp_allowed", defence, task_rows, rows)
    ranked = average_rank_share(ranked, "_opp_scored", offence, task_rows, rows)
    defended, attacked = fill(col(defence), 0.5), fill(col(offence), 0.5)
    quality = attacked * offence_share + defended * (1 - offence_share)
    return df.join(
        ranked.select(
            key,
            defended.alias(defence),
            attacked.alias(offence),
            quality.alias("opponent_quality_factor"),
        ),
        key,
    )


# ------------------------------------------------------------------ team points


def points_base() -> dict[str, Column]:
    return {
        "team_possessions": shooting.possessions_points(),
        "opp_possessions": shooting.possessions_points("_Opp"),
        "real_possessions": shooting.possessions_points(),
        "opp_real_possessions": shooting.possessions_points("_Opp"),
        "team_true_shooting_approx": shooting.true_shooting_approx(),
        "opp_true_shooting_approx": shooting.true_shooting_approx("_Opp"),
        "team_efg_approx": shooting.effective_fg_approx(),
        "opp_efg_approx": shooting.effective_fg_approx("_Opp"),
        "team_conversion_efficiency": shooting.conversion_weighted(),
        "opp_conversion_efficiency": shooting.conversion_weighted("_Opp"),
        "team_direct_scoring_projection": shooting.direct_projection(),
        "team_total_shot_volume": shooting.shot_volume(),
        "opp_total_shot_volume": shooting.shot_volume("_Opp"),
        "team_weighted_shot_volume": shooting.shot_volume() * shooting.conversion_weighted(),
        "team_expected_shots": shooting.expected_shots(),
        "opp_expected_shots": shooting.expected_shots("_Opp"),
    }


POINTS_ROLLED = (
    ("team_direct_projection", "team_direct_scoring_projection"),
    ("team_conversion_efficiency", "team_conversion_efficiency"),
    ("team_pace", "team_possessions"),
    ("team_ts", "team_true_shooting_approx"),
    ("team_volume", "team_total_shot_volume"),
)


def points_history(w) -> dict[str, Column]:
    out = {"days_rest": rolling.days_rest(w)}
    for n in (3, 5, 7, 10):
        for label, source in POINTS_ROLLED:
            out[f"{label}_avg_{n}g"] = rolling.rolled(w, col(source), n)
    projection = col("team_direct_scoring_projection")
    five = rolling.win_rate(w, 5)
    out |= {
        "team_scoring_stability": rolling.stability_ten(w, projection),
        "team_scoring_pressure": rolling.scoring_pressure(w, projection),
        "team_win_pct_5g": five,
        "team_win_pct_10g": rolling.win_rate(w, 10),
        "team_recent_wins": rolling.recent_wins(w),
        "team_win_streak": rolling.wins_in_last5(w),
        "team_confidence_factor": (five - 0.5) * 4,
        "team_confidence_momentum": rolling.confidence_momentum(w),
    }
    return out


def tier_running() -> dict[str, tuple[str, Column]]:
    out = {}
    for tier in ("low_scoring", "mid_scoring", "high_scoring"):
        in_tier = F.when(col("team_scoring_tier") == tier, col("team_conversion_efficiency"))
        out |= running_mean(f"team_{tier}_efficiency", in_tier)
    return out


def with_scoring_tier(
    df: DataFrame, task_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    median = exact_quantiles(df, ["team_direct_scoring_projection"], [0.5], task_rows, rows)
    (middle,) = median["team_direct_scoring_projection"]
    tier = shooting.scoring_tier(col("team_direct_scoring_projection"), F.lit(middle).cast("double"))
    return df.withColumn("team_scoring_tier", tier)


def points_features(games: DataFrame, order=ORDER, task_rows: int | None = None) -> DataFrame:
    """Features of the team-points model. Needs ``is_win`` or a result text, and ``is_home``."""
    rows = row_count(games)
    df = _add(season_day(games), points_base())
    df = with_scoring_tier(df, task_rows, rows)
    df = with_history(df, TEAM, order, points_history, 10, tier_running(), task_rows, rows)
    for tier in ("low_scoring", "mid_scoring", "high_scoring"):
        df = expanding_mean(df, f"team_{tier}_efficiency", col("team_conversion_efficiency"))
    df = with_history(
        df,
        ["Team", "Opp"],
        order,
        lambda w: {},
        0,
        running_mean("team_vs_opp_scoring_history", col("team_direct_scoring_projection")),
        task_rows,
        rows,
    )
    df = expanding_mean(df, "team_vs_opp_scoring_history")
    df = opponent_strength(df, 0.4, order=order, task_rows=task_rows, games=games, rows=rows)
    ten = col("team_direct_projection_avg_10g")
    df = _add(
        df,
        {
            "team_game_pace": col("team_pace_avg_5g"),
            "team_base_projection": col("team_direct_projection_avg_5g"),
            "team_matchup_edge": F.coalesce(col("team_vs_opp_scoring_history"), ten) - ten,
            "team_is_home": col("is_home"),
            "team_energy_factor": situation.energy("points"),
            "team_home_court_boost": col("is_home") * 2.8,
            "team_season_importance": situation.season_importance("points"),
            "team_altitude_factor": situation.altitude("points"),
            "team_rivalry_factor": situation.rivalry_directed(),
            "team_season_fatigue": situation.month_fatigue("points"),
            "team_urgency_factor": situation.urgency_by_day(),
            "team_rest_advantage": situation.rest_advantage("points"),
        }
        | shooting.team_projection(),
    )
    return _add(_add(df, shooting.team_interactions()), shooting.team_final())


# ------------------------------------------------------------------ game total


def total_base() -> dict[str, Column]:
    own, other = shooting.conversion_mean(), shooting.conversion_mean("_Opp")
    volume = shooting.shot_volume() + shooting.shot_volume("_Opp")
    return {
        "possessions": shooting.possessions_total(),
        "opp_possessions": shooting.possessions_total("_Opp"),
        "real_possessions": shooting.possessions_total_alt(),
        "opp_real_possessions": shooting.possessions_total_alt("_Opp"),
        "true_shooting_pct": shooting.true_shooting(),
        "opp_true_shooting_pct": shooting.true_shooting("_Opp"),
        "efg_pct": shooting.effective_fg(),
        "opp_efg_pct": shooting.effective_fg("_Opp"),
        "conversion_efficiency": own,
        "opp_conversion_efficiency": other,
        "combined_conversion_efficiency": (own + other) / 2,
        "direct_scoring_projection": shooting.direct_projection(),
        "opp_direct_scoring_projection": shooting.direct_projection("_Opp"),
        "total_direct_projection": shooting.direct_projection()
        + shooting.direct_projection("_Opp"),
        "total_shot_volume": volume,
        "weighted_shot_volume": volume * ((own + other) / 2),
        "total_expected_shots": shooting.expected_shots(),
        "opp_expected_shots": shooting.expected_shots("_Opp"),
        "is_win": flag(col("PTS") > col("PTS_Opp")),
    }


TOTAL_ROLLED = (
    ("pts", "PTS"),
    ("pts_allowed", "PTS_Opp"),
    ("ts_pct", "true_shooting_pct"),
    ("opp_ts_pct", "opp_true_shooting_pct"),
    ("pace", "possessions"),
    ("opp_pace", "opp_possessions"),
    ("direct_projection", "direct_scoring_projection"),
)


def total_history(w) -> dict[str, Column]:
    out = {"days_rest": rolling.days_rest(w)}
    for n in (3, 5, 7, 10):
        for label, source in TOTAL_ROLLED:
            out[f"{label}_avg_{n}g"] = rolling.rolled(w, col(source), n)
    out |= {
        "projection_trend": rolling.relative_trend(w, col("direct_scoring_projection")),
        "pts_volatility": rolling.volatility(w, col("PTS")),
        "scoring_momentum": rolling.scoring_momentum(w, col("PTS")),
        "defensive_momentum": rolling.defensive_momentum(w, col("PTS_Opp")),
        "win_pct_5g": rolling.rolled(w, col("is_win"), 5),
    }
    return out


def total_derived() -> dict[str, Column]:
    pts_trend = col("pts_avg_3g") - col("pts_avg_10g")
    allowed_trend = col("pts_allowed_avg_3g") - col("pts_allowed_avg_10g")
    return {
        **{
            f"total_pts_avg_{n}g": col(f"pts_avg_{n}g") + col(f"pts_allowed_avg_{n}g")
            for n in (3, 5, 7, 10)
        },
        "combined_pace_3g": col("pace_avg_3g") + col("opp_pace_avg_3g"),
        "combined_pace_5g": col("pace_avg_5g") + col("opp_pace_avg_5g"),
        "total_game_pace": col("real_possessions") + col("opp_real_possessions"),
        "pts_trend_short": pts_trend,
        "pts_allowed_trend_short": allowed_trend,
        "total_pts_trend": pts_trend + allowed_trend,
        "pace_acceleration": col("pace_avg_3g") - col("pace_avg_10g"),
        "offensive_consistency": 1 / (col("pts_volatility") + 0.01),
        "efficiency_differential": col("ts_pct_avg_5g") - col("opp_ts_pct_avg_5g"),
        "confidence_factor": (col("win_pct_5g") - 0.5) * 2,
    }


def games_remaining(df: DataFrame, order=ORDER, task_rows: int | None = None) -> DataFrame:
    """82 minus the games already played by the team, and the urgency of the last ten."""
    df = with_history(
        df, TEAM, order, lambda w: {}, 0, {"_played": ("count", F.lit(1))}, task_rows
    )
    remaining = 82 - col("_played")
    return _add(
        df,
        {
            "games_remaining": remaining,
            "urgency_factor": F.when(remaining <= 10, 1.5).otherwise(1.0),
        },
    ).drop("_played")


def total_features(games: DataFrame, order=ORDER, task_rows: int | None = None) -> DataFrame:
    """Features of the game-total model. Needs ``is_home``."""
    rows = row_count(games)
    df = _add(season_day(games), total_base())
    df = with_history(
        df, TEAM, order, total_history, 10, {"_played": ("count", F.lit(1))}, task_rows, rows
    )
    df = _add(df, total_derived())
    df = with_history(
        df,
        ["Team", "Opp"],
        order,
        lambda w: {},
        0,
        running_mean("vs_opp_pts_history", col("PTS"))
        | running_mean("vs_opp_allowed_history", col("PTS_Opp")),
        task_rows,
        rows,
    )
    df = expanding_mean(expanding_mean(df, "vs_opp_pts_history"), "vs_opp_allowed_history")
    df = opponent_strength(
        df, 0.6, "opp_defensive_ranking", "opp_offensive_ranking", order, task_rows, games, rows
    )
    edge = (
        F.coalesce(col("vs_opp_pts_history"), col("pts_avg_10g"))
        + F.coalesce(col("vs_opp_allowed_history"), col("pts_allowed_avg_10g"))
        - col("total_pts_avg_10g")
    )
    df = _add(
        df,
        {
            "matchup_total_edge": edge,
            "energy_factor": situation.energy("total"),
            "home_court_boost": col("is_home") * 2.5,
            "season_importance": situation.season_importance("total"),
            "altitude_factor": situation.altitude("total"),
            "rivalry_factor": situation.rivalry_undirected(),
            "season_fatigue": situation.month_fatigue("total"),
            "urgency_factor": F.when(82 - col("_played") <= 10, 1.5).otherwise(1.0),
            "rest_advantage": situation.rest_advantage("total"),
        }
        | shooting.total_projection(),
    ).drop("_played")
    return _add(_add(df, shooting.total_interactions()), shooting.total_final())


# ------------------------------------------------------------------ double-double

PLAYER_STATS = ("PTS", "TRB", "AST", "STL", "BLK", "MP")


def double_history(w) -> dict[str, Column]:
    out = {"days_rest": rolling.days_rest(w)}
    for n in (5, 10):
        for s in PLAYER_STATS:
            out[f"{s.lower()}_hist_avg_{n}g"] = rolling.rolled(w, col(s), n)
        out[f"dd_rate_{n}g"] = rolling.win_rate(w, n, 0.1, "double_double")
        out[f"usage_hist_{n}g"] = (
            rolling.rolled(w, col("FGA"), n) + rolling.rolled(w, col("FTA"), n) * 0.44
        )
        out[f"pts_per_min_hist_{n}g"] = fill(
            rolling.rolled(w, shooting.points_per_minute(), n), 0.0
        )
        for s in ("PTS", "TRB", "AST"):
            out[f"{s.lower()}_above_historical_{n}g"] = rolling.above_history(w, col(s), n)
    for s in ("PTS", "TRB", "AST", "MP"):
        out[f"{s.lower()}_consistency_5g"] = rolling.consistency(w, col(s))
    for s in ("PTS", "TRB", "AST"):
        out[f"{s.lower()}_momentum_6g"] = rolling.stat_momentum(w, col(s))
        out[f"{s.lower()}_trend_factor"] = fill(rolling.rolled(w, col(s), 3), 0.0) - fill(
            rolling.rolled(w, col(s), 10), 0.0
        )
    means = [rolling.rolled(w, col(s), 5) for s in ("PTS", "TRB", "AST")]
    blocks = fill(rolling.rolled(w, col("STL"), 5), 0.0) + fill(rolling.rolled(w, col("BLK"), 5), 0.0)
    out |= {
        "weighted_dd_rate_5g": rolling.weighted_rate(w, col("double_double")),
        "dd_momentum_5g": rolling.rate_momentum(w, col("double_double")),
        "recent_dd_form": rolling.win_rate(w, 3, 0.1, "double_double"),
        "usage_consistency_5g": rolling.consistency(w, col("FGA")),
        "efficiency_consistency_5g": rolling.consistency(w, shooting.points_per_minute()),
        "minutes_stability": rolling.minutes_stability(w),
        "versatility_index": rolling.versatility(*means),
        "dd_potential_score": rolling.double_potential(*means),
        "total_impact_5g": means[0] + means[1] + means[2] + blocks,
    }
    return out


def current_streak(
    df: DataFrame,
    keys=PLAYER,
    lag: int = 1,
    name: str = "dd_streak",
    order=ORDER,
    task_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Length of the run of double-doubles that ends ``lag`` rows before the current one.

    Built from two running aggregates, the row position and the position of the last miss.
    """
    rows = row_count(df) if rows is None else rows
    df = with_history(
        df,
        keys,
        order,
        lambda w: {"_flag": F.lag("double_double", lag - 1).over(w)} if lag > 1 else {},
        max(lag - 1, 0),
        {"_at": ("count", F.lit(1))},
        task_rows,
        rows,
    )
    shown = col("_flag") if lag > 1 else col("double_double")
    position = col("_at") + (2 - lag)
    df = with_history(
        df,
        keys,
        order,
        lambda w: {},
        0,
        {"_miss": ("max", F.when(shown == 0, position))},
        task_rows,
        rows,
    )
    rows_seen = F.greatest(col("_at") - (lag - 1), F.lit(0))
    streak = rows_seen - F.coalesce(col("_miss"), F.lit(0))
    return df.withColumn(name, streak).drop("_flag", "_at", "_miss")


#: Rows of one opponent that a task may sort.
OPPONENT_ROWS = 250_000


def opponent_defence(
    df: DataFrame, order=ORDER, task_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    """There are few opponents, so their rows are cut into blocks earlier than those of players."""
    task_rows = OPPONENT_ROWS if task_rows is None else task_rows
    return with_history(
        df,
        ["Opp"],
        order,
        lambda w: {"opponent_def_rating": fill(rolling.rolled(w, col("PTS"), 10, "mean", 3), 105.0)},
        10,
        task_rows=task_rows,
        rows=rows,
    )


def double_features(games: DataFrame, order=ORDER, task_rows: int | None = None) -> DataFrame:
    """Features of the double-double model. Needs flags, venue, starter and, if known, biometrics."""
    rows = row_count(games)
    # the rows of an opponent are many, so they are sorted before the other features make them wide
    df = opponent_defence(games, order, task_rows, rows)
    df = _add(
        season_day(df),
        {"usage_rate_approx": shooting.usage_rate(), "pts_efficiency": shooting.points_per_shot()},
    )
    # all steps per player share this shuffle; its parts are not merged, so none grows with the table
    df = df.repartition(even_parts(df.sparkSession, rows, OPPONENT_ROWS), *PLAYER)
    df = with_history(df, PLAYER, order, double_history, 10, task_rows=task_rows, rows=rows)
    df = current_streak(df, order=order, task_rows=task_rows, rows=rows)
    df = last_meeting(df, PLAYER, "double_double", "last_dd_vs_opp", 0.1, order, task_rows, rows)
    df = df.select(*[col(c) for c in df.columns if c != "opponent_def_rating"], "opponent_def_rating")
    df = df.withColumn("is_back_to_back", situation.back_to_back())
    columns = situation.home_factors("double") | {
        "energy_factor": situation.energy("double"),
        "rest_advantage": situation.rest_advantage("double"),
        "season_progression_factor": situation.month_progression(),
        "rivalry_motivation": rolling.revenge(col("last_dd_vs_opp"), 0.05, -0.02),
    }
    if "Height_Inches" in df.columns:
        columns |= shooting.biometrics()
    return _add(df, columns)
