"""Possession, efficiency and projection formulas of one box score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions.scalars import clip, col, fill, ratio


def _stat(name: str, side: str) -> Column:
    return col(f"{name}{side}")


def _pct(name: str, side: str) -> Column:
    return fill(_stat(name, side), fixed.SHOOTING_FILL[name])


def possessions_points(side: str = "") -> Column:
    return _stat("FGA", side) + _stat("FTA", side) * 0.44


def possessions_total(side: str = "") -> Column:
    made = _stat("FG", side)
    return _stat("FGA", side) - made + _stat("FTA", side) * 0.44 + made * 0.56


def possessions_total_alt(side: str = "") -> Column:
    return _stat("FGA", side) + _stat("FTA", side) * 0.44 - _stat("FG", side) * 0.1


def true_shooting(side: str = "") -> Column:
    return ratio(_stat("PTS", side), 2 * (_stat("FGA", side) + 0.44 * _stat("FTA", side)))


def effective_fg(side: str = "") -> Column:
    return ratio(_stat("FG", side) + 0.5 * _stat("3P", side), _stat("FGA", side))


def conversion_mean(side: str = "") -> Column:
    return (_pct("FG%", side) + _pct("3P%", side) + _pct("FT%", side)) / 3


def true_shooting_approx(side: str = "") -> Column:
    return _pct("FG%", side) * 0.6 + _pct("FT%", side) * 0.4


def effective_fg_approx(side: str = "") -> Column:
    share = _stat("3PA", side) / (_stat("FGA", side) + 1)
    return _pct("FG%", side) + 0.5 * _pct("3P%", side) * share


def conversion_weighted(side: str = "") -> Column:
    return _pct("FG%", side) * 0.5 + _pct("3P%", side) * 0.3 + _pct("FT%", side) * 0.2


def direct_projection(side: str = "") -> Column:
    return (
        _stat("FGA", side) * _pct("FG%", side) * 2
        + _stat("3PA", side) * _pct("3P%", side) * 3
        + _stat("FTA", side) * _pct("FT%", side)
    )


def expected_shots(side: str = "") -> Column:
    return _stat("FGA", side) + _stat("3PA", side) * 0.4 + _stat("FTA", side) * 0.44


def shot_volume(side: str = "") -> Column:
    return _stat("FGA", side) + _stat("FTA", side)


def scoring_tier(projection: Column, default: Column) -> Column:
    """Right-closed tiers; a missing projection takes the default, anything outside is 'mid'."""
    x = F.coalesce(projection, default)
    out = None
    for name, low, high in fixed.SCORING_TIERS:
        hit = (x > low) & (x <= high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("mid_scoring")


def team_projection() -> dict[str, Column]:
    """First layer of the team projection; needs the base columns."""
    mathematical = col("team_expected_shots") * col("team_conversion_efficiency") * 100
    return {
        "team_mathematical_projection": mathematical,
        "team_hybrid_projection": mathematical * 0.6 + col("team_weighted_shot_volume") * 40,
    }


def team_interactions() -> dict[str, Column]:
    conversion, quality = col("team_conversion_efficiency"), col("opponent_quality_factor")
    confidence = col("team_confidence_factor")
    return {
        "team_pace_efficiency_interaction": col("team_possessions") * conversion,
        "team_momentum_context": confidence * col("team_energy_factor"),
        "team_quality_efficiency_interaction": conversion * (2 - quality),
        "team_stability_confidence": col("team_scoring_stability") * (confidence + 1),
        "team_pressure_quality": col("team_scoring_pressure") * (1 - quality),
    }


def team_final() -> dict[str, Column]:
    """Second layer: needs projections, interactions and context columns."""
    enhanced = (
        col("team_hybrid_projection") * 0.65 + col("team_quality_efficiency_interaction") * 25
    )
    context = (
        col("team_home_court_boost")
        + col("team_rest_advantage")
        + col("team_season_importance") * 3.0
    )
    stability = col("team_stability_confidence") * 2.0 + col("team_pressure_quality") * 5.0
    factor = F.lit(1.0)
    for tier, value in fixed.TIER_FACTOR.items():
        factor = F.when(col("team_scoring_tier") == tier, value).otherwise(factor)
    final = (enhanced + context + stability) * factor
    return {
        "team_enhanced_projection": enhanced,
        "team_contextual_adjustment": context,
        "team_stability_adjustment": stability,
        "team_final_projection": final,
        "team_final_prediction": clip(final, *fixed.TEAM_PROJECTION_CLIP),
        "team_prediction_confidence": (2 - col("opponent_quality_factor")) * 0.4
        + col("team_conversion_efficiency") * 0.3
        + col("team_scoring_stability") * 0.3,
    }


def total_projection() -> dict[str, Column]:
    mathematical = (
        col("total_expected_shots") * col("combined_conversion_efficiency") * 1.1
    )
    return {
        "mathematical_total_projection": mathematical,
        "hybrid_scoring_projection": mathematical * 0.6 + col("weighted_shot_volume") * 0.4,
    }


def total_interactions() -> dict[str, Column]:
    return {
        "pace_efficiency_interaction": col("possessions") * col("FG%"),
        "momentum_context_combo": col("confidence_factor") * col("energy_factor"),
        "quality_efficiency_interaction": col("combined_conversion_efficiency")
        * col("opponent_quality_factor"),
    }


def total_final() -> dict[str, Column]:
    final = (
        col("hybrid_scoring_projection") * 0.7
        + col("quality_efficiency_interaction") * 20
        + col("home_court_boost")
        + col("rest_advantage")
        + col("season_importance") * 3.0
    )
    return {
        "final_projection": final,
        "final_prediction": clip(final, *fixed.TOTAL_PROJECTION_CLIP),
        "prediction_confidence": col("opponent_quality_factor") * 0.5
        + col("combined_conversion_efficiency") * 0.5,
    }


def usage_rate() -> Column:
    return (col("FGA") + 0.44 * col("FTA") + col("TOV")) / (col("MP") + 0.1)


def usage_rate_short() -> Column:
    """Used when free throws or turnovers are not recorded."""
    return col("FGA") / (col("MP") + 0.1)


def points_per_shot() -> Column:
    return col("PTS") / (col("FGA") + 0.1)


def points_per_minute() -> Column:
    return col("PTS") / (col("MP") + 0.1)


def biometrics() -> dict[str, Column]:
    h, ratio_hw = col("Height_Inches"), ratio(col("Weight"), col("Height_Inches"))
    over_six_feet = (h - 72) / 12
    rebounding = clip(over_six_feet * 0.15, 0.0, 0.25)
    blocking = clip(over_six_feet * 0.1, 0.0, 0.2)
    return {
        "height_category": F.when(h.isNull(), 0)
        .when(h < 72, 1)
        .when(h < 75, 2)
        .when(h < 78, 3)
        .when(h < 81, 4)
        .otherwise(5),
        "height_rebounding_factor": rebounding,
        "height_blocking_factor": blocking,
        "height_advantage": (rebounding + blocking) / 2,
        "height_position_interaction": F.when(
            h < 75, F.when(h > 73, 0.1).otherwise(0.0)
        ).otherwise(F.when(h > 80, 0.05).otherwise(0.15)),
        "build_factor": F.when(ratio_hw > 2.8, 0.1).when(ratio_hw < 2.4, -0.05).otherwise(0.0),
    }
