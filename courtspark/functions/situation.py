"""Rest, season, venue and rivalry factors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions.scalars import col, flag, steps


def by_rest(table: dict, target: str, rest: Column | None = None) -> Column:
    """Value for 0, 1, 2, or at least 3 days of rest."""
    rest = col("days_rest") if rest is None else rest
    none, one, two, more = table[target]
    return F.when(rest == 0, none).when(rest == 1, one).when(rest >= 3, more).otherwise(two)


def energy(target: str) -> Column:
    return by_rest(fixed.REST_ENERGY, target)


def rest_advantage(target: str) -> Column:
    return by_rest(fixed.REST_ADVANTAGE, target)


def back_to_back() -> Column:
    return flag(col("days_rest") <= 1)


def is_home() -> Column:
    """Only '@' marks an away game; a missing mark is a home game."""
    return F.when(col("Away") == "@", 0).otherwise(1)


def is_starter() -> Column:
    return flag(col("GS") == "*")


def calendar(day: Column) -> dict[str, Column]:
    """Weekday with Monday = 0, month and weekend flag."""
    weekday = F.weekday(day)
    return {
        "day_of_week": weekday,
        "month": F.month(day),
        "is_weekend": flag(weekday.isin(5, 6)),
    }


def season_importance(target: str) -> Column:
    late, middle, early = fixed.SEASON_IMPORTANCE[target]
    return steps(col("days_into_season"), [(200, late), (100, middle)], early)


def urgency_by_day() -> Column:
    return steps(col("days_into_season"), [(200, fixed.URGENCY_LATE_SEASON)], 1.0)


def month_fatigue(target: str) -> Column:
    first_quarter = col("month").isin(1, 2, 3)
    if target == "points":
        return F.when(first_quarter, 0.98).otherwise(1.0)
    if target == "total":
        return F.when(first_quarter, 1.2).otherwise(1.0)
    return (
        F.when(first_quarter, -0.015).when(col("month").isin(11, 12), 0.01).otherwise(0.0)
    )


def month_progression() -> Column:
    return (
        F.when(col("month").isin(10, 11), -0.05)
        .when(col("month").isin(12, 1, 2), 0.05)
        .when(col("month").isin(3, 4), 0.02)
        .otherwise(0.0)
    )


def home_factors(target: str) -> dict[str, Column]:
    home = col("is_home")
    out = {}
    if target in fixed.HOME_ADVANTAGE:
        out["home_advantage"] = home * fixed.HOME_ADVANTAGE[target]
        out["travel_penalty"] = F.when(home == 0, fixed.TRAVEL_PENALTY[target]).otherwise(0.0)
    if target == "win":
        road = (home == 0) & (col("is_back_to_back") == 1)
        out["road_b2b_penalty"] = F.when(road, fixed.ROAD_B2B_PENALTY).otherwise(0.0)
    if target in fixed.HOME_COURT_BOOST:
        out["home_court_boost"] = home * fixed.HOME_COURT_BOOST[target]
    if target == "double":
        out["starter_boost"] = col("is_started") * fixed.STARTER_BOOST
    if target in fixed.WEEKEND_BOOST:
        out["weekend_boost"] = col("is_weekend") * fixed.WEEKEND_BOOST[target]
    return out


def altitude(target: str, team: str = "Team") -> Column:
    high, other = fixed.ALTITUDE_FACTOR[target]
    return F.when(col(team).isin(*fixed.ALTITUDE_TEAMS), high).otherwise(other)


def rivalry_directed(team: str = "Team", opp: str = "Opp") -> Column:
    hit = F.lit(False)
    for name, rivals in fixed.RIVALS_DIRECTED.items():
        hit = hit | ((col(team) == name) & col(opp).isin(*rivals))
    return F.when(hit, fixed.RIVAL_FACTOR_DIRECTED).otherwise(1.0)


def rivalry_undirected(team: str = "Team", opp: str = "Opp") -> Column:
    first, second = F.least(col(team), col(opp)), F.greatest(col(team), col(opp))
    hit = F.lit(False)
    for pair in fixed.RIVALS_UNDIRECTED:
        a, b = sorted(pair)
        hit = hit | ((first == a) & (second == b))
    return F.when(hit, fixed.RIVAL_FACTOR_UNDIRECTED).otherwise(1.0)
