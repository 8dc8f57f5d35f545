"""Row-wise operators: parsing, flags, factors, formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark import fixed, views
from courtspark.functions import shooting, situation
from courtspark.functions.scalars import col, with_scalar
from courtspark.operators import loading
from courtspark.operators.features import points_base, season_day, total_base
from courtspark.registry.entry import Query, ask, tidy
from courtspark.views import (
    DOUBLE_LOG, PLAYER_BIO, PLAYER_GAMES, TEAM_GAMES, TEAM_RESULTS, double_log, player_bio,
    player_games, table, team_games, team_results, team_scores,
)

REST = """
rested AS (
  SELECT *, coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2) AS days_rest,
    isodow("Date") - 1 AS day_of_week, month("Date") AS month, (isodow("Date") >= 6)::INT AS is_weekend,
    "Date" - (SELECT min("Date") FROM team_games) AS days_into_season,
    CASE WHEN "Away" = '@' THEN 0 ELSE 1 END AS is_home
  FROM team_games)"""
RESTED = TEAM_GAMES + "," + REST


def rested(spark, sf_dir):
    from courtspark.functions.rolling import days_rest
    from courtspark.plans.history import with_history

    df = season_day(team_scores(spark, sf_dir)).withColumn("is_home", situation.is_home())
    df = with_history(df, ["Team"], ["Date", "game_id"], lambda w: {"days_rest": days_rest(w)}, 1)
    return df.withColumn("is_back_to_back", situation.back_to_back())


def _pick(df, key, columns):
    return tidy(df.select(key, *[c.alias(n) for n, c in columns.items()]))


def _result_sql(view_cols: str) -> str:
    return f"""SELECT game_id, {view_cols} FROM (
      SELECT game_id, "Result", regexp_matches(trim("Result"), '^([WL])\\s+(\\d+)-(\\d+)(?:\\s+\\((\\d*OT)\\))?$') AS hit,
        split_part("Result", ' ', 1) AS letter, split_part(split_part("Result", ' ', 2), '-', 1) AS a,
        split_part(split_part("Result", ' ', 2), '-', 2) AS b, split_part("Result", '(', 2) AS ot
      FROM team_results)"""


_OUTCOME = """CASE WHEN hit THEN (letter = 'W')::INT::DOUBLE END AS is_win,
  (hit AND ot <> '')::INT AS has_overtime,
  CASE WHEN NOT hit OR ot = '' THEN 0 WHEN ot LIKE '2%' THEN 2 ELSE 1 END AS overtime_periods"""
_SCORES = """CASE WHEN hit THEN a::DOUBLE END AS team_score, CASE WHEN hit THEN b::DOUBLE END AS opp_score,
  CASE WHEN hit THEN a::DOUBLE + b::DOUBLE END AS total_score, CASE WHEN hit THEN a::DOUBLE - b::DOUBLE END AS point_diff"""


def _doubles(df, names):
    return df.withColumns({n: col(n).cast("double") for n in names})


def parse_result_player(spark, sf_dir):
    df = loading.parse_results(team_results(spark, sf_dir))
    names = ["is_win", "team_score", "opp_score", "total_score", "point_diff"]
    df = _doubles(df, names).select("game_id", *names, "has_overtime", "overtime_periods")
    return tidy(df)


def parse_result_team(spark, sf_dir):
    df = loading.parse_results(team_results(spark, sf_dir), scores=False)
    return tidy(_doubles(df, ["is_win"]).select("game_id", "is_win", "has_overtime", "overtime_periods"))


def win_from_prefix(spark, sf_dir):
    df = loading.win_from_prefix(team_results(spark, sf_dir))
    return tidy(_doubles(df, ["is_win"]).select("game_id", "is_win"))


def win_from_points(spark, sf_dir):
    return tidy(loading.win_from_points(team_scores(spark, sf_dir)).select("game_id", "is_win"))


def mixed_dates(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format(day, "M/d/yyyy"))
        .when(key % 5 == 2, F.date_format(day, "MMM d, yyyy"))
        .when(key % 5 == 3, F.date_format(day, "yyyyMMdd"))
        .otherwise("no date")
    )
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"))
    return tidy(df.select("o_orderkey", F.to_date(loading.mixed_date(col("written"))).alias("Date")))


def flags(column, build, view=team_scores):
    def run(spark, sf_dir):
        return tidy(view(spark, sf_dir).select("game_id", build().alias(column)))

    return run


def infinities(spark, sf_dir):
    odd = F.when(col("game_id") % 7 == 0, F.lit(float("inf"))).when(
        col("game_id") % 11 == 0, F.lit(float("-inf"))
    ).when(col("game_id") % 13 == 0, F.lit(float("nan"))).otherwise(col("PTS"))
    df = team_scores(spark, sf_dir).select("game_id", odd.alias("PTS"))
    return tidy(loading.infinities_to_null(df))


def percents(spark, sf_dir):
    text = F.when(col("game_id") % 9 == 0, "n/a").otherwise((col("FG%") * 100).cast("string"))
    df = team_games(spark, sf_dir).select("game_id", text.alias("FG%"))
    return tidy(loading.percents_to_fractions(df).withColumnRenamed("FG%", "fg_pct"))


def heights(spark, sf_dir):
    df = loading.clean_biometrics(player_bio(spark, sf_dir))
    return tidy(df.select("Player", "Height_Inches", "Weight"))


def bmi(spark, sf_dir):
    df = loading.clean_biometrics(player_bio(spark, sf_dir))
    return tidy(df.select("Player", loading.body_mass_index().alias("BMI")))


def doubles_flags(spark, sf_dir):
    names = [f"{s}_double" for s in fixed.DOUBLE_STATS]
    return tidy(
        double_log(spark, sf_dir).select("game_id", *names, "double_double", "triple_double")
    )


def dd_audit(spark, sf_dir):
    return tidy(loading.double_audit(double_log(spark, sf_dir)))


def plausible(spark, sf_dir):
    points = loading.plausible_points(team_scores(spark, sf_dir))
    totals = loading.plausible_totals(
        team_games(spark, sf_dir).withColumn("total_points", col("PTS") + col("PTS_Opp")),
        ["FGA", "FTA", "FG%"],
        "total_points",
    )
    a = points.select("game_id", F.lit("points").alias("kind"), col("PTS").alias("target"))
    b = totals.select("game_id", F.lit("total").alias("kind"), col("total_points").alias("target"))
    return tidy(a.unionByName(b))


def recent(spark, sf_dir):
    df = loading.recent_days(team_scores(spark, sf_dir), 60)
    return tidy(df.select("game_id", "Team", "Date"))


def entity(spark, sf_dir):
    df = loading.only_entity(team_scores(spark, sf_dir), "DEN", "Team")
    return tidy(df.select("game_id", "Team", "PTS"))


def calendar(spark, sf_dir):
    df = season_day(team_scores(spark, sf_dir))
    return tidy(df.select("game_id", "day_of_week", "month", "is_weekend", "days_into_season"))


def rest_buckets(spark, sf_dir):
    out = {"is_back_to_back": col("is_back_to_back")}
    for t in ("win", "points", "total", "double"):
        out[f"energy_{t}"] = situation.energy(t)
        out[f"advantage_{t}"] = situation.rest_advantage(t)
    return _pick(rested(spark, sf_dir), "game_id", out)


def _rest_sql(table_: dict, prefix: str) -> str:
    return ", ".join(
        f"CASE WHEN days_rest = 0 THEN {a} WHEN days_rest = 1 THEN {b} WHEN days_rest >= 3 THEN {d} ELSE {c} END AS {prefix}_{t}"
        for t, (a, b, c, d) in table_.items()
    )


def season_factors(spark, sf_dir):
    return _pick(
        rested(spark, sf_dir),
        "game_id",
        {
            "importance_points": situation.season_importance("points"),
            "importance_total": situation.season_importance("total"),
            "urgency": situation.urgency_by_day(),
            "fatigue_points": situation.month_fatigue("points"),
            "fatigue_total": situation.month_fatigue("total"),
            "fatigue_win": situation.month_fatigue("win"),
            "progression": situation.month_progression(),
        },
    )


def home_factors(spark, sf_dir):
    df = rested(spark, sf_dir).withColumn("is_started", (col("game_id") % 3 == 0).cast("int"))
    out = {}
    for t in ("win", "points", "total", "double"):
        out |= {f"{n}_{t}": c for n, c in situation.home_factors(t).items()}
    return _pick(df, "game_id", out)


def lookups(build):
    def run(spark, sf_dir):
        return _pick(team_games(spark, sf_dir), "game_id", build())

    return run


def base_columns(build, names):
    def run(spark, sf_dir):
        columns = build()
        return _pick(team_games(spark, sf_dir), "game_id", {n: columns[n] for n in names})

    return run


def tiers(spark, sf_dir):
    from courtspark.operators.features import with_scoring_tier

    df = team_games(spark, sf_dir).select(
        "game_id", shooting.direct_projection().alias("team_direct_scoring_projection")
    )
    return tidy(with_scoring_tier(df).select("game_id", "team_scoring_tier"))


def biometric_features(spark, sf_dir):
    df = loading.clean_biometrics(player_bio(spark, sf_dir))
    return _pick(df, "Player", shooting.biometrics())


def usage(spark, sf_dir):
    return _pick(
        player_games(spark, sf_dir),
        "game_id",
        {
            "usage_rate": shooting.usage_rate(),
            "usage_rate_short": shooting.usage_rate_short(),
            "points_per_shot": shooting.points_per_shot(),
            "points_per_minute": shooting.points_per_minute(),
        },
    )


def join_bio(spark, sf_dir):
    bio = loading.clean_biometrics(player_bio(spark, sf_dir))
    df = loading.join_biometrics(player_games(spark, sf_dir), bio)
    return tidy(df.select("game_id", "Player", "Height_Inches", "Weight", "BMI"))


def fanout(spark, sf_dir):
    """Orders placed more than once by a customer would multiply customer rows."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("Player"))
    return tidy(loading.fanout_keys(orders))


def global_scalar(spark, sf_dir):
    df = team_scores(spark, sf_dir)
    scalar = df.agg(
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"), F.avg("PTS").alias("mean_pts")
    )
    return tidy(
        with_scalar(df, scalar).select(
            "game_id", "first_date", "last_date", (col("PTS") - col("mean_pts")).alias("above_mean")
        )
    )


_PCT = {s: {k: f'coalesce("{k}{s}", {v})' for k, v in fixed.SHOOTING_FILL.items()} for s in ("", "_Opp")}


def _direct(s):
    p = _PCT[s]
    return f'"FGA{s}" * {p["FG%"]} * 2 + "3PA{s}" * {p["3P%"]} * 3 + "FTA{s}" * {p["FT%"]}'


def _weighted(s):
    p = _PCT[s]
    return f'{p["FG%"]} * 0.5 + {p["3P%"]} * 0.3 + {p["FT%"]} * 0.2'


def _mean3(s):
    p = _PCT[s]
    return f'({p["FG%"]} + {p["3P%"]} + {p["FT%"]}) / 3'


_INCHES = """CASE WHEN "Height" LIKE '%''%' THEN split_part("Height", '''', 1)::INT * 12
  + replace(split_part("Height", '''', 2), '"', '')::INT END::DOUBLE AS "Height_Inches", "Weight"::DOUBLE AS "Weight" """
BIO = PLAYER_BIO + f', bio AS (SELECT "Player", {_INCHES} FROM player_bio)'
_BMI = 'CASE WHEN "Height_Inches" > 0 THEN "Weight" * 703 / ("Height_Inches" * "Height_Inches") END AS "BMI"'
_STEP = "CASE WHEN days_into_season > 200 THEN {0} WHEN days_into_season > 100 THEN {1} ELSE {2} END"

_SHOOT = {
    "team_true_shooting_approx": f'{_PCT[""]["FG%"]} * 0.6 + {_PCT[""]["FT%"]} * 0.4',
    "opp_true_shooting_approx": f'{_PCT["_Opp"]["FG%"]} * 0.6 + {_PCT["_Opp"]["FT%"]} * 0.4',
    "team_efg_approx": f'{_PCT[""]["FG%"]} + 0.5 * {_PCT[""]["3P%"]} * ("3PA" / ("FGA" + 1))',
    "opp_efg_approx": f'{_PCT["_Opp"]["FG%"]} + 0.5 * {_PCT["_Opp"]["3P%"]} * ("3PA_Opp" / ("FGA_Opp" + 1))',
    "team_conversion_efficiency": _weighted(""),
    "opp_conversion_efficiency": _weighted("_Opp"),
    "true_shooting_pct": '"PTS" / nullif(2 * ("FGA" + 0.44 * "FTA"), 0)',
    "opp_true_shooting_pct": '"PTS_Opp" / nullif(2 * ("FGA_Opp" + 0.44 * "FTA_Opp"), 0)',
    "efg_pct": '("FG" + 0.5 * "3P") / nullif("FGA", 0)',
    "opp_efg_pct": '("FG_Opp" + 0.5 * "3P_Opp") / nullif("FGA_Opp", 0)',
    "conversion_efficiency": _mean3(""),
    "opp_conversion_mean": _mean3("_Opp"),
    "combined_conversion_efficiency": f'({_mean3("")} + {_mean3("_Opp")}) / 2',
}
_POSS = {
    "team_possessions": '"FGA" + "FTA" * 0.44',
    "opp_possessions_points": '"FGA_Opp" + "FTA_Opp" * 0.44',
    "possessions": '"FGA" - "FG" + "FTA" * 0.44 + "FG" * 0.56',
    "opp_possessions": '"FGA_Opp" - "FG_Opp" + "FTA_Opp" * 0.44 + "FG_Opp" * 0.56',
    "real_possessions": '"FGA" + "FTA" * 0.44 - "FG" * 0.1',
    "opp_real_possessions": '"FGA_Opp" + "FTA_Opp" * 0.44 - "FG_Opp" * 0.1',
}
_VOL = {
    "team_total_shot_volume": '"FGA" + "FTA"',
    "opp_total_shot_volume": '"FGA_Opp" + "FTA_Opp"',
    "team_weighted_shot_volume": f'("FGA" + "FTA") * ({_weighted("")})',
    "team_expected_shots": '"FGA" + "3PA" * 0.4 + "FTA" * 0.44',
    "opp_expected_shots": '"FGA_Opp" + "3PA_Opp" * 0.4 + "FTA_Opp" * 0.44',
    "total_shot_volume": '"FGA" + "FGA_Opp" + "FTA" + "FTA_Opp"',
    "weighted_shot_volume": f'("FGA" + "FGA_Opp" + "FTA" + "FTA_Opp") * ({_mean3("")} + {_mean3("_Opp")}) / 2',
}
_DIRECT = {
    "direct_scoring_projection": _direct(""),
    "opp_direct_scoring_projection": _direct("_Opp"),
    "total_direct_projection": f'{_direct("")} + {_direct("_Opp")}',
}


def _formula(sqls):
    body = ", ".join(f"{e} AS {n}" for n, e in sqls.items())
    return ask(TEAM_GAMES, f"SELECT game_id, {body} FROM team_games", ", ".join(sqls), "game_id")


def _possessions():
    p, t = points_base(), total_base()
    names = ("possessions", "opp_possessions", "real_possessions", "opp_real_possessions")
    return {
        "team_possessions": p["team_possessions"],
        "opp_possessions_points": p["opp_possessions"],
    } | {n: t[n] for n in names}


def _merged_base():
    total = total_base()
    return total | points_base() | {"opp_conversion_mean": total["opp_conversion_efficiency"]}


def _pairs_sql(pairs, a, b):
    return " OR ".join(f"({a} = '{x}' AND {b} = '{y}')" for x, y in pairs)


_DIRECTED = [(t, o) for t, rivals in fixed.RIVALS_DIRECTED.items() for o in rivals]
_UNDIRECTED = [p for x, y in fixed.RIVALS_UNDIRECTED for p in ((x, y), (y, x))]
_ALT = '"Team" IN (' + ", ".join(f"'{t}'" for t in fixed.ALTITUDE_TEAMS) + ")"
_FIVE = [f'("{s}" >= 10)::INT AS "{s}_double"' for s in fixed.DOUBLE_STATS]

QUERIES = {
    "parse_result_player": Query(
        parse_result_player,
        ask(TEAM_RESULTS, _result_sql(_OUTCOME + ", " + _SCORES),
            "is_win, team_score, opp_score, total_score, point_diff", "game_id, has_overtime, overtime_periods"),
    ),
    "parse_result_team": Query(
        parse_result_team,
        ask(TEAM_RESULTS, _result_sql(_OUTCOME), "is_win", "game_id, has_overtime, overtime_periods"),
    ),
    "win_from_prefix": Query(
        win_from_prefix,
        ask(TEAM_RESULTS, """SELECT game_id, CASE "Result"[1] WHEN 'W' THEN 1.0 WHEN 'L' THEN 0.0 END AS is_win
            FROM team_results""", "is_win", "game_id"),
    ),
    "win_from_points": Query(
        win_from_points,
        ask(TEAM_GAMES, 'SELECT game_id, ("PTS" > "PTS_Opp")::INT AS is_win FROM team_games', "", "game_id, is_win"),
    ),
    "parse_mixed_date": Query(
        mixed_dates,
        ask("", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate::DATE END AS "Date" FROM orders""",
            "", "o_orderkey", "Date"),
    ),
    "home_flag": Query(
        flags("is_home", situation.is_home),
        ask(TEAM_GAMES, """SELECT game_id, ("Away" IS DISTINCT FROM '@')::INT AS is_home FROM team_games""", "", "game_id, is_home"),
    ),
    "starter_flag": Query(
        flags("is_started", situation.is_starter, player_games),
        ask(PLAYER_GAMES, """SELECT game_id, coalesce(("GS" = '*')::INT, 0) AS is_started FROM player_games""", "", "game_id, is_started"),
    ),
    "inf_to_null": Query(
        infinities,
        ask(TEAM_GAMES, """SELECT game_id, CASE WHEN game_id % 7 <> 0 AND game_id % 11 <> 0 AND game_id % 13 <> 0 THEN "PTS" END AS "PTS"
            FROM team_games""", "PTS", "game_id"),
    ),
    "pct_to_fraction": Query(
        percents,
        ask(TEAM_GAMES, """SELECT game_id, CASE WHEN game_id % 9 <> 0 THEN "FG%" * 100 / 100 END AS fg_pct FROM team_games""",
            "fg_pct", "game_id"),
    ),
    "height_to_inches": Query(heights, ask(BIO, "SELECT * FROM bio", "Height_Inches, Weight", "Player")),
    "bmi": Query(bmi, ask(BIO, f'SELECT "Player", {_BMI} FROM bio', "BMI", "Player")),
    "double_triple_double": Query(
        doubles_flags,
        ask(DOUBLE_LOG, f"SELECT game_id, {', '.join(_FIVE)}, double_double, triple_double FROM double_log", "",
            "game_id, PTS_double, TRB_double, AST_double, STL_double, BLK_double, double_double, triple_double"),
    ),
    "zero_point_dd_audit": Query(
        dd_audit,
        ask(DOUBLE_LOG, """SELECT sum(double_double) AS double_doubles, sum(triple_double) AS triple_doubles,
            count(*) FILTER ("PTS" < 1 AND double_double = 1) AS without_points FROM double_log""", "",
            "double_doubles, triple_doubles, without_points"),
    ),
    "filter_plausible": Query(
        plausible,
        ask(TEAM_GAMES, """SELECT game_id, 'points' AS kind, "PTS" AS target FROM team_games WHERE "PTS" BETWEEN 70 AND 160
            UNION ALL SELECT game_id, 'total', "PTS" + "PTS_Opp" FROM team_games
            WHERE "PTS" + "PTS_Opp" BETWEEN 150 AND 350 AND "FGA" IS NOT NULL AND "FTA" IS NOT NULL AND "FG%" IS NOT NULL""",
            "target", "game_id", "kind"),
    ),
    "filter_recent_days": Query(
        recent,
        ask(TEAM_GAMES, """SELECT game_id, "Team", "Date" FROM team_games
            WHERE "Date" >= (SELECT max("Date") FROM team_games) - INTERVAL 60 DAY""", "", "game_id", "Team, Date"),
    ),
    "filter_entity": Query(
        entity, ask(TEAM_GAMES, """SELECT game_id, "Team", "PTS" FROM team_games WHERE "Team" = 'DEN'""", "PTS", "game_id", "Team"),
    ),
    "calendar_features": Query(
        calendar,
        ask(RESTED, "SELECT game_id, day_of_week, month, is_weekend, days_into_season FROM rested", "",
            "game_id, day_of_week, month, is_weekend, days_into_season"),
    ),
    "rest_buckets": Query(
        rest_buckets,
        ask(RESTED, f"""SELECT game_id, (days_rest <= 1)::INT AS is_back_to_back, {_rest_sql(fixed.REST_ENERGY, 'energy')},
            {_rest_sql(fixed.REST_ADVANTAGE, 'advantage')} FROM rested""",
            ", ".join(f"{p}_{t}" for p in ("energy", "advantage") for t in fixed.REST_ENERGY), "game_id, is_back_to_back"),
    ),
    "season_factors": Query(
        season_factors,
        ask(RESTED, f"""SELECT game_id, {_STEP.format(1.06, 1.03, 1.0)} AS importance_points,
            {_STEP.format(1.05, 1.02, 1.0)} AS importance_total, CASE WHEN days_into_season > 200 THEN 1.04 ELSE 1 END AS urgency,
            CASE WHEN month <= 3 THEN 0.98 ELSE 1 END AS fatigue_points, CASE WHEN month <= 3 THEN 1.2 ELSE 1 END AS fatigue_total,
            CASE WHEN month <= 3 THEN -0.015 WHEN month >= 11 THEN 0.01 ELSE 0 END AS fatigue_win,
            CASE WHEN month IN (10, 11) THEN -0.05 WHEN month IN (12, 1, 2) THEN 0.05 WHEN month IN (3, 4) THEN 0.02 ELSE 0 END AS progression
            FROM rested""",
            "importance_points, importance_total, urgency, fatigue_points, fatigue_total, fatigue_win, progression", "game_id"),
    ),
    "home_factors": Query(
        home_factors,
        ask(RESTED, """SELECT game_id, is_home * 0.06 AS home_advantage_win, (1 - is_home) * -0.02 AS travel_penalty_win,
            CASE WHEN is_home = 0 AND days_rest <= 1 THEN -0.04 ELSE 0 END AS road_b2b_penalty_win, is_weekend * 0.01 AS weekend_boost_win,
            is_home * 2.8 AS home_court_boost_points, is_home * 2.5 AS home_court_boost_total, is_home * 0.03 AS home_advantage_double,
            (1 - is_home) * -0.01 AS travel_penalty_double, (game_id % 3 = 0)::INT * 0.15 AS starter_boost_double,
            is_weekend * 0.02 AS weekend_boost_double FROM rested""",
            """home_advantage_win, travel_penalty_win, road_b2b_penalty_win, weekend_boost_win, home_court_boost_points,
            home_court_boost_total, home_advantage_double, travel_penalty_double, starter_boost_double, weekend_boost_double""", "game_id"),
    ),
    "altitude_lookup": Query(
        lookups(lambda: {f"altitude_{t}": situation.altitude(t) for t in ("win", "points", "total")}),
        ask(TEAM_GAMES, f"""SELECT game_id, CASE WHEN {_ALT} THEN 0.025 ELSE 0 END AS altitude_win,
            CASE WHEN {_ALT} THEN 1.02 ELSE 1 END AS altitude_points, CASE WHEN {_ALT} THEN 1.02 ELSE 1 END AS altitude_total
            FROM team_games""", "altitude_win, altitude_points, altitude_total", "game_id"),
    ),
    "rivalry_lookup": Query(
        lookups(lambda: {"directed": situation.rivalry_directed(), "undirected": situation.rivalry_undirected()}),
        ask(TEAM_GAMES, f"""SELECT game_id, CASE WHEN {_pairs_sql(_DIRECTED, '"Team"', '"Opp"')} THEN 1.04 ELSE 1 END AS directed,
            CASE WHEN {_pairs_sql(_UNDIRECTED, '"Team"', '"Opp"')} THEN 1.03 ELSE 1 END AS undirected FROM team_games""",
            "directed, undirected", "game_id"),
    ),
    "possessions": Query(lookups(_possessions), _formula(_POSS)),
    "shooting_efficiency": Query(base_columns(_merged_base, list(_SHOOT)), _formula(_SHOOT)),
    "direct_projection": Query(base_columns(_merged_base, list(_DIRECT)), _formula(_DIRECT)),
    "shot_volume": Query(base_columns(_merged_base, list(_VOL)), _formula(_VOL)),
    "scoring_tier": Query(
        tiers,
        ask(TEAM_GAMES + f""", p AS (SELECT game_id, {_direct('')} AS x FROM team_games)""",
            """SELECT game_id, CASE WHEN y > 0 AND y <= 95 THEN 'low_scoring' WHEN y > 95 AND y <= 115 THEN 'mid_scoring'
            WHEN y > 115 AND y <= 200 THEN 'high_scoring' ELSE 'mid_scoring' END AS team_scoring_tier
            FROM (SELECT game_id, coalesce(x, (SELECT median(x) FROM p)) AS y FROM p)""", "", "game_id", "team_scoring_tier"),
    ),
    "biometric_features": Query(
        biometric_features,
        ask(BIO + """, b AS (SELECT *, "Height_Inches" AS h, least(greatest(("Height_Inches" - 72) / 12 * 0.15, 0), 0.25) AS r,
            least(greatest(("Height_Inches" - 72) / 12 * 0.1, 0), 0.2) AS k FROM bio)""",
            """SELECT "Player", CASE WHEN h IS NULL THEN 0 WHEN h < 72 THEN 1 WHEN h < 75 THEN 2 WHEN h < 78 THEN 3 WHEN h < 81 THEN 4 ELSE 5 END AS height_category,
            CASE WHEN h IS NOT NULL THEN r END AS height_rebounding_factor, CASE WHEN h IS NOT NULL THEN k END AS height_blocking_factor,
            CASE WHEN h IS NOT NULL THEN (r + k) / 2 END AS height_advantage,
            CASE WHEN h < 75 AND h > 73 THEN 0.1 WHEN h < 75 THEN 0 WHEN h > 80 THEN 0.05 ELSE 0.15 END AS height_position_interaction,
            CASE WHEN "Weight" / h > 2.8 THEN 0.1 WHEN "Weight" / h < 2.4 THEN -0.05 ELSE 0 END AS build_factor FROM b""",
            "height_rebounding_factor, height_blocking_factor, height_advantage, height_position_interaction, build_factor",
            "Player, height_category"),
    ),
    "usage_per_minute": Query(
        usage,
        ask(PLAYER_GAMES, """SELECT game_id, ("FGA" + 0.44 * "FTA" + "TOV") / ("MP" + 0.1) AS usage_rate, "FGA" / ("MP" + 0.1) AS usage_rate_short,
            "PTS" / ("FGA" + 0.1) AS points_per_shot, "PTS" / ("MP" + 0.1) AS points_per_minute FROM player_games""",
            "usage_rate, usage_rate_short, points_per_shot, points_per_minute", "game_id"),
    ),
    "join_biometrics": Query(
        join_bio,
        ask(PLAYER_GAMES + "," + BIO, f"""SELECT game_id, g."Player", "Height_Inches", "Weight", {_BMI}
            FROM player_games g LEFT JOIN bio b ON g."Player" = b."Player" """, "Height_Inches, Weight, BMI", "game_id, Player"),
    ),
    "join_fanout_check": Query(
        fanout,
        ask("", """SELECT o_custkey AS "Player", count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1""", "", "Player, copies"),
    ),
    "global_scalar": Query(
        global_scalar,
        ask(TEAM_GAMES, """SELECT game_id, (SELECT min("Date") FROM team_games) AS first_date, (SELECT max("Date") FROM team_games) AS last_date,
            "PTS" - (SELECT avg("PTS") FROM team_games) AS above_mean FROM team_games""", "above_mean", "game_id", "first_date, last_date"),
    ),
}
