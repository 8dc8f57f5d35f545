"""Profiles, cleaning, feature selection, sources and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from courtspark import fixed, views
from courtspark.functions import shooting, situation
from courtspark.functions.scalars import col
from courtspark.operators import cleaning, features, loading, neighbours, profiles, selection
from courtspark.registry.entry import Query, ask, tidy
from courtspark.registry.history import ORDER, PLAYER_ORDER, box, scores
from courtspark.registry.rows import _direct, _mean3
from courtspark.sources import tables as table_source
from courtspark.sources.staging import staging_folder
from courtspark.views import (
    DOUBLE_LOG, PLAYER_GAMES, TEAM_GAMES, TEAM_RESULTS, double_log, player_bio, player_games, team_games, team_results, team_scores,
)

STATS = ["PTS", "TRB", "AST", "STL", "BLK", "MP", "TOV"]
NUMBERS = ["PTS", "PTS_Opp", "FGA", "FG%", "FT%", "3PA", "3P%"]


def positions(spark, sf_dir):
    df = player_games(spark, sf_dir).withColumn(
        "mapped_pos", F.element_at(F.array(F.lit("guard"), F.lit("forward"), F.lit("center")), (col("Player") % 3 + 1).cast("int"))
    )
    return tidy(profiles.by_position(df, STATS))


def months(spark, sf_dir):
    return tidy(profiles.by_month(player_games(spark, sf_dir), STATS[:3]))


def opponents(spark, sf_dir):
    return tidy(profiles.by_opponent(player_games(spark, sf_dir), STATS))


def consistency(spark, sf_dir):
    return tidy(profiles.player_consistency(player_games(spark, sf_dir)))


def correlation_pairs(spark, sf_dir):
    df = team_games(spark, sf_dir)
    return tidy(profiles.strong_pairs(df, ["FGA", "3PA", "FTA", "PTS", "3P", "FG"]))


def streaks(spark, sf_dir):
    return tidy(profiles.longest_streak(double_log(spark, sf_dir), order=PLAYER_ORDER))


def top_streaks(spark, sf_dir):
    return tidy(profiles.top_streaks(profiles.longest_streak(double_log(spark, sf_dir), order=PLAYER_ORDER)))


def mean_streak(spark, sf_dir):
    df = profiles.longest_streak(double_log(spark, sf_dir), order=PLAYER_ORDER)
    return tidy(df.agg(F.avg("longest_streak").alias("mean_streak"), F.max("longest_streak").alias("max_streak")))


def profile(spark, sf_dir):
    return tidy(profiles.dataset_profile(team_scores(spark, sf_dir)))


def targets(spark, sf_dir):
    df = loading.parse_results(team_results(spark, sf_dir))
    return tidy(profiles.target_summary(df, "is_win"))


WIN_GROUPS = {
    "temporal_context": ["day_of_week", "month", "is_weekend", "days_into_season", "days_rest", "energy_factor", "season_fatigue_factor"],
    "opponent_quality": ["opponent_recent_form", "opponent_season_record", "opponent_power_rating", "last_vs_opp_result", "revenge_motivation", "power_mismatch"],
    "clutch_performance": ["clutch_win_rate", "overtime_win_rate"],
}


def coverage(spark, sf_dir):
    df = features.win_features(box(spark, sf_dir))
    return tidy(profiles.feature_coverage(df, WIN_GROUPS))


def group_coverage(spark, sf_dir):
    df = features.season_day(scores(spark, sf_dir))
    return tidy(profiles.group_coverage(profiles.feature_coverage(df, WIN_GROUPS)))


def importance_scores(spark, sf_dir):
    """|r| of each column with points scored and allowed, as two 'models'."""
    df = team_games(spark, sf_dir)
    names = ["FGA", "FG%", "FT%", "3PA", "3P%", "FGA_Opp", "FTA_Opp"]
    found = profiles.correlations(df, [(n, t) for t in ("PTS", "PTS_Opp") for n in names])
    return found.select(col("a").alias("feature"), col("b").alias("model"), F.abs("r").alias("importance"))


def rollup(spark, sf_dir):
    df = importance_scores(spark, sf_dir)
    kind = F.when(col("feature").contains("%"), "share").otherwise("volume")
    groups = df.select("feature", kind.alias("feature_group")).distinct()
    return tidy(profiles.importance_rollup(df, groups))


def group_rollup(spark, sf_dir):
    df = importance_scores(spark, sf_dir)
    kind = F.when(col("feature").contains("%"), "share").otherwise("volume")
    return tidy(df.groupBy(kind.alias("feature_group")).agg(F.sum("importance").alias("importance")))


def top_features(spark, sf_dir):
    df = importance_scores(spark, sf_dir).where(col("model") == "PTS").select("feature", "importance")
    return tidy(profiles.top_features(df, 5))


def tail_events(spark, sf_dir):
    df = profiles.newest_events(player_games(spark, sf_dir).select("game_id", "ts", "PTS"), 50, PLAYER_ORDER)
    return tidy(df.select("game_id", "PTS"))


def sparse(spark, sf_dir):
    df = team_games(spark, sf_dir).select(
        "game_id", "PTS", F.when(col("game_id") % 3 == 0, col("PTS_Opp")).alias("seldom"), F.when(col("game_id") % 3 > 0, col("PTS_Opp")).alias("often")
    )
    return tidy(profiles.drop_sparse_columns(df, ["PTS", "seldom", "often"], 0.5))


def holes(spark, sf_dir):
    """Games with gaps: some percentages, paces and points unknown."""
    key = col("game_id")
    return team_games(spark, sf_dir).select(
        "game_id", "PTS", "FGA", F.when(key % 5 > 0, col("FG%")).alias("FG%"), F.when(key % 7 > 0, col("PTS_Opp")).alias("pts_allowed"),
        F.when(key % 11 > 0, shooting.possessions_points()).alias("pace"), F.when(key % 13 == 0, F.lit(float("inf"))).otherwise(col("3PA")).alias("volume"),
        F.when(key % 4 > 0, col("Opp")).alias("Opp"),
    )


def impute_name(spark, sf_dir):
    df = holes(spark, sf_dir).drop("volume", "Opp")
    fills = cleaning.fills_by_name(df, ["FG%", "pts_allowed", "pace", "FGA"], pace=True)
    return tidy(cleaning.fill_missing(df, fills))


def impute_median(spark, sf_dir):
    df = holes(spark, sf_dir)
    fills = cleaning.fills_by_median(df, ["FGA", "FG%", "pts_allowed", "pace", "volume"]) | cleaning.modes(df, ["Opp"])
    return tidy(cleaning.fill_missing(df, fills).drop("PTS"))


def winsor(bounds):
    def run(spark, sf_dir):
        df = team_games(spark, sf_dir).select("game_id", *[col(n) for n in NUMBERS])
        return tidy(cleaning.winsorize(df, bounds(df, NUMBERS)))

    return run


def transform_rows(spark, sf_dir):
    df = player_games(spark, sf_dir)
    made = cleaning.transforms("FGA") | {
        "FGA_per_minute": cleaning.per_minute("FGA"), "PTS_trend": cleaning.average_ratio("PTS", "TRB"),
        "FGA_x_MP": cleaning.product("FGA", "MP"), "FGA_squared_x_MP": cleaning.product("FGA", "MP", True),
    }
    scaled = cleaning.scaled_transforms(df, "FGA")
    return tidy(scaled.select("game_id", *[c.alias(n) for n, c in made.items()], "FGA_norm", "FGA_minmax", "FGA_rank"))


def align(spark, sf_dir):
    df = holes(spark, sf_dir)
    names = ["pace", "FGA", "FGA_sqrt", "some_rate", "some_log", "other", "volume"]
    return tidy(cleaning.align_features(df, names, ["game_id"]))


def sanitize(spark, sf_dir):
    key = col("game_id")
    odd = F.when(key % 7 == 0, F.lit(float("inf"))).when(key % 11 == 0, F.lit(float("-inf"))).when(key % 13 == 0, F.lit(float("nan"))).when(
        key % 17 == 0, F.lit(5e7)).otherwise(col("PTS"))
    df = team_scores(spark, sf_dir).select("game_id", odd.alias("raw"), odd.alias("scaled"))
    df = cleaning.sanitize_matrix(df, ["raw"])
    return tidy(cleaning.sanitize_matrix(df, ["scaled"], scaled=True))


def clip_rows(spark, sf_dir):
    x = F.when(col("game_id") % 9 > 0, col("PTS") + col("PTS_Opp"))
    df = team_scores(spark, sf_dir).select(
        "game_id", cleaning.clip_predictions(x, *fixed.TOTAL_PREDICTION_CLIP, fixed.TOTAL_PREDICTION_DEFAULT).alias("total"),
        cleaning.clip_predictions(col("PTS"), 80.0, 130.0, 110.0).alias("points"),
    )
    return tidy(df)


def listing(df, names, label="feature"):
    """Names chosen for a table, as rows with the size of that table."""
    items = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(n).alias(label)) for i, n in enumerate(names)])
    return df.agg(F.count("*").alias("rows")).select("rows", F.inline(items))


def with_target(spark, sf_dir):
    return selection.correlate_with_target(team_games(spark, sf_dir), "PTS", [n for n in NUMBERS if n != "PTS"])


def by_correlation(spark, sf_dir):
    df = features.total_features(box(spark, sf_dir)).withColumn("total_points", col("PTS") + col("PTS_Opp"))
    names = ["possessions", "direct_scoring_projection", "total_direct_projection", "total_shot_volume", "weighted_shot_volume",
             "total_expected_shots", "true_shooting_pct", "opp_true_shooting_pct", "pts_avg_10g"]
    narrow = df.select("total_points", *[col(n) for n in names])
    return tidy(listing(narrow, selection.select_by_correlation(narrow, "total_points", names)))


def collinear(spark, sf_dir):
    df = team_games(spark, sf_dir)
    names = selection.drop_collinear_both(df, ["FGA", "3PA", "FTA", "FG", "3P", "FG%", "FT%", "3P%", "PTS", "PTS_Opp"])
    return tidy(listing(df, names))


def by_priority(spark, sf_dir):
    df = features.win_features(box(spark, sf_dir))
    return tidy(listing(df.select("game_id"), selection.win_priority(selection.feature_columns(df, "win"))))


def double_df(spark, sf_dir):
    df = double_log(spark, sf_dir).withColumns({"is_home": situation.is_home(), "is_started": situation.is_starter()})
    return features.double_features(df, PLAYER_ORDER)


def by_priority_double(spark, sf_dir):
    df = double_df(spark, sf_dir)
    return tidy(listing(df.select("game_id"), selection.double_priority(selection.feature_columns(df, "double"))))


def model_columns(spark, sf_dir):
    df = features.points_features(box(spark, sf_dir))
    return tidy(listing(df.select("game_id"), selection.feature_columns(df, "points")))


def score_parts(spark, sf_dir):
    df = double_log(spark, sf_dir)
    names = ["PTS", "TRB", "AST", "MP"]
    f, mi = selection.f_scores(df, "double_double", names), selection.binned_information(df, "double_double", names)
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(f[n]).alias("f_score"), F.lit(mi[n]).alias("information")) for n in names])
    return tidy(df.agg(F.count("*").alias("rows")).select("rows", F.inline(items)))


def information(spark, sf_dir):
    return tidy(neighbours.neighbour_information(double_log(spark, sf_dir), "double_double", ["PTS", "TRB", "AST", "MP"]))


def betting(spark, sf_dir):
    df = player_games(spark, sf_dir).withColumns(
        {"PTS_over_20_prob_5": col("PTS") / 100, "PTS_volatility_5": col("TRB"), "height": F.when(col("game_id") % 2 == 0, col("MP")), "minutes_load": col("PTS") + col("MP")}
    )
    return tidy(listing(df.select("game_id"), selection.betting_features(df, "PTS", 20.0, ["minutes_load", "TRB", "AST"])))


def confident_columns(spark, sf_dir):
    df = player_games(spark, sf_dir).select("game_id", "ts", F.lit(0.95).alias("PTS_over_10_prob_5"), (col("PTS") / 1000).alias("PTS_over_20_prob_5"), col("PTS").alias("PTS_over_10_line_diff"))
    return tidy(listing(df.select("game_id"), selection.high_confidence_columns(df, "PTS", PLAYER_ORDER)))


# ------------------------------------------------------------------ sources


def _write_raw(spark, sf_dir):
    folder = f"{staging_folder(spark)}/raw-{uuid.uuid4().hex}"
    teams = team_results(spark, sf_dir).withColumn("FG%", (45 + col("game_id") % 10).cast("double"))
    games = player_games(spark, sf_dir)
    letter = F.when(col("game_id") % 2 == 0, "W 101-99").otherwise("L 90-95 (OT)")
    games = games.withColumns({"Result": letter, "Date": F.date_format("ts", "M/d/yyyy")}).drop("ts")
    for name, df in (("teams", teams), ("games", games), ("biometrics", player_bio(spark, sf_dir))):
        df.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return folder


def csv_tables(spark, sf_dir):
    """The three tables written as CSV, loaded, cleaned and joined."""
    folder = _write_raw(spark, sf_dir)
    games, _ = table_source.load_data(spark, f"{folder}/games", f"{folder}/biometrics", f"{folder}/teams")
    return tidy(games.select("game_id", "Player", "Date", "is_home", "is_started", "is_win", "total_score", "double_double", "Height_Inches", "BMI"))


def csv_teams(spark, sf_dir):
    folder = _write_raw(spark, sf_dir)
    df = table_source.load_teams(spark, f"{folder}/teams")
    return tidy(df.select("game_id", "Team", "Date", "is_home", col("is_win").cast("double").alias("is_win"), "has_overtime", col("FG%").alias("fg_pct"), "PTS"))


def required(spark, sf_dir):
    """The checked team log, counted; a missing column raises while the plan is built."""
    df = loading.check_required_columns(team_results(spark, sf_dir), fixed.REQUIRED_TEAMS, "teams")
    missing = 0
    try:
        loading.check_required_columns(df.drop("PTS"), fixed.REQUIRED_TEAMS, "teams")
    except ValueError:
        missing = 1
    df = loading.check_trainable(df, ["PTS_Opp"], "PTS")
    return tidy(df.agg(F.count("*").alias("rows")).withColumn("raised", F.lit(missing)))


def sorted_log(spark, sf_dir):
    """First and last game per team: the order lives in the window, not in a global sort."""
    df = scores(spark, sf_dir)
    return tidy(df.groupBy("Team").agg(
        F.min_by("game_id", F.struct("Date", "game_id")).alias("first_game"), F.max_by("game_id", F.struct("Date", "game_id")).alias("last_game")))


# --- SQL pieces ---------------------------------------------------------------------------
_POS = """CASE "Player" % 3 WHEN 0 THEN 'guard' WHEN 1 THEN 'forward' ELSE 'center' END"""
_STREAK = """s1 AS (SELECT "Player", double_double, sum(1 - double_double) OVER (PARTITION BY "Player" ORDER BY ts, game_id) AS island FROM double_log),
s2 AS (SELECT "Player", island, sum(double_double) AS run, count(*) AS n FROM s1 GROUP BY 1, 2),
streaks AS (SELECT "Player", max(run) AS longest_streak, sum(n) AS games FROM s2 GROUP BY 1)"""
_PAIRS = ["FGA", "3PA", "FTA", "PTS", "3P", "FG"]
_CORR = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, corr("{a}", "{b}") AS r FROM team_games""" for a in _PAIRS for b in _PAIRS if a != b)
_IMP = " UNION ALL ".join(f"""SELECT '{n}' AS feature, '{t}' AS model, abs(corr("{n}", "{t}")) AS importance FROM team_games"""
                          for t in ("PTS", "PTS_Opp") for n in ("FGA", "FG%", "FT%", "3PA", "3P%", "FGA_Opp", "FTA_Opp"))
_KIND = "CASE WHEN feature LIKE '%\\%%' ESCAPE '\\' THEN 'share' ELSE 'volume' END"
_HOLES = TEAM_GAMES + """, holes AS (SELECT game_id, "PTS", "FGA", CASE WHEN game_id % 5 > 0 THEN "FG%" END AS "FG%", CASE WHEN game_id % 7 > 0 THEN "PTS_Opp" END AS pts_allowed,
  CASE WHEN game_id % 11 > 0 THEN "FGA" + "FTA" * 0.44 END AS pace, CASE WHEN game_id % 13 > 0 THEN "3PA" END AS volume, CASE WHEN game_id % 4 > 0 THEN "Opp" END AS "Opp" FROM team_games)"""


def _winsor_sql(low, high):
    made = ", ".join(f"""CASE WHEN "{n}" IS NOT NULL THEN least(greatest("{n}", (SELECT {low.format(n)} FROM team_games)), (SELECT {high.format(n)} FROM team_games)) END AS "{n}" """ for n in NUMBERS)
    return ask(TEAM_GAMES, f"SELECT game_id, {made} FROM team_games", ", ".join(NUMBERS), "game_id")


def _named(table, names):
    """The names in order, each with the size of the table."""
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS place, '{n}' AS feature" for i, n in enumerate(names))
    return ask("", f"SELECT (SELECT count(*) FROM {table}) AS rows, * FROM ({rows})", "", "rows, place", "feature")


_Q1, _Q3 = 'quantile_cont("{0}", 0.25)', 'quantile_cont("{0}", 0.75)'
_SEL = {
    "possessions": '"FGA" - "FG" + "FTA" * 0.44 + "FG" * 0.56', "direct_scoring_projection": _direct(""), "total_direct_projection": f"{_direct('')} + {_direct('_Opp')}",
    "total_shot_volume": '"FGA" + "FGA_Opp" + "FTA" + "FTA_Opp"', "weighted_shot_volume": f"""("FGA" + "FGA_Opp" + "FTA" + "FTA_Opp") * ({_mean3('')} + {_mean3('_Opp')}) / 2""",
    "total_expected_shots": '"FGA" + "3PA" * 0.4 + "FTA" * 0.44', "true_shooting_pct": '"PTS" / nullif(2 * ("FGA" + 0.44 * "FTA"), 0)',
    "opp_true_shooting_pct": '"PTS_Opp" / nullif(2 * ("FGA_Opp" + 0.44 * "FTA_Opp"), 0)',
    "pts_avg_10g": 'avg("PTS") OVER (PARTITION BY "Team" ORDER BY "Date", game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)',
}
_SEL_PAIRS = [(a, b) for i, a in enumerate(_SEL) for b in list(_SEL)[i + 1 :]]
_BY_CORRELATION = ask(
    TEAM_GAMES + ', x AS (SELECT "PTS" + "PTS_Opp" AS target, ' + ", ".join(f'{e} AS "{n}"' for n, e in _SEL.items()) + " FROM team_games), filled AS (SELECT "
    + ", ".join(f'coalesce("{n}", (SELECT median("{n}") FROM x)) AS "{n}"' for n in _SEL) + " FROM x), s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS feature, abs(corr(\"{n}\", target)) AS r FROM x" for i, n in enumerate(_SEL)) + """),
    k AS (SELECT * FROM s WHERE r >= 0.08 AND feature <> 'total_direct_projection'), m AS ("""
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr(\"{a}\", \"{b}\")) AS c FROM filled" for a, b in _SEL_PAIRS) + """),
    gone AS (SELECT CASE WHEN ka.r >= kb.r THEN b ELSE a END AS feature FROM m JOIN k ka ON ka.feature = a JOIN k kb ON kb.feature = b WHERE c > 0.95)""",
    "SELECT (SELECT count(*) FROM x) AS rows, row_number() OVER (ORDER BY i) AS place, feature FROM k WHERE feature NOT IN (SELECT feature FROM gone)", "", "rows, place", "feature",
)
_FX = "greatest(\"FGA\", 0)"
_TR = {
    "FGA_sqrt": f"sqrt({_FX})", "FGA_log2": f"log2({_FX} + 1)", "FGA_log": f"ln({_FX} + 1)", "FGA_log10": f"log10({_FX} + 1)", "FGA_yj": f"2 * sqrt({_FX} + 1) - 2",
    "FGA_boxcox": f"(sqrt({_FX} + 1) - 1) / 0.5", "FGA_power2": f"{_FX} ** 2", "FGA_power3": f"{_FX} ** 3", "FGA_inv": f"1 / ({_FX} + 1e-8)",
    "FGA_per_minute": '"FGA" / greatest("MP", 1)', "PTS_trend": '"PTS" / greatest("TRB", 1)', "FGA_x_MP": '"FGA" * "MP"', "FGA_squared_x_MP": '"FGA" ** 2 * "MP"',
    "FGA_norm": f"({_FX} - avg({_FX}) OVER ()) / stddev_samp({_FX}) OVER ()", "FGA_minmax": f"({_FX} - min({_FX}) OVER ()) / (max({_FX}) OVER () - min({_FX}) OVER ())",
    "FGA_rank": f"(rank() OVER (ORDER BY {_FX}) + (count(*) OVER (PARTITION BY {_FX}) - 1) / 2.0 - 1) / (count(*) OVER () - 1)",
}

QUERIES = {
    "agg_by_position": Query(
        positions,
        ask(PLAYER_GAMES, f"SELECT {_POS} AS mapped_pos, " + ", ".join(f'round(avg("{s}") + 1e-12, 2) AS "{s}_mean", round(stddev_samp("{s}") + 1e-12, 2) AS "{s}_std"' for s in STATS) + " FROM player_games GROUP BY 1",
            ", ".join(f"{s}_{k}" for s in STATS for k in ("mean", "std")), "", "mapped_pos"),
    ),
    "agg_by_month": Query(
        months,
        ask(PLAYER_GAMES, """SELECT strftime("Date", '%Y-%m') AS month, """ + ", ".join(f'avg("{s}") AS "{s}_mean", count("{s}") AS "{s}_count"' for s in STATS[:3]) + " FROM player_games GROUP BY 1",
            ", ".join(f"{s}_mean" for s in STATS[:3]), ", ".join(f"{s}_count" for s in STATS[:3]), "month"),
    ),
    "agg_by_opponent": Query(
        opponents, ask(PLAYER_GAMES, 'SELECT "Opp", ' + ", ".join(f'round(avg("{s}"), 3) AS "{s}"' for s in STATS) + ' FROM player_games GROUP BY 1', ", ".join(STATS), "", "Opp"),
    ),
    "player_consistency": Query(
        consistency,
        ask(PLAYER_GAMES + """, c AS (SELECT "Player", count(*) AS games, avg("PTS") AS mean, stddev_samp("PTS") AS std, stddev_samp("PTS") / avg("PTS") AS cv FROM player_games GROUP BY 1 HAVING count(*) >= 10 AND avg("PTS") > 0)""",
            """SELECT *, 'most_consistent' AS side FROM (SELECT * FROM c ORDER BY cv, "Player" LIMIT 10) UNION ALL SELECT *, 'least_consistent' FROM (SELECT * FROM c ORDER BY cv DESC, "Player" LIMIT 10)""",
            "mean, std, cv", "Player, games", "side"),
    ),
    "topk_players": Query(
        lambda spark, sf_dir: tidy(profiles.player_consistency(player_games(spark, sf_dir), stat="TRB", top=5).select("Player", "cv", "side")),
        ask(PLAYER_GAMES + """, c AS (SELECT "Player", stddev_samp("TRB") / avg("TRB") AS cv FROM player_games GROUP BY 1 HAVING count(*) >= 10 AND avg("TRB") > 0)""",
            """SELECT *, 'most_consistent' AS side FROM (SELECT * FROM c ORDER BY cv, "Player" LIMIT 5) UNION ALL SELECT *, 'least_consistent' FROM (SELECT * FROM c ORDER BY cv DESC, "Player" LIMIT 5)""", "cv", "Player", "side"),
    ),
    "stat_correlation_pairs": Query(correlation_pairs, ask(TEAM_GAMES + f", c AS ({_CORR})", "SELECT * FROM c WHERE abs(r) > 0.7 AND r < 1 - 1e-9", "r", "", "a, b")),
    "longest_streak": Query(streaks, ask(DOUBLE_LOG + "," + _STREAK, "SELECT * FROM streaks", "", "Player, longest_streak, games")),
    "topk_streaks": Query(top_streaks, ask(DOUBLE_LOG + "," + _STREAK, 'SELECT * FROM streaks ORDER BY longest_streak DESC, "Player" LIMIT 10', "", "Player, longest_streak, games")),
    "streak_summary": Query(mean_streak, ask(DOUBLE_LOG + "," + _STREAK, "SELECT avg(longest_streak) AS mean_streak, max(longest_streak) AS max_streak FROM streaks", "mean_streak", "max_streak")),
    "dataset_profile": Query(
        profile,
        ask(TEAM_GAMES, """SELECT count(*) AS rows, count(DISTINCT "Team") AS teams, min("Date") AS first_date, max("Date") AS last_date, avg("PTS") AS mean_pts, min("PTS") AS min_pts, max("PTS") AS max_pts, 8 AS columns FROM team_games""",
            "mean_pts, min_pts, max_pts", "rows, teams, columns", "first_date, last_date"),
    ),
    "target_summary": Query(
        targets,
        ask(TEAM_RESULTS + """, w AS (SELECT CASE "Result"[1] WHEN 'W' THEN 1 WHEN 'L' THEN 0 END AS x FROM team_results)""",
            """SELECT count(*) AS games, sum(x) AS positives, count(*) FILTER (x = 0) AS negatives, avg(x) AS rate, count(*) FILTER (x IS NULL) AS missing, avg(x) AS share_positive, avg(1 - x) AS share_negative FROM w""",
            "rate, share_positive, share_negative", "games, positives, negatives, missing"),
    ),
    "feature_coverage": Query(
        coverage,
        ask("n AS (SELECT count(*) AS rows FROM orders)", " UNION ALL ".join(
            f"SELECT '{g}' AS feature_group, '{f}' AS feature, {int(f not in ('opponent_power_rating', 'power_mismatch', 'clutch_win_rate', 'overtime_win_rate'))} AS present, {int(f not in ('opponent_power_rating', 'power_mismatch', 'clutch_win_rate', 'overtime_win_rate'))} * rows AS known, rows FROM n"
            for g, names in WIN_GROUPS.items() for f in names), "", "present, known, rows", "feature_group, feature"),
    ),
    "group_coverage": Query(
        group_coverage,
        ask("n AS (SELECT count(*) AS rows FROM orders)", "SELECT 'temporal_context' AS feature_group, 7 AS expected, 4 AS existing, 4 / 7 AS coverage UNION ALL SELECT 'opponent_quality', 6, 0, 0 UNION ALL SELECT 'clutch_performance', 2, 0, 0", "coverage", "expected, existing", "feature_group"),
    ),
    "importance_rollup": Query(
        rollup,
        ask(TEAM_GAMES + f", i AS ({_IMP}), m AS (SELECT feature, avg(importance) AS importance FROM i GROUP BY 1)",
            f"SELECT feature, importance, {_KIND} AS feature_group, row_number() OVER (ORDER BY importance DESC, feature) AS place, sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS cumulative FROM m",
            "importance, cumulative", "place", "feature, feature_group"),
    ),
    "importance_by_group": Query(group_rollup, ask(TEAM_GAMES + f", i AS ({_IMP})", f"SELECT {_KIND} AS feature_group, sum(importance) AS importance FROM i GROUP BY 1", "importance", "", "feature_group")),
    "topk_features": Query(top_features, ask(TEAM_GAMES + f", i AS ({_IMP})", "SELECT feature, importance FROM i WHERE model = 'PTS' ORDER BY importance DESC, feature LIMIT 5", "importance", "", "feature")),
    "tail_n_events": Query(tail_events, ask(PLAYER_GAMES, 'SELECT game_id, "PTS" FROM player_games ORDER BY ts DESC, game_id DESC LIMIT 50', "PTS", "game_id")),
    "drop_sparse_columns": Query(sparse, ask(TEAM_GAMES, 'SELECT game_id, "PTS", CASE WHEN game_id % 3 > 0 THEN "PTS_Opp" END AS often FROM team_games', "PTS, often", "game_id")),
    "impute_by_name": Query(
        impute_name,
        ask(_HOLES, """SELECT game_id, "PTS", coalesce("FGA", (SELECT median("FGA") FROM holes)) AS "FGA", coalesce("FG%", 0.45) AS "FG%", coalesce(pts_allowed, 110) AS pts_allowed, coalesce(pace, 100) AS pace FROM holes""",
            "PTS, FGA, FG%, pts_allowed, pace", "game_id"),
    ),
    "impute_median_chain": Query(
        impute_median,
        ask(_HOLES, "SELECT game_id, " + ", ".join(f'coalesce("{c}", (SELECT median("{c}") FROM holes)) AS "{c}"' for c in ("FGA", "FG%", "pts_allowed", "pace", "volume")) +
            """, coalesce("Opp", (SELECT "Opp" FROM holes WHERE "Opp" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS "Opp" FROM holes""", "FGA, FG%, pts_allowed, pace, volume", "game_id", "Opp"),
    ),
    "winsorize_quantile": Query(winsor(cleaning.quantile_bounds), _winsor_sql('quantile_cont("{0}", 0.01)', 'quantile_cont("{0}", 0.99)')),
    "winsorize_iqr": Query(winsor(cleaning.iqr_bounds), _winsor_sql(f"{_Q1} - 3 * ({_Q3} - {_Q1})", f"{_Q3} + 3 * ({_Q3} - {_Q1})")),
    "winsorize_zscore": Query(winsor(cleaning.zscore_bounds), _winsor_sql('avg("{0}") - 3 * stddev_pop("{0}")', 'avg("{0}") + 3 * stddev_pop("{0}")')),
    "transform_set": Query(transform_rows, ask(PLAYER_GAMES, "SELECT game_id, " + ", ".join(f'{e} AS "{n}"' for n, e in _TR.items()) + " FROM player_games", ", ".join(_TR), "game_id")),
    "align_feature_schema": Query(
        align,
        ask(_HOLES, """SELECT game_id, coalesce(pace, 0) AS pace, coalesce("FGA", 0) AS "FGA", coalesce(sqrt("FGA"), 0) AS "FGA_sqrt", 0.5 AS some_rate, 1 AS some_log, 0 AS other, coalesce(volume, 0) AS volume FROM holes""",
            "pace, FGA, FGA_sqrt, some_rate, some_log, other, volume", "game_id"),
    ),
    "sanitize_matrix": Query(
        sanitize,
        ask(TEAM_GAMES, """SELECT game_id, CASE WHEN game_id % 7 = 0 THEN 1000 WHEN game_id % 11 = 0 THEN -1000 WHEN game_id % 13 = 0 THEN 0 WHEN game_id % 17 = 0 THEN 1e6 ELSE "PTS" END AS raw,
            CASE WHEN game_id % 7 = 0 THEN 1 WHEN game_id % 11 = 0 THEN -1 WHEN game_id % 13 = 0 THEN 0 WHEN game_id % 17 = 0 THEN 5e7 ELSE "PTS" END AS scaled FROM team_games""", "raw, scaled", "game_id"),
    ),
    "clip_predictions": Query(
        clip_rows,
        ask(TEAM_GAMES, """SELECT game_id, CASE WHEN game_id % 9 = 0 THEN 220 ELSE least(greatest("PTS" + "PTS_Opp", 200), 250) END AS total, least(greatest("PTS", 80), 130) AS points FROM team_games""", "total, points", "game_id"),
    ),
    "correlate_with_target": Query(
        lambda spark, sf_dir: tidy(with_target(spark, sf_dir)),
        ask(TEAM_GAMES, " UNION ALL ".join(f"""SELECT '{n}' AS feature, abs(corr("{n}", "PTS")) AS correlation FROM team_games""" for n in NUMBERS if n != "PTS"), "correlation", "", "feature"),
    ),
    "select_by_correlation": Query(by_correlation, _BY_CORRELATION),
    "drop_collinear_both": Query(
        collinear,
        ask(TEAM_GAMES + ", c AS (" + " UNION ALL ".join(f"""SELECT {i} AS i, '{a}' AS a, '{b}' AS b, corr("{a}", "{b}") AS r FROM team_games"""
            for i, a in enumerate(["FGA", "3PA", "FTA", "FG", "3P", "FG%", "FT%", "3P%", "PTS", "PTS_Opp"]) for b in ["FGA", "3PA", "FTA", "FG", "3P", "FG%", "FT%", "3P%", "PTS", "PTS_Opp"] if a != b) + ")",
            "SELECT (SELECT count(*) FROM team_games) AS rows, row_number() OVER (ORDER BY i) AS place, a AS feature FROM (SELECT i, a FROM c GROUP BY 1, 2 HAVING max(abs(r)) <= 0.8)", "", "rows, place", "feature"),
    ),
    "select_by_priority": Query(
        by_priority,
        _named("orders", [
            "team_win_rate_5g", "team_win_rate_10g", "weighted_win_rate_5g", "win_momentum_5g", "home_win_rate_10g", "away_win_rate_10g",
            "pts_hist_avg_5g", "pts_opp_hist_avg_5g", "point_diff_hist_avg_5g", "pts_consistency_5g", "pts_hist_avg_10g", "pts_opp_hist_avg_10g",
            "point_diff_hist_avg_10g", "pts_consistency_10g", "fg_pct_hist_avg_5g", "3p_pct_hist_avg_5g", "ft_pct_hist_avg_5g", "fg_pct_hist_avg_10g",
            "3p_pct_hist_avg_10g", "ft_pct_hist_avg_10g", "is_weekend", "is_back_to_back", "home_advantage", "rest_advantage",
            "last_vs_opp_result", "opponent_recent_form", "opponent_season_record", "revenge_motivation"]),
    ),
    "select_by_priority_double": Query(by_priority_double),
    "feature_columns": Query(model_columns),
    "select_by_scores": Query(
        score_parts,
        ask(DOUBLE_LOG + ", v AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS feature, double_double AS y, "{n}" AS x FROM double_log""" for n in ("PTS", "TRB", "AST", "MP")) + """),
            g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM v GROUP BY 1, 2), a AS (SELECT feature, avg(x) AS grand, count(*) AS n FROM v GROUP BY 1),
            f AS (SELECT feature, sum(g.n * (m - grand) ** 2) / (sum(g.n * v) / (max(a.n) - 2)) AS f_score FROM g JOIN a USING (feature) GROUP BY 1),
            e AS (SELECT DISTINCT feature, unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM v GROUP BY 1),
            el AS (SELECT feature, list(edge) AS edges FROM e GROUP BY 1),
            b AS (SELECT feature, y, len(list_filter(edges, lambda t: x > t)) AS bin FROM v JOIN el USING (feature)),
            j AS (SELECT feature, bin, y, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY feature)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY feature, bin)::DOUBLE AS pb,
              sum(count(*)) OVER (PARTITION BY feature, y)::DOUBLE AS py FROM b GROUP BY 1, 2, 3),
            mi AS (SELECT feature, sum(c / n * ln(c * n / (pb * py))) AS information FROM j GROUP BY 1)""",
            "SELECT (SELECT count(*) FROM double_log) AS rows, feature, f_score, information FROM f JOIN mi USING (feature)", "f_score, information", "rows", "feature"),
    ),
    "neighbour_information": Query(
        information,
        ask(DOUBLE_LOG + ", v AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS feature, game_id, double_double AS y, "{n}"::DOUBLE AS x FROM double_log""" for n in ("PTS", "TRB", "AST", "MP")) + """),
            r AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size, lag(x, 1) OVER w AS b1, lag(x, 2) OVER w AS b2, lag(x, 3) OVER w AS b3, lead(x, 1) OVER w AS a1, lead(x, 2) OVER w AS a2, lead(x, 3) OVER w AS a3
              FROM v WINDOW w AS (PARTITION BY feature, y ORDER BY x, game_id)),
            d AS (SELECT *, list_min([a3 - x, CASE WHEN b1 IS NOT NULL AND a2 IS NOT NULL THEN greatest(x - b1, a2 - x) END, CASE WHEN b2 IS NOT NULL AND a1 IS NOT NULL THEN greatest(x - b2, a1 - x) END, x - b3]) AS radius FROM r),
            e AS (SELECT *, CASE WHEN radius = 0 THEN 0 ELSE radius - 1e-12::DOUBLE * (abs(x) + radius) END AS within FROM d),
            m AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY x RANGE BETWEEN within PRECEDING AND within FOLLOWING) AS inside FROM e),
            h AS (SELECT i AS n, sum(1 / i::DOUBLE) OVER (ORDER BY i) - 1 / i::DOUBLE - 0.5772156649015329::DOUBLE AS psi FROM range(1, (SELECT count(*) + 1 FROM double_log)) AS t(i))""",
            """SELECT feature, greatest(0, (SELECT psi FROM h WHERE n = (SELECT count(*) FROM double_log)) + (SELECT psi FROM h WHERE n = 3) - avg(s.psi) - avg(t.psi)) AS information
            FROM m JOIN h s ON s.n = size JOIN h t ON t.n = inside GROUP BY feature""", "information", "", "feature"),
    ),
    "betting_features": Query(
        betting, _named("events", ["PTS_over_20_prob_5", "minutes_load", "PTS_volatility_5", "TRB", "AST"]),
    ),
    "high_confidence_columns": Query(
        confident_columns, _named("events", ["PTS_over_10_prob_5", "PTS_over_10_line_diff"]),
    ),
    "src_csv_tables": Query(
        csv_tables,
        ask(DOUBLE_LOG + "," + views.PLAYER_BIO.strip() + """, b AS (SELECT "Player", CASE WHEN "Height" LIKE '%''%' THEN split_part("Height", '''', 1)::INT * 12 + replace(split_part("Height", '''', 2), '"', '')::INT END::DOUBLE AS h, "Weight"::DOUBLE AS wt FROM player_bio)""",
            """SELECT game_id, g."Player", strftime("Date", '%Y-%m-%d 00:00:00') AS "Date", CASE WHEN "Away" = '@' THEN 0 ELSE 1 END AS is_home, (game_id % 3 = 0)::INT AS is_started, (game_id % 2 = 0)::INT AS is_win,
            CASE WHEN game_id % 2 = 0 THEN 200 ELSE 185 END AS total_score, double_double, h AS "Height_Inches", CASE WHEN h > 0 THEN wt * 703 / (h * h) END AS "BMI" FROM double_log g LEFT JOIN b ON g."Player" = b."Player" """,
            "Height_Inches, BMI", "game_id, is_home, is_started, is_win, total_score, double_double", "Player, Date").replace('"game_id"::BIGINT AS "game_id"', '"game_id"::DOUBLE AS "game_id"'),
    ),
    "src_teams_only": Query(
        csv_teams,
        ask(TEAM_RESULTS, """SELECT game_id, "Team", strftime("Date", '%Y-%m-%d 00:00:00') AS "Date", CASE WHEN "Away" = '@' THEN 0 ELSE 1 END AS is_home, CASE "Result"[1] WHEN 'W' THEN 1.0 WHEN 'L' THEN 0.0 END AS is_win,
            (game_id % 97 <> 0 AND (game_id % 10 = 0 OR game_id % 25 = 0))::INT AS has_overtime, (45 + game_id % 10) / 100.0::DOUBLE AS fg_pct, "PTS" FROM team_results""",
            "is_win, fg_pct, PTS", "game_id, is_home, has_overtime", "Team, Date").replace('"game_id"::BIGINT AS "game_id"', '"game_id"::DOUBLE AS "game_id"'),
    ),
    "check_required_columns": Query(required, ask("", "SELECT count(*) AS rows, 1 AS raised FROM orders", "", "rows, raised")),
    "sort_log": Query(
        sorted_log,
        ask(TEAM_GAMES, """SELECT "Team", first(game_id ORDER BY "Date", game_id) AS first_game, last(game_id ORDER BY "Date", game_id) AS last_game FROM team_games GROUP BY 1""", "", "first_game, last_game", "Team"),
    ),
}
