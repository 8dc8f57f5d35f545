"""History windows, opponent strength, streaks and the four feature tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions import rolling, shooting, situation
from courtspark.functions.scalars import col, fill
from courtspark.operators import features, loading
from courtspark.operators.profiles import last_n_mean, latest_row
from courtspark.plans.history import with_history
from courtspark.plans.increment import History
from courtspark.plans.ordering import average_rank_share
from courtspark.registry.entry import Query, ask, tidy
from courtspark.registry.rows import BIO, RESTED, _direct, _mean3, _weighted, _rest_sql, _PCT, _pairs_sql, _DIRECTED, _UNDIRECTED, _ALT
from courtspark.sources.staging import stage, staging_folder
from courtspark.views import (
    DOUBLE_LOG, PLAYER_GAMES, TEAM_GAMES, double_log, player_bio, team_games, team_scores,
)

ORDER = ["Date", "game_id"]
PLAYER_ORDER = ["ts", "game_id"]


def scores(spark, sf_dir):
    df = loading.win_from_points(team_scores(spark, sf_dir))
    return df.withColumn("is_home", situation.is_home())


def box(spark, sf_dir):
    df = loading.win_from_points(team_games(spark, sf_dir))
    return df.withColumn("is_home", situation.is_home())


def hist(view, keys, order, build, reach=10, running=None, after=None):
    """Query that shows the history columns made by ``build`` and ``running``."""

    def run(spark, sf_dir):
        df = view(spark, sf_dir)
        out = with_history(df, keys, order, build, reach, running and running())
        if after is not None:
            out = after(out)
        new = [c for c in out.columns if c not in df.columns]
        return tidy(out.select("game_id", *new))

    return run


CUTS = ("1997-06-01", "1998-01-01", "1998-05-01", "9999-01-01")


def increments(view, keys, build, reach, running, after=None):
    """History of the rows from the first cut on, made in lots: each lot reads the written state and its own rows."""

    def run(spark, sf_dir):
        df = stage(view(spark, sf_dir), "log")
        history = History(f"{staging_folder(spark)}/history-{uuid.uuid4().hex}", keys, ORDER, build, reach, running and running())
        history.start(df.where(col("Date") < F.lit(CUTS[0]).cast("date")))
        out = None
        for a, b in zip(CUTS, CUTS[1:], strict=False):
            lot = history.extend(df.where((col("Date") >= F.lit(a).cast("date")) & (col("Date") < F.lit(b).cast("date"))))
            out = lot if out is None else out.unionByName(lot)
        if after is not None:
            out = after(out)
        return tidy(out.select("game_id", *[c for c in out.columns if c not in df.columns]))

    return run


def b_increment(w):
    return b_hist_roll(w) | b_win_rates(w) | {"days_rest": rolling.days_rest(w)}


def pair_running():
    return features.running_mean("vs_opp_pts_history", col("PTS")) | {"best_vs_opp": ("max", col("PTS"))}


# --- SQL pieces ---------------------------------------------------------------------------
GAMES = TEAM_GAMES + """, g AS (SELECT *, ("PTS" > "PTS_Opp")::INT AS is_win, CASE WHEN "Away" = '@' THEN 0 ELSE 1 END AS is_home FROM team_games)"""


def over(n, key='"Team"', order='"Date", game_id', start=None, end=1):
    begin = "UNBOUNDED" if n is None else n
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {begin} PRECEDING AND {end} PRECEDING)"


def avg(x, n, key='"Team"', order='"Date", game_id'):
    return f"avg({x}) {over(n, key, order)}"


def std(x, n, key='"Team"', order='"Date", game_id'):
    return f"stddev_samp({x}) {over(n, key, order)}"


def at_least(m, x, value, n, key='"Team"', order='"Date", game_id'):
    return f"CASE WHEN count({x}) {over(n, key, order)} >= {m} THEN {value} END"


P, PO = '"Player"', "ts, game_id"


def pavg(x, n):
    return avg(x, n, P, PO)


def pstd(x, n):
    return std(x, n, P, PO)


def twin(ctes, exprs, source, longs="game_id", rest=""):
    body = ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())
    return ask(ctes, f"SELECT game_id, {body} FROM {source}", ", ".join(exprs), longs, rest)


def _from_cut(exprs, longs=None):
    body = ", ".join(f'{e} AS "{n}"' for n, e in {**exprs, **(longs or {})}.items())
    ctes = GAMES + f""", every AS (SELECT game_id, "Date", {body} FROM g)"""
    return ask(ctes, f"""SELECT * FROM every WHERE "Date" >= DATE '{CUTS[0]}'""", ", ".join(exprs), ", ".join(["game_id", *(longs or {})]))


def shifted(source, key, order, flag):
    return f"""s AS (SELECT *, coalesce(lag({flag}) OVER (PARTITION BY {key} ORDER BY {order}), 0)::DOUBLE AS s FROM {source})"""


def weighted_sql(key, order):
    frame = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    wt = "(CASE WHEN len(l) = 1 THEN 0.5 ELSE 0.5 + 0.5 * (i - 1)::DOUBLE / (len(l) - 1) END)"
    return f"""SELECT game_id, list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * {wt})) /
      list_sum(list_transform(range(1, len(l) + 1), lambda i: {wt})) AS weighted
      FROM (SELECT game_id, list(s) {frame} AS l FROM s)"""


def momentum_sql(key, order):
    w = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN"
    return f"""SELECT game_id, avg(s) {w} 2 PRECEDING AND CURRENT ROW) - avg(s) {w} 4 PRECEDING AND 2 PRECEDING) AS momentum FROM s"""


# --- builders -----------------------------------------------------------------------------


def b_hist_roll(w):
    x = col("PTS")
    return {f"pts_{op}_5": rolling.rolled(w, x, 5, op, m) for op, m in (("mean", 1), ("std", 2), ("sum", 3), ("var", 2))}


def b_roll_then_shift(w):
    out = {}
    for n in (3, 5, 7, 10):
        for name in ("PTS", "PTS_Opp"):
            out[f"{name}_avg_{n}g"] = rolling.rolled(w, col(name), n)
        out[f"pace_avg_{n}g"] = rolling.rolled(w, shooting.possessions_points(), n)
        out[f"ts_avg_{n}g"] = rolling.rolled(w, shooting.true_shooting(), n)
        out[f"projection_avg_{n}g"] = rolling.rolled(w, shooting.direct_projection(), n)
        out[f"conversion_avg_{n}g"] = rolling.rolled(w, shooting.conversion_weighted(), n)
        out[f"volume_avg_{n}g"] = rolling.rolled(w, shooting.shot_volume(), n)
    return out


_ROLLED = {
    "PTS": '"PTS"', "PTS_Opp": '"PTS_Opp"', "pace": '"FGA" + "FTA" * 0.44',
    "ts": '"PTS" / nullif(2 * ("FGA" + 0.44 * "FTA"), 0)', "projection": _direct(""),
    "conversion": _weighted(""), "volume": '"FGA" + "FTA"',
}


def b_hist_averages(w):
    names = [f"{p}_hist_avg_{n}g" for n in (5, 10) for p in ("pts", "pts_opp", "point_diff", "fg_pct", "3p_pct", "ft_pct")]
    made = features.win_history(w)
    return {n: made[n] for n in names}


def pick(build, names):
    def chosen(w):
        made = build(w)
        return {n: made[n] for n in names}

    return chosen


WIN_RATES = ["team_win_rate_5g", "team_win_rate_10g", "home_win_rate_10g", "away_win_rate_10g"]


def b_win_rates(w):
    made = features.win_history(w)
    out = {n: made[n] for n in WIN_RATES}
    out["team_recent_wins"] = rolling.recent_wins(w)
    out["team_confidence_factor"] = (rolling.win_rate(w, 5) - 0.5) * 4
    out["confidence_factor"] = (rolling.rolled(w, col("is_win"), 5) - 0.5) * 2
    return out


def b_trends(w):
    return {
        "pts_trend_short": rolling.trend(w, col("PTS")),
        "projection_trend": rolling.relative_trend(w, shooting.direct_projection()),
        "scoring_momentum": rolling.scoring_momentum(w, col("PTS")),
        "defensive_momentum": rolling.defensive_momentum(w, col("PTS_Opp")),
    }


def dd_view(spark, sf_dir):
    return double_log(spark, sf_dir)


def streaks(spark, sf_dir):
    df = double_log(spark, sf_dir)
    one = features.current_streak(df, lag=1, name="streak_lag1", order=PLAYER_ORDER)
    two = features.current_streak(one, lag=2, name="streak_lag2", order=PLAYER_ORDER)
    return tidy(two.select("game_id", "streak_lag1", "streak_lag2"))


_STREAK = f"""
a AS (SELECT *, row_number() OVER (PARTITION BY "Player" ORDER BY ts, game_id) AS rn,
  sum(1 - double_double) OVER (PARTITION BY "Player" ORDER BY ts, game_id ROWS UNBOUNDED PRECEDING) AS island FROM double_log),
b AS (SELECT *, sum(double_double) OVER (PARTITION BY "Player", island ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM a)"""


def opp_form(spark, sf_dir):
    df = features.opponent_form(scores(spark, sf_dir))
    return tidy(df.select("game_id", "opponent_recent_form", "opponent_season_record"))


def opp_strength(spark, sf_dir):
    df = scores(spark, sf_dir)
    a = features.opponent_strength(df, 0.4)
    return tidy(
        a.select(
            "game_id",
            "opponent_def_strength",
            "opponent_off_strength",
            col("opponent_quality_factor").alias("quality_points"),
            (col("opponent_off_strength") * 0.6 + col("opponent_def_strength") * 0.4).alias("quality_total"),
        )
    )


_OPP_STRENGTH = GAMES + f""",
o AS (SELECT game_id, {at_least(3, '"PTS_Opp"', avg('"PTS_Opp"', 10, '"Opp"'), 10, '"Opp"')} AS d,
  {at_least(3, '"PTS"', avg('"PTS"', 10, '"Opp"'), 10, '"Opp"')} AS f FROM g),
r AS (SELECT game_id,
  coalesce(CASE WHEN d IS NOT NULL THEN (rank() OVER (ORDER BY d NULLS LAST) + (count(*) OVER (PARTITION BY d) - 1) / 2.0) / count(d) OVER () END, 0.5) AS ds,
  coalesce(CASE WHEN f IS NOT NULL THEN (rank() OVER (ORDER BY f NULLS LAST) + (count(*) OVER (PARTITION BY f) - 1) / 2.0) / count(f) OVER () END, 0.5) AS fs
  FROM o)"""


def pct_rank(spark, sf_dir):
    df = team_games(spark, sf_dir).select("game_id", "FGA", "FG%")
    df = average_rank_share(df, "FGA", "fga_rank")
    df = average_rank_share(df, "FG%", "fg_pct_rank")
    return tidy(df.select("game_id", "fga_rank", "fg_pct_rank"))


def _rank_sql(x):
    return f'CASE WHEN {x} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER () END'


def def_rating(spark, sf_dir):
    df = features.opponent_defence(double_log(spark, sf_dir), PLAYER_ORDER)
    return tidy(df.select("game_id", "opponent_def_rating"))


def pair_history(spark, sf_dir):
    df = box(spark, sf_dir).withColumn("projection", shooting.direct_projection())
    running = {}
    for name, x in (("vs_opp_projection", "projection"), ("vs_opp_pts_history", "PTS"), ("vs_opp_allowed_history", "PTS_Opp")):
        running |= features.running_mean(name, col(x))
    out = with_history(df, ["Team", "Opp"], ORDER, lambda w: {}, 0, running)
    for name in ("vs_opp_projection", "vs_opp_pts_history", "vs_opp_allowed_history"):
        out = features.expanding_mean(out, name)
    tens = lambda w: {f"_{n}": rolling.rolled(w, col(x), 10) for n, x in (("j", "projection"), ("p", "PTS"), ("a", "PTS_Opp"))}
    out = with_history(out, ["Team"], ORDER, tens, 10)
    edge = F.coalesce(col("vs_opp_projection"), col("_j")) - col("_j")
    total = (
        F.coalesce(col("vs_opp_pts_history"), col("_p"))
        + F.coalesce(col("vs_opp_allowed_history"), col("_a")) - (col("_p") + col("_a"))
    )
    return tidy(
        out.select(
            "game_id", "vs_opp_projection", "vs_opp_pts_history", "vs_opp_allowed_history",
            edge.alias("matchup_edge"), total.alias("matchup_total_edge"),
        )
    )


def last_vs_opponent(spark, sf_dir):
    df = features.last_meeting(scores(spark, sf_dir), ["Team"], "is_win", "last_vs_opp_result", 0.5)
    return tidy(
        df.select(
            "game_id", "last_vs_opp_result",
            rolling.revenge(col("last_vs_opp_result"), 0.04, -0.01).alias("revenge_motivation"),
        )
    )


def last_dd_vs_opponent(spark, sf_dir):
    df = features.last_meeting(double_log(spark, sf_dir), ["Player"], "double_double", "last_dd_vs_opp", 0.1, PLAYER_ORDER)
    return tidy(
        df.select(
            "game_id", "last_dd_vs_opp",
            rolling.revenge(col("last_dd_vs_opp"), 0.05, -0.02).alias("rivalry_motivation"),
        )
    )


def tier_expanding(spark, sf_dir):
    df = box(spark, sf_dir).withColumns(
        {
            "team_direct_scoring_projection": shooting.direct_projection(),
            "team_conversion_efficiency": shooting.conversion_weighted(),
        }
    )
    df = features.with_scoring_tier(df)
    df = with_history(df, ["Team"], ORDER, lambda w: {}, 0, features.tier_running())
    names = [f"team_{t}_efficiency" for t in ("low_scoring", "mid_scoring", "high_scoring")]
    for n in names:
        df = features.expanding_mean(df, n, col("team_conversion_efficiency"))
    return tidy(df.select("game_id", *names))


_TIER_CTE = GAMES + f""",
p AS (SELECT *, {_direct('')} AS x, {_weighted('')} AS e FROM g),
t AS (SELECT *, CASE WHEN y > 0 AND y <= 95 THEN 'low_scoring' WHEN y > 95 AND y <= 115 THEN 'mid_scoring'
   WHEN y > 115 AND y <= 200 THEN 'high_scoring' ELSE 'mid_scoring' END AS tier
   FROM (SELECT *, coalesce(x, (SELECT median(x) FROM p)) AS y FROM p))"""


def _tier_sql(tier, e="e"):
    return f"coalesce(avg(CASE WHEN tier = '{tier}' THEN {e} END) {over(None)}, {e})"


def remaining(spark, sf_dir):
    df = features.games_remaining(scores(spark, sf_dir))
    return tidy(df.select("game_id", "games_remaining", "urgency_factor"))


def n_mean(spark, sf_dir):
    df = last_n_mean(scores(spark, sf_dir), ["Team"], ORDER, ["PTS", "PTS_Opp", "is_win"], 3)
    return tidy(df)


def latest(spark, sf_dir):
    df = latest_row(scores(spark, sf_dir), ["Team"], ORDER)
    return tidy(df.select("Team", "game_id", "Date", "PTS", "PTS_Opp"))


def team_form(spark, sf_dir):
    """Flagship: rest, win rates and averages per game, then each team's latest row, top ten."""

    def build(w):
        return {
            "days_rest": rolling.days_rest(w),
            "rate_5g": rolling.win_rate(w, 5),
            "rate_10g": rolling.win_rate(w, 10),
            "pts_avg_10g": rolling.rolled(w, col("PTS"), 10),
            "allowed_avg_10g": rolling.rolled(w, col("PTS_Opp"), 10),
        }

    df = with_history(scores(spark, sf_dir), ["Team"], ORDER, build, 10)
    names = ["Team", "game_id", "days_rest", "rate_5g", "rate_10g", "pts_avg_10g", "allowed_avg_10g"]
    newest = latest_row(df, ["Team"], ORDER).select(*names)
    return tidy(newest.orderBy(F.desc("rate_10g"), "Team").limit(10))


def win_table(spark, sf_dir):
    df = features.win_features(box(spark, sf_dir))
    return tidy(df.select("game_id", *WIN_OUT))


def points_table(spark, sf_dir):
    df = features.points_features(box(spark, sf_dir))
    return tidy(df.select("game_id", *POINTS_OUT))


def interactions(spark, sf_dir):
    a = features.points_features(box(spark, sf_dir))
    return tidy(a.select("game_id", *INTERACTIONS_OUT))


def total_table(spark, sf_dir):
    df = features.total_features(box(spark, sf_dir))
    return tidy(df.select("game_id", *TOTAL_OUT))


def double_table(spark, sf_dir):
    bio = loading.clean_biometrics(player_bio(spark, sf_dir))
    df = loading.join_biometrics(double_log(spark, sf_dir), bio).withColumns(
        {"is_home": situation.is_home(), "is_started": situation.is_starter()}
    )
    df = features.double_features(df, PLAYER_ORDER)
    return tidy(df.select("game_id", *DOUBLE_OUT))


def versatility(spark, sf_dir):
    build = pick(features.double_history, ["versatility_index", "dd_potential_score", "total_impact_5g"])
    return hist(dd_view, ["Player"], PLAYER_ORDER, build)(spark, sf_dir)


WIN_OUT = [
    "days_rest", "days_into_season", "pts_hist_avg_5g", "pts_hist_avg_10g", "point_diff_hist_avg_10g", "pts_consistency_5g",
    "pts_consistency_10g", "fg_pct_hist_avg_5g", "3p_pct_hist_avg_10g", "team_win_rate_5g", "team_win_rate_10g",
    "home_win_rate_10g", "away_win_rate_10g", "opponent_recent_form", "opponent_season_record", "last_vs_opp_result",
    "revenge_motivation", "home_advantage", "travel_penalty", "road_b2b_penalty", "energy_factor", "altitude_advantage",
    "rest_advantage", "season_fatigue_factor", "weekend_boost",
]
INTERACTIONS_OUT = [
    "team_pace_efficiency_interaction", "team_momentum_context", "team_quality_efficiency_interaction",
    "team_stability_confidence", "team_pressure_quality",
]
POINTS_OUT = [
    "team_mathematical_projection", "team_hybrid_projection", "team_enhanced_projection", "team_contextual_adjustment",
    "team_stability_adjustment", "team_final_projection", "team_final_prediction", "team_prediction_confidence",
]
TOTAL_OUT = [
    "mathematical_total_projection", "hybrid_scoring_projection", "quality_efficiency_interaction", "momentum_context_combo",
    "pace_efficiency_interaction", "final_projection", "final_prediction", "prediction_confidence", "urgency_factor",
    "matchup_total_edge",
]
DOUBLE_OUT = [
    "days_rest", "pts_hist_avg_5g", "trb_hist_avg_10g", "pts_consistency_5g", "dd_rate_5g", "dd_rate_10g", "recent_dd_form",
    "dd_streak", "usage_hist_5g", "pts_per_min_hist_10g", "opponent_def_rating", "last_dd_vs_opp", "rivalry_motivation",
    "versatility_index", "dd_potential_score", "total_impact_5g", "minutes_stability", "starter_boost", "home_advantage",
    "energy_factor", "rest_advantage", "season_progression_factor", "weekend_boost", "height_category", "height_advantage",
    "build_factor",
]

_REST_CASE = "CASE WHEN days_rest = 0 THEN {0} WHEN days_rest = 1 THEN {1} WHEN days_rest >= 3 THEN {3} ELSE {2} END"
_IMPORTANCE = "CASE WHEN days_into_season > 200 THEN {0} WHEN days_into_season > 100 THEN {1} ELSE 1.0 END"

_POINTS_CTE = _TIER_CTE + f""",
o AS (SELECT game_id, {at_least(3, '"PTS_Opp"', avg('"PTS_Opp"', 10, '"Opp"'), 10, '"Opp"')} AS d,
  {at_least(3, '"PTS"', avg('"PTS"', 10, '"Opp"'), 10, '"Opp"')} AS f FROM g),
r AS (SELECT game_id, coalesce({_rank_sql('d')}, 0.5) AS ds, coalesce({_rank_sql('f')}, 0.5) AS fs FROM o),
h AS (SELECT *, coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2) AS days_rest,
  "Date" - (SELECT min("Date") FROM g) AS days_into_season,
  1 / (({at_least(3, 'x', std('x', 10), 10)}) / (({at_least(3, 'x', avg('x', 10), 10)}) + 1e-6) + 0.01) AS stab,
  (x - {avg('x', 10)}) / ({avg('x', 10)} + 1e-6) AS pressure,
  (coalesce({avg('is_win', 5)}, 0.5) - 0.5) * 4 AS conf FROM t),
i AS (SELECT *, fs * 0.4 + ds * 0.6 AS q, ("FGA" + "3PA" * 0.4 + "FTA" * 0.44) * e * 100 AS math,
  {_REST_CASE.format(*fixed.REST_ENERGY['points'])} AS energy, {_REST_CASE.format(*fixed.REST_ADVANTAGE['points'])} AS rest
  FROM h JOIN r USING (game_id)),
k AS (SELECT *, math * 0.6 + ("FGA" + "FTA") * e * 40 AS hybrid, e * (2 - q) AS qe, stab * (conf + 1) AS sc, pressure * (1 - q) AS pq FROM i),
m AS (SELECT *, hybrid * 0.65 + qe * 25 AS enhanced, is_home * 2.8 + rest + 3.0 * {_IMPORTANCE.format(1.06, 1.03)} AS ctx, sc * 2 + pq * 5 AS st FROM k),
n AS (SELECT *, (enhanced + ctx + st) * CASE tier WHEN 'low_scoring' THEN 0.98 WHEN 'high_scoring' THEN 1.02 ELSE 1.0 END AS fin FROM m)"""

_TOTAL_CTE = GAMES + f""",
o AS (SELECT game_id, {at_least(3, '"PTS_Opp"', avg('"PTS_Opp"', 10, '"Opp"'), 10, '"Opp"')} AS d,
  {at_least(3, '"PTS"', avg('"PTS"', 10, '"Opp"'), 10, '"Opp"')} AS f FROM g),
r AS (SELECT game_id, coalesce({_rank_sql('d')}, 0.5) AS ds, coalesce({_rank_sql('f')}, 0.5) AS fs FROM o),
h AS (SELECT *, coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2) AS days_rest,
  "Date" - (SELECT min("Date") FROM g) AS days_into_season, ({_mean3('')} + {_mean3('_Opp')}) / 2 AS e,
  row_number() OVER (PARTITION BY "Team" ORDER BY "Date", game_id) - 1 AS played,
  ({avg('is_win', 5)} - 0.5) * 2 AS conf, {avg('"PTS"', 10)} AS p10, {avg('"PTS_Opp"', 10)} AS a10,
  {avg('"PTS"', None, '"Team", "Opp"')} AS vp, {avg('"PTS_Opp"', None, '"Team", "Opp"')} AS va FROM g),
i AS (SELECT *, fs * 0.6 + ds * 0.4 AS q, ("FGA" + "3PA" * 0.4 + "FTA" * 0.44) * e * 1.1 AS math,
  {_REST_CASE.format(*fixed.REST_ENERGY['total'])} AS energy, {_REST_CASE.format(*fixed.REST_ADVANTAGE['total'])} AS rest
  FROM h JOIN r USING (game_id)),
k AS (SELECT *, math * 0.6 + ("FGA" + "FGA_Opp" + "FTA" + "FTA_Opp") * e * 0.4 AS hybrid, e * q AS qe FROM i),
n AS (SELECT *, hybrid * 0.7 + qe * 20 + is_home * 2.5 + rest + 3.0 * {_IMPORTANCE.format(1.05, 1.02)} AS fin FROM k)"""

_WIN_CTE = RESTED + """, g AS (SELECT *, ("PTS" > "PTS_Opp")::INT AS is_win FROM rested)"""
_LAST = 'coalesce(lag({0}) OVER (PARTITION BY {1}, "Opp" ORDER BY {2}), {3})'

_DD = {
    "pts_hist_avg_5g": pavg('"PTS"', 5), "trb_hist_avg_10g": pavg('"TRB"', 10), "pts_consistency_5g": f"""1 / (coalesce({pstd('"PTS"', 5)}, 1) + 1)""",
    "dd_rate_5g": f"coalesce({pavg('double_double', 5)}, 0.1)", "dd_rate_10g": f"coalesce({pavg('double_double', 10)}, 0.1)",
    "recent_dd_form": f"coalesce({pavg('double_double', 3)}, 0.1)", "usage_hist_5g": f"""{pavg('"FGA"', 5)} + {pavg('"FTA"', 5)} * 0.44""",
    "pts_per_min_hist_10g": f"""coalesce({pavg('"PTS" / ("MP" + 0.1)', 10)}, 0)""",
    "opponent_def_rating": f"""coalesce({at_least(3, '"PTS"', avg('"PTS"', 10, '"Opp"', PO), 10, '"Opp"', PO)}, 105)""",
    "last_dd_vs_opp": _LAST.format("double_double", P, PO, "0.1"),
    "rivalry_motivation": f"CASE {_LAST.format('double_double', P, PO, '0.1')} WHEN 0 THEN 0.05 WHEN 1 THEN -0.02 ELSE 0 END",
    "versatility_index": f"""0.4 * {pavg('"PTS"', 5)} + 0.35 * {pavg('"TRB"', 5)} + 0.25 * {pavg('"AST"', 5)}""",
    "dd_potential_score": f"""{pavg('"PTS"', 5)} + {pavg('"TRB"', 5)} + {pavg('"AST"', 5)} - least({pavg('"PTS"', 5)}, {pavg('"TRB"', 5)}, {pavg('"AST"', 5)})""",
    "total_impact_5g": " + ".join(pavg(f'"{s}"', 5) for s in ("PTS", "TRB", "AST", "STL", "BLK")),
    "minutes_stability": f"""1 / (coalesce({pstd('"MP"', 5)}, 1) / (coalesce({pavg('"MP"', 5)}, 1) + 0.1) + 1)""",
    "starter_boost": """CASE WHEN "GS" = '*' THEN 0.15 ELSE 0 END""", "home_advantage": """CASE WHEN "Away" = '@' THEN 0 ELSE 0.03 END""",
    "energy_factor": _REST_CASE.format(*fixed.REST_ENERGY["double"]), "rest_advantage": _REST_CASE.format(*fixed.REST_ADVANTAGE["double"]),
    "season_progression_factor": """CASE WHEN month("Date") IN (10, 11) THEN -0.05 WHEN month("Date") IN (12, 1, 2) THEN 0.05 WHEN month("Date") IN (3, 4) THEN 0.02 ELSE 0 END""",
    "weekend_boost": """CASE WHEN isodow("Date") >= 6 THEN 0.02 ELSE 0 END""",
    "height_advantage": "(least(greatest((h - 72) / 12 * 0.15, 0), 0.25) + least(greatest((h - 72) / 12 * 0.1, 0), 0.2)) / 2 + 0 * h",
    "build_factor": "CASE WHEN wt / h > 2.8 THEN 0.1 WHEN wt / h < 2.4 THEN -0.05 ELSE 0 END",
}
_DOUBLE_SQL = ask(
    DOUBLE_LOG + "," + _STREAK + "," + BIO + """, q AS (SELECT b.*, coalesce(lag(run, 1) OVER (PARTITION BY b."Player" ORDER BY ts, b.game_id), 0) AS dd_streak,
      "Height_Inches" AS h, "Weight" AS wt, coalesce("Date" - lag("Date") OVER (PARTITION BY b."Player" ORDER BY ts, b.game_id), 2) AS days_rest
      FROM b LEFT JOIN bio ON b."Player" = bio."Player")""",
    "SELECT game_id, days_rest, dd_streak, CASE WHEN h IS NULL THEN 0 WHEN h < 72 THEN 1 WHEN h < 75 THEN 2 WHEN h < 78 THEN 3 WHEN h < 81 THEN 4 ELSE 5 END AS height_category, "
    + ", ".join(f'{e} AS "{n}"' for n, e in _DD.items()) + " FROM q",
    ", ".join(_DD), "game_id, days_rest, dd_streak, height_category",
)

QUERIES = {
    "team_form": Query(
        team_form,
        ask(GAMES + f""", h AS (SELECT *, coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2) AS days_rest,
            coalesce({avg('is_win', 5)}, 0.5) AS rate_5g, coalesce({avg('is_win', 10)}, 0.5) AS rate_10g,
            {avg('"PTS"', 10)} AS pts_avg_10g, {avg('"PTS_Opp"', 10)} AS allowed_avg_10g,
            row_number() OVER (PARTITION BY "Team" ORDER BY "Date" DESC, game_id DESC) AS newest FROM g)""",
            'SELECT * FROM h WHERE newest = 1 ORDER BY rate_10g DESC, "Team" LIMIT 10',
            "rate_5g, rate_10g, pts_avg_10g, allowed_avg_10g", "game_id, days_rest", "Team"),
    ),
    "hist_roll": Query(
        hist(scores, ["Team"], ORDER, b_hist_roll, 5, lambda: features.running_mean("pts_expanding", col("PTS")),
             lambda df: features.expanding_mean(df, "pts_expanding")),
        twin(GAMES, {"pts_mean_5": avg('"PTS"', 5), "pts_std_5": std('"PTS"', 5),
                     "pts_sum_5": at_least(3, '"PTS"', f'sum("PTS") {over(5)}', 5), "pts_var_5": f'var_samp("PTS") {over(5)}',
                     "pts_expanding": avg('"PTS"', None)}, "g"),
    ),
    "hist_increment": Query(
        increments(scores, ["Team"], b_increment, 10, lambda: features.running_mean("pts_expanding", col("PTS")),
                   lambda df: features.expanding_mean(df, "pts_expanding")),
        _from_cut({"pts_mean_5": avg('"PTS"', 5), "pts_std_5": std('"PTS"', 5),
                   "pts_sum_5": at_least(3, '"PTS"', f'sum("PTS") {over(5)}', 5), "pts_var_5": f'var_samp("PTS") {over(5)}',
                   "pts_expanding": avg('"PTS"', None), "team_win_rate_5g": f"coalesce({avg('is_win', 5)}, 0.5)", "team_win_rate_10g": f"coalesce({avg('is_win', 10)}, 0.5)",
                   "home_win_rate_10g": f"least(coalesce({avg('is_win', 10)}, 0.5) + 0.05, 1)",
                   "away_win_rate_10g": f"greatest(coalesce({avg('is_win', 10)}, 0.5) - 0.05, 0)",
                   "team_recent_wins": f"coalesce(sum(is_win) {over(3)}, 1.5)", "team_confidence_factor": f"(coalesce({avg('is_win', 5)}, 0.5) - 0.5) * 4",
                   "confidence_factor": f"({avg('is_win', 5)} - 0.5) * 2"},
                  {"days_rest": """coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2)"""}),
    ),
    "pair_increment": Query(
        increments(scores, ["Team", "Opp"], lambda w: {}, 0, pair_running, lambda df: features.expanding_mean(df, "vs_opp_pts_history")),
        _from_cut({"vs_opp_pts_history": avg('"PTS"', None, '"Team", "Opp"'), "best_vs_opp": 'max("PTS") ' + over(None, '"Team", "Opp"')}),
    ),
    "roll_then_shift": Query(
        hist(box, ["Team"], ORDER, b_roll_then_shift),
        twin(GAMES, {f"{k}_avg_{n}g": avg(e, n) for n in (3, 5, 7, 10) for k, e in _ROLLED.items()}, "g"),
    ),
    "hist_averages": Query(
        hist(box, ["Team"], ORDER, b_hist_averages),
        twin(GAMES, {f"{k}_hist_avg_{n}g": e for n in (5, 10) for k, e in (
            ("pts", avg('"PTS"', n)), ("pts_opp", avg('"PTS_Opp"', n)), ("point_diff", f"""{avg('"PTS"', n)} - {avg('"PTS_Opp"', n)}"""),
            ("fg_pct", avg('"FG%"', n)), ("3p_pct", avg('"3P%"', n)), ("ft_pct", avg('"FT%"', n)))}, "g"),
    ),
    "consistency": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, pick(features.double_history, [
            f"{s}_consistency_5g" for s in ("pts", "trb", "ast", "mp", "usage", "efficiency")])),
        twin(DOUBLE_LOG, {f"{k}_consistency_5g": f"1 / (coalesce({pstd(e, 5)}, 1) + 1)" for k, e in (
            ("pts", '"PTS"'), ("trb", '"TRB"'), ("ast", '"AST"'), ("mp", '"MP"'), ("usage", '"FGA"'),
            ("efficiency", '"PTS" / ("MP" + 0.1)'))}, "double_log"),
    ),
    "minutes_stability": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, pick(features.double_history, ["minutes_stability"])),
        twin(DOUBLE_LOG, {"minutes_stability": f"""1 / (coalesce({pstd('"MP"', 5)}, 1) / (coalesce({pavg('"MP"', 5)}, 1) + 0.1) + 1)"""}, "double_log"),
    ),
    "volatility_cv": Query(
        hist(box, ["Team"], ORDER, lambda w: {
            "pts_volatility": rolling.volatility(w, col("PTS")),
            "offensive_consistency": 1 / (rolling.volatility(w, col("PTS")) + 0.01),
            "team_scoring_stability": rolling.stability_ten(w, shooting.direct_projection())}),
        twin(GAMES, {"pts_volatility": f"""{std('"PTS"', 5)} / ({avg('"PTS"', 5)} + 1)""",
                     "offensive_consistency": f"""1 / ({std('"PTS"', 5)} / ({avg('"PTS"', 5)} + 1) + 0.01)""",
                     "team_scoring_stability": "1 / ((" + at_least(3, _direct(""), std(_direct(""), 10), 10) + ") / ((" +
                     at_least(3, _direct(""), avg(_direct(""), 10), 10) + ") + 1e-6) + 0.01)"}, "g"),
    ),
    "win_rates": Query(
        hist(scores, ["Team"], ORDER, b_win_rates),
        twin(GAMES, {"team_win_rate_5g": f"coalesce({avg('is_win', 5)}, 0.5)", "team_win_rate_10g": f"coalesce({avg('is_win', 10)}, 0.5)",
                     "home_win_rate_10g": f"least(coalesce({avg('is_win', 10)}, 0.5) + 0.05, 1)",
                     "away_win_rate_10g": f"greatest(coalesce({avg('is_win', 10)}, 0.5) - 0.05, 0)",
                     "team_recent_wins": f"coalesce(sum(is_win) {over(3)}, 1.5)",
                     "team_confidence_factor": f"(coalesce({avg('is_win', 5)}, 0.5) - 0.5) * 4",
                     "confidence_factor": f"({avg('is_win', 5)} - 0.5) * 2"}, "g"),
    ),
    "wins_in_last5": Query(
        hist(scores, ["Team"], ORDER, lambda w: {"team_win_streak": rolling.wins_in_last5(w)}),
        twin(GAMES, {"team_win_streak": f"coalesce(sum(is_win) {over(5)}, 2.5)"}, "g"),
    ),
    "dd_rates": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, pick(features.double_history, ["dd_rate_5g", "dd_rate_10g", "recent_dd_form"])),
        twin(DOUBLE_LOG, {"dd_rate_5g": f"coalesce({pavg('double_double', 5)}, 0.1)", "dd_rate_10g": f"coalesce({pavg('double_double', 10)}, 0.1)",
                          "recent_dd_form": f"coalesce({pavg('double_double', 3)}, 0.1)"}, "double_log"),
    ),
    "weighted_rate": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, lambda w: {"weighted": rolling.weighted_rate(w, col("double_double"))}),
        ask(DOUBLE_LOG + "," + shifted("double_log", P, PO, "double_double"), weighted_sql(P, PO), "weighted", "game_id"),
    ),
    "rate_momentum": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, lambda w: {"momentum": rolling.rate_momentum(w, col("double_double"))}),
        ask(DOUBLE_LOG + "," + shifted("double_log", P, PO, "double_double"), momentum_sql(P, PO), "momentum", "game_id"),
    ),
    "stat_momentum": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, pick(features.double_history, ["pts_momentum_6g", "trb_momentum_6g", "ast_momentum_6g"])),
        twin(DOUBLE_LOG, {f"{s.lower()}_momentum_6g": f"""coalesce({pavg(f'"{s}"', 3)}, 0) - coalesce(avg("{s}")
            OVER (PARTITION BY "Player" ORDER BY ts, game_id ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0)""" for s in ("PTS", "TRB", "AST")}, "double_log"),
    ),
    "trend_short_long": Query(
        hist(box, ["Team"], ORDER, b_trends),
        twin(GAMES, {"pts_trend_short": f"""{avg('"PTS"', 3)} - {avg('"PTS"', 10)}""",
                     "projection_trend": f"({avg(_direct(''), 3)} - {avg(_direct(''), 10)}) / ({avg(_direct(''), 10)} + 1)",
                     "scoring_momentum": f"""({avg('"PTS"', 3)} - {avg('"PTS"', 10)}) / {avg('"PTS"', 10)}""",
                     "defensive_momentum": f"""({avg('"PTS_Opp"', 10)} - {avg('"PTS_Opp"', 3)}) / {avg('"PTS_Opp"', 10)}"""}, "g"),
    ),
    "confidence_momentum": Query(
        hist(scores, ["Team"], ORDER, lambda w: {"team_confidence_momentum": rolling.confidence_momentum(w)}),
        ask(GAMES + f", h AS (SELECT *, coalesce({avg('is_win', 5)}, 0.5) AS r FROM g)",
            """SELECT game_id, coalesce(lag(r, 1) OVER w - lag(r, 2) OVER w, 0) AS team_confidence_momentum FROM h
            WINDOW w AS (PARTITION BY "Team" ORDER BY "Date", game_id)""", "team_confidence_momentum", "game_id"),
    ),
    "above_history": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, pick(features.double_history, [
            f"{s}_above_historical_{n}g" for n in (5, 10) for s in ("pts", "trb", "ast")])),
        ask(DOUBLE_LOG, "SELECT game_id, " + ", ".join(f"""("{s}" > coalesce({pavg(f'"{s}"', n)}, 0))::INT AS {s.lower()}_above_historical_{n}g"""
            for n in (5, 10) for s in ("PTS", "TRB", "AST")) + " FROM double_log", "",
            "game_id, " + ", ".join(f"{s}_above_historical_{n}g" for n in (5, 10) for s in ("pts", "trb", "ast"))),
    ),
    "scoring_pressure": Query(
        hist(box, ["Team"], ORDER, lambda w: {"team_scoring_pressure": rolling.scoring_pressure(w, shooting.direct_projection())}),
        twin(GAMES, {"team_scoring_pressure": f"({_direct('')} - {avg(_direct(''), 10)}) / ({avg(_direct(''), 10)} + 1e-6)"}, "g"),
    ),
    "days_rest": Query(
        hist(scores, ["Team"], ORDER, lambda w: {"days_rest": rolling.days_rest(w)}, 1),
        ask(RESTED, "SELECT game_id, days_rest FROM rested", "", "game_id, days_rest"),
    ),
    "games_remaining": Query(
        remaining,
        ask(GAMES, """SELECT game_id, 83 - row_number() OVER (PARTITION BY "Team" ORDER BY "Date", game_id) AS games_remaining,
            CASE WHEN 83 - row_number() OVER (PARTITION BY "Team" ORDER BY "Date", game_id) <= 10 THEN 1.5 ELSE 1 END AS urgency_factor FROM g""",
            "urgency_factor", "game_id, games_remaining"),
    ),
    "dd_streak": Query(
        streaks,
        ask(DOUBLE_LOG + "," + _STREAK, """SELECT game_id, coalesce(lag(run, 1) OVER w, 0) AS streak_lag1, coalesce(lag(run, 2) OVER w, 0) AS streak_lag2
            FROM b WINDOW w AS (PARTITION BY "Player" ORDER BY rn)""", "", "game_id, streak_lag1, streak_lag2"),
    ),
    "opponent_form": Query(
        opp_form,
        twin(GAMES, {"opponent_recent_form": f"""1 - coalesce({at_least(2, 'is_win', avg('is_win', 5, '"Opp"'), 5, '"Opp"')}, 0.5)""",
                     "opponent_season_record": f"""1 - coalesce({avg('is_win', None, '"Opp"')}, 0.5)"""}, "g"),
    ),
    "opponent_strength": Query(
        opp_strength,
        ask(_OPP_STRENGTH, """SELECT game_id, ds AS opponent_def_strength, fs AS opponent_off_strength,
            fs * 0.4 + ds * 0.6 AS quality_points, fs * 0.6 + ds * 0.4 AS quality_total FROM r""",
            "opponent_def_strength, opponent_off_strength, quality_points, quality_total", "game_id"),
    ),
    "pct_rank_avg": Query(
        pct_rank, twin(TEAM_GAMES, {"fga_rank": _rank_sql('"FGA"'), "fg_pct_rank": _rank_sql('"FG%"')}, "team_games"),
    ),
    "opponent_def_rating": Query(
        def_rating,
        twin(DOUBLE_LOG, {"opponent_def_rating": f"""coalesce({at_least(3, '"PTS"', avg('"PTS"', 10, '"Opp"', PO), 10, '"Opp"', PO)}, 105)"""}, "double_log"),
    ),
    "pair_history": Query(
        pair_history,
        ask(GAMES + f""", h AS (SELECT *, {_direct('')} AS j FROM g), i AS (SELECT *, {avg('j', None, '"Team", "Opp"')} AS vj,
            {avg('"PTS"', None, '"Team", "Opp"')} AS vp, {avg('"PTS_Opp"', None, '"Team", "Opp"')} AS va,
            {avg('j', 10)} AS j10, {avg('"PTS"', 10)} AS p10, {avg('"PTS_Opp"', 10)} AS a10 FROM h)""",
            """SELECT game_id, vj AS vs_opp_projection, vp AS vs_opp_pts_history, va AS vs_opp_allowed_history,
            coalesce(vj, j10) - j10 AS matchup_edge, coalesce(vp, p10) + coalesce(va, a10) - (p10 + a10) AS matchup_total_edge FROM i""",
            "vs_opp_projection, vs_opp_pts_history, vs_opp_allowed_history, matchup_edge, matchup_total_edge", "game_id"),
    ),
    "last_vs_opponent": Query(
        last_vs_opponent,
        ask(GAMES + f""", h AS (SELECT game_id, {_LAST.format('is_win', '"Team"', '"Date", game_id', '0.5')} AS r FROM g)""",
            "SELECT game_id, r AS last_vs_opp_result, CASE r WHEN 0 THEN 0.04 WHEN 1 THEN -0.01 ELSE 0 END AS revenge_motivation FROM h",
            "last_vs_opp_result, revenge_motivation", "game_id"),
    ),
    "last_dd_vs_opponent": Query(
        last_dd_vs_opponent,
        ask(DOUBLE_LOG + f""", h AS (SELECT game_id, {_LAST.format('double_double', P, PO, '0.1')} AS r FROM double_log)""",
            "SELECT game_id, r AS last_dd_vs_opp, CASE r WHEN 0 THEN 0.05 WHEN 1 THEN -0.02 ELSE 0 END AS rivalry_motivation FROM h",
            "last_dd_vs_opp, rivalry_motivation", "game_id"),
    ),
    "tier_expanding": Query(
        tier_expanding,
        twin(_TIER_CTE, {f"team_{t}_efficiency": _tier_sql(t) for t in ("low_scoring", "mid_scoring", "high_scoring")}, "t"),
    ),
    "usage_history": Query(
        hist(dd_view, ["Player"], PLAYER_ORDER, pick(features.double_history, [
            f"{k}_{n}g" for n in (5, 10) for k in ("usage_hist", "pts_per_min_hist")])),
        twin(DOUBLE_LOG, {f"{k}_{n}g": e for n in (5, 10) for k, e in (
            ("usage_hist", f"""{pavg('"FGA"', n)} + {pavg('"FTA"', n)} * 0.44"""),
            ("pts_per_min_hist", f"""coalesce({pavg('"PTS" / ("MP" + 0.1)', n)}, 0)"""))}, "double_log"),
    ),
    "versatility_dd_potential": Query(
        versatility,
        ask(DOUBLE_LOG + f""", h AS (SELECT game_id, {pavg('"PTS"', 5)} AS p, {pavg('"TRB"', 5)} AS t, {pavg('"AST"', 5)} AS a,
            coalesce({pavg('"STL"', 5)}, 0) AS s, coalesce({pavg('"BLK"', 5)}, 0) AS b FROM double_log)""",
            """SELECT game_id, 0.4 * p + 0.35 * t + 0.25 * a AS versatility_index, greatest(p + t, p + a, t + a) AS dd_potential_score,
            p + t + a + s + b AS total_impact_5g FROM h""", "versatility_index, dd_potential_score, total_impact_5g", "game_id"),
    ),
    "last_n_mean": Query(
        n_mean,
        ask(GAMES + """, h AS (SELECT *, row_number() OVER (PARTITION BY "Team" ORDER BY "Date" DESC, game_id DESC) AS k FROM g)""",
            'SELECT "Team", avg("PTS") AS "PTS", avg("PTS_Opp") AS "PTS_Opp", avg(is_win) AS is_win FROM h WHERE k <= 3 GROUP BY "Team"',
            "PTS, PTS_Opp, is_win", "", "Team"),
    ),
    "latest_row": Query(
        latest,
        ask(GAMES + """, h AS (SELECT *, row_number() OVER (PARTITION BY "Team" ORDER BY "Date" DESC, game_id DESC) AS k FROM g)""",
            'SELECT * FROM h WHERE k = 1', "PTS, PTS_Opp", "game_id", "Team, Date"),
    ),
    "features_win": Query(
        win_table,
        twin(_WIN_CTE, {
            "days_rest": "days_rest", "days_into_season": "days_into_season",
            "pts_hist_avg_5g": avg('"PTS"', 5), "pts_hist_avg_10g": avg('"PTS"', 10),
            "point_diff_hist_avg_10g": f"""{avg('"PTS"', 10)} - {avg('"PTS_Opp"', 10)}""",
            "pts_consistency_5g": f"""1 / (coalesce({std('"PTS"', 5)}, 1) + 1)""", "pts_consistency_10g": f"""1 / (coalesce({std('"PTS"', 10)}, 1) + 1)""",
            "fg_pct_hist_avg_5g": avg('"FG%"', 5), "3p_pct_hist_avg_10g": avg('"3P%"', 10),
            "team_win_rate_5g": f"coalesce({avg('is_win', 5)}, 0.5)", "team_win_rate_10g": f"coalesce({avg('is_win', 10)}, 0.5)",
            "home_win_rate_10g": f"least(coalesce({avg('is_win', 10)}, 0.5) + 0.05, 1)", "away_win_rate_10g": f"greatest(coalesce({avg('is_win', 10)}, 0.5) - 0.05, 0)",
            "opponent_recent_form": f"""1 - coalesce({at_least(2, 'is_win', avg('is_win', 5, '"Opp"'), 5, '"Opp"')}, 0.5)""",
            "opponent_season_record": f"""1 - coalesce({avg('is_win', None, '"Opp"')}, 0.5)""",
            "last_vs_opp_result": _LAST.format('is_win', '"Team"', '"Date", game_id', '0.5'),
            "revenge_motivation": f"""CASE {_LAST.format('is_win', '"Team"', '"Date", game_id', '0.5')} WHEN 0 THEN 0.04 WHEN 1 THEN -0.01 ELSE 0 END""",
            "home_advantage": "is_home * 0.06", "travel_penalty": "(1 - is_home) * -0.02",
            "road_b2b_penalty": "CASE WHEN is_home = 0 AND days_rest <= 1 THEN -0.04 ELSE 0 END",
            "energy_factor": _REST_CASE.format(*fixed.REST_ENERGY["win"]), "altitude_advantage": f"CASE WHEN {_ALT} THEN 0.025 ELSE 0 END",
            "rest_advantage": _REST_CASE.format(*fixed.REST_ADVANTAGE["win"]),
            "season_fatigue_factor": "CASE WHEN month <= 3 THEN -0.015 WHEN month >= 11 THEN 0.01 ELSE 0 END", "weekend_boost": "is_weekend * 0.01",
        }, "g").replace('round("days_rest"::DOUBLE + 2e-11::DOUBLE, 6) + 0.0::DOUBLE', '"days_rest"::BIGINT').replace(
            'round("days_into_season"::DOUBLE + 2e-11::DOUBLE, 6) + 0.0::DOUBLE', '"days_into_season"::BIGINT'),
    ),
    "team_projection": Query(
        points_table,
        twin(_POINTS_CTE, {"team_mathematical_projection": "math", "team_hybrid_projection": "hybrid", "team_enhanced_projection": "enhanced",
                           "team_contextual_adjustment": "ctx", "team_stability_adjustment": "st", "team_final_projection": "fin",
                           "team_final_prediction": "CASE WHEN fin IS NOT NULL THEN least(greatest(fin, 85), 150) END",
                           "team_prediction_confidence": "(2 - q) * 0.4 + e * 0.3 + stab * 0.3"}, "n"),
    ),
    "interactions": Query(
        interactions,
        twin(_POINTS_CTE, {"team_pace_efficiency_interaction": '("FGA" + "FTA" * 0.44) * e', "team_momentum_context": "conf * energy",
                           "team_quality_efficiency_interaction": "qe", "team_stability_confidence": "sc", "team_pressure_quality": "pq"}, "n"),
    ),
    "total_projection": Query(
        total_table,
        twin(_TOTAL_CTE, {"mathematical_total_projection": "math", "hybrid_scoring_projection": "hybrid", "quality_efficiency_interaction": "qe",
                          "momentum_context_combo": "conf * energy",
                          "pace_efficiency_interaction": '("FGA" - "FG" + "FTA" * 0.44 + "FG" * 0.56) * "FG%"', "final_projection": "fin",
                          "final_prediction": "CASE WHEN fin IS NOT NULL THEN least(greatest(fin, 185), 275) END",
                          "prediction_confidence": "q * 0.5 + e * 0.5", "urgency_factor": "CASE WHEN 82 - played <= 10 THEN 1.5 ELSE 1 END",
                          "matchup_total_edge": "coalesce(vp, p10) + coalesce(va, a10) - (p10 + a10)"}, "n"),
    ),
    "features_double_double": Query(double_table, _DOUBLE_SQL),
}
