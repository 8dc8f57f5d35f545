"""Lines, prices, market decisions, and odds sources."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark import fixed, views
from courtspark.functions.scalars import col
from courtspark.operators import lines, markets
from courtspark.registry.entry import Query, ask, tidy
from courtspark.sources import odds as odds_source
from courtspark.sources.reports import read_report, write_report, write_value_bets
from courtspark.sources.staging import stage_lines, staging_folder
from courtspark.views import EVENT_RESULTS, PLAYER_GAMES, PRICES, event_results, odds_documents, player_games, prices

ORDER = ["ts", "game_id"]
CONFIDENT = 0.5
TARGETS = ("PTS", "TRB", "AST", "3P")


def flags(spark, sf_dir):
    df = player_games(spark, sf_dir)
    out = [lines.over_line_flags(df.select("game_id", t), t).select("game_id", F.lit(t).alias("target"), "line", "over") for t in TARGETS]
    return tidy(reduce(DataFrame.unionByName, out))


def nearest(spark, sf_dir):
    df = player_games(spark, sf_dir).select("game_id", "PTS")
    made = lines.nearest_line(col("PTS"), lines.lines_of("PTS"))
    return tidy(df.select("game_id", *[c.alias(n) for n, c in made.items()]))


def all_confidence(spark, sf_dir):
    return lines.line_confidence(player_games(spark, sf_dir), TARGETS, order=ORDER)


def confidence(spark, sf_dir):
    keep = ["target", "line", "samples", "over_share", "under_share", "confidence", "prediction", "volatility"]
    return tidy(all_confidence(spark, sf_dir).select(*keep))


def adjusted(spark, sf_dir):
    df = lines.confident_lines(all_confidence(spark, sf_dir), CONFIDENT)
    return tidy(df.select("target", "line", "prediction", "adjusted_confidence"))


def windows(spark, sf_dir):
    df = lines.recent_windows(player_games(spark, sf_dir), lines.line_pairs(TARGETS), ORDER)
    return tidy(df)


def by_opponent(spark, sf_dir):
    df = lines.line_by_opponent(player_games(spark, sf_dir), TARGETS)
    return tidy(df.select("Opp", "target", "line", "samples", "consistency"))


def per_player(spark, sf_dir):
    return tidy(lines.player_vs_lines(player_games(spark, sf_dir), TARGETS, at_least=0.8))


def per_player_summary(spark, sf_dir):
    df = player_games(spark, sf_dir)
    made = [lines.player_line_summary(df, lines.player_vs_lines(df, t, at_least=0.8)).withColumn("target", F.lit(t)) for t in TARGETS]
    return tidy(reduce(DataFrame.unionByName, made))


def semijoin(spark, sf_dir):
    chosen = lines.confident_lines(all_confidence(spark, sf_dir), 0.8)
    df = markets.lines_semijoin(prices(spark, sf_dir), chosen)
    return tidy(df.groupBy("target", "line", "side").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")))


def edges_of(spark, sf_dir):
    chosen = lines.confident_lines(all_confidence(spark, sf_dir), CONFIDENT)
    return markets.market_edges(prices(spark, sf_dir), chosen, lookback_days=None)


def edges(spark, sf_dir):
    df = edges_of(spark, sf_dir)
    keep = ["target", "line", "bookmaker", "prediction", "samples", "market_odds", "market_probability", "confidence", "edge", "expected_value", "expected_roi"]
    return tidy(df.select(*keep))


def best_lines(spark, sf_dir):
    return tidy(markets.best_per_line(edges_of(spark, sf_dir)))


def value_bets(spark, sf_dir):
    df = markets.best_value_bets(edges_of(spark, sf_dir), CONFIDENT)
    return tidy(df.select("target", "line", "bookmaker", "prediction", "confidence", "edge", "expected_roi"))


def strategy_of(spark, sf_dir):
    chosen = lines.confident_lines(all_confidence(spark, sf_dir), CONFIDENT)
    return markets.betting_strategy(chosen, prices(spark, sf_dir))


def strategy(spark, sf_dir):
    keep = ["target", "line", "prediction", "adjusted_confidence", "market_probability", "edge", "kelly_fraction", "verdict"]
    return tidy(strategy_of(spark, sf_dir).select(*keep))


def portfolio(spark, sf_dir):
    return tidy(markets.kelly_portfolio(markets.kelly_bets(strategy_of(spark, sf_dir))))


def portfolio_bets(spark, sf_dir):
    df = markets.kelly_bets(strategy_of(spark, sf_dir))
    return tidy(df.select("target", "line", "prediction", "edge", "kelly_fraction", "adjusted_kelly", "ev"))


def arbitrage(spark, sf_dir):
    return tidy(markets.arbitrage_pairs(prices(spark, sf_dir), lookback_days=None))


def movement(spark, sf_dir):
    df = markets.line_movement(prices(spark, sf_dir), event_results(spark, sf_dir))
    return tidy(df)


def movement_results(spark, sf_dir):
    df = markets.line_movement(prices(spark, sf_dir), event_results(spark, sf_dir))
    return tidy(markets.movement_by_result(df, 0.01))


def pipeline(spark, sf_dir):
    """The chain for every target: confident lines, their best edge, and the verdict."""
    made = []
    for target in TARGETS:
        parts = markets.market_pipeline(player_games(spark, sf_dir), prices(spark, sf_dir), target, CONFIDENT, ORDER, lookback_days=None)
        best = markets.best_per_line(parts["edges"]).select("line", "best_bookmaker", "best_odds", "best_edge", "expected_roi")
        out = parts["strategy"].select("target", "line", "prediction", "adjusted_confidence", "edge", "verdict")
        books = parts["bookmakers"].select("line", "juice")
        made.append(out.join(best, "line", "left").join(books, "line", "left"))
    return tidy(reduce(DataFrame.unionByName, made))


def stats(spark, sf_dir):
    return tidy(markets.bookmaker_stats(prices(spark, sf_dir)))


def best_books(spark, sf_dir):
    return tidy(markets.best_bookmaker(markets.bookmaker_stats(prices(spark, sf_dir))))


def implied(spark, sf_dir):
    return tidy(markets.implied_probability(prices(spark, sf_dir)))


def props_of(spark, sf_dir, **filters):
    return markets.explode_props(odds_source.parse_snapshots(odds_documents(spark, sf_dir)), **filters)


def props(spark, sf_dir):
    df = props_of(spark, sf_dir)
    return tidy(df.groupBy("player", "team", "prop_type", "line", "bookmaker", "game_time").agg(
        F.count("*").alias("n"), F.sum("over_price").alias("over_sum"), F.sum("under_price").alias("under_sum")))


def props_filtered(spark, sf_dir):
    df = props_of(spark, sf_dir, player="player 1", team="b", prop="Points")
    return tidy(df.groupBy("player", "team", "prop_type").agg(F.count("*").alias("n")))


def prop_types(spark, sf_dir):
    df = markets.long_props(props_of(spark, sf_dir))
    return tidy(df.groupBy("target", "side").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")))


WIDE_NAMES = [f"{t}_{s}_{x:g}_odds_bm{b}" for t, row in zip(views.PRICE_TARGETS, views.PRICE_LINES, strict=True)
              for x in row for s in ("over", "under") for b in range(5)]
SHOWN = ("PTS_over_10_odds_bm0", "PTS_under_20_odds_bm3", "3P_over_1_odds_bm4")


def game_props(spark, sf_dir):
    long = markets.long_props(props_of(spark, sf_dir)).withColumnRenamed("player", "Player")
    games = player_games(spark, sf_dir).select("game_id", F.concat(F.lit("Player "), "Player").alias("Player"))
    df = markets.odds_columns(markets.props_to_games(games, long), SHOWN)
    return tidy(df.select("game_id", F.coalesce(F.size("odds"), F.lit(0)).alias("quotes"), *[col(c) for c in SHOWN]))


def merge(spark, sf_dir):
    """Prices joined to games of the same player and day."""
    long = prices(spark, sf_dir).select(F.col("event_id").alias("Player"), col("snapshot").cast("date").alias("Date"),
        "target", "line", "side", "bookmaker", "price", F.struct("snapshot", "quote_id").alias("game_time"))
    games = player_games(spark, sf_dir).select("game_id", "Player", col("Date").cast("date").alias("Date"))
    df = markets.odds_columns(markets.props_to_games(games, long, ["Player", "Date"]), SHOWN)
    return tidy(df.select("game_id", F.coalesce(F.size("odds"), F.lit(0)).alias("quotes"), *[col(c) for c in SHOWN]))


def wide(spark, sf_dir):
    df = markets.odds_wide(prices(spark, sf_dir), ["event_id"], WIDE_NAMES, ["snapshot", "quote_id"])
    return tidy(df)


def long_again(spark, sf_dir):
    df = markets.odds_wide(prices(spark, sf_dir), ["event_id"], WIDE_NAMES, ["snapshot", "quote_id"])
    return tidy(markets.odds_long(df, ["event_id"]))


def snapshot_files(spark, sf_dir):
    """Documents written as JSON lines, then read back with the nested schema."""
    folder = stage_lines(odds_documents(spark, sf_dir), "snapshots")
    df = odds_source.read_snapshots(spark, folder)
    return tidy(df.groupBy("last_update", "success").agg(F.count("*").alias("documents"), F.sum(F.size("data")).alias("games")))


def rejected(spark, sf_dir):
    """Documents of March cut off, those of April without games: kept apart with the reason, the others read."""
    month = F.regexp_extract("value", r'"last_update":"\d{4}-(\d\d)', 1)
    cut = F.when(month == "03", F.expr("left(value, length(value) - 30)")).when(month == "04", F.replace("value", F.lit('"data"'), F.lit('"date"'))).otherwise(col("value"))
    folder = stage_lines(odds_documents(spark, sf_dir).select(cut.alias("value")), "snapshots")
    kept = odds_source.read_snapshots(spark, folder, f"{folder}-rejected")
    apart = spark.read.parquet(f"{folder}-rejected").groupBy("reason").agg(F.count("*").alias("documents"))
    return tidy(apart.unionByName(kept.agg(F.lit("none").alias("reason"), F.count("*").alias("documents"))))


TRACKED = ["event_id", "target", "line", "side", "bookmaker"]


def tracks(spark, sf_dir):
    df = prices(spark, sf_dir).withColumn("polled", col("snapshot").cast("timestamp"))
    out = markets.line_tracks(df, TRACKED, expiry_hours=24 * 7)
    days = {f"{c}_poll": col(f"{c}_poll").cast("date") for c in ("first", "last")}
    return tidy(out.withColumns(days))


def fresh(spark, sf_dir):
    docs = odds_source.parse_snapshots(odds_documents(spark, sf_dir))
    df = odds_source.fresh_snapshots(docs, "1998-06-15 06:00:00", 24 * 365)
    return tidy(df.groupBy("last_update").agg(F.count("*").alias("n")))


def odds_files(spark, sf_dir):
    """Prices written as CSV and as JSON, read back by extension."""
    folder = f"{staging_folder(spark)}/odds-{uuid.uuid4().hex}"
    df = prices(spark, sf_dir)  # one record per line; documents over several lines are in the tests
    df.where(col("side") == "over").write.option("header", True).csv(f"{folder}.csv")
    df.where(col("side") == "under").write.json(f"{folder}.json")
    both = odds_source.read_odds_file(spark, f"{folder}.csv").unionByName(odds_source.read_odds_file(spark, f"{folder}.json"))
    return tidy(both.groupBy("target", "line", "side", "bookmaker").agg(
        F.count("*").alias("n"), F.sum("price").alias("price_sum"), F.min("snapshot").alias("first"), F.max("snapshot").alias("last")))


def report(spark, sf_dir):
    """Top value bets written as CSV, then read back."""
    path = f"{staging_folder(spark)}/bets-{uuid.uuid4().hex}"
    write_value_bets(edges_of(spark, sf_dir), path, min_confidence=CONFIDENT)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return tidy(back.select("target", "line", "bookmaker", "prediction", "confidence", "edge", "expected_roi"))


def json_report(spark, sf_dir):
    path = f"{staging_folder(spark)}/report-{uuid.uuid4().hex}"
    df = markets.best_bookmaker(markets.bookmaker_stats(prices(spark, sf_dir)))
    write_report(df, path)
    return tidy(read_report(spark, path, df.schema))


# --- SQL pieces ---------------------------------------------------------------------------
_LINES = ", ".join(f"('{t}', {x}::DOUBLE)" for t in TARGETS for x in fixed.TARGET_LINES[t])
_VALUE = """CASE target WHEN 'PTS' THEN "PTS" WHEN 'TRB' THEN "TRB" WHEN 'AST' THEN "AST" ELSE "3P" END"""
CONF = PLAYER_GAMES + f""",
ln AS (SELECT * FROM (VALUES {_LINES}) AS t(target, line)),
rec AS (SELECT *, row_number() OVER (ORDER BY ts DESC, game_id DESC) AS k FROM player_games WHERE "Date" >= (SELECT max("Date") FROM player_games) - INTERVAL 60 DAY),
ov AS (SELECT target, line, k, "Player", coalesce(({_VALUE} > line)::INT, 0) AS o FROM rec, ln),
win AS (SELECT target, line, """ + ", ".join(f"greatest(avg(o) FILTER (k <= {w}), 1 - avg(o) FILTER (k <= {w})) AS window_{w}" for w in fixed.RECENT_WINDOWS) + """ FROM ov GROUP BY 1, 2),
sh AS (SELECT target, line, count(*) AS samples, avg(o) AS over_share, 1 - avg(o) AS under_share, greatest(avg(o), 1 - avg(o)) AS confidence,
  CASE WHEN avg(o) >= 0.5 THEN 'over' ELSE 'under' END AS prediction, stddev_samp(o) AS volatility FROM ov GROUP BY 1, 2),
conf AS (SELECT *, 0.7 * confidence * (CASE WHEN volatility > 0.3 THEN 1 - (volatility - 0.3) ELSE 1 END) +
  0.3 * (window_3 / 3 + window_5 / 5 + window_10 / 10 + window_20 / 20) / (1.0 / 3 + 1.0 / 5 + 1.0 / 10 + 1.0 / 20) AS adjusted_confidence FROM sh JOIN win USING (target, line)),
chosen AS (SELECT * FROM conf WHERE adjusted_confidence >= 0.5)"""
_IMPLIED = """imp AS (SELECT target, line, side, bookmaker, count(*) AS samples, avg(price) AS market_odds, avg(1 / price) AS market_probability
  FROM prices GROUP BY ALL HAVING avg(price) BETWEEN 1.1 AND 10)"""
MARKET = CONF + "," + PRICES + "," + _IMPLIED + """,
edges AS (SELECT i.target, i.line, bookmaker, prediction, i.samples, market_odds, market_probability, adjusted_confidence AS confidence,
  adjusted_confidence - market_probability AS edge, market_odds * adjusted_confidence AS expected_value, (market_odds * adjusted_confidence - 1) * 100 AS expected_roi
  FROM imp i JOIN chosen c ON i.target = c.target AND i.line = c.line AND i.side = c.prediction
  WHERE adjusted_confidence - market_probability >= 0.04 AND market_odds >= 1.8),
mp AS (SELECT target, line, avg(market_probability) FILTER (side = 'over') AS po, avg(market_probability) FILTER (side = 'under') AS pu FROM imp GROUP BY 1, 2),
st0 AS (SELECT c.target, c.line, prediction, adjusted_confidence, coalesce(CASE WHEN prediction = 'over' THEN po ELSE 1 - pu END, 0.5) AS market_probability
  FROM chosen c LEFT JOIN mp ON c.target = mp.target AND c.line = mp.line),
st1 AS (SELECT *, CASE WHEN prediction = 'over' THEN adjusted_confidence - market_probability ELSE adjusted_confidence - (1 - market_probability) END AS edge FROM st0),
strat AS (SELECT *, CASE WHEN edge > 0 THEN least(adjusted_confidence * 2 - 1, 0.02) ELSE 0 END AS kelly_fraction,
  CASE WHEN edge >= 0.05 THEN 'value' WHEN edge < -0.05 THEN 'avoid' ELSE 'none' END AS verdict FROM st1),
bets AS (SELECT *, kelly_fraction * least(1.0, 0.25 / sum(kelly_fraction) OVER ()) AS adjusted_kelly, (1 + edge) * 0.5 AS ev
  FROM strat WHERE verdict = 'value' AND edge >= 0.04 AND kelly_fraction > 0),
bestl AS (SELECT target, line, prediction, confidence, first(bookmaker ORDER BY expected_value DESC, bookmaker) AS best_bookmaker,
  first(market_odds ORDER BY expected_value DESC, bookmaker) AS best_odds, first(edge ORDER BY expected_value DESC, bookmaker) AS best_edge,
  max(expected_roi) AS expected_roi, count(*) AS bookmakers FROM edges GROUP BY 1, 2, 3, 4)"""
_STATS = PRICES + """, stats AS (SELECT target, line, side, bookmaker, count(price) AS "count", avg(price) AS mean, min(price) AS min, max(price) AS max,
  stddev_samp(price) AS std, 1 / avg(price) AS implied_prob FROM prices GROUP BY 1, 2, 3, 4 HAVING count(price) >= 5),
books AS (SELECT target, line, count(*) FILTER (side = 'over') AS over_bookmakers, count(*) FILTER (side = 'under') AS under_bookmakers,
  first(bookmaker ORDER BY mean DESC, bookmaker) FILTER (side = 'over') AS best_over_bookmaker, coalesce(max(mean) FILTER (side = 'over'), 0) AS best_over_odds,
  first(bookmaker ORDER BY mean DESC, bookmaker) FILTER (side = 'under') AS best_under_bookmaker, coalesce(max(mean) FILTER (side = 'under'), 0) AS best_under_odds,
  avg(1 / mean) FILTER (side = 'over') + avg(1 / mean) FILTER (side = 'under') AS juice FROM stats GROUP BY 1, 2)"""
_LATEST = PRICES + """, lat AS (SELECT event_id, target, line, side, bookmaker, max_by(price, (snapshot, quote_id)) AS price FROM prices GROUP BY 1, 2, 3, 4, 5)"""
_MOVE = PRICES + "," + EVENT_RESULTS + """, mv AS (SELECT event_id, target, line, side, bookmaker, count(*) AS quotes, min_by(price, (snapshot, quote_id)) AS initial_odds,
  max_by(price, (snapshot, quote_id)) AS final_odds, max(snapshot) - min(snapshot) AS days_tracked FROM prices GROUP BY 1, 2, 3, 4, 5
  HAVING count(*) > 1 AND min(price) < max(price)),
mr AS (SELECT mv.*, (final_odds - initial_odds) / initial_odds AS pct_change, CASE WHEN actual > line THEN 'over' WHEN actual <= line THEN 'under' END AS result
  FROM mv LEFT JOIN results USING (event_id))"""
_WORD = "CASE target WHEN 'PTS' THEN 'points' WHEN 'TRB' THEN 'rebounds' WHEN 'AST' THEN 'assists' ELSE 'threes' END"
_NAME = "target || '_' || side || '_' || line::BIGINT || '_odds_' || bookmaker"


def _player_ctes(t: str) -> str:
    """pl: players of the last 60 days with the share above every line; ul: their sure lines."""
    k, lines_ = TARGETS.index(t), fixed.TARGET_LINES[t]
    shares = ", ".join(f'avg(("{t}" > {x})::INT) AS r{i}' for i, x in enumerate(lines_))
    rows = " UNION ALL ".join(f"SELECT *, {x}::DOUBLE AS line, r{i} AS over_rate FROM pl{k}" for i, x in enumerate(lines_))
    return f"""
pl{k} AS (SELECT '{t}' AS target, "Player", count(*) AS num_games, avg("{t}") AS avg_value, stddev_samp("{t}") AS std_value,
  min("{t}") AS min_value, max("{t}") AS max_value, {shares} FROM player_games
  WHERE "Date" >= (SELECT max("Date") FROM player_games) - INTERVAL 60 DAY GROUP BY 2),
ul{k} AS (SELECT target, "Player", num_games, avg_value, std_value, min_value, max_value, line, over_rate,
  greatest(over_rate, 1 - over_rate) AS confidence, CASE WHEN over_rate >= 0.5 THEN 'over' ELSE 'under' END AS prediction
  FROM ({rows}) WHERE num_games >= 10 AND greatest(over_rate, 1 - over_rate) >= 0.8)"""


_PLAYER_SQL = PLAYER_GAMES + "," + ",".join(_player_ctes(t) for t in TARGETS) + """,
ul AS (""" + " UNION ALL ".join(f"SELECT * FROM ul{k}" for k in range(len(TARGETS))) + """),
pl AS (""" + " UNION ALL ".join(f'SELECT target, "Player" FROM pl{k}' for k in range(len(TARGETS))) + ")"
_PTS = [float(x) for x in fixed.TARGET_LINES["PTS"]]
_EDGE_D = "line, market_odds, market_probability, confidence, edge, expected_value, expected_roi"
_MR = ", ".join(
    f"avg(pct_change) FILTER (result = '{r}') AS {r}_avg_change, count(*) FILTER (result = '{r}') AS {r}_count, count(*) FILTER (result = '{r}' AND pct_change > 0) AS {r}_positive, "
    f"count(*) FILTER (result = '{r}' AND pct_change < 0) AS {r}_negative, avg(initial_odds) FILTER (result = '{r}') AS {r}_avg_initial, avg(final_odds) FILTER (result = '{r}') AS {r}_avg_final"
    for r in ("over", "under"))
_NEAR = "list_sort([[abs(x - v), v] FOR v IN [" + ", ".join(f"{v}::DOUBLE" for v in _PTS) + "]])[1][2]"

QUERIES = {
    "over_line_flags": Query(
        flags,
        ask(PLAYER_GAMES, f"""SELECT game_id, target, line, coalesce(({_VALUE} > line)::INT, 0) AS over FROM player_games,
            (VALUES {', '.join(f"('{t}', {x}::DOUBLE)" for t in TARGETS for x in fixed.TARGET_LINES[t])}) AS t(target, line)""", "line", "game_id, over", "target"),
    ),
    "line_by_nearest": Query(
        nearest,
        ask(PLAYER_GAMES + f""", x AS (SELECT game_id, "PTS" AS x FROM player_games), c AS (SELECT game_id, x, {_NEAR} AS closest_line FROM x)""",
            """SELECT game_id, closest_line, CASE WHEN closest_line <> x AND closest_line < 35 THEN closest_line + 5 END AS upper_line,
            CASE WHEN closest_line <> x AND closest_line > 10 THEN closest_line - 5 END AS lower_line FROM c""", "closest_line, upper_line, lower_line", "game_id"),
    ),
    "line_confidence": Query(confidence, ask(CONF, "SELECT * FROM conf", "line, over_share, under_share, confidence, volatility", "samples", "target, prediction")),
    "line_adjusted_confidence": Query(adjusted, ask(CONF, "SELECT * FROM chosen", "line, adjusted_confidence", "", "target, prediction")),
    "line_recent_windows": Query(windows, ask(CONF, "SELECT * FROM win", "line, window_3, window_5, window_10, window_20", "", "target")),
    "line_by_opponent": Query(
        by_opponent,
        ask(PLAYER_GAMES + f""", l AS (SELECT * FROM (VALUES {_LINES}) AS t(target, line)), o AS (SELECT "Opp", target, line, coalesce(({_VALUE} > line)::INT, 0) AS over FROM player_games, l)""",
            """SELECT "Opp", target, line, count(*) AS samples, greatest(avg(over), 1 - avg(over)) AS consistency FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
            "line, consistency", "samples", "Opp, target"),
    ),
    "player_vs_lines": Query(
        per_player, ask(_PLAYER_SQL, "SELECT * FROM ul", "avg_value, std_value, min_value, max_value, line, over_rate, confidence", "Player, num_games", "target, prediction"),
    ),
    "player_line_summary": Query(
        per_player_summary,
        ask(_PLAYER_SQL, """SELECT p.target, players_analyzed, count(DISTINCT ul."Player") AS players_with_high_confidence, count(ul."Player") AS total_high_confidence_lines
            FROM (SELECT target, count(*) AS players_analyzed FROM pl GROUP BY 1) p LEFT JOIN ul ON ul.target = p.target GROUP BY 1, 2""",
            "", "players_analyzed, players_with_high_confidence, total_high_confidence_lines", "target"),
    ),
    "lines_semijoin": Query(
        semijoin,
        ask(CONF + "," + PRICES, """SELECT target, line, side, count(*) AS n, avg(price) AS mean_price FROM prices
            WHERE (target, line) IN (SELECT (target, line) FROM conf WHERE adjusted_confidence >= 0.8) GROUP BY 1, 2, 3""", "line, mean_price", "n", "target, side"),
    ),
    "implied_probability": Query(implied, ask(PRICES + "," + _IMPLIED, "SELECT * FROM imp", "line, market_odds, market_probability", "samples", "target, side, bookmaker")),
    "market_edges": Query(edges, ask(MARKET, "SELECT * FROM edges", _EDGE_D, "samples", "target, bookmaker, prediction")),
    "best_per_line": Query(best_lines, ask(MARKET, "SELECT * FROM bestl", "line, confidence, best_odds, best_edge, expected_roi", "bookmakers", "target, prediction, best_bookmaker")),
    "best_value_bets": Query(
        value_bets,
        ask(MARKET, "SELECT * FROM edges WHERE confidence >= 0.5 ORDER BY expected_roi DESC, target, line, bookmaker LIMIT 10", "line, confidence, edge, expected_roi", "", "target, bookmaker, prediction"),
    ),
    "topk_bets": Query(
        lambda spark, sf_dir: tidy(markets.best_value_bets(edges_of(spark, sf_dir), 0.0, 0.0, 10).select("target", "line", "bookmaker", "expected_roi")),
        ask(MARKET, "SELECT * FROM edges ORDER BY expected_roi DESC, target, line, bookmaker LIMIT 10", "line, expected_roi", "", "target, bookmaker"),
    ),
    "betting_strategy": Query(
        strategy, ask(MARKET, "SELECT * FROM strat", "line, adjusted_confidence, market_probability, edge, kelly_fraction", "", "target, prediction, verdict"),
    ),
    "kelly_bets": Query(portfolio_bets, ask(MARKET, "SELECT * FROM bets", "line, edge, kelly_fraction, adjusted_kelly, ev", "", "target, prediction")),
    "kelly_portfolio": Query(
        portfolio,
        ask(MARKET, """SELECT count(*) AS portfolio_size, coalesce(sum(adjusted_kelly), 0) AS total_risk, coalesce(sum(adjusted_kelly * ev), 0) AS estimated_growth_rate,
            coalesce(sum(adjusted_kelly * edge), 0) * 100 AS expected_roi FROM bets""", "total_risk, estimated_growth_rate, expected_roi", "portfolio_size"),
    ),
    "arbitrage_pairs": Query(
        arbitrage,
        ask(_LATEST + """, pr AS (SELECT o.event_id, o.target, o.line, o.bookmaker AS over_bookmaker, o.price AS over_odds, u.bookmaker AS under_bookmaker, u.price AS under_odds,
            1 / o.price + 1 / u.price AS inverse_sum FROM lat o JOIN lat u ON o.event_id = u.event_id AND o.target = u.target AND o.line = u.line AND o.side = 'over' AND u.side = 'under'
            WHERE o.price > 1 AND u.price > 1), pk AS (SELECT *, 1 / inverse_sum - 1 AS profit, 1 / over_odds / inverse_sum AS over_weight, 1 / under_odds / inverse_sum AS under_weight,
            row_number() OVER (PARTITION BY target ORDER BY 1 / inverse_sum - 1 DESC, event_id, line, over_bookmaker, under_bookmaker) AS place FROM pr WHERE inverse_sum < 1 AND 1 / inverse_sum - 1 >= 0.02)""",
            "SELECT * FROM pk WHERE place <= 10", "line, over_odds, under_odds, inverse_sum, profit, over_weight, under_weight", "event_id, place", "target, over_bookmaker, under_bookmaker"),
    ),
    "line_movement": Query(
        movement, ask(_MOVE, "SELECT * FROM mr", "line, initial_odds, final_odds, pct_change", "event_id, quotes, days_tracked", "target, side, bookmaker, result"),
    ),
    "movement_by_result": Query(
        movement_results,
        ask(_MOVE + f", g AS (SELECT target, line, side, {_MR} FROM mr WHERE result IS NOT NULL GROUP BY 1, 2, 3), d AS (SELECT *, over_avg_change - under_avg_change AS movement_diff FROM g)",
            """SELECT *, coalesce((abs(movement_diff) >= 0.01)::INT, 0) AS significant, CASE WHEN abs(movement_diff) >= 0.01 THEN CASE WHEN movement_diff > 0 THEN 'over' ELSE 'under' END END AS movement_indicates FROM d""",
            "line, movement_diff, " + ", ".join(f"{r}_{x}" for r in ("over", "under") for x in ("avg_change", "avg_initial", "avg_final")),
            "significant, " + ", ".join(f"{r}_{x}" for r in ("over", "under") for x in ("count", "positive", "negative")), "target, side, movement_indicates"),
    ),
    "market_pipeline": Query(
        pipeline,
        ask(MARKET + ", " + _STATS[len(PRICES) + 2:],
            """SELECT s.target, s.line, s.prediction, s.adjusted_confidence, s.edge, s.verdict, best_bookmaker, best_odds, best_edge, expected_roi, juice
            FROM strat s LEFT JOIN bestl b ON s.target = b.target AND s.line = b.line LEFT JOIN books k ON s.target = k.target AND s.line = k.line""",
            "line, adjusted_confidence, edge, best_odds, best_edge, expected_roi, juice", "", "target, prediction, verdict, best_bookmaker"),
    ),
    "bookmaker_stats": Query(stats, ask(_STATS, "SELECT * FROM stats", "line, mean, min, max, std, implied_prob", "count", "target, side, bookmaker")),
    "best_bookmaker": Query(
        best_books, ask(_STATS, "SELECT * FROM books", "line, best_over_odds, best_under_odds, juice", "over_bookmakers, under_bookmakers", "target, best_over_bookmaker, best_under_bookmaker"),
    ),
    "explode_props": Query(
        props,
        ask(PRICES, f"""SELECT 'Player ' || event_id AS player, {views._TEAM_LIST}[(event_id % 25) + 1] AS team, 'player_' || {_WORD} AS prop_type, line, bookmaker,
            strftime(snapshot, '%Y-%m-%d 00:00:00') AS game_time, count(*) AS n, sum(price) FILTER (side = 'over') AS over_sum, sum(price) FILTER (side = 'under') AS under_sum FROM prices GROUP BY 1, 2, 3, 4, 5, 6""",
            "line, over_sum, under_sum", "n", "player, team, prop_type, bookmaker, game_time"),
    ),
    "explode_props_filtered": Query(
        props_filtered,
        ask(PRICES, f"""SELECT 'Player ' || event_id AS player, {views._TEAM_LIST}[(event_id % 25) + 1] AS team, 'player_points' AS prop_type, count(*) AS n FROM prices
            WHERE target = 'PTS' AND ('player ' || event_id || ' ' || side) LIKE '%player 1%' AND lower({views._TEAM_LIST}[(event_id % 25) + 1]) LIKE '%b%' GROUP BY 1, 2, 3""", "", "n", "player, team, prop_type"),
    ),
    "prop_type_map": Query(
        prop_types, ask(PRICES, "SELECT target, side, count(*) AS n, avg(price) AS mean_price FROM prices GROUP BY 1, 2", "mean_price", "n", "target, side"),
    ),
    "props_to_games": Query(
        game_props,
        ask(PRICES + "," + PLAYER_GAMES + f""", q AS (SELECT event_id, {_NAME} AS name, max_by(price, (snapshot, price)) AS price FROM prices GROUP BY 1, 2),
            w AS (SELECT event_id, count(*) AS quotes, {', '.join(f'''max(price) FILTER (name = '{c}') AS "{c}"''' for c in SHOWN)} FROM q GROUP BY 1)""",
            f"""SELECT game_id, coalesce(quotes, 0) AS quotes, {', '.join(f'"{c}"' for c in SHOWN)} FROM player_games LEFT JOIN w ON "Player" = event_id""", ", ".join(SHOWN), "game_id, quotes"),
    ),
    "odds_merge": Query(
        merge,
        ask(PRICES + "," + PLAYER_GAMES + f""", q AS (SELECT event_id, snapshot::DATE AS m, {_NAME} AS name, max_by(price, (snapshot, quote_id)) AS price FROM prices GROUP BY 1, 2, 3),
            w AS (SELECT event_id, m, count(*) AS quotes, {', '.join(f'''max(price) FILTER (name = '{c}') AS "{c}"''' for c in SHOWN)} FROM q GROUP BY 1, 2)""",
            f"""SELECT game_id, coalesce(quotes, 0) AS quotes, {', '.join(f'"{c}"' for c in SHOWN)} FROM player_games LEFT JOIN w ON "Player" = event_id AND m = "Date"::DATE""",
            ", ".join(SHOWN), "game_id, quotes"),
    ),
    "odds_wide": Query(
        wide,
        ask(PRICES + f""", q AS (SELECT event_id, {_NAME} AS name, max_by(price, (snapshot, quote_id)) AS price FROM prices GROUP BY 1, 2)""",
            f"""SELECT event_id, {', '.join(f'''max(price) FILTER (name = '{c}') AS "{c}"''' for c in WIDE_NAMES)} FROM q GROUP BY 1""", ", ".join(WIDE_NAMES), "event_id"),
    ),
    "odds_long": Query(long_again, ask(_LATEST, "SELECT * FROM lat", "line, price", "event_id", "target, side, bookmaker")),
    "src_odds_snapshot": Query(
        snapshot_files,
        ask("", "SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS last_update, 1 AS success, count(*) AS documents, count(*) AS games FROM lineitem GROUP BY 1", "", "success, documents, games", "last_update"),
    ),
    "src_odds_rejected": Query(
        rejected,
        ask("", """SELECT CASE month(l_shipdate) WHEN 3 THEN 'malformed' WHEN 4 THEN 'no games' ELSE 'none' END AS reason, count(*) AS documents FROM lineitem GROUP BY 1""", "", "documents", "reason"),
    ),
    "line_tracks": Query(
        tracks,
        ask(PRICES + """, once AS (SELECT event_id, target, line, side, bookmaker, snapshot, max(price) AS price FROM prices GROUP BY 1, 2, 3, 4, 5, 6),
            gaps AS (SELECT *, CASE WHEN snapshot - lag(snapshot) OVER w <= 7 THEN 0 ELSE 1 END AS fresh FROM once WINDOW w AS (PARTITION BY event_id, target, line, side, bookmaker ORDER BY snapshot)),
            numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY event_id, target, line, side, bookmaker ORDER BY snapshot) AS track FROM gaps)""",
            """SELECT event_id, target, line, side, bookmaker, track, count(*) AS polls, min(snapshot) AS first_poll, max(snapshot) AS last_poll, min_by(price, snapshot) AS first_price,
            max_by(price, snapshot) AS last_price, min(price) AS low, max(price) AS high FROM numbered GROUP BY 1, 2, 3, 4, 5, 6""",
            "line, first_price, last_price, low, high", "event_id, track, polls", "target, side, bookmaker, first_poll, last_poll"),
    ),
    "fresh_snapshot": Query(
        fresh,
        ask("", """SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS last_update, count(*) AS n FROM lineitem
            WHERE l_shipdate > TIMESTAMP '1998-06-15 06:00:00' - INTERVAL 8760 HOUR GROUP BY 1""", "", "n", "last_update"),
    ),
    "src_odds_file": Query(
        odds_files,
        ask(PRICES, "SELECT target, line, side, bookmaker, count(*) AS n, sum(price) AS price_sum, min(snapshot) AS first, max(snapshot) AS last FROM prices GROUP BY 1, 2, 3, 4",
            "line, price_sum", "n", "target, side, bookmaker, first, last"),
    ),
    "sink_value_bets_csv": Query(
        report, ask(MARKET, "SELECT * FROM edges WHERE confidence >= 0.5 ORDER BY expected_roi DESC, target, line, bookmaker LIMIT 50", "line, confidence, edge, expected_roi", "", "target, bookmaker, prediction"),
    ),
    "sink_report_json": Query(
        json_report, ask(_STATS, "SELECT * FROM books", "line, best_over_odds, best_under_odds, juice", "over_bookmakers, under_bookmakers", "target, best_over_bookmaker, best_under_bookmaker"),
    ),
}
