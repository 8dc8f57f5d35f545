"""Game logs, player logs, prices and scores derived from the test tables.

Each view exists twice: as a DataFrame and as SQL text (``CTE``) for the oracle. Column names
are those of the box-score files the engine reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.fixed import VIEW_TEAMS
from courtspark.functions.scalars import col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _team(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in VIEW_TEAMS]), (code + 1).cast("int"))


def _cents(name: str) -> Column:
    """Share given with two decimals, as a whole number, so that sums are exact."""
    return F.round(F.abs(F.col(name)) * 100).cast("long")


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a team's game with its own and the opponent's box score."""
    scores = team_scores(spark, sf_dir)
    n = F.count("*").cast("double")
    box = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("FGA"),
            (F.lit(0.40) + F.sum(_cents("l_discount")) / (n * 100)).alias("FG%"),
            (F.lit(0.70) + F.sum(_cents("l_tax")) / (n * 100)).alias("FT%"),
            n.alias("3PA"),
            (F.lit(0.30) + F.max(_cents("l_discount")) / F.lit(100.0)).alias("3P%"),
            (n * 2).alias("FTA"),
        )
    )
    key = F.col("game_id")
    return scores.join(box, key == F.col("l_orderkey"), "left").select(
        *scores.columns,
        "FGA",
        F.floor(col("FGA") * col("FG%")).cast("double").alias("FG"),
        "FG%",
        F.floor(col("3PA") * col("3P%")).cast("double").alias("3P"),
        "3PA",
        "3P%",
        "FTA",
        "FT%",
        (60 + (key * 13) % 45).cast("double").alias("FGA_Opp"),
        (25 + (key * 11) % 20).cast("double").alias("FG_Opp"),
        (F.lit(0.40) + ((key * 7) % 11) / F.lit(100.0)).alias("FG%_Opp"),
        (5 + (key * 3) % 9).cast("double").alias("3P_Opp"),
        (15 + (key * 5) % 20).cast("double").alias("3PA_Opp"),
        (F.lit(0.30) + ((key * 3) % 10) / F.lit(100.0)).alias("3P%_Opp"),
        (10 + (key * 17) % 20).cast("double").alias("FTA_Opp"),
        (F.lit(0.70) + ((key * 9) % 9) / F.lit(100.0)).alias("FT%_Opp"),
    )


def team_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The game log without the box score: no scan of the line items."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    opp = (F.col("c_nationkey") + 1 + key % 24) % 25
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("game_id"),
        _team(F.col("c_nationkey")).alias("Team"),
        _team(opp).alias("Opp"),
        F.to_date("o_orderdate").alias("Date"),
        F.when(key % 2 == 0, F.lit("@")).alias("Away"),
        F.lit(240.0).alias("MP"),
        (70 + F.floor(F.col("o_totalprice") / 5600)).cast("double").alias("PTS"),
        (70 + (key * 37) % 90).cast("double").alias("PTS_Opp"),
    )


_TEAM_LIST = "[" + ", ".join(f"'{t}'" for t in VIEW_TEAMS) + "]"

TEAM_GAMES = f"""
box AS (
  SELECT l_orderkey, sum(l_quantity) AS "FGA",
    0.40::DOUBLE + sum(round(abs(l_discount) * 100)::BIGINT)::DOUBLE / (count(*)::DOUBLE * 100) AS "FG%",
    0.70::DOUBLE + sum(round(abs(l_tax) * 100)::BIGINT)::DOUBLE / (count(*)::DOUBLE * 100) AS "FT%",
    count(*)::DOUBLE AS "3PA",
    0.30::DOUBLE + max(round(abs(l_discount) * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS "3P%",
    count(*)::DOUBLE * 2 AS "FTA"
  FROM lineitem GROUP BY l_orderkey),
team_games AS (
  SELECT o_orderkey AS game_id, {_TEAM_LIST}[c_nationkey + 1] AS "Team",
    {_TEAM_LIST}[((c_nationkey + 1 + o_orderkey % 24) % 25) + 1] AS "Opp",
    o_orderdate::DATE AS "Date", CASE WHEN o_orderkey % 2 = 0 THEN '@' END AS "Away",
    240.0::DOUBLE AS "MP",
    (70 + floor(o_totalprice / 5600))::DOUBLE AS "PTS", (70 + (o_orderkey * 37) % 90)::DOUBLE AS "PTS_Opp",
    "FGA", floor("FGA" * "FG%") AS "FG", "FG%", floor("3PA" * "3P%") AS "3P", "3PA", "3P%", "FTA", "FT%",
    (60 + (o_orderkey * 13) % 45)::DOUBLE AS "FGA_Opp", (25 + (o_orderkey * 11) % 20)::DOUBLE AS "FG_Opp",
    0.40::DOUBLE + ((o_orderkey * 7) % 11)::DOUBLE / 100.0::DOUBLE AS "FG%_Opp",
    (5 + (o_orderkey * 3) % 9)::DOUBLE AS "3P_Opp", (15 + (o_orderkey * 5) % 20)::DOUBLE AS "3PA_Opp",
    0.30::DOUBLE + ((o_orderkey * 3) % 10)::DOUBLE / 100.0::DOUBLE AS "3P%_Opp",
    (10 + (o_orderkey * 17) % 20)::DOUBLE AS "FTA_Opp",
    0.70::DOUBLE + ((o_orderkey * 9) % 9)::DOUBLE / 100.0::DOUBLE AS "FT%_Opp"
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN box ON o_orderkey = l_orderkey)
"""


def team_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team log with its result as text; every 97th text does not match the pattern."""
    key = F.col("game_id")
    letter = F.when(col("PTS") > col("PTS_Opp"), "W").otherwise("L")
    overtime = F.when(key % 25 == 0, " (2OT)").when(key % 10 == 0, " (OT)").otherwise("")
    text = F.concat(
        letter, F.lit(" "), col("PTS").cast("int"), F.lit("-"), col("PTS_Opp").cast("int"), overtime
    )
    return team_scores(spark, sf_dir).withColumn(
        "Result", F.when(key % 97 == 0, "postponed").otherwise(text)
    )


TEAM_RESULTS = (
    TEAM_GAMES
    + """,
team_results AS (
  SELECT *, CASE WHEN game_id % 97 = 0 THEN 'postponed' ELSE
    (CASE WHEN "PTS" > "PTS_Opp" THEN 'W' ELSE 'L' END) || ' ' || "PTS"::INT || '-' || "PTS_Opp"::INT ||
    (CASE WHEN game_id % 25 = 0 THEN ' (2OT)' WHEN game_id % 10 = 0 THEN ' (OT)' ELSE '' END) END AS "Result"
  FROM team_games)
"""
)


def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a player's game."""
    key = F.col("event_id")
    stat = lambda c: c.cast("double")
    return table(spark, sf_dir, "events").select(
        key.alias("game_id"),
        F.col("user_id").alias("Player"),
        F.element_at(
            F.array(*[F.lit(t) for t in VIEW_TEAMS]), (F.col("user_id") % 25 + 1).cast("int")
        ).alias("Team"),
        F.col("event_type").alias("Opp"),
        F.col("ts"),
        F.to_date("ts").alias("Date"),
        F.when(key % 2 == 0, F.lit("@")).alias("Away"),
        F.when(key % 3 == 0, F.lit("*")).alias("GS"),
        stat(10 + key % 30).alias("MP"),
        F.col("value").alias("PTS"),
        stat((key * 7919) % 20).alias("TRB"),
        stat((key * 104729) % 15).alias("AST"),
        stat(key % 4).alias("STL"),
        stat(key % 3).alias("BLK"),
        stat(5 + (key * 31) % 20).alias("FGA"),
        stat((key * 17) % 10).alias("FTA"),
        stat((key * 13) % 6).alias("TOV"),
        stat((key * 19) % 8).alias("3P"),
    )


PLAYER_GAMES = f"""
player_games AS (
  SELECT event_id AS game_id, user_id AS "Player", {_TEAM_LIST}[(user_id % 25) + 1] AS "Team",
    event_type AS "Opp", ts, ts::DATE AS "Date", CASE WHEN event_id % 2 = 0 THEN '@' END AS "Away",
    CASE WHEN event_id % 3 = 0 THEN '*' END AS "GS",
    (10 + event_id % 30)::DOUBLE AS "MP", value AS "PTS", ((event_id * 7919) % 20)::DOUBLE AS "TRB",
    ((event_id * 104729) % 15)::DOUBLE AS "AST", (event_id % 4)::DOUBLE AS "STL", (event_id % 3)::DOUBLE AS "BLK",
    (5 + (event_id * 31) % 20)::DOUBLE AS "FGA", ((event_id * 17) % 10)::DOUBLE AS "FTA",
    ((event_id * 13) % 6)::DOUBLE AS "TOV", ((event_id * 19) % 8)::DOUBLE AS "3P"
  FROM events)
"""


def player_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player; every 50th height is unreadable."""
    key = F.col("user_id")
    height = F.concat(5 + key % 3, F.lit("'"), key % 12, F.lit('"'))
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(
            key.alias("Player"),
            F.when(key % 50 == 0, "unknown").otherwise(height).alias("Height"),
            (170 + key % 100).cast("string").alias("Weight"),
        )
    )


PLAYER_BIO = """
player_bio AS (
  SELECT DISTINCT user_id AS "Player", CASE WHEN user_id % 50 = 0 THEN 'unknown'
    ELSE (5 + user_id % 3) || '''' || (user_id % 12) || '"' END AS "Height",
    (170 + user_id % 100)::VARCHAR AS "Weight"
  FROM events)
"""


def double_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player log with double-double flags."""
    from courtspark.operators.loading import double_triple_double

    return double_triple_double(player_games(spark, sf_dir))


DOUBLE_LOG = (
    PLAYER_GAMES
    + """,
double_log AS (
  SELECT *, (("PTS">=10)::INT + ("TRB">=10)::INT + ("AST">=10)::INT + ("STL">=10)::INT + ("BLK">=10)::INT >= 2)::INT AS double_double,
    (("PTS">=10)::INT + ("TRB">=10)::INT + ("AST">=10)::INT + ("STL">=10)::INT + ("BLK">=10)::INT >= 3)::INT AS triple_double
  FROM player_games)
"""
)


PRICE_TARGETS = ("PTS", "TRB", "AST", "3P")
PRICE_LINES = ((10.0, 20.0, 30.0), (4.0, 8.0, 12.0), (4.0, 8.0, 12.0), (1.0, 3.0, 5.0))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote per line item: an over and an under price of one bookmaker for one line."""
    targets = F.array(*[F.lit(t) for t in PRICE_TARGETS])
    lines = F.array(*[F.array(*[F.lit(x) for x in row]) for row in PRICE_LINES])
    kind = (F.col("l_partkey") % 4 + 1).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("event_id"),
        F.element_at(targets, kind).alias("target"),
        F.element_at(F.element_at(lines, kind), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("line"),
        F.concat(F.lit("bm"), F.col("l_suppkey") % 5).alias("bookmaker"),
        F.to_date("l_shipdate").alias("snapshot"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("quote_id"),
        ((160 + 9 * _cents("l_discount")) / F.lit(100.0)).alias("over_price"),
        ((160 + 10 * _cents("l_tax")) / F.lit(100.0)).alias("under_price"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long odds table: one row per quote and side."""
    sides = F.array(
        F.struct(F.lit("over").alias("side"), F.col("over_price").alias("price")),
        F.struct(F.lit("under").alias("side"), F.col("under_price").alias("price")),
    )
    df = quotes(spark, sf_dir)
    return df.select(
        "event_id", "target", "line", "bookmaker", "snapshot", "quote_id", F.inline(sides)
    )


PRICES = """
quotes AS (
  SELECT l_orderkey % 200 AS event_id, ['PTS', 'TRB', 'AST', '3P'][l_partkey % 4 + 1] AS target,
    [[10, 20, 30], [4, 8, 12], [4, 8, 12], [1, 3, 5]][l_partkey % 4 + 1][l_linenumber % 3 + 1]::DOUBLE AS line,
    'bm' || (l_suppkey % 5) AS bookmaker, l_shipdate::DATE AS snapshot,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT AS quote_id,
    (160 + 9 * round(abs(l_discount) * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS over_price,
    (160 + 10 * round(abs(l_tax) * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS under_price
  FROM lineitem),
prices AS (
  SELECT event_id, target, line, bookmaker, snapshot, quote_id, 'over' AS side, over_price AS price FROM quotes
  UNION ALL
  SELECT event_id, target, line, bookmaker, snapshot, quote_id, 'under', under_price FROM quotes)
"""


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final value of each priced event."""
    return (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 200).alias("event_id"))
        .agg(F.max("value").alias("actual"))
    )


EVENT_RESULTS = "results AS (SELECT user_id % 200 AS event_id, max(value) AS actual FROM events GROUP BY 1)"


def odds_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot document per quote, as JSON text."""
    key = F.col("event_id")
    player = F.concat(F.lit("Player "), key)
    market = F.concat(
        F.lit("player_"),
        F.element_at(
            F.create_map(*[F.lit(x) for pair in zip(PRICE_TARGETS, ("points", "rebounds", "assists", "threes")) for x in pair]),
            F.col("target"),
        ),
    )
    outcome = lambda side, price: F.struct(
        F.concat(player, F.lit(f" {side}")).alias("name"),
        F.element_at(F.array(*[F.lit(t) for t in VIEW_TEAMS]), (key % 25 + 1).cast("int")).alias("team"),
        F.col("line").alias("point"),
        F.col(price).alias("price"),
    )
    document = F.struct(
        F.lit(True).alias("success"),
        F.col("_time").alias("last_update"),
        F.array(
            F.struct(
                F.col("_time").alias("commence_time"),
                F.lit("HOME").alias("home_team"),
                F.lit("AWAY").alias("away_team"),
                F.array(
                    F.struct(
                        F.col("bookmaker").alias("key"),
                        F.array(
                            F.struct(
                                market.alias("key"),
                                F.array(
                                    outcome("Over", "over_price"), outcome("Under", "under_price")
                                ).alias("outcomes"),
                            )
                        ).alias("markets"),
                    )
                ).alias("bookmakers"),
            )
        ).alias("data"),
    )
    time = F.date_format("snapshot", "yyyy-MM-dd'T'HH:mm:ss")
    return quotes(spark, sf_dir).withColumn("_time", time).select(F.to_json(document).alias("value"))


def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and scores of a made-up classifier: one row per event."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        kind.isin("purchase", "signup").cast("int").alias("y_true"),
        (F.col("value") / (F.col("value") + 40)).alias("y_proba"),
        (F.col("event_id") % 2).cast("int").alias("is_home"),
    )


SCORED_BINARY = """
scored AS (
  SELECT event_id AS id, (event_type IN ('purchase', 'signup'))::INT AS y_true,
    value / (value + 40) AS y_proba, (event_id % 2)::INT AS is_home
  FROM events)
"""


def scored_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and predicted points: one row per game."""
    key = F.col("game_id")
    return team_scores(spark, sf_dir).select(
        key.alias("id"),
        col("PTS").alias("y_true"),
        (col("PTS") + ((key * 29) % 41 - 20) / F.lit(2.0)).alias("y_pred"),
    )


SCORED_REGRESSION = (
    TEAM_GAMES
    + """,
scored AS (
  SELECT game_id AS id, "PTS" AS y_true, "PTS" + ((game_id * 29) % 41 - 20)::DOUBLE / 2.0::DOUBLE AS y_pred
  FROM team_games)
"""
)


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of four made-up models, with a train / validation split."""
    key = F.col("game_id")
    spread = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(k).alias("_k"), F.lit(d).alias("_d"))
            for m, k, d in (("forest", 29, 2.0), ("boosting", 31, 4.0), ("ridge", 37, 8.0), ("net", 43, 1.0))
        ]
    )
    return (
        team_scores(spark, sf_dir)
        .select(
            key.alias("id"), col("PTS").alias("y_true"), col("Date"), F.inline(spread)
        )
        .select(
            "id",
            "model",
            "y_true",
            (col("y_true") + ((F.col("id") * col("_k")) % 41 - 20) / col("_d")).alias("y_pred"),
            F.when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"),
        )
    )


MODEL_PREDICTIONS = (
    TEAM_GAMES
    + """,
predictions AS (
  SELECT game_id AS id, model, "PTS" AS y_true, "PTS" + ((game_id * k) % 41 - 20)::DOUBLE / d AS y_pred,
    CASE WHEN game_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM team_games, (VALUES ('forest', 29, 2.0::DOUBLE), ('boosting', 31, 4.0::DOUBLE),
                           ('ridge', 37, 8.0::DOUBLE), ('net', 43, 1.0::DOUBLE)) AS m(model, k, d))
"""
)
