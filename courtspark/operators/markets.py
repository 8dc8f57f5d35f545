"""Bookmaker prices: flattening, statistics, edges, arbitrage, movements, stakes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from courtspark import fixed
from courtspark.functions.scalars import col, fill, flag, ratio, with_scalar
from courtspark.operators.loading import recent_days
from courtspark.operators.lines import confident_lines, line_confidence

LINE = ["target", "line"]
PROP_TARGETS = {"points": "PTS", "rebounds": "TRB", "assists": "AST", "threes": "3P"}


# ------------------------------------------------------------------ snapshots to long prices


def explode_props(
    snapshots: DataFrame,
    player: str | None = None,
    team: str | None = None,
    prop: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Player markets of snapshot documents, one row per outcome.

    ``prop`` is points, rebounds, assists or threes; an unknown one matches nothing. ``keep`` names columns
    of the documents that go along. Points and prices may be doubles or variants.
    """
    # The outer form keeps Spark from testing the parsed document again in a filter; a document
    # without games has no bookmakers and drops out in the next step.
    games = snapshots.select(*keep, F.explode_outer("data").alias("g"))
    about = [F.col(f"g.{c}").alias(c) for c in ("commence_time", "home_team", "away_team")]
    books = games.select(*keep, *about, F.explode("g.bookmakers").alias("b"))
    about = [*keep, "commence_time", "home_team", "away_team"]
    markets = books.select(*about, F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    wanted = F.lower("m.key").contains("player")
    if prop is not None:
        target = PROP_TARGETS.get(prop.lower())
        wanted = wanted & (_names_target(F.col("m.key"), target) if target else F.lit(False))
    outcomes = markets.where(wanted).select(
        *about, "book", F.col("m.key").alias("prop_type"), F.explode("m.outcomes").alias("o")
    )
    if player is not None:
        outcomes = outcomes.where(F.lower("o.name").contains(player.lower()))
    if team is not None:
        outcomes = outcomes.where(F.lower("o.team").contains(team.lower()))
    name = F.coalesce(F.col("o.name"), F.lit(""))
    lowered = F.lower(name)
    point, price = (_number(F.col(f"o.{c}"), outcomes.schema["o"].dataType[c].dataType) for c in ("point", "price"))
    return outcomes.select(
        *keep,
        name.alias("outcome"),
        _without_side(name, lowered).alias("player"),
        F.col("o.team").alias("team"),
        "prop_type",
        point.alias("line"),
        F.when(lowered.endswith("over"), price).alias("over_price"),
        F.when(lowered.endswith("under"), price).alias("under_price"),
        F.lower("book").alias("bookmaker"),
        F.try_to_timestamp(F.col("commence_time")).alias("game_time"),
        "home_team",
        "away_team",
    )


_SPACES = " \t\n\x0b\f\r"


def _without_side(name: Column, lowered: Column) -> Column:
    """The name without the side at its end and the space before it. A name that plainly ends with its side is
    cut there; the pattern, which takes longer, also knows a side before a last line break."""
    cut = lambda word: F.rtrim(F.substring(name, F.lit(1), F.char_length(name) - len(word)), F.lit(_SPACES))
    ends = F.when(lowered.endswith("over"), cut("over")).when(lowered.endswith("under"), cut("under"))
    return ends.otherwise(F.regexp_replace(name, r"(?i)\s*(over|under)$", ""))


def _number(x: Column, kind) -> Column:
    """A double, also out of a variant that holds a number or its text; null for any other variant."""
    return F.try_variant_get(x, "$", "double") if isinstance(kind, VariantType) else x


def _names_target(prop_type: Column, target: str) -> Column:
    return _holds_synonym(F.lower(prop_type), target)


def _holds_synonym(lowered: Column, target: str) -> Column:
    """Synonyms that hold another one of the target add no match and are not looked for."""
    words = fixed.PROP_SYNONYMS[target]
    hit = F.lit(False)
    for word in words:
        if not any(other != word and other in word for other in words):
            hit = hit | lowered.contains(word)
    return hit


def targets_of(prop_type: Column) -> Column:
    """All targets whose synonyms occur in the market name; a combined market has several."""
    return F.array_compact(
        F.array(*[F.when(_names_target(prop_type, t), t) for t in fixed.PROP_SYNONYMS])
    )


def long_props(props: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(player, target, line, side, bookmaker, price, game_time) with known prices only.

    The outer form keeps Spark from testing all synonyms in a filter first and then once more. Nulls of
    targets that a market does not name fall with the last condition; a lambda to drop them would run uncompiled.
    """
    targets = F.array(*[F.when(_holds_synonym(col("_market"), t), t) for t in fixed.PROP_SYNONYMS])
    side = F.when(col("over_price").isNotNull(), "over").when(col("under_price").isNotNull(), "under")
    return props.withColumn("_market", F.lower("prop_type")).select(
        *keep,
        "player",
        F.explode_outer(targets).alias("target"),
        "line",
        side.alias("side"),
        "bookmaker",
        F.coalesce("over_price", "under_price").alias("price"),
        "game_time",
    ).where(col("line").isNotNull() & col("price").isNotNull() & col("target").isNotNull())


def _line_text(line: Column) -> Column:
    return F.regexp_replace(line.cast("string"), r"\.0$", "")


def odds_column() -> Column:
    return F.concat(
        col("target"), F.lit("_"), col("side"), F.lit("_"), _line_text(col("line")), F.lit("_odds_"), col("bookmaker")
    )


def latest_prices(prices: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Last price per key: the last write wins. Combined before the shuffle."""
    return prices.groupBy(*keys).agg(
        F.max_by("price", F.struct(*[col(c) for c in newest])).alias("price")
    )


def props_to_games(
    games: DataFrame, props: DataFrame, keys: Sequence[str] = ("Player",), as_of: str | None = None, date: str = "Date"
) -> DataFrame:
    """Attach each player's prices as one map {odds column: price}.

    The prices of a player shrink to one entry per odds column before the join, so a game row
    meets one row and is never multiplied. A missing bookmaker is called "unknown"; prices without
    a line or a side name no odds column and are left out. With ``as_of`` (a day, as text) only
    games from that day on get prices; without it all games do, earlier ones too.
    """
    props = props.where(col("line").isNotNull() & col("side").isNotNull() & col("target").isNotNull())
    props = props.withColumn("bookmaker", F.coalesce("bookmaker", F.lit("unknown")))
    latest = latest_prices(props, [*keys, "target", "line", "side", "bookmaker"], ["game_time", "price"])
    maps = latest.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(odds_column(), col("price")))).alias("odds")
    )
    if as_of is None:
        return games.join(maps, list(keys), "left")
    out = games.join(maps, list(keys), "left")
    return out.withColumn("odds", F.when(col(date) >= F.lit(as_of).cast("date"), col("odds")))


def odds_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named odds columns out of the map."""
    return df.withColumns({n: F.try_element_at(col("odds"), F.lit(n)) for n in names})


def odds_wide(prices: DataFrame, keys: Sequence[str], names: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One column per target, side, line and bookmaker; the names are given, so one pass."""
    return (
        prices.withColumn("_name", odds_column())
        .groupBy(*keys)
        .pivot("_name", list(names))
        .agg(F.max_by("price", F.struct(*[col(c) for c in newest])))
    )


def odds_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back from named columns to rows; absent prices are dropped."""
    pattern = r"^(.+?)_(over|under)_([0-9.]+)_odds_(.+)$"
    names = [c for c in wide.columns if "_odds_" in c]
    long = wide.unpivot([col(k) for k in keys], [col(n) for n in names], "_name", "price")
    part = lambda k: F.regexp_extract("_name", pattern, k)
    return long.where(col("price").isNotNull()).select(
        *keys, part(1).alias("target"), part(2).alias("side"), part(3).cast("double").alias("line"),
        part(4).alias("bookmaker"), "price",
    )


TRACK = ("player", "target", "line", "side", "bookmaker")
EXPIRY_HOURS = 12.0


def line_tracks(prices: DataFrame, keys: Sequence[str] = TRACK, polled: str = "polled", expiry_hours: float = EXPIRY_HOURS) -> DataFrame:
    """First and latest price, lowest, highest and number of polls of every line that is tracked. A line
    that is not polled for ``expiry_hours`` is forgotten and begins anew. A poll gives one price per line;
    repeated polls count once."""
    known = prices.where(col(polled).isNotNull() & col("price").isNotNull())
    once = known.groupBy(*keys, polled).agg(F.max("price").alias("price"))
    in_order = Window.partitionBy(*[col(k) for k in keys]).orderBy(polled)
    gap = F.unix_micros(polled) - F.lag(F.unix_micros(polled)).over(in_order)
    new = F.when(gap <= int(expiry_hours * 3_600_000_000), 0).otherwise(1)
    tracks = once.withColumn("_new", new).withColumn("track", F.sum("_new").over(in_order))
    return tracks.groupBy(*keys, "track").agg(
        F.count("*").alias("polls"), F.min(polled).alias("first_poll"), F.max(polled).alias("last_poll"),
        F.min_by("price", polled).alias("first_price"), F.max_by("price", polled).alias("last_price"),
        F.min("price").alias("low"), F.max("price").alias("high"),
    )


# ------------------------------------------------------------------ price statistics


def implied_probability(prices: DataFrame) -> DataFrame:
    """Mean price and mean 1/price per line, side and bookmaker; implausible means are left out."""
    return (
        prices.where(col("price").isNotNull())
        .groupBy(*LINE, "side", "bookmaker")
        .agg(
            F.count("*").alias("samples"),
            F.avg("price").alias("market_odds"),
            F.avg(F.when(col("price") > 0, 1 / col("price"))).alias("market_probability"),
        )
        .where(col("market_odds").between(1.1, 10.0))
    )


def bookmaker_stats(prices: DataFrame, at_least: int = 5) -> DataFrame:
    mean = F.avg("price")
    return (
        prices.groupBy(*LINE, "side", "bookmaker")
        .agg(
            F.count("price").alias("count"),
            mean.alias("mean"),
            F.min("price").alias("min"),
            F.max("price").alias("max"),
            F.stddev_samp("price").alias("std"),
            ratio(F.lit(1.0), mean).alias("implied_prob"),
        )
        .where(col("count") >= at_least)
    )


def best_bookmaker(stats: DataFrame) -> DataFrame:
    """Per line: best mean price of each side (first name on ties), bookmakers, juice."""
    rank = lambda s: F.when(col("side") == s, F.struct(-col("mean"), col("bookmaker")))
    side = lambda s, x: F.when(col("side") == s, x)
    juice = F.avg(side("over", ratio(F.lit(1.0), col("mean")))) + F.avg(side("under", ratio(F.lit(1.0), col("mean"))))
    return stats.groupBy(*LINE).agg(
        F.count(side("over", F.lit(1))).alias("over_bookmakers"),
        F.count(side("under", F.lit(1))).alias("under_bookmakers"),
        F.min_by("bookmaker", rank("over")).alias("best_over_bookmaker"),
        F.coalesce(F.max(side("over", col("mean"))), F.lit(0.0)).alias("best_over_odds"),
        F.min_by("bookmaker", rank("under")).alias("best_under_bookmaker"),
        F.coalesce(F.max(side("under", col("mean"))), F.lit(0.0)).alias("best_under_odds"),
        juice.alias("juice"),
    )


def lines_semijoin(prices: DataFrame, lines: DataFrame) -> DataFrame:
    """Prices of the lines that passed the confidence test."""
    return prices.join(lines.select(*LINE).distinct(), LINE, "left_semi")


# ------------------------------------------------------------------ decisions


def _recent(prices: DataFrame, days: int | None, snapshot: str = "snapshot") -> DataFrame:
    return prices if days is None else recent_days(prices, days, snapshot)


def market_edges(
    prices: DataFrame,
    confidence: DataFrame,
    min_edge: float = 0.04,
    min_odds: float = 1.8,
    lookback_days: int | None = 60,
) -> DataFrame:
    """Bookmakers whose price on the predicted side leaves an edge, with expected value."""
    prices = _recent(prices, lookback_days)
    found = implied_probability(prices).join(
        confidence.select(*LINE, "prediction", col("adjusted_confidence").alias("confidence")), LINE
    )
    found = found.where(col("side") == col("prediction"))
    found = found.withColumns(
        {
            "edge": col("confidence") - col("market_probability"),
            "expected_value": col("market_odds") * col("confidence"),
            "expected_roi": (col("market_odds") * col("confidence") - 1) * 100,
        }
    )
    return found.where((col("edge") >= min_edge) & (col("market_odds") >= min_odds)).drop("side")


def best_per_line(edges: DataFrame) -> DataFrame:
    """Best bookmaker per line by expected value, lines by return."""
    best = F.struct(-col("expected_value"), col("bookmaker"))
    return edges.groupBy(*LINE, "prediction", "confidence").agg(
        F.min_by("bookmaker", best).alias("best_bookmaker"),
        F.min_by("market_odds", best).alias("best_odds"),
        F.min_by("edge", best).alias("best_edge"),
        F.max("expected_roi").alias("expected_roi"),
        F.count("*").alias("bookmakers"),
    ).orderBy(F.desc("expected_roi"), *LINE)


def best_value_bets(
    edges: DataFrame, min_confidence: float = 0.96, min_edge: float = 0.04, n: int = 10
) -> DataFrame:
    keep = (col("confidence") >= min_confidence) & (col("edge") >= min_edge)
    return edges.where(keep).orderBy(F.desc("expected_roi"), *LINE, "bookmaker").limit(n)


def betting_strategy(
    confidence: DataFrame,
    prices: DataFrame | None = None,
    min_edge: float = 0.05,
    bankroll_fraction: float = 0.02,
    both_sides: bool = False,
) -> DataFrame:
    """Edge and stake per confident line, best first.

    The market's chance of 'over' comes from the prices of the predicted side, or, with
    ``both_sides``, from the mean over both sides; without prices it is one half.
    """
    out = confidence.withColumn("market_probability", F.lit(0.5))
    if prices is not None:
        books = implied_probability(prices)
        sides = books.groupBy(*LINE).agg(
            F.avg(F.when(col("side") == "over", col("market_probability"))).alias("_over"),
            F.avg(F.when(col("side") == "under", col("market_probability"))).alias("_under"),
            F.avg("market_probability").alias("_both"),
        )
        own = F.when(col("prediction") == "over", col("_over")).otherwise(1 - col("_under"))
        market = col("_both") if both_sides else own
        out = (
            confidence.join(sides, LINE, "left")
            .withColumn("market_probability", fill(market, 0.5))
            .drop("_over", "_under", "_both")
        )
    model, market = col("adjusted_confidence"), col("market_probability")
    edge = F.when(col("prediction") == "over", model - market).otherwise(model - (1 - market))
    kelly = F.when(edge > 0, F.least(model * 2 - 1, F.lit(bankroll_fraction))).otherwise(0.0)
    verdict = F.when(edge >= min_edge, "value").when(edge < -min_edge, "avoid").otherwise("none")
    return out.withColumns(
        {"edge": edge, "kelly_fraction": kelly, "verdict": verdict}
    ).orderBy(F.desc("adjusted_confidence"), *LINE)


def kelly_bets(strategy: DataFrame, min_edge: float = 0.04, max_risk: float = 0.25) -> DataFrame:
    """Value bets with stakes scaled so that they add up to at most ``max_risk``."""
    bets = strategy.where(
        (col("verdict") == "value") & (col("edge") >= min_edge) & (col("kelly_fraction") > 0)
    )
    whole = bets.agg(F.sum("kelly_fraction").alias("_sum"))
    scale = F.least(F.lit(1.0), F.lit(max_risk) / col("_sum"))
    return (
        with_scalar(bets, whole)
        .withColumns(
            {"adjusted_kelly": col("kelly_fraction") * scale, "ev": (1 + col("edge")) * 0.5}
        )
        .drop("_sum")
    )


def kelly_portfolio(bets: DataFrame) -> DataFrame:
    k = col("adjusted_kelly")
    return bets.agg(
        F.count("*").alias("portfolio_size"),
        fill(F.sum(k), 0.0).alias("total_risk"),
        fill(F.sum(k * col("ev")), 0.0).alias("estimated_growth_rate"),
        (fill(F.sum(k * col("edge")), 0.0) * 100).alias("expected_roi"),
    )


def arbitrage_pairs(
    prices: DataFrame,
    entity: str = "event_id",
    min_profit: float = 0.02,
    n: int = 10,
    newest: Sequence[str] = ("snapshot", "quote_id"),
    lookback_days: int | None = 30,
) -> DataFrame:
    """The n most profitable over / under pairs per target, on the latest price per bookmaker.

    Within a line, the pair of the i-th best over and the j-th best under price is beaten by
    i*j - 1 others, so pairs with i*j > n cannot be among the n best: the rest is never formed.
    """
    keys = [entity, *LINE]
    prices = _recent(prices, lookback_days, newest[0])
    latest = latest_prices(prices, [*keys, "side", "bookmaker"], newest).where(col("price") > 1.0)
    best = Window.partitionBy(*keys, "side").orderBy(F.desc("price"), "bookmaker")
    ranked = latest.withColumn("_k", F.row_number().over(best)).where(col("_k") <= n)

    def one(side: str) -> DataFrame:
        return ranked.where(col("side") == side).select(
            *keys, col("bookmaker").alias(f"{side}_bookmaker"), col("price").alias(f"{side}_odds"), col("_k").alias(f"_{side}")
        )

    s = 1 / col("over_odds") + 1 / col("under_odds")
    pairs = (
        one("over")
        .join(one("under"), keys)
        .where((col("_over") * col("_under") <= n) & (s < 1))
        .withColumns(
            {
                "inverse_sum": s,
                "profit": 1 / s - 1,
                "over_weight": 1 / col("over_odds") / s,
                "under_weight": 1 / col("under_odds") / s,
            }
        )
        .where(col("profit") >= min_profit)
        .drop("_over", "_under")
    )
    top = Window.partitionBy("target").orderBy(
        F.desc("profit"), entity, "line", "over_bookmaker", "under_bookmaker"
    )
    return pairs.withColumn("place", F.row_number().over(top)).where(col("place") <= n)


# ------------------------------------------------------------------ movements


def line_movement(
    prices: DataFrame,
    results: DataFrame | None = None,
    entity: str = "event_id",
    newest: Sequence[str] = ("snapshot", "quote_id"),
    lookback_events: int | None = None,
    side: str | None = None,
) -> DataFrame:
    """First and last price per entity, line, side and bookmaker, ordered by snapshot time; of both
    sides unless one is named."""
    quoted = prices if side is None else prices.where(col("side") == side)
    if lookback_events is not None:
        rows = quoted.groupBy(entity, newest[0]).agg(F.lit(1).alias("_x")).drop("_x")
        latest = rows.orderBy(F.desc(newest[0]), F.desc(entity)).limit(lookback_events)
        quoted = quoted.join(latest, [entity, newest[0]], "left_semi")
    when = F.struct(*[col(c) for c in newest])
    moved = (
        quoted.groupBy(entity, *LINE, "side", "bookmaker")
        .agg(
            F.count("*").alias("quotes"),
            F.min_by("price", when).alias("initial_odds"),
            F.max_by("price", when).alias("final_odds"),
            F.min("price").alias("_lo"),
            F.max("price").alias("_hi"),
            F.datediff(F.max(newest[0]), F.min(newest[0])).alias("days_tracked"),
        )
        .where((col("quotes") > 1) & (col("_lo") < col("_hi")) & (col("initial_odds") > 0))
        .drop("_lo", "_hi")
        .withColumn("pct_change", (col("final_odds") - col("initial_odds")) / col("initial_odds"))
    )
    if results is None:
        return moved
    over = F.when(col("actual").isNotNull(), F.when(col("actual") > col("line"), "over").otherwise("under"))
    return moved.join(results, entity, "left").withColumn("result", over).drop("actual")


def movement_by_result(movements: DataFrame, at_least: float = 0.05) -> DataFrame:
    """Mean movements per line and side of the price, by the side that won, and the side that the
    difference points to."""
    aggs = []
    for r in ("over", "under"):
        x = lambda c, r=r: F.when(col("result") == r, c)
        aggs += [
            F.avg(x(col("pct_change"))).alias(f"{r}_avg_change"),
            F.count(x(F.lit(1))).alias(f"{r}_count"),
            F.count(F.when((col("result") == r) & (col("pct_change") > 0), 1)).alias(f"{r}_positive"),
            F.count(F.when((col("result") == r) & (col("pct_change") < 0), 1)).alias(f"{r}_negative"),
            F.avg(x(col("initial_odds"))).alias(f"{r}_avg_initial"),
            F.avg(x(col("final_odds"))).alias(f"{r}_avg_final"),
        ]
    diff = col("over_avg_change") - col("under_avg_change")
    return (
        movements.where(col("result").isNotNull())
        .groupBy(*LINE, "side")
        .agg(*aggs)
        .withColumns(
            {
                "movement_diff": diff,
                "significant": flag(F.abs(diff) >= at_least),
                "movement_indicates": F.when(F.abs(diff) >= at_least, F.when(diff > 0, "over").otherwise("under")),
            }
        )
    )


# ------------------------------------------------------------------ the whole chain


def market_pipeline(
    games: DataFrame,
    prices: DataFrame,
    target: str,
    min_confidence: float = 0.96,
    order: Sequence[str] = ("Date", "game_id"),
    results: DataFrame | None = None,
    lookback_days: int | None = 60,
) -> dict[str, DataFrame]:
    """Confident lines of one target, and the market tables about them."""
    confidence = line_confidence(games, target, order=order)
    lines = confident_lines(confidence, min_confidence)
    mine = prices.where(col("target") == target)
    return {
        "lines": lines,
        "edges": market_edges(mine, lines, lookback_days=lookback_days),
        "strategy": betting_strategy(lines, mine),
        "bookmakers": best_bookmaker(bookmaker_stats(mine)),
        "arbitrage": arbitrage_pairs(mine, lookback_days=lookback_days),
        "movements": line_movement(mine, results),
    }
