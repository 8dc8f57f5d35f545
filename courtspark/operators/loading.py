"""Parsing and cleaning of raw game, team and biometric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from courtspark import fixed
from courtspark.functions import situation
from courtspark.functions.scalars import col, finite, flag, total, with_scalar

# Tried in this order; the first that fits the text wins.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd")


def check_required_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    """Raise while the plan is built when a required column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def check_trainable(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features named and present, and at least one row with a target."""
    if not features:
        raise ValueError("no feature columns given")
    check_required_columns(df, [*features, target], "training data")
    if df.where(col(target).isNotNull()).limit(1).isEmpty():
        raise ValueError(f"no row has a value for {target}")
    return df


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_results(df: DataFrame, name: str = "Result", scores: bool = True) -> DataFrame:
    """Outcome, scores and overtime from texts such as ``W 133-129 (OT)``.

    The pattern runs twice per text, to test and to take apart; all columns read the parts. Text
    that does not match has no outcome and no scores, and no overtime.
    """
    text = _strip(col(name))
    cut = F.split(F.regexp_replace(text, fixed.RESULT_PATTERN, r"$1|$2|$3|$4"), r"\|")
    out = df.withColumn("_parts", F.when(text.rlike(fixed.RESULT_PATTERN), cut))
    part = lambda k: F.get(col("_parts"), k)
    extra = F.coalesce(part(3), F.lit(""))
    digit = F.nullif(F.regexp_extract(extra, r"^(\d)", 1), F.lit("")).try_cast("int")
    columns = {"is_win": F.when(col("_parts").isNotNull(), (part(0) == "W").cast("int"))}
    if scores:
        ours, theirs = part(1).try_cast("int"), part(2).try_cast("int")
        columns |= {
            "team_score": ours,
            "opp_score": theirs,
            "total_score": ours + theirs,
            "point_diff": ours - theirs,
        }
    columns["has_overtime"] = flag(extra != "")
    columns["overtime_periods"] = F.when(extra == "", 0).otherwise(F.coalesce(digit, F.lit(1)))
    return out.withColumns(columns).drop("_parts")


def win_from_prefix(df: DataFrame) -> DataFrame:
    """First letter W or L, only when the table has no ``is_win`` yet."""
    if "is_win" in df.columns:
        return df
    text = _strip(col("Result"))
    win = F.when(text.startswith("W"), 1).when(text.startswith("L"), 0)
    return df.withColumn("is_win", win)


def win_from_points(df: DataFrame) -> DataFrame:
    return df.withColumn("is_win", flag(col("PTS") > col("PTS_Opp")))


def mixed_date(c: Column) -> Column:
    """Date from text whose format changes from row to row; unreadable text is null."""
    text = _strip(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def infinities_to_null(df: DataFrame) -> DataFrame:
    fix = {
        f.name: finite(col(f.name))
        for f in df.schema.fields
        if f.dataType.simpleString() in ("double", "float")
    }
    return df.withColumns(fix) if fix else df


def percents_to_fractions(df: DataFrame) -> DataFrame:
    """Every column whose name ends in % is read as a number and divided by 100."""
    fix = {c: col(c).try_cast("double") / 100 for c in df.columns if c.endswith("%")}
    return df.withColumns(fix) if fix else df


def height_inches(c: Column) -> Column:
    pattern = r"^\s*([+-]?\d+)\s*'\s*([+-]?\d+)\s*$"
    text = F.regexp_replace(c, '"', "")
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int")
    return (part(1) * 12 + part(2)).cast("double")


def clean_biometrics(df: DataFrame) -> DataFrame:
    check_required_columns(df, fixed.REQUIRED_BIOMETRICS, "biometrics")
    return df.withColumns(
        {"Height_Inches": height_inches(col("Height")), "Weight": col("Weight").try_cast("double")}
    )


def body_mass_index() -> Column:
    known = col("Weight").isNotNull() & (col("Height_Inches") > 0)
    return F.when(known, col("Weight") * 703 / (col("Height_Inches") * col("Height_Inches")))


def join_biometrics(games: DataFrame, bio: DataFrame) -> DataFrame:
    """Left join by player. No broadcast hint: the player table may be large, so Spark decides
    from its measured size, and splits a hot player when it sort-merges."""
    if {"Height_Inches", "Weight", "BMI"} <= set(games.columns):
        return games
    slim = bio.select("Player", "Height_Inches", "Weight")
    merged = games.join(slim, "Player", "left")
    if "BMI" not in merged.columns:
        merged = merged.withColumn("BMI", body_mass_index())
    return merged


def fanout_keys(bio: DataFrame, keys: Sequence[str] = ("Player",)) -> DataFrame:
    """Keys that would multiply rows in a left join on them."""
    return bio.groupBy(*keys).agg(F.count("*").alias("copies")).where(col("copies") > 1)


def double_triple_double(df: DataFrame) -> DataFrame:
    """Double flags per statistic, and the double-double and triple-double of the game."""
    stats = [s for s in fixed.DOUBLE_STATS if s in df.columns]
    numbers = {s: F.coalesce(col(s).try_cast("double"), F.lit(0.0)) for s in stats}
    flags = {f"{s}_double": flag(numbers[s] >= 10) for s in stats}
    count = total(flags.values())
    return df.withColumns(
        numbers
        | flags
        | {"double_double": flag(count >= 2), "triple_double": flag(count >= 3)}
    )


def double_audit(df: DataFrame) -> DataFrame:
    return df.agg(
        F.sum("double_double").alias("double_doubles"),
        F.sum("triple_double").alias("triple_doubles"),
        F.count(F.when((col("PTS") < 1) & (col("double_double") == 1), 1)).alias("without_points"),
    )


def clean_teams(raw: DataFrame) -> DataFrame:
    """Team table: dates, results, venue, infinities, percents."""
    check_required_columns(raw, fixed.REQUIRED_TEAMS, "teams")
    df = raw.withColumn("Date", mixed_date(col("Date")))
    df = parse_results(df, scores=False).withColumn("is_home", situation.is_home())
    return percents_to_fractions(infinities_to_null(df))


def clean_games(raw: DataFrame) -> DataFrame:
    """Player table: as the team table, with scores, starters and double-doubles."""
    check_required_columns(raw, fixed.REQUIRED_GAMES, "games")
    df = raw.withColumn("Date", mixed_date(col("Date")))
    df = parse_results(df).withColumns(
        {"is_home": situation.is_home(), "is_started": situation.is_starter()}
    )
    return double_triple_double(percents_to_fractions(infinities_to_null(df)))


def load_tables(games: DataFrame, bio: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned games joined to biometrics, and cleaned teams."""
    return join_biometrics(clean_games(games), clean_biometrics(bio)), clean_teams(teams)


def plausible_points(df: DataFrame, target: str = "PTS") -> DataFrame:
    return df.where(col(target).between(*fixed.TEAM_POINTS_RANGE))


def plausible_totals(df: DataFrame, features: Sequence[str], target: str, at_least: int = 10) -> DataFrame:
    """Finite features and a total in range; raises when fewer than ``at_least`` rows stay."""
    keep = col(target).between(*fixed.TOTAL_POINTS_RANGE)
    for f in features:
        keep = keep & finite(col(f).cast("double")).isNotNull()
    out = df.where(keep)
    if out.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} valid rows")
    return out


def recent_days(df: DataFrame, days: int, date: str = "Date") -> DataFrame:
    newest = df.agg(F.max(date).alias("_newest"))
    return (
        with_scalar(df, newest)
        .where(col(date) >= F.date_sub(col("_newest"), days))
        .drop("_newest")
    )


def only_entity(df: DataFrame, value, key: str = "Player") -> DataFrame:
    return df.where(col(key) == value)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
