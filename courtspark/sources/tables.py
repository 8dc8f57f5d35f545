"""CSV tables of games, teams and biometrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtspark.functions.scalars import col
from courtspark.operators import loading

# --- fixed values: columns read as text; every other column is a number -----------------------
TEXT = ("Player", "Team", "Opp", "Result", "Away", "GS", "Date", "Height", "Weight", "mapped_pos")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV without schema inference: one pass, numbers by name, unreadable ones null.

    Percent columns stay text, since the loader reads them itself.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(
        *[
            col(c) if c in TEXT or c.endswith("%") else col(c).try_cast("double").alias(c)
            for c in raw.columns
        ]
    )


def load_data(spark: SparkSession, games: str, biometrics: str, teams: str) -> tuple[DataFrame, DataFrame]:
    """Games joined to biometrics, and teams, cleaned."""
    return loading.load_tables(
        read_csv(spark, games), read_csv(spark, biometrics), read_csv(spark, teams)
    )


def load_teams(spark: SparkSession, teams: str) -> DataFrame:
    return loading.clean_teams(read_csv(spark, teams))
