"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from courtspark.operators.markets import best_value_bets


def write_value_bets(
    edges: DataFrame, path: str, include_low_confidence: bool = False, min_confidence: float | None = None
) -> None:
    """The 50 best value bets as CSV with a header."""
    if min_confidence is None:
        min_confidence = 0.94 if include_low_confidence else 0.96
    bets = best_value_bets(edges, min_confidence, 0.03, 50)
    bets.write.option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as JSON lines; missing fields are written as null."""
    df.write.option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
