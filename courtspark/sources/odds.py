"""Odds files and saved odds snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.operators.loading import check_required_columns, mixed_date

OUTCOME = "struct<name: string, team: string, point: double, price: double>"
SNAPSHOT_SCHEMA = (
    "success boolean, last_update string, data array<struct<commence_time: string, "
    "home_team: string, away_team: string, bookmakers: array<struct<key: string, "
    f"markets: array<struct<key: string, outcomes: array<{OUTCOME}>>>>>>>"
)
ODDS_COLUMNS = ("event_id", "target", "line", "side", "bookmaker", "price", "snapshot")


def _json_form(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a JSON file holds snapshot documents, and whether a document goes over several lines.

    Told from the first line that is not empty; a line that is no JSON object begins a longer document.
    """
    first = spark.read.text(path).where("trim(value) <> ''").first()
    if first is None:
        return False, False
    try:
        names = set(json.loads(first["value"]))
        several = not names or not all(isinstance(n, str) for n in names)
    except (ValueError, TypeError):
        names, several = set(), True
    if several:
        names = set(spark.read.option("multiLine", True).json(path).columns)
    return "data" in names, several


def read_odds_document(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents of a JSON file, one per line or one per file over several lines.

    ``operators.markets.explode_props`` flattens them. A malformed document is an error."""
    nested, several = _json_form(spark, path)
    if not nested:
        raise ValueError(f"{path} holds no snapshot document: it has no field 'data'")
    reader = spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "FAILFAST")
    return reader.option("multiLine", several).json(path)


def read_odds_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Long odds from CSV or JSON, told apart by the extension unless ``kind`` is given.

    JSON may have one record per line, or one array or record over several lines; a malformed record
    is an error. Snapshot documents are nested and are told to ``read_odds_document``."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif kind == "json":
        nested, several = _json_form(spark, path)
        if nested:
            raise ValueError(f"{path} holds snapshot documents: use read_odds_document and explode_props")
        if several:
            raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
        else:
            raw = spark.read.schema(", ".join(f"`{c}` string" for c in ODDS_COLUMNS)).option("mode", "FAILFAST").json(path)
    else:
        raise ValueError(f"unknown odds format {kind!r}: use csv or json")
    check_required_columns(raw, ODDS_COLUMNS, "odds")
    return raw.select(
        col("event_id").try_cast("long").alias("event_id"),
        "target",
        col("line").try_cast("double").alias("line"),
        F.lower("side").alias("side"),
        "bookmaker",
        col("price").try_cast("double").alias("price"),
        F.to_date(mixed_date(col("snapshot"))).alias("snapshot"),
    )


#: Points and prices come as numbers or as text, and are kept as they are until they are read.
DRIFTING_SCHEMA = SNAPSHOT_SCHEMA.replace("point: double, price: double", "point: variant, price: variant")
_CORRUPT = "_corrupt"


def check_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents out of JSON text, and ``reason``: null, or why a text is none. Other columns stay, the
    text too. Texts of white space are no documents and are left out.

    A cut or malformed text, one whose fields have other types, and one without a list of games is rejected."""
    kept = texts.where(F.trim(col(column)) != "")
    schema = f"{DRIFTING_SCHEMA}, {_CORRUPT} string"
    parsed = kept.withColumn("_d", F.from_json(col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    reason = F.when(col("_d").isNull() | col("_d")[_CORRUPT].isNotNull(), "malformed").when(col("_d")["data"].isNull(), "no games")
    return parsed.select(*texts.columns, reason.alias("reason"), "_d.success", "_d.last_update", "_d.data")


def good_documents(checked: DataFrame) -> DataFrame:
    """The documents that were not rejected."""
    return checked.where(col("reason").isNull()).drop("reason")


def rejected_documents(checked: DataFrame, column: str = "value") -> DataFrame:
    """file, reason and text of what was rejected."""
    return checked.where(col("reason").isNotNull()).select("file", "reason", col(column).alias("document"))


def read_snapshot_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of saved snapshot files (value), with the file each came from."""
    return spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"))


def read_snapshots(spark: SparkSession, folder: str, quarantine: str | None = None) -> DataFrame:
    """Saved snapshot documents, one per line, with the file each came from.

    With ``quarantine`` rejected texts are appended to that table, with their file and reason; without it the first
    one is an error. None is ever left out silently."""
    checked = check_documents(read_snapshot_texts(spark, folder))
    if quarantine is not None:
        rejected_documents(checked).write.mode("append").parquet(quarantine)
        return good_documents(checked).select("success", "last_update", "data", "file")
    told = F.raise_error(F.concat(F.lit("rejected snapshot in "), col("file"), F.lit(": "), col("reason")))
    data = F.when(col("reason").isNull(), col("data")).otherwise(told.cast(checked.schema["data"].dataType))
    return checked.select("success", "last_update", data.alias("data"), "file")


def parse_snapshots(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents out of JSON text."""
    return texts.select(F.from_json(col(column), SNAPSHOT_SCHEMA).alias("_d")).select("_d.*")


def fresh_snapshots(snapshots: DataFrame, as_of, hours: float = 12) -> DataFrame:
    """Snapshots younger than ``hours`` at the time ``as_of``."""
    updated = F.try_to_timestamp(col("last_update"))
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(updated)
    return snapshots.where(age < F.lit(int(hours * 3_600_000_000)))
