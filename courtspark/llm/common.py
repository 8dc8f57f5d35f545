"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.sources.staging import stage

__all__ = ["ascii_lower", "column", "handing_back", "row_hash", "small_batches", "without", "stage", "table"]

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col(f"`{name.replace('`', '``')}`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def row_hash(text: Column) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.isnull(text))


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all their columns, but for the rows of ``rejected`` (doc_id, row_hash)."""
    out = rejected.select(F.col("doc_id").alias("__rejected_id"), F.col("row_hash").alias("__rejected_hash")).distinct()
    out = stage(out, "rejected")
    same = docs[id_col].cast("long").eqNullSafe(out["__rejected_id"]) & (row_hash(docs[text_col]) == out["__rejected_hash"])
    return docs.join(out, same, "left_anti")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch: texts can be long, and a batch of the
    usual 10,000 would fill a worker's memory. A lower setting is kept."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def handing_back(run: Callable, done: Callable[[], None] = lambda: None) -> Callable:
    """The Arrow function ``run``; when a task ends, ``done`` is called and free memory goes back to the
    system. Workers live on, and what they hold adds to the memory of later stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            done()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none but in the GNU library
            if trim:
                trim(0)

    return task
