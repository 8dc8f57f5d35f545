"""A training corpus from raw documents: five stages, each written as Parquet before the next.

Documents of low quality and toxic ones go, one document of every near-duplicate group stays (the one
with the smallest id), documents that hold benchmark passages go, and the rest is encoded. Every stage
reads all rows that its predecessor kept, and all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.llm import decontamination, ngram_join, pieces, quality, toxicity
from courtspark.llm.common import column, stage, table, without


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group stays: the one with the smallest id, rows without an id last; of rows that
    repeat an id, the first one of the staged table. Texts without words stay. The kept rows are listed as
    one bit each, so that texts meet the list where they are and are not shuffled."""
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join.jaccard_components(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    first = F.min(F.struct("unnamed", "doc_id", "__row")).alias("first")
    kept = groups.join(ids, "__row").groupBy("component_id").agg(first).select("first.__row")
    bits = F.expr("bit_or(shiftleft(1L, cast(__row & 63 AS int)))").alias("__bits")
    kept = stage(kept.groupBy(F.shiftright("__row", 6).alias("__word")).agg(bits), "kept")
    kept = F.broadcast(kept) if kept.count() <= ngram_join.LISTED else kept
    found = rows.withColumn("__word", F.shiftright("__row", 6)).join(kept, "__word")
    return found.where("shiftright(__bits, cast(__row & 63 AS int)) & 1 = 1").select(*[column(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).drop("row_hash")


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Learned models and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
