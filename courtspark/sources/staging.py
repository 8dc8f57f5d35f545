"""Tables written once into the shared folder of the cluster.

A written table cuts lineage and survives lost executors. The folder is the one named by
``spark.checkpoint.dir``. A session within one process may leave it unset; on a cluster it is
required.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Lines of one written text file: a compressed file is read by one task.
FILE_LINES = 200_000

# Used where nothing is set and driver and executors are one process.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def staging_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` and return the written table."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_lines(lines: DataFrame, label: str = "lines") -> str:
    """Write one text column as compressed text files and return their folder."""
    folder = f"{staging_folder(lines.sparkSession)}/{label}-{uuid.uuid4().hex}"
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).text(folder)
    return folder
