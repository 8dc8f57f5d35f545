"""Size checks that decide between a one-task plan and a split one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that one task may sort for a single key or for a whole small table.
TASK_ROWS = 2_000_000


# A part is never planned for fewer rows than this, however small the limit.
LEAST_PART_ROWS = 10_000


def even_parts(spark: SparkSession, rows: int, limit: int) -> int:
    """Parts of half as many rows as a task may sort, one per core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-2 * rows // max(limit, LEAST_PART_ROWS)))


def row_count(df: DataFrame) -> int:
    """Counted anew at every call: the data behind a plan can change within a session."""
    return df.count()


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key, by a map-side combined count over the key columns only."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def fits_one_task(df: DataFrame, limit: int | None = None, rows: int | None = None) -> bool:
    """Whether the whole table may be sorted in one task; ``rows`` saves the count when known."""
    rows = row_count(df) if rows is None else rows
    return rows <= (TASK_ROWS if limit is None else limit)


def keys_fit_one_task(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, rows: int | None = None
) -> bool:
    """Whether every key may be sorted in one task. A small table needs no count per key."""
    limit = TASK_ROWS if limit is None else limit
    return fits_one_task(df, limit, rows) or largest_key(df, keys) <= limit
