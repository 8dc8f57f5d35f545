"""History that goes on from a written state: a new day reads that state and its own rows, nothing else.

The state of a key is the tail of its last ``reach`` rows, which bounded frames look back on, and its
running totals so far. New rows are put behind the tails and get their columns by the same
:func:`~courtspark.plans.history.with_history`; totals are added. Rows that do not come after all
earlier rows of their key raise, since earlier results would be wrong.

Every state is a version in a folder of its own; the version's row in the log comes last, so a job that dies
half-way leaves the state as it was, and running it again gives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.plans.history import _AGG, Build, with_history
from courtspark.sources.staging import stage

_LOG = "version long, folder string, rows long, saved timestamp"
_NEW, _LAST = "_new_row", "_last_order"


class LateRows(ValueError):
    """Rows that come before, or together with, rows that the state already holds."""


@dataclass(frozen=True)
class History:
    """What is kept per key, and where. ``order`` must be unique within a key; ``running`` as in ``with_history``."""

    path: str
    keys: Sequence[str]
    order: Sequence[str]
    build: Build
    reach: int
    running: Mapping[str, tuple[str, Column]] | None = None
    task_rows: int | None = None

    # -- the written state

    def _log(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(_LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def state(self, spark: SparkSession) -> tuple[int, DataFrame, DataFrame] | None:
        """Version, tails and totals of the newest state."""
        log = self._log(spark)
        row = None if log is None else log.orderBy(F.desc("version")).first()
        if row is None:
            return None
        return row["version"], spark.read.parquet(f"{row['folder']}/tails"), spark.read.parquet(f"{row['folder']}/totals")

    def _save(self, version: int, tails: DataFrame, totals: DataFrame, rows: int) -> None:
        spark = tails.sparkSession
        folder = f"{self.path}/v{version}-{uuid.uuid4().hex}"
        tails.write.parquet(f"{folder}/tails")
        totals.write.parquet(f"{folder}/totals")
        row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("saved"))
        row.write.mode("append").json(f"{self.path}/log")

    # -- the steps

    def _tails(self, rows: DataFrame) -> DataFrame:
        """The last ``reach`` rows of every key. Spark keeps that many per key and task before the shuffle."""
        newest = Window.partitionBy(*[col(k) for k in self.keys]).orderBy(*[col(c).desc() for c in self.order])
        return rows.withColumn("_place", F.row_number().over(newest)).where(col("_place") <= self.reach).drop("_place")

    def _totals(self, rows: DataFrame) -> DataFrame:
        running = self.running or {}
        last = F.max(F.struct(*[col(c) for c in self.order])).alias(_LAST)
        return rows.groupBy(*[col(k) for k in self.keys]).agg(last, *[_AGG[kind](x).alias(f"_c_{n}") for n, (kind, x) in running.items()])

    def _same_key(self, left: DataFrame, right: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & left[f"`{k}`"].eqNullSafe(right[f"`_k_{k}`"])
        return out

    def _check(self, new: DataFrame, totals: DataFrame) -> None:
        """Raises when a new row is not after its key's last row. One row per key is looked at."""
        first = new.groupBy(*[col(k) for k in self.keys]).agg(F.min(F.struct(*[col(c) for c in self.order])).alias("_first_order"))
        late = first.join(totals, self._same_key(first, totals)).where(col("_first_order") <= col(_LAST))
        found = late.select(*[col(k) for k in self.keys], "_first_order", _LAST).limit(3).collect()
        if found:
            raise LateRows(f"rows come after later ones, e.g. {[tuple(r) for r in found]}")

    def start(self, df: DataFrame) -> DataFrame:
        """History columns of a first lot of rows, all of them; writes version 1. Raises if there is a state."""
        if self.state(df.sparkSession) is not None:
            raise ValueError(f"{self.path} has a state already")
        df = stage(df, "lot")
        rows = df.count()
        out = stage(with_history(df, self.keys, self.order, self.build, self.reach, self.running, self.task_rows, rows), "history")
        self._save(1, self._tails(df), self._totals(df), rows)
        return out

    def extend(self, new: DataFrame) -> DataFrame:
        """History columns of new rows, which all come after the earlier ones of their key; writes the next version."""
        spark = new.sparkSession
        found = self.state(spark)
        if found is None:
            raise ValueError(f"{self.path} has no state yet")
        version, tails, totals = found
        columns = tails.columns
        missing = [c for c in columns if c not in new.columns]
        if missing:
            raise ValueError(f"columns of the state that the new rows don't have: {missing}")
        new = stage(new.select(*[col(c).cast(tails.schema[c].dataType).alias(c) for c in columns]), "lot")
        totals = totals.withColumnsRenamed({k: f"_k_{k}" for k in self.keys})
        self._check(new, totals)

        # only the tails of keys that have new rows are read on
        touched = new.select(*[col(k).alias(f"_k_{k}") for k in self.keys]).distinct()
        near = tails.join(touched, self._same_key(tails, touched), "left_semi").withColumn(_NEW, F.lit(False))
        both = stage(near.unionByName(new.withColumn(_NEW, F.lit(True))), "both")
        running = {n: (kind, F.when(col(_NEW), x)) for n, (kind, x) in (self.running or {}).items()}
        made = with_history(both, self.keys, self.order, self.build, self.reach, running, self.task_rows).where(_NEW)
        if running:
            made = made.join(totals.drop(_LAST), self._same_key(made, totals), "left")
        names = [n for n in made.columns if n not in (*columns, _NEW) and not n.startswith(("_c_", "_k_"))]
        out = stage(made.select(*[col(c) for c in columns], *[self._added(n).alias(n) for n in names]), "history")

        untouched = tails.join(touched, self._same_key(tails, touched), "left_anti")
        sums = self._totals(new)
        old = totals.withColumnsRenamed({f"_k_{k}": k for k in self.keys})
        merged = old.unionByName(sums).groupBy(*[col(k) for k in self.keys]).agg(
            F.max(_LAST).alias(_LAST), *[(F.max if kind == "max" else F.sum)(f"_c_{n}").alias(f"_c_{n}") for n, (kind, _) in running.items()]
        )
        self._save(version + 1, untouched.unionByName(self._tails(both.drop(_NEW))), merged, new.count())
        return out

    def _added(self, name: str) -> Column:
        """A history column; running totals take in what the state carries."""
        if name not in (self.running or {}):
            return col(name)
        inner, carried = col(name), col(f"_c_{name}")
        kind = self.running[name][0]
        if kind == "max":
            return F.greatest(inner, carried)
        if kind == "count":
            return F.coalesce(inner, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.coalesce(inner + carried, inner, carried)

    def apply(self, df: DataFrame) -> DataFrame:
        """``start`` or ``extend``, whichever is due."""
        return self.start(df) if self.state(df.sparkSession) is None else self.extend(df)

    def at(self, path: str) -> History:
        return replace(self, path=path)
