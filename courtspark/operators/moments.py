"""Linear models from sums of products: one scan of the rows gives every fold's fit.

Rows belong to cells (elementary ranges between fold bounds, or fold times sample share). One aggregate adds up, per
cell, the products of all pairs of [1, x m, m, y], where m says whether x is known. A fit's sums are those of its cells; the
means that fill missing values follow from them too, and so does the fit, on a matrix as wide as the
features. A second scan scores every row with all the fits it belongs to.

Penalties are those of standardised features (population deviation): ridge minimises |y - Xb|^2 + alpha |b|^2, the elastic
net |y - Xb|^2 / 2n + alpha (mix |b|_1 + (1 - mix) |b|^2 / 2).
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, finite, ratio
from courtspark.operators import evaluation
from courtspark.plans.ordering import row_index
from courtspark.sources.staging import stage

RIDGE, ELASTIC, MIX = 50.0, 10.0, 0.5  # fixed values: the penalties of the points model
ROUNDS, PRECISION = 10_000, 1e-12
BUCKETS = 16**7


@dataclass(frozen=True)
class Linear:
    """Intercept, a coefficient and a fill per feature."""

    intercept: float
    coefficients: Mapping[str, float]
    fills: Mapping[str, float]

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for name, b in self.coefficients.items():
            if b:
                out = out + F.coalesce(finite(col(name).cast("double")), F.lit(self.fills[name])) * b
        return out


@dataclass(frozen=True)
class Moments:
    """Sums of products of [1, x m of every feature, m of the features that have gaps, y]; they add up."""

    features: Sequence[str]
    gaps: Sequence[str]
    sums: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.features, self.gaps, self.sums + other.sums)

    def filled(self) -> tuple[dict[str, float], np.ndarray]:
        """Means of the known values, and the sums of [1, x, y] with gaps filled by them."""
        p, q = len(self.features), len(self.gaps)
        fills, change = {}, np.zeros((p + 2, 2 + p + q))
        change[0, 0] = change[p + 1, 1 + p + q] = 1
        for j, name in enumerate(self.features):
            change[1 + j, 1 + j] = 1
            known = 0 if name not in self.gaps else 1 + p + list(self.gaps).index(name)
            count = self.sums[known, known]
            fills[name] = float(self.sums[0, 1 + j] / count) if count else 0.0
            if known:
                change[1 + j, 0], change[1 + j, known] = fills[name], -fills[name]
        return fills, change @ self.sums @ change.T

    def _standard(self):
        fills, sums = self.filled()
        n = sums[0, 0]
        mean = sums[0, 1:] / n
        cov = sums[1:, 1:] / n - np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        usable = deviation > 1e-9 * np.maximum(1, np.abs(mean[:-1]))
        scale = np.where(usable, deviation, 1.0)
        inner = np.where(np.outer(usable, usable), cov[:-1, :-1] / np.outer(scale, scale), 0.0)
        return fills, n, mean, scale, inner, np.where(usable, cov[:-1, -1] / scale, 0.0)

    def _linear(self, fills, mean, scale, b) -> Linear:
        slope = b / scale
        return Linear(float(mean[-1] - slope @ mean[:-1]), dict(zip(self.features, slope.tolist(), strict=True)), fills)

    def ridge(self, alpha: float = RIDGE) -> Linear:
        fills, n, mean, scale, inner, outer = self._standard()
        b = np.linalg.solve(inner + np.eye(len(inner)) * max(alpha / n, 1e-12), outer) if len(inner) else outer
        return self._linear(fills, mean, scale, b)

    def elastic(self, alpha: float = ELASTIC, mix: float = MIX) -> Linear:
        """Coordinate descent on the matrix of products."""
        fills, _, mean, scale, inner, outer = self._standard()
        b = np.zeros(len(outer))
        for _ in range(ROUNDS):
            before = b.copy()
            for j in range(len(b)):
                pull = outer[j] - inner[j] @ b + inner[j, j] * b[j]
                b[j] = np.sign(pull) * max(abs(pull) - alpha * mix, 0) / (inner[j, j] + alpha * (1 - mix) or 1.0)
            if np.abs(b - before).max(initial=0) < PRECISION:
                break
        return self._linear(fills, mean, scale, b)


def cell_moments(df: DataFrame, features: Sequence[str], target: str, cell: str = "cell") -> dict[Hashable, Moments]:
    """Moments of every cell; ``df`` is written. The number of cells is the number of rows that reach the driver."""
    x = [finite(col(f).cast("double")) for f in features]
    counts = df.agg(F.count("*").alias("n"), *[F.count(v).alias(f"c{i}") for i, v in enumerate(x)]).first()
    gaps = [f for i, f in enumerate(features) if counts[f"c{i}"] < counts["n"]]
    known = [F.when(v.isNotNull(), 1.0).otherwise(0.0) for f, v in zip(features, x, strict=True) if f in gaps]
    z = [F.lit(1.0), *[F.coalesce(v, F.lit(0.0)) for v in x], *known, col(target).cast("double")]
    parts = df.select(col(cell), *[v.alias(f"z{i}") for i, v in enumerate(z)])
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    rows = parts.groupBy(cell).agg(*[F.sum(col(f"z{i}") * col(f"z{j}")).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for row in rows:
        sums = np.zeros((len(z), len(z)))
        for i, j in pairs:
            sums[i, j] = sums[j, i] = row[f"s{i}_{j}"]
        out[row[cell]] = Moments(list(features), gaps, sums)
    return out


def fit_cells(moments: Mapping[Hashable, Moments], cells: Sequence[Hashable], how: Callable[[Moments], Linear] = Moments.ridge) -> Linear:
    """The fit on all rows of some cells."""
    found = [moments[c] for c in cells if c in moments]
    if not found:
        raise ValueError("no rows to fit")
    total = found[0]
    for m in found[1:]:
        total = total + m
    return how(total)


def scored(df: DataFrame, fits: Mapping[tuple, tuple[Linear, Column]], names: Sequence[str]) -> DataFrame:
    """One row per row and fit that it belongs to: the columns ``names`` (the fit's key), role, y_true, y_pred. A fit comes
    with the row's role in it, null if it has none. One scan for all fits."""
    items = []
    for key, (linear, role) in fits.items():
        row = F.struct(*[F.lit(k).alias(n) for n, k in zip(names, key, strict=True)], role.alias("role"), linear.predict().alias("y_pred"))
        items.append(F.when(role.isNotNull(), row))
    return df.select(col("y").alias("y_true"), F.inline(F.array_compact(F.array(*items))))


def cell_r2(df: DataFrame, fits: Mapping[tuple, tuple[Linear, Column]], names: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """The columns ``names`` (a fit's key), role, n and r2 of every fit, whose roles depend on the columns ``cells`` alone.
    A row is scored with all the fits it belongs to, and its squared errors are added up in its cell: rows are never
    multiplied by fits, only cells are."""
    known = df.select(*[col(c) for c in cells], "y", *[finite(col(f).cast("double")).alias(f) for f in next(iter(fits.values()))[0].coefficients])
    error = [F.sum(F.when(role.isNotNull(), (linear.predict() - col("y")) ** 2)).alias(f"e{i}") for i, (linear, role) in enumerate(fits.values())]
    y = [F.count("y").alias("rows"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread")]
    sums = stage(known.groupBy(*cells).agg(*y, *error), "errors")
    items = []
    for i, (key, (_, role)) in enumerate(fits.items()):
        row = F.struct(*[F.lit(k).alias(n) for n, k in zip(names, key, strict=True)], role.alias("role"), col(f"e{i}").alias("error"))
        items.append(F.when(role.isNotNull(), row))
    each = sums.select("rows", "mean", "spread", F.inline(F.array_compact(F.array(*items)))).groupBy(*names, "role")
    n = F.sum("rows")
    between = F.sum(col("rows") * col("mean") ** 2) - F.sum(col("rows") * col("mean")) ** 2 / n
    made = each.agg(n.alias("n"), F.sum("error").alias("error"), (F.sum(col("rows") * col("spread")) + between).alias("total"))
    return made.select(*names, "role", "n", (1 - ratio(col("error"), col("total"))).alias("r2"))


# ------------------------------------------------------------------ plans of folds


def holdout(df: DataFrame, features: Sequence[str], models: Mapping[str, Callable[[Moments], Linear]]) -> DataFrame:
    """Metrics of each model on both parts. ``df`` has y and split, and is written."""
    moments = cell_moments(df, features, "y", "split")
    fits = {(n,): (fit_cells(moments, ["train"], how), col("split")) for n, how in models.items()}
    return evaluation.regression_metrics(scored(df, fits, ["model"]).withColumnRenamed("role", "split"), ["model", "split"])


def cross_validate(df: DataFrame, features: Sequence[str], order: Sequence[str], bounds: Sequence[tuple[int, int]], models: Mapping[str, Callable[[Moments], Linear]], limit: int | None = None) -> DataFrame:
    """fold, role, model and metrics. Fold i trains on the rows before ``bounds[i][0]`` in order and is validated on those
    from there to ``bounds[i][1]``. Missing values take the mean of the fold's own training rows."""
    edges = sorted({e for pair in bounds for e in pair})
    cell = F.lit(0)
    for e in edges:
        cell = cell + (col("_ix") >= e).cast("int")
    wanted = [c for c in dict.fromkeys([*order, "y", *features])]
    rows = row_index(df.select(*[col(c) for c in wanted]), [col(c) for c in order], "_ix", limit)
    rows = stage(rows.withColumn("cell", cell), "cells")
    moments = cell_moments(rows, features, "y")
    fits = {}
    for k, (end, stop) in enumerate(bounds):
        a, b = edges.index(end) + 1, edges.index(stop) + 1
        role = F.when(col("cell") < a, "train").when(col("cell") < b, "validation")
        for name, how in models.items():
            fits[k + 1, name] = fit_cells(moments, range(a), how), role
    return evaluation.regression_metrics(scored(rows, fits, ["fold", "model"]), ["fold", "role", "model"])


def drawn(key: Column, seed: int, start: int) -> Column:
    """A number below ``BUCKETS`` from seven hex digits of a seeded hash of the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), start, 7), 16, 10).cast("long")


def learning_curve(df: DataFrame, features: Sequence[str], how: Callable[[Moments], Linear] = Moments.ridge, sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, key: str = "game_id", seed: int = 42) -> DataFrame:
    """Train and validation R2 for nested shares of the training rows, mean and deviation over folds."""
    place = F.lit(0)
    for s in sorted(sizes):
        place = place + (drawn(col(key), seed, 9) >= int(s * BUCKETS)).cast("int")
    rows = df.select(col(key), "y", *[col(f) for f in features]).withColumns({"fold": drawn(col(key), seed, 1) % folds, "place": place})
    rows = stage(rows.withColumn("cell", col("fold") * 1000 + col("place")), "cells")
    moments = cell_moments(rows, features, "y")
    fits = {}
    for k in range(folds):
        for i, s in enumerate(sorted(sizes)):
            cells = [f * 1000 + j for f in range(folds) if f != k for j in range(i + 1)]
            role = F.when(col("fold") == k, "validation").when(col("place") <= i, "train")
            fits[float(s), k] = fit_cells(moments, cells, how), role
    each = cell_r2(rows, fits, ["size", "fold"], ["fold", "place"])
    return each.groupBy("size", "role").agg(F.avg("n").alias("rows"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))
