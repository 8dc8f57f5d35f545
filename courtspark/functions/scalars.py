"""Small column helpers with one null rule: missing in, missing out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by name; the back-quotes allow names such as ``FG%`` and ``3PA``."""
    return F.col(f"`{name}`")


def flag(condition: Column) -> Column:
    """1 or 0; a missing comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def clip(x: Column, low, high) -> Column:
    """Limit to [low, high]. ``least``/``greatest`` would turn null into a bound."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def fill(x: Column, value: float) -> Column:
    return F.coalesce(x.cast("double"), F.lit(float(value)))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null, not an error, for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def finite(x: Column) -> Column:
    """NaN and both infinities become null."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are known; null when one of them is constant.

    The built-in ``corr`` raises for a constant column in ANSI mode.
    """
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def total(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def steps(x: Column, table: Iterable[tuple[float, float]], otherwise: float) -> Column:
    """First matching ``x > limit`` of (limit, value) pairs given from high to low."""
    out = None
    for limit, value in table:
        out = F.when(x > limit, value) if out is None else out.when(x > limit, value)
    return out.otherwise(otherwise)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table, as a scalar subquery: no join at all."""
    packed = one_row.select(F.struct(*[col(c) for c in one_row.columns]).alias("_s")).scalar()
    return df.withColumns({c: packed.getField(c) for c in one_row.columns})
