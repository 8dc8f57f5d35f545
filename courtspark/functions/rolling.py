"""History columns over a window of one key: all of them leave the current row out."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from courtspark.functions.scalars import clip, col, fill, flag, ratio
from courtspark.plans.history import last, mean_of, std_of, sum_of, var_of

_OPS = {"mean": mean_of, "std": std_of, "sum": sum_of, "var": var_of}


def rolled(w: WindowSpec, x: Column, n: int, op: str = "mean", at_least: int = 1) -> Column:
    """``op`` over the n rows before the current one, null under ``at_least`` known values."""
    return _OPS[op](x, last(w, n), at_least)


def days_rest(w: WindowSpec, date: str = "Date") -> Column:
    return F.coalesce(F.datediff(col(date), F.lag(col(date)).over(w)), F.lit(2))


def consistency(w: WindowSpec, x: Column, n: int = 5) -> Column:
    return 1 / (fill(rolled(w, x, n, "std", 2), 1.0) + 1)


def minutes_stability(w: WindowSpec, x: Column | None = None) -> Column:
    x = col("MP") if x is None else x
    spread = fill(rolled(w, x, 5, "std"), 1.0)
    return 1 / (spread / (fill(rolled(w, x, 5), 1.0) + 0.1) + 1)


def volatility(w: WindowSpec, x: Column) -> Column:
    return rolled(w, x, 5, "std") / (rolled(w, x, 5) + 1)


def stability_ten(w: WindowSpec, x: Column) -> Column:
    cv = rolled(w, x, 10, "std", 3) / (rolled(w, x, 10, "mean", 3) + 1e-6)
    return 1 / (cv + 0.01)


def win_rate(w: WindowSpec, n: int, default: float = 0.5, name: str = "is_win") -> Column:
    return fill(rolled(w, col(name), n), default)


def recent_wins(w: WindowSpec) -> Column:
    return fill(rolled(w, col("is_win"), 3, "sum"), 1.5)


def wins_in_last5(w: WindowSpec) -> Column:
    """Wins among the last five known results."""
    return fill(rolled(w, F.when(col("is_win").isNotNull(), flag(col("is_win") == 1)), 5, "sum"), 2.5)


def venue_rate(w: WindowSpec, shift: float) -> Column:
    return clip(win_rate(w, 10) + shift, 0.0, 1.0)


def _back(w: WindowSpec, x: Column, k: int) -> Column:
    return fill(F.lag(x, k).over(w), 0.0)


def _earlier_rows(w: WindowSpec) -> Column:
    """How many of the four rows before exist."""
    return F.count(F.lit(1)).over(last(w, 4))


def weighted_rate(w: WindowSpec, x: Column) -> Column:
    """Five shifted flags, the missing first one taken as 0, weights rising from .5 to 1."""
    size = _earlier_rows(w) + 1
    out = None
    for k in range(1, 6):
        weights = [1.0] if k == 1 else [0.5 + 0.5 * i / (k - 1) for i in range(k)]
        value = F.lit(0.0)
        for age, weight in enumerate(reversed(weights)):
            value = value + _back(w, x, age + 1) * (weight / sum(weights))
        out = F.when(size == k, value) if out is None else out.when(size == k, value)
    return out


def rate_momentum(w: WindowSpec, x: Column) -> Column:
    """Mean of the three newest shifted flags minus the mean of the three from two rows before.

    Null in the first two rows, where the older group is empty.
    """
    earlier = _earlier_rows(w)
    newer = (_back(w, x, 1) + _back(w, x, 2) + _back(w, x, 3)) / F.least(earlier + 1, F.lit(3))
    older = (_back(w, x, 3) + _back(w, x, 4) + _back(w, x, 5)) / F.when(earlier > 1, earlier - 1)
    return newer - older


def stat_momentum(w: WindowSpec, x: Column) -> Column:
    """Rows -3..-1 against rows -5..-3; row -3 belongs to both."""
    older = F.avg(x).over(w.rowsBetween(-5, -3))
    return fill(rolled(w, x, 3), 0.0) - fill(older, 0.0)


def trend(w: WindowSpec, x: Column, short: int = 3, long: int = 10) -> Column:
    return rolled(w, x, short) - rolled(w, x, long)


def relative_trend(w: WindowSpec, x: Column) -> Column:
    return trend(w, x) / (rolled(w, x, 10) + 1)


def scoring_momentum(w: WindowSpec, x: Column) -> Column:
    return ratio(trend(w, x), rolled(w, x, 10))


def defensive_momentum(w: WindowSpec, x: Column) -> Column:
    return ratio(rolled(w, x, 10) - rolled(w, x, 3), rolled(w, x, 10))


def confidence_momentum(w: WindowSpec, name: str = "is_win") -> Column:
    """Change of the five-game rate between the two rows before the current one."""
    x = col(name)
    one = fill(F.avg(x).over(w.rowsBetween(-6, -2)), 0.5)
    two = fill(F.avg(x).over(w.rowsBetween(-7, -3)), 0.5)
    return F.when(F.lag(F.lit(1), 2).over(w).isNotNull(), one - two).otherwise(0.0)


def above_history(w: WindowSpec, x: Column, n: int) -> Column:
    """Compares the current game: mark as a same-game column."""
    return flag(x > fill(rolled(w, x, n), 0.0))


def scoring_pressure(w: WindowSpec, x: Column) -> Column:
    average = rolled(w, x, 10)
    return (x - average) / (average + 1e-6)


def versatility(pts: Column, trb: Column, ast: Column) -> Column:
    return 0.4 * pts + 0.35 * trb + 0.25 * ast


def double_potential(pts: Column, trb: Column, ast: Column) -> Column:
    sums = [pts + trb, pts + ast, trb + ast]
    known = pts.isNotNull() & trb.isNotNull() & ast.isNotNull()
    return F.when(known, F.greatest(*sums))


def last_result(w: WindowSpec, name: str, default: float) -> Column:
    return fill(F.lag(col(name)).over(w), default)


def revenge(x: Column, lost: float, won: float) -> Column:
    return F.when(x == 0, lost).when(x == 1, won).otherwise(0.0)
