"""Global order without a one-task window: row index, running totals, average ranks, quantiles.

The large path sorts by range (Spark samples the bounds, so a hot value is split by the rest
of the sort key), writes the result once, and adds per-partition offsets. Written, because the
sampled bounds must be the same for the offsets and for the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, with_scalar
from courtspark.plans.sizes import TASK_ROWS, even_parts, fits_one_task, row_count
from courtspark.sources.staging import stage

_MID, _PART, _AT, _N = "_sorted_id", "_sorted_part", "_sorted_at", "_sorted_n"
_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def _sorted_table(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Range-sorted copy with the partition number and the position inside it."""
    ranged = df.repartitionByRange(*([] if parts is None else [parts]), *order).sortWithinPartitions(*order)
    staged = stage(ranged.withColumn(_MID, F.monotonically_increasing_id()), "sorted")
    return staged.withColumn(_PART, F.shiftright(_MID, _PART_BITS)).withColumn(
        _AT, col(_MID) - F.shiftleft(col(_PART), _PART_BITS)
    )


def _offsets(parts: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions. One row per partition, so one task is enough."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        _PART, *[F.coalesce(F.sum(col(s)).over(before), F.lit(0)).alias(s) for s in sums]
    )


def row_index(
    df: DataFrame, order: Sequence[Column], name: str = "row_ix", limit: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add the 0-based position of every row in ``order``. The order must be total.

    ``rows`` is the number of rows of ``df``, if known."""
    if fits_one_task(df, limit, rows):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    parts = None if rows is None else even_parts(df.sparkSession, rows, TASK_ROWS if limit is None else limit)
    rows = _sorted_table(df, order, parts)
    offsets = _offsets(rows.groupBy(_PART).agg(F.count("*").alias(_N)), [_N])
    return (
        rows.join(F.broadcast(offsets), _PART)  # one row per partition
        .withColumn(name, col(_N) + col(_AT))
        .drop(_PART, _AT, _MID, _N)
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, str],
    limit: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums {new name: summed column} over the whole table.

    ``rows`` bounds the rows of ``df`` from above, if known; otherwise, or when the bound is too
    large, ``df`` is written once so that counting it does not work it out twice.
    """
    fits = rows is not None and fits_one_task(df, limit, rows)
    if not fits:
        df = stage(df, "totals")
    if fits or fits_one_task(df, limit):
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(col(c)).over(upto).alias(n) for n, c in sums.items()])
    rows = _sorted_table(df, order)
    offsets = _offsets(
        rows.groupBy(_PART).agg(*[F.sum(col(c)).alias(f"_before_{n}") for n, c in sums.items()]),
        [f"_before_{n}" for n in sums],
    )
    upto = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(offsets), _PART)  # one row per partition
        .select(
            *[col(c) for c in df.columns],
            *[
                (F.coalesce(F.sum(col(c)).over(upto), F.lit(0)) + col(f"_before_{n}")).alias(n)
                for n, c in sums.items()
            ],
        )
    )


def value_ranks(
    df: DataFrame, column: str, limit: int | None = None, rows: int | None = None
) -> DataFrame:
    """Distinct non-null values with count ``n``, smallest rank ``low`` and largest rank ``high``.

    ``rows`` bounds the distinct values from above, if known.
    """
    rows = row_count(df) if rows is None else rows
    counted = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, [col(column).asc()], {"high": "n"}, limit, rows)
    return ranked.withColumn("low", col("high") - col("n") + 1)


def average_rank_share(
    df: DataFrame, column: str, name: str, limit: int | None = None, rows: int | None = None
) -> DataFrame:
    """Average rank divided by the number of non-null values: ties share the middle rank.

    ``percent_rank`` has another definition and needs a window over the whole table; here the
    rank is computed once per distinct value and joined back.
    """
    ranks = value_ranks(df, column, limit, rows)
    size = ranks.agg(F.sum("n").alias("_size"))
    share = with_scalar(ranks, size).select(
        col(column).alias("_value"), ((col("low") + col("high")) / 2 / col("_size")).alias(name)
    )
    return df.join(share, col(column) == col("_value"), "left").drop("_value")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    limit: int | None = None,
    rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, as numbers on the driver.

    Up to ``limit`` values (rows times columns) the built-in ``percentile`` is used; its state grows
    with the distinct values of all columns. Beyond that, brackets around all quantiles are narrowed
    together by approximate quantiles and exact counts, with nothing shuffled but one row per task,
    until few distinct values are left inside; their ranks are found in Spark, and only the values
    at the wanted ranks reach the driver.
    """
    rows = row_count(df) if rows is None else rows
    if fits_one_task(df, limit, rows * len(columns)):
        row = df.agg(
            *[
                F.percentile(col(c).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
                .alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {
            c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
            for i, c in enumerate(columns)
        }
    found = _narrowed_quantiles(df, columns, probs, BRACKET_ROWS if limit is None else limit)
    return {c: [found[c, p] for p in probs] for c in columns}


BRACKET_ROWS = 100_000  # rows of one bracket that one task may sort
_ACCURACY, _ROUNDS = 1000, 8


@dataclass
class _Bracket:
    """Values in [low, high]; ``below`` rows lie under it and ``inside`` rows in it."""

    column: str
    low: float
    high: float
    below: int
    inside: int
    rank: int  # 1-based rank of the lower neighbour of the quantile
    part: float  # share of the way to the next rank
    stuck: bool = False

    @property
    def last_rank(self) -> int:
        return self.rank + (1 if self.part > 0 else 0)

    def hit(self, low, high) -> Column:
        return col(self.column).between(F.lit(low), F.lit(high))


def _narrowed_quantiles(df, columns, probs, few) -> dict[tuple[str, float], float | None]:
    values = stage(df.select(*[col(c).cast("double").alias(c) for c in columns]), "values")
    ends = values.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(col(c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    brackets: dict[tuple[str, float], _Bracket] = {}
    out: dict[tuple[str, float], float | None] = {}
    for i, c in enumerate(columns):
        n = ends[f"n{i}"]
        for p in probs:
            if n == 0:
                out[c, p] = None
                continue
            place = p * (n - 1)
            brackets[c, p] = _Bracket(
                c, ends[f"a{i}"], ends[f"b{i}"], 0, n, int(place) + 1, place - int(place)
            )
    for _ in range(_ROUNDS):
        wide = [b for b in brackets.values() if b.inside > few and b.low < b.high and not b.stuck]
        if not wide:
            break
        _narrow(values, wide)
    exact = {k: b for k, b in brackets.items() if b.inside > few and b.low < b.high}
    for key, b in exact.items():
        ranks = value_ranks(values.where(b.hit(b.low, b.high)), b.column, few)
        out[key] = _pick(b, lambda r, t=ranks, b=b: _value_at(t, b.column, r))
    return out | _finish(values, {k: b for k, b in brackets.items() if k not in exact})


def _narrow(values: DataFrame, wide: Sequence[_Bracket]) -> None:
    """One approximate pass for new ends, one exact pass for the counts; a miss keeps the old."""
    slack = 2.0 / _ACCURACY
    shares = [
        (
            max(0.0, (b.rank - b.below) / b.inside - slack),
            min(1.0, (b.last_rank - b.below) / b.inside + slack),
        )
        for b in wide
    ]
    near = values.agg(
        *[
            F.percentile_approx(
                F.when(b.hit(b.low, b.high), col(b.column)), [lo, hi], F.lit(_ACCURACY)
            ).alias(f"e{i}")
            for i, (b, (lo, hi)) in enumerate(zip(wide, shares, strict=True))
        ]
    ).first()
    counts = values.agg(
        *[F.count(F.when(col(b.column) < near[f"e{i}"][0], 1)).alias(f"u{i}") for i, b in enumerate(wide)],
        *[F.count(F.when(b.hit(*near[f"e{i}"]), 1)).alias(f"n{i}") for i, b in enumerate(wide)],
    ).first()
    for i, b in enumerate(wide):
        below, inside = counts[f"u{i}"], counts[f"n{i}"]
        if below < b.rank and below + inside >= b.last_rank and inside < b.inside:
            b.low, b.high = near[f"e{i}"]
            b.below, b.inside = below, inside
        else:
            b.stuck = True


def _pick(b: _Bracket, at) -> float:
    low = at(b.rank - b.below)
    return low if b.part == 0 else low + (at(b.rank + 1 - b.below) - low) * b.part


def _value_at(ranks: DataFrame, column: str, rank: int) -> float:
    return ranks.where((col("low") <= rank) & (col("high") >= rank)).select(col(column)).first()[0]


def _finish(values: DataFrame, brackets: Mapping) -> dict[tuple[str, float], float]:
    """Values at the wanted ranks of all remaining brackets, from one pass; at most two per bracket."""
    out = {k: b.low for k, b in brackets.items() if b.low == b.high}
    left = {k: b for k, b in brackets.items() if k not in out}
    if not left:
        return out
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("b"),
                F.when(b.hit(b.low, b.high), col(b.column)).alias("x"),
                F.lit(b.rank - b.below).alias("first"),
                F.lit(b.last_rank - b.below).alias("last"),
            )
            for i, b in enumerate(left.values())
        ]
    )
    counted = values.select(F.inline(items)).where(col("x").isNotNull()).groupBy("b", "first", "last", "x").count()
    upto = F.sum("count").over(Window.partitionBy("b").orderBy("x"))  # at most BRACKET_ROWS values
    ranked = counted.withColumn("high", upto).withColumn("low", col("high") - col("count") + 1)
    wanted = ranked.where("first BETWEEN low AND high OR last BETWEEN low AND high")
    tables: dict[int, list] = {}
    for r in wanted.collect():
        tables.setdefault(r["b"], []).append((r["low"], r["high"], r["x"]))
    for i, (key, b) in enumerate(left.items()):

        def at(rank: int, table=tables[i]) -> float:
            return next(x for low, high, x in table if low <= rank <= high)

        out[key] = _pick(b, at)
    return out
