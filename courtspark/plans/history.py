"""History windows per key that stay safe when one key holds a large share of the rows.

Small keys use one plain window: one shuffle and one sort for all frames. When a size check
finds a key with more rows than a task should sort, the table is cut into blocks of equal
length along (key, order). Every block also receives the last ``reach`` rows before it, so
bounded frames see the same rows as in the plain window. Running totals over all earlier rows
take the block's own rows plus one carried row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.plans.ordering import row_index
from courtspark.plans.sizes import TASK_ROWS, even_parts, keys_fit_one_task, row_count

_IX, _BLOCK, _HOME, _OWN = "_row_ix", "_block", "_home_block", "_own_row"

Build = Callable[[WindowSpec], Mapping[str, Column]]


def last(window: WindowSpec, n: int) -> WindowSpec:
    """Frame of the n rows before the current one."""
    return window.rowsBetween(-n, -1)


def mean_of(x: Column, frame: WindowSpec, at_least: int = 1) -> Column:
    return _guard(F.avg(x).over(frame), x, frame, at_least)


def std_of(x: Column, frame: WindowSpec, at_least: int = 1) -> Column:
    return _guard(F.stddev_samp(x).over(frame), x, frame, at_least)


def var_of(x: Column, frame: WindowSpec, at_least: int = 1) -> Column:
    return _guard(F.var_samp(x).over(frame), x, frame, at_least)


def sum_of(x: Column, frame: WindowSpec, at_least: int = 1) -> Column:
    return _guard(F.sum(x).over(frame), x, frame, at_least)


def _guard(value: Column, x: Column, frame: WindowSpec, at_least: int) -> Column:
    if at_least <= 1:
        return value
    return F.when(F.count(x).over(frame) >= at_least, value)


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Build,
    reach: int,
    running: Mapping[str, tuple[str, Column]] | None = None,
    task_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add history columns to ``df``.

    ``build`` gets a window (keys, order) and returns the bounded columns, none of which may
    look more than ``reach`` rows back. ``running`` maps a name to ('sum' | 'count' | 'max',
    expression): the aggregate of all earlier rows of the key, the current row left out.
    ``order`` must be unique within a key. ``rows`` is the number of rows of ``df``, if known.
    """
    running = dict(running or {})
    task_rows = TASK_ROWS if task_rows is None else task_rows
    rows = row_count(df.select(*keys)) if rows is None else rows
    if keys_fit_one_task(df, keys, task_rows, rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        wall = window.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*",
            *[c.alias(n) for n, c in build(window).items()],
            *[_AGG[kind](x).over(wall).alias(n) for n, (kind, x) in running.items()],
        )
    return _blocked(df, keys, order, build, reach, running, max(task_rows, reach + 1), rows)


CARRY_ROWS = 1_000_000  # carried rows, at most one per block, that may be broadcast
_AGG = {"sum": F.sum, "count": F.count, "max": F.max}


def _blocked(df, keys, order, build, reach, running, block_rows, n_rows) -> DataFrame:
    rows = row_index(df, [F.col(c) for c in [*keys, *order]], _IX, limit=block_rows, rows=n_rows)
    here = F.expr(f"{_IX} div {block_rows}")
    near_end = (col(_IX) % block_rows) >= block_rows - reach
    spread = rows.withColumn(_HOME, here).withColumn(
        _BLOCK,
        F.explode(F.when(near_end, F.array(here, here + 1)).otherwise(F.array(here))),
    )
    spread = spread.withColumn(_OWN, col(_BLOCK) == col(_HOME))
    # a given number of parts is not merged into larger ones, so few blocks meet in a task
    spread = spread.repartition(even_parts(df.sparkSession, n_rows, block_rows), _BLOCK, *keys)
    window = Window.partitionBy(_BLOCK, *keys).orderBy(_IX)
    wall = window.rowsBetween(Window.unboundedPreceding, -1)
    out = spread.select(
        "*",
        *[c.alias(n) for n, c in build(window).items()],
        *[
            _AGG[kind](F.when(col(_OWN), x)).over(wall).alias(f"_in_{n}")
            for n, (kind, x) in running.items()
        ],
    ).where(_OWN)
    if running:
        out = _add_carry(out, rows.withColumn(_BLOCK, here), keys, running, n_rows // block_rows)
    plain = [col(c) for c in df.columns]
    bounded = [col(n) for n in build(window)]
    return out.select(*plain, *bounded, *[col(n) for n in running])


def _add_carry(out, rows, keys, running, blocks) -> DataFrame:
    """Join the totals of a key's earlier blocks; only blocks that a key enters from before."""
    totals = rows.groupBy(*keys, _BLOCK).agg(
        *[_AGG[kind](x).alias(f"_c_{n}") for n, (kind, x) in running.items()]
    )
    before = (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    over_blocks = {"sum": F.sum, "count": F.sum, "max": F.max}
    carry = totals.select(
        *[col(k).alias(f"_k_{k}") for k in keys],
        col(_BLOCK).alias("_k_block"),
        F.count("*").over(before).alias("_blocks_before"),
        *[
            over_blocks[kind](col(f"_c_{n}")).over(before).alias(f"_c_{n}")
            for n, (kind, _) in running.items()
        ],
    ).where(col("_blocks_before") > 0)
    if blocks <= CARRY_ROWS:
        carry = F.broadcast(carry)  # a block has at most one key that began before it
    match = col(_BLOCK) == col("_k_block")
    for k in keys:
        match = match & col(k).eqNullSafe(col(f"_k_{k}"))
    joined = out.join(carry, match, "left")
    for n, (kind, _) in running.items():
        inner, carried = col(f"_in_{n}"), col(f"_c_{n}")
        if kind == "max":
            value = F.greatest(inner, carried)
        elif kind == "count":
            value = F.coalesce(inner, F.lit(0)) + F.coalesce(carried, F.lit(0))
        else:
            value = F.coalesce(inner + carried, inner, carried)
        joined = joined.withColumn(n, value)
    return joined
