"""How a registered query is declared and how its output is rounded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.functions.scalars import col

# Added before rounding on both sides, so that exact ties in the next digit fall the same way.
NUDGE = 2e-11

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles (sums depend on row order), dates as text, whole numbers as long."""
    out = []
    for name, kind in df.dtypes:
        c = col(name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("date", "timestamp"):
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def ask(
    ctes: str, body: str, doubles: str = "", longs: str = "", rest: str = "", digits: int = 6
) -> str:
    """SQL twin: the body as a CTE, then rounded doubles, longs and the other columns.

    The lists are comma-separated column names.
    """

    def names(text: str) -> list[str]:
        return [n.strip() for n in text.split(",") if n.strip()]

    cols = [f'round("{n}"::DOUBLE + {NUDGE}::DOUBLE, {digits}) + 0.0::DOUBLE AS "{n}"' for n in names(doubles)]
    cols += [f'"{n}"::BIGINT AS "{n}"' for n in names(longs)]
    cols += [f'"{n}"::VARCHAR AS "{n}"' for n in names(rest)]
    head = f"WITH {ctes}, result AS ({body})" if ctes else f"WITH result AS ({body})"
    return f"{head} SELECT {', '.join(cols)} FROM result"
