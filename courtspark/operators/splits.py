"""Train / test splits and cross-validation folds, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.plans.ordering import exact_quantiles, row_index
from courtspark.plans.sizes import row_count

MAX_CLASSES = 1000  # classes whose sizes may reach the driver


def by_date_quantile(
    df: DataFrame, share: float = 0.8, date: str = "Date", limit: int | None = None
) -> DataFrame:
    """Rows before the date quantile train, the others test."""
    micros = F.unix_micros(col(date).cast("timestamp"))
    cut = exact_quantiles(df.select(micros.alias("_t")), ["_t"], [share], limit)["_t"][0]
    return df.withColumn("split", F.when(micros < F.lit(cut), "train").otherwise("test"))


def _before(columns: Sequence[Column], cut: Sequence | None) -> Column:
    """Whether a row sorts before the row with the values ``cut``; nulls sort first."""
    if cut is None:
        return F.lit(True)
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, cut, strict=True))):
        same = c.eqNullSafe(F.lit(v))
        smaller = F.lit(False) if v is None else F.coalesce(c < F.lit(v), F.lit(True))
        out = smaller | (same & out)
    return out


def by_row_fraction(
    df: DataFrame, order: Sequence[str], share: float = 0.8, limit: int | None = None, rows: int | None = None
) -> DataFrame:
    """The first share of the ordered rows trains. ``rows`` is the number of rows of ``df``, if known.

    Only the order columns are sorted, to find the row at the cut; the table itself is compared
    with that row and not moved.
    """
    narrow = df.select(*[col(c) for c in order])
    n = row_count(narrow) if rows is None else rows
    rows = row_index(narrow, [col(c) for c in order], "row_ix", limit, n)
    cut = rows.where(col("row_ix") == int(n * share)).select(*[col(c) for c in order]).first()
    split = F.when(_before([col(c) for c in order], cut), "train").otherwise("validation")
    return df.withColumn("split", split)


def _shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def place_in_class(
    df: DataFrame, label: str, key: str = "id", seed: int = 42, limit: int | None = None
) -> DataFrame:
    """Position of each row in a seeded shuffle of its class, and the class size.

    One global index over (class, hash, key) minus the start of the class: a class that holds
    half of all rows is not gathered in one task.
    """
    ordered = row_index(
        df.withColumn("_h", _shuffled(col(key), seed)),
        [col(label), col("_h"), col(key)],
        "_ix",
        limit,
    )
    sizes = df.groupBy(label).count().orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    place, size, start = F.lit(None).cast("long"), F.lit(None).cast("long"), 0
    for row in sizes:
        hit = col(label).eqNullSafe(F.lit(row[0]))
        place = F.when(hit, col("_ix") - start).otherwise(place)
        size = F.when(hit, F.lit(row[1]).cast("long")).otherwise(size)
        start += row[1]
    return ordered.withColumns({"class_place": place, "class_size": size}).drop("_h", "_ix")


def stratified(
    df: DataFrame, label: str, key: str = "id", share: float = 0.8, seed: int = 42, limit: int | None = None
) -> DataFrame:
    """The same share of every class trains, drawn by a seeded hash of the key.

    One row per class, the one at the cut, decides for all rows; the table is not moved.
    """
    rows = place_in_class(df.select(label, key), label, key, seed, limit)
    at_cut = col("class_place") == F.round(col("class_size") * share)
    hashed = _shuffled(col(key), seed)
    train = F.lit(True)
    for cut in rows.where(at_cut).withColumn("_h", hashed).collect():  # one row per class
        mine = _before([hashed, col(key)], [cut["_h"], cut[key]])
        train = F.when(col(label).eqNullSafe(F.lit(cut[label])), mine).otherwise(train)
    return df.withColumn("split", F.when(train, "train").otherwise("validation"))


def stratified_folds(
    df: DataFrame, label: str, key: str = "id", folds: int = 5, seed: int = 42, limit: int | None = None
) -> DataFrame:
    rows = place_in_class(df, label, key, seed, limit)
    return rows.withColumn("fold", (col("class_place") % folds).cast("int")).drop(
        "class_place", "class_size"
    )


def block_folds(
    df: DataFrame, order: Sequence[str], folds: int, limit: int | None = None
) -> DataFrame:
    """``fold``: contiguous blocks of the ordered rows, the first ones a row longer where it does not come out even."""
    rows = row_index(df, [col(c) for c in order], "_row_ix", limit)
    n = row_count(df.select(*[col(c) for c in order]))
    size, longer = divmod(n, folds)
    head = longer * (size + 1)
    in_head = F.floor(col("_row_ix") / (size + 1))
    in_tail = F.lit(longer) + F.floor((col("_row_ix") - head) / max(size, 1))
    return rows.withColumn("fold", F.when(col("_row_ix") < head, in_head).otherwise(in_tail).cast("int")).drop("_row_ix")


def fold_plan(df: DataFrame, kind: str, folds: int, order: Sequence[str] = ("Date", "game_id"), label: str = "y", key: str = "game_id") -> DataFrame:
    """Adds ``fold`` by a named plan: 'blocks' in order, or 'stratified' by class, shuffled by a hash of the key."""
    if kind == "blocks":
        return block_folds(df, order, folds)
    if kind == "stratified":
        return stratified_folds(df, label, key, folds)
    raise ValueError(f"no fold plan {kind!r}")


def expanding_bounds(n: int, folds: int = 5, first: float = 0.6, width: float = 0.2) -> list[tuple[int, int]]:
    """(end of train = start of validation, end of validation) per fold; empty folds dropped."""
    base = int(n * first)
    out = []
    for i in range(1, folds + 1):
        end = base + int((n - base) * i / folds)
        stop = min(end + int(n * width), n)
        if stop > end:
            out.append((end, stop))
    return out


def series_bounds(n: int, folds: int = 7) -> list[tuple[int, int]]:
    """Equal test parts at the end of the series, training on all rows before each."""
    size = n // (folds + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    return [(n - size * (folds - i), n - size * (folds - i - 1)) for i in range(folds)]


def with_parts(df: DataFrame, order: Sequence[str], bounds: Sequence[tuple[int, int]], limit: int | None = None) -> DataFrame:
    """Adds ``parts``: the (fold, role) of every train and validation part that a row belongs to."""
    rows = row_index(df, [F.col(c) for c in order], "_row_ix", limit)
    parts = []
    for i, (end, stop) in enumerate(bounds):
        role = F.when(col("_row_ix") < end, "train").when(col("_row_ix") < stop, "validation")
        parts.append(F.when(role.isNotNull(), F.struct(F.lit(i + 1).alias("fold"), role.alias("role"))))
    return rows.withColumn("parts", F.array_compact(F.array(*parts))).drop("_row_ix")


def fold_report(
    df: DataFrame, order: Sequence[str], bounds: Sequence[tuple[int, int]], limit: int | None = None
) -> DataFrame:
    """Rows and date range of every fold's train and validation part.

    Every row is counted once per elementary range between bounds, then the few ranges are
    summed up per fold.
    """
    rows = row_index(df.select(*order), [F.col(c) for c in order], "row_ix", limit)
    edges = sorted({e for pair in bounds for e in pair})
    part = F.lit(0)
    for e in edges:
        part = part + (col("row_ix") >= e).cast("int")
    parts = rows.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi")
    )
    roles = []
    for i, (end, stop) in enumerate(bounds):
        a, b = edges.index(end) + 1, edges.index(stop) + 1
        roles.append((i + 1, "train", 0, a - 1))
        roles.append((i + 1, "validation", a, b - 1))
    items = F.array(
        *[F.struct(F.lit(f).alias("fold"), F.lit(r).alias("role"), F.lit(x).alias("x"), F.lit(y).alias("y")) for f, r, x, y in roles]
    )
    return (
        parts.select("part", "n", "lo", "hi", F.inline(items))
        .where(col("part").between(col("x"), col("y")))
        .groupBy("fold", "role")
        .agg(F.sum("n").alias("rows"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    )
