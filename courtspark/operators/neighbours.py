"""Mutual information of continuous columns with classes, by nearest neighbours (Ross 2014).

For every point the distance to its k-th nearest neighbour of the same class is found from the points beside it in
sorted order; then all points nearer than that are counted. The estimate needs only the mean of the digamma
function of these counts. All features are worked on together, as rows (feature, class, value).

Sorting is global: points get a position, positions are cut into blocks, and a block also gets the k rows
before and after it. Counts come from running totals over points and interval ends. So neither a class nor a
feature that holds most of the rows is gathered in one task, and results do not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, finite
from courtspark.plans.ordering import row_index, running_totals
from courtspark.plans.sizes import TASK_ROWS, row_count
from courtspark.sources.staging import stage

NEIGHBOURS = 3
EULER = 0.5772156649015329
#: Distances that differ by less than this share of their size count as equal.
CLOSE = 1e-12


def digamma(x: Column) -> Column:
    """Of whole numbers from 1: six steps up, then the asymptotic series."""
    y = x.cast("double") + 6
    out = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6)) + 1 / (240 * F.pow(y, 8))
    for i in range(6):
        out = out - 1 / (x.cast("double") + i)
    return out


def _points(df: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """feature, y, x of known values, of classes with two points at least, and the size of the class."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), finite(col(n).cast("double")).alias("x")) for n in names])
    long = df.where(col(label).isNotNull()).select(col(label).alias("y"), F.inline(items)).where("x IS NOT NULL")
    long = stage(long, "points")
    sizes = long.groupBy("feature", "y").agg(F.count("*").alias("size"), F.min("x").alias("least"), F.max("x").alias("most")).where("size > 1")
    return long.join(sizes, ["feature", "y"])


def with_radius(points: DataFrame, k: int = NEIGHBOURS, block: int | None = None, limit: int | None = None) -> DataFrame:
    """Adds ``radius``: the distance to the k-th nearest other point of the class, or to its farthest if the class has no
    more than k others."""
    block = max(TASK_ROWS if block is None else block, k)
    rows = row_index(points.withColumn("_id", F.monotonically_increasing_id()), [col(c) for c in ("feature", "y", "x", "_id")], "_ix", limit)
    here = F.expr(f"_ix div {block}")
    spot = col("_ix") % block
    near = F.array(here, F.when(spot >= block - k, here + 1), F.when((spot < k) & (here > 0), here - 1))
    spread = stage(rows, "indexed").withColumns({"_home": here, "_block": F.explode(F.array_compact(near))})
    w = Window.partitionBy("_block", "feature", "y").orderBy("_ix")
    x = col("x")
    reach = []
    for j in range(k + 1):  # j of the k neighbours lie before the point
        before = x - F.lag("x", j).over(w) if j else F.lit(0.0)
        after = F.lead("x", k - j).over(w) - x if j < k else F.lit(0.0)
        reach.append(F.when(before.isNotNull() & after.isNotNull(), F.greatest(before, after)))
    nearest = F.array_min(F.array(*reach))
    few = F.greatest(col("most") - x, x - col("least"))
    out = spread.withColumn("radius", F.when(col("size") <= k, few).otherwise(nearest)).where("_block = _home")
    return out.select("_id", "feature", "y", "x", "size", "radius")


def with_counts(points: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``inside``: the points of the feature, of any class, that are nearer than the radius; equal ones if it is 0."""
    slack = CLOSE * (F.abs("x") + col("radius"))
    none = col("radius") == 0
    low = F.when(none, col("x")).otherwise(col("x") - col("radius") + slack)
    high = F.when(none, col("x")).otherwise(col("x") + col("radius") - slack)
    # at equal places: ends that leave equal points out, then points, then ends that take them in
    kind = lambda k, at, sign, point: F.struct(at.alias("at"), F.lit(k).alias("kind") if isinstance(k, int) else k.alias("kind"), F.lit(sign).alias("sign"), F.lit(point).alias("point"))
    events = F.array(
        kind(1, col("x"), 0, 1),
        kind(F.when(none, 0).otherwise(2), low, -1, 0),
        kind(F.when(none, 2).otherwise(0), high, 1, 0),
    )
    rows = points.select("_id", "feature", F.inline(events))
    total = running_totals(rows, [col(c) for c in ("feature", "at", "kind", "_id", "sign")], {"upto": "point"}, limit)
    inside = total.where("sign <> 0").groupBy("_id").agg(F.sum(col("sign") * col("upto")).alias("inside"))
    return points.join(inside, "_id")


def neighbour_information(df: DataFrame, label: str, names: Sequence[str], k: int = NEIGHBOURS, block: int | None = None, limit: int | None = None) -> DataFrame:
    """feature and its information (nats, 0 at least) about the class. Ties are kept as they are: no noise is added."""
    points = stage(with_radius(_points(df, label, names), k, block, limit), "radii")
    counted = with_counts(points, limit)
    used = F.least(F.lit(k), col("size") - 1)
    value = digamma(F.count("*")) + F.avg(digamma(used)) - F.avg(digamma(col("size"))) - F.avg(digamma(col("inside")))
    return counted.groupBy("feature").agg(F.greatest(F.lit(0.0), value).alias("information"))
