"""History from a written state and new rows is that of the whole log."""

import uuid

import pytest
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.plans.history import last, with_history
from courtspark.plans.increment import History, LateRows
from courtspark.sources.staging import staging_folder

ORDER = ["day", "id"]


def build(w):
    x = col("x y")
    return {"mean3": F.avg(x).over(last(w, 3)), "std5": F.stddev_samp(x).over(last(w, 5)), "before": F.lag(x).over(w)}


def running():
    return {"total": ("sum", col("x y")), "seen": ("count", col("x y")), "most": ("max", col("x y"))}


@pytest.fixture(scope="module")
def log(spark):
    """One key with half of all rows, keys that come late or stay away, a null key and missing values."""
    df = spark.range(600).select(
        col("id"), (col("id") / 20).cast("int").alias("day"),
        F.when(col("id") % 2 == 0, "hot").when(col("id") % 29 == 0, None).when((col("id") > 400) & (col("id") % 5 == 0), "late").otherwise(F.concat(F.lit("k"), col("id") % 7)).alias("key"),
        F.when(col("id") % 11 > 0, (F.rand(1) * 10)).alias("x y"),
    )
    return df.where("NOT (key = 'k3' AND day > 10)").cache()


def history(spark, **more):
    return History(f"{staging_folder(spark)}/history-{uuid.uuid4().hex}", ["key"], ORDER, build, 5, running(), **more)


def same(a, b):
    names = ["id", "mean3", "std5", "before", "total", "seen", "most"]
    rounded = lambda df: df.select("id", *[F.round(col(n).cast("double"), 9).alias(n) for n in names[1:]])
    a, b = rounded(a), rounded(b)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("cuts,task_rows", [((10, 11, 12, 30), None), ((1, 25, 30), 40)])
def test_state_and_new_days_are_the_full_run(spark, log, cuts, task_rows):
    h = history(spark, task_rows=task_rows)
    whole = with_history(log, ["key"], ORDER, build, 5, running())
    assert same(h.start(log.where(col("day") < cuts[0])), whole.where(col("day") < cuts[0]))
    for a, b in zip(cuts, cuts[1:]):
        days = (col("day") >= a) & (col("day") < b)
        assert same(h.extend(log.where(days)), whole.where(days)), (a, b)
    version, tails, totals = h.state(spark)
    assert version == len(cuts)
    assert tails.groupBy("key").count().agg(F.max("count")).first()[0] == 5
    assert totals.count() == log.select("key").distinct().count()


def test_late_rows_raise_and_change_nothing(spark, log):
    h = history(spark)
    h.start(log.where("day < 10"))
    for late in (log.where("day = 9"), log.where("id = 198"), log.where("day = 12").unionByName(log.where("id = 4"))):
        with pytest.raises(LateRows):
            h.extend(late)
    assert h.state(spark)[0] == 1
    assert same(h.extend(log.where("day = 10")), with_history(log.where("day < 11"), ["key"], ORDER, build, 5, running()).where("day = 10"))


def test_an_empty_lot_and_a_lot_with_more_columns(spark, log):
    h = history(spark)
    h.apply(log.where("day < 10"))
    assert h.apply(log.where("day > 99")).count() == 0
    whole = with_history(log, ["key"], ORDER, build, 5, running())
    assert same(h.apply(log.where("day >= 10").withColumn("more", F.lit(1))), whole.where("day >= 10"))
    with pytest.raises(ValueError, match="have"):
        h.extend(log.drop("x y"))


def test_states_are_started_once(spark, log):
    h = history(spark)
    with pytest.raises(ValueError, match="no state"):
        h.extend(log)
    h.start(log.where("day < 2"))
    with pytest.raises(ValueError, match="already"):
        h.start(log)
