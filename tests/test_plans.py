"""The split plans give the same results as the plain ones, on skewed data with hot keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtspark.functions import rolling
from courtspark.functions.scalars import col
from courtspark.operators import features, profiles
from courtspark.plans import ordering, sizes
from courtspark.plans.history import with_history

ORDER = ["Date", "game_id"]


@pytest.fixture(scope="module")
def log(spark):
    """A third of all rows belong to one key; dates repeat; some values are unknown."""
    rng = random.Random(7)
    data = []
    for i in range(600):
        team = "HOT" if rng.random() < 0.34 else f"T{rng.randrange(40)}"
        pts = None if rng.random() < 0.1 else float(rng.randrange(80, 130))
        data.append((i, team, f"O{rng.randrange(3)}", f"2024-01-{1 + rng.randrange(28):02d}", pts, rng.randrange(2)))
    df = spark.createDataFrame(data, "game_id long, Team string, Opp string, d string, PTS double, is_win int")
    return df.withColumn("Date", F.to_date("d")).drop("d")


def build(w):
    return {
        "avg5": rolling.rolled(w, col("PTS"), 5),
        "std5": rolling.rolled(w, col("PTS"), 5, "std", 2),
        "rest": rolling.days_rest(w),
        "weighted": rolling.weighted_rate(w, col("is_win")),
        "momentum": rolling.rate_momentum(w, col("is_win")),
    }


RUNNING = lambda: {
    "sum_before": ("sum", col("PTS")),
    "known_before": ("count", col("PTS")),
    "best_before": ("max", col("PTS")),
}


def frame(df, names):
    return df.select("game_id", *names).toPandas().sort_values("game_id").reset_index(drop=True)


@pytest.mark.parametrize("task_rows", [11, 40, 150])
def test_blocked_history_equals_plain(log, task_rows):
    names = ["avg5", "std5", "rest", "weighted", "momentum", "sum_before", "known_before", "best_before"]
    plain = with_history(log, ["Team"], ORDER, build, 10, RUNNING())
    split = with_history(log, ["Team"], ORDER, build, 10, RUNNING(), task_rows=task_rows)
    assert "_block" in split._jdf.queryExecution().toString()
    pd.testing.assert_frame_equal(frame(plain, names), frame(split, names), check_dtype=False)


def test_blocks_are_not_merged_into_larger_tasks(log, monkeypatch):
    """The rows of a hot key lie in as many parts as the limit asks for, though all would fit one by their bytes."""
    monkeypatch.setattr(sizes, "LEAST_PART_ROWS", 10)
    split = with_history(log, ["Team"], ORDER, build, 10, task_rows=40)
    assert split.rdd.getNumPartitions() == 2 * 600 // 40


def test_opponents_are_cut_into_blocks_before_the_rows_are_wide(spark, monkeypatch):
    data = [(i, f"P{i % 7}", f"O{i % 2}", f"2024-01-{1 + i % 28:02d}", float(i % 31)) for i in range(400)]
    df = spark.createDataFrame(data, "game_id long, Player string, Opp string, d string, PTS double")
    df = df.withColumn("Date", F.to_date("d")).drop("d")
    plain = features.opponent_defence(df, ORDER)
    monkeypatch.setattr(features, "OPPONENT_ROWS", 50)
    split = features.opponent_defence(df, ORDER)
    assert "_block" in split._jdf.queryExecution().toString() and "_block" not in plain._jdf.queryExecution().toString()
    pd.testing.assert_frame_equal(frame(plain, ["opponent_def_rating"]), frame(split, ["opponent_def_rating"]))


def test_history_matches_pandas(log):
    got = frame(with_history(log, ["Team"], ORDER, build, 10, RUNNING()), ["avg5", "std5", "sum_before"])
    pdf = log.toPandas().sort_values(["Team", "Date", "game_id"])
    group = pdf.groupby("Team")["PTS"]
    pdf["avg5"] = group.transform(lambda x: x.shift(1).rolling(5, min_periods=1).mean())
    pdf["std5"] = group.transform(lambda x: x.shift(1).rolling(5, min_periods=2).std())
    want = pdf.sort_values("game_id").reset_index(drop=True)
    np.testing.assert_allclose(got["avg5"], want["avg5"])
    np.testing.assert_allclose(got["std5"], want["std5"], atol=1e-9)


def test_current_and_later_rows_do_not_matter(log):
    changed = log.withColumn("PTS", F.when(col("Date") >= "2024-01-20", 0.0).otherwise(col("PTS")))
    names = ["avg5", "std5", "sum_before"]
    a = frame(with_history(log, ["Team"], ORDER, build, 10, RUNNING()).where("Date < '2024-01-20'"), names)
    b = frame(with_history(changed, ["Team"], ORDER, build, 10, RUNNING()).where("Date < '2024-01-20'"), names)
    pd.testing.assert_frame_equal(a, b)


def test_row_index_large_path(log):
    got = ordering.row_index(log, [col("Date"), col("game_id")], "ix", limit=50).toPandas()
    got = got.sort_values(["Date", "game_id"])
    assert got["ix"].tolist() == list(range(len(got)))


def test_running_totals_large_path(log):
    df = log.groupBy("PTS").agg(F.count("*").alias("n")).where("PTS is not null")
    small = ordering.running_totals(df, [col("PTS").asc()], {"s": "n"})
    large = ordering.running_totals(df, [col("PTS").asc()], {"s": "n"}, limit=5)
    assert sorted(small.collect()) == sorted(large.collect())


@pytest.mark.parametrize("limit", [None, 7])
def test_average_rank_share(log, limit):
    got = ordering.average_rank_share(log, "PTS", "r", limit).toPandas().sort_values("game_id")
    want = log.toPandas().sort_values("game_id")["PTS"].rank(pct=True)
    np.testing.assert_allclose(got["r"], want)


@pytest.mark.parametrize("limit", [None, 3, 20])
def test_exact_quantiles(log, limit):
    probs = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    wide = log.withColumns({"tied": F.when(col("game_id") % 3 == 0, 1.0).otherwise(col("PTS")), "none": F.lit(None).cast("double")})
    got = ordering.exact_quantiles(wide, ["PTS", "tied", "none"], probs, limit)
    pdf = wide.toPandas()
    for c in ("PTS", "tied"):
        np.testing.assert_allclose(got[c], pdf[c].quantile(probs))
    assert got["none"] == [None] * len(probs)


def test_quantiles_of_many_distinct_values(spark):
    df = spark.range(20000).select((F.pow((col("id") * 7919) % 20011, 1.5)).alias("x"))
    got = ordering.exact_quantiles(df, ["x"], [0.1, 0.5, 0.999], limit=50)["x"]
    np.testing.assert_allclose(got, df.toPandas()["x"].quantile([0.1, 0.5, 0.999]))


@pytest.mark.parametrize("task_rows", [None, 13])
def test_streaks(spark, log, task_rows):
    df = log.withColumn("double_double", col("is_win"))
    got = features.current_streak(df, ["Team"], 1, "s1", task_rows=task_rows)
    got = features.current_streak(got, ["Team"], 2, "s2", task_rows=task_rows)
    got = got.toPandas().sort_values(["Team", "Date", "game_id"])
    longest = profiles.longest_streak(df, key="Team", task_rows=task_rows).toPandas().set_index("Team")
    for team, g in got.groupby("Team"):
        flags, run, runs = g["double_double"].tolist(), 0, []
        for f in flags:
            run = run + 1 if f else 0
            runs.append(run)
        assert g["s1"].tolist() == [0, *runs[:-1]]
        assert g["s2"].tolist() == ([0, 0, *runs[:-2]])[: len(runs)]
        assert longest.loc[team, "longest_streak"] == max(runs)
        assert longest.loc[team, "games"] == len(runs)
