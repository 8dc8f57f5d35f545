import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.operators import neighbours as N


def psi(n):
    return sum(1 / i for i in range(1, n)) - N.EULER


def brute(x, y, k=3):
    """Every distance of every pair."""
    keep = [i for i in range(len(x)) if np.isfinite(x[i]) and sum(np.isfinite(x[j]) and y[j] == y[i] for j in range(len(x))) > 1]
    x, y = np.array([x[i] for i in keep]), np.array([y[i] for i in keep])
    out = []
    for i in range(len(x)):
        far = np.abs(x - x[i])
        mine = np.sort(np.delete(far[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)[0]))
        used = min(k, len(mine))
        r = mine[used - 1]
        inside = (far < r * (1 - 1e-9)).sum() if r else (far == 0).sum()
        out.append((psi(used), psi(len(mine) + 1), psi(int(inside))))
    a, b, c = np.mean(out, axis=0)
    return max(0.0, psi(len(x)) + a - b - c)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    y = np.r_[r.integers(0, 3, 495), [7, 8, 8, 9, 9]]  # a class of one, and classes smaller than k
    told = y * 2.0 + r.normal(0, 1, 500)
    ties = np.round(told)
    noise = r.random(500) * 1e3 + 1e6
    gaps = np.where(r.random(500) < 0.2, np.nan, told)
    return y, {"told": told, "ties": ties, "noise": noise, "gaps": gaps, "same": np.full(500, 4.0)}


@pytest.mark.parametrize("block,limit", [(None, None), (40, 60), (3, 60)])
def test_against_all_distances(spark, rows, block, limit):
    y, x = rows
    data = [(int(y[i]), *[None if math.isnan(v[i]) else float(v[i]) for v in x.values()]) for i in range(len(y))]
    df = spark.createDataFrame(data, ["label", *x]).repartition(3)
    got = {r["feature"]: r["information"] for r in N.neighbour_information(df, "label", list(x), 3, block, limit).collect()}
    assert set(got) == set(x)
    for name, v in x.items():
        assert got[name] == pytest.approx(brute(v, y), abs=1e-9), name
    assert got["told"] > 0.3 > got["noise"]


def test_digamma(spark):
    rows = spark.range(1, 200).select("id", N.digamma(col("id")).alias("d")).collect()
    assert all(r["d"] == pytest.approx(psi(r["id"]), abs=1e-9) for r in rows)


def test_no_points(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "label int, a double")
    assert N.neighbour_information(df, "label", ["a"]).count() == 0
    assert N.neighbour_information(df.where(F.lit(False)), "label", ["a"]).count() == 0
