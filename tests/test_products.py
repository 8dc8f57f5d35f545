import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, pearson
from courtspark.operators import profiles, selection
from courtspark.plans.products import pairwise_correlations


def test_against_one_expression_per_pair(spark):
    df = spark.range(500).select(
        (F.rand(1) * 10 + 1e6).alias("a"), F.when(col("id") % 3 > 0, F.rand(2)).alias("b%"), F.when(col("id") % 2 > 0, F.rand(3)).alias("c"),
        F.lit(7.5).alias("flat"), F.lit(None).cast("double").alias("none"), F.when(col("id") % 3 > 0, 2.0).otherwise(col("id").cast("double")).alias("flat where b is known"),
        F.when(col("id") == 1, 3.0).alias("once"),
    ).cache()
    df = df.withColumn("sum", col("a") + 5 * F.coalesce(col("b%"), F.lit(0.0)))
    names = df.columns
    got = pairwise_correlations(df, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            want = df.agg(pearson(col(a), col(b))).first()[0]
            assert (want is None and np.isnan(got[i, j])) or got[i, j] == pytest.approx(want, abs=1e-9), (a, b)


def test_many_columns_take_one_product(spark):
    base = [F.rand(i) for i in range(3)]
    df = spark.range(300).select(*[(base[i % 3] * (i % 7 + 1) + F.rand(100 + i) * (i % 11)).alias(f"f{i}") for i in range(500)])
    names = df.columns
    start = time.time()
    kept = selection.drop_collinear_both(df, names, 0.95)
    assert time.time() - start < 120
    x = np.array(df.collect())
    r = np.abs(np.corrcoef(x.T)) - np.eye(len(names))
    assert kept == [n for n, bad in zip(names, (r > 0.95).any(0)) if not bad]


def test_few_and_many_pairs_agree(spark, monkeypatch):
    df = spark.range(200).select(F.rand(1).alias("a"), F.when(col("id") % 4 > 0, F.rand(2)).alias("b"), F.lit(1.0).alias("c"))
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "a")]
    few = profiles.correlations(df, pairs).collect()
    monkeypatch.setattr(profiles, "PAIRS", 1)
    many = profiles.correlations(df, pairs).collect()
    for x, y in zip(few, many, strict=True):
        assert (x["a"], x["b"]) == (y["a"], y["b"]) and (x["r"] is None) == (y["r"] is None)
        assert x["r"] is None or x["r"] == pytest.approx(y["r"], abs=1e-12)


def test_no_rows(spark):
    df = spark.range(0).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    assert np.isnan(pairwise_correlations(df, ["a", "b"])).all()
