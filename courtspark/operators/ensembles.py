"""Combining predictions of several models: long tables (id, model, y_true, y_pred)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions.scalars import clip, col, ratio, with_scalar
from courtspark.operators.cleaning import clip_predictions

# --- fixed values: ensemble weights, plausible ranges, confidence limits -----------------------
TOTAL_WEIGHTS = {"extra_trees": 0.35, "gradient_boost": 0.30, "random_forest": 0.25, "ridge": 0.10}
BEST_THREE = ("extra_trees", "gradient_boost", "random_forest")
PLAUSIBLE = (180.0, 280.0)
TYPICAL = (210.0, 240.0)
MEMBER_CLIP = (195.0, 265.0)
HYBRID_SHARES = {"optimized_70_30": 0.7, "balanced_50_50": 0.5, "conservative_80_20": 0.8}


def voting_average(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("id").agg(F.avg("y_pred").alias("y_pred"))


def _weight(weights: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for model, w in weights.items():
        out = F.when(col("model") == model, F.lit(float(w))).otherwise(out)
    return out


def weighted_ensemble(
    predictions: DataFrame,
    weights: Mapping[str, float] = TOTAL_WEIGHTS,
    method: str = "weighted",
    best: Sequence[str] = BEST_THREE,
    low: float = fixed.TOTAL_PREDICTION_CLIP[0],
    high: float = fixed.TOTAL_PREDICTION_CLIP[1],
) -> DataFrame:
    """One prediction per id. Models whose mean is implausible are left out, unless all are.

    Methods: 'weighted', 'best_models_only' (plain mean of the named ones), 'robust_median'.
    """
    known = predictions.where(col("model").isin(*weights))
    if method == "robust_median":
        value = F.median("y_pred")
    elif method == "best_models_only":
        value = F.avg(F.when(col("model").isin(*best), col("y_pred")))
    elif method == "weighted":
        means = {r["model"]: r["m"] for r in known.groupBy("model").agg(F.avg("y_pred").alias("m")).collect()}
        valid = {m: w for m, w in weights.items() if means.get(m) is not None and low <= means[m] <= high}
        w = _weight(valid or weights)
        value = ratio(F.sum(col("y_pred") * w), F.sum(F.when(col("y_pred").isNotNull(), w)))
    else:
        raise ValueError(f"unknown method {method}")
    out = known.groupBy("id").agg(value.alias("y_pred"))
    return out.withColumn("y_pred", clip_predictions(col("y_pred"), low, high, fixed.TOTAL_PREDICTION_DEFAULT))


def metric_weights(predictions: DataFrame) -> DataFrame:
    """Weights from accuracy within 3 points, error, and a penalty for extreme predictions.

    Models above 60 % and below an error of 8 take part; if there is none, all do.
    """
    e = F.abs(col("y_pred") - col("y_true"))
    extreme = ((col("y_pred") < 190) | (col("y_pred") > 270)).cast("double")
    per = predictions.groupBy("model").agg(
        F.avg(e).alias("mae"),
        (F.avg((e <= 3).cast("double")) * 100 - F.avg(extreme) * 20).alias("accuracy"),
        (F.avg((e <= 2).cast("double")) * 100).alias("accuracy_strict"),
    )
    good = (col("accuracy") > 60) & (col("mae") < 8)
    any_good = per.agg(F.max(good.cast("int")).alias("_any"))
    raw = (col("accuracy") / 100) * (col("accuracy") / 100) * 0.7 + 0.3 / (col("mae") + 1e-6)
    per = with_scalar(per, any_good).withColumn(
        "_raw", F.when((col("_any") == 0) | good, raw).otherwise(0.0)
    )
    whole = per.agg(F.sum("_raw").alias("_sum"))
    return with_scalar(per, whole).select(
        "model", "mae", "accuracy", "accuracy_strict", (col("_raw") / col("_sum")).alias("weight")
    )


def combine_by_weights(predictions: DataFrame, weights: Mapping[str, float], least: float = 0.01) -> DataFrame:
    """Clipped predictions times weights; very small weights are left out, not redistributed."""
    used = {m: w for m, w in weights.items() if w > least}
    part = clip(col("y_pred"), *MEMBER_CLIP) * _weight(used)
    return predictions.where(col("model").isin(*used)).groupBy("id").agg(F.sum(part).alias("y_pred"))


def _consistency(predictions: DataFrame) -> DataFrame:
    ok = F.when(col("y_pred").between(*PLAUSIBLE), col("y_pred"))
    return predictions.groupBy("id").agg(
        F.count(ok).alias("_n"), F.stddev_pop(ok).alias("_std"), F.avg(ok).alias("_mean")
    )


def confidence_of(n: Column, std: Column, mean: Column) -> Column:
    """Agreement of the models (70 %) and closeness to usual totals (30 %), in [70, 95]."""
    agreement = F.greatest(F.lit(0.0), 100 - std * 8)
    usual = F.when(mean.between(*TYPICAL), 100.0).otherwise(
        F.greatest(F.lit(70.0), 100 - F.abs(mean - 225) * 2)
    )
    return F.when(n < 2, 70.0).otherwise(clip(agreement * 0.7 + usual * 0.3, 70.0, 95.0))


def simple_confidence_of(n: Column, std: Column, mean: Column) -> Column:
    base = F.greatest(F.lit(70.0), 95 - std * 5)
    base = base + F.when(mean.between(*TYPICAL), 5.0).otherwise(0.0)
    base = base - F.when(std > 10, 10.0).otherwise(0.0)
    return F.when(n < 3, 70.0).otherwise(clip(base, 70.0, 95.0))


def ensemble_confidence(predictions: DataFrame) -> DataFrame:
    """Both confidence rules per id, over the plausible predictions."""
    c = _consistency(predictions)
    args = (col("_n"), col("_std"), col("_mean"))
    return c.select(
        "id", confidence_of(*args).alias("confidence"), simple_confidence_of(*args).alias("confidence_simple")
    )


def hybrid(ensemble: Column, rule: Column, method: str = "optimized_70_30") -> Column:
    """Rule and ensemble mixed; an unknown method uses 70 / 30."""
    share = HYBRID_SHARES.get(method, 0.7)
    return clip(rule * share + ensemble * (1 - share), *fixed.TOTAL_PREDICTION_CLIP)


def older_hybrid(
    df: DataFrame, members: Mapping[str, Column], direct: Column, recent_total: Column, name: str = "older"
) -> DataFrame:
    """85 % rule and 15 % weighted members, pulled to the median of all plausible predictions
    when they disagree, then a tenth of the way to the recent total."""
    shares = {"extra_trees": 0.4, "gradient_boost": 0.4, "ridge": 0.2}
    top, bottom = F.lit(0.0), F.lit(0.0)
    for m, w in shares.items():
        ok = members[m].between(*PLAUSIBLE)
        top = top + F.when(ok, members[m] * w).otherwise(0.0)
        bottom = bottom + F.when(ok, w).otherwise(0.0)
    ml = F.when(bottom > 0, top / bottom).otherwise(direct)
    df = df.withColumn("_ml", ml)
    every = F.filter(
        F.array(direct, col("_ml"), *[members[m] for m in shares]), lambda x: x.between(*PLAUSIBLE)
    )
    df = df.withColumn("_every", F.array_sort(every)).withColumn("_n", F.size("_every"))
    n, every = col("_n"), col("_every")
    df = df.withColumn("_mean", ratio(F.aggregate(every, F.lit(0.0), lambda a, x: a + x), n))
    mean = col("_mean")
    spread = F.aggregate(every, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    at = lambda k: F.try_element_at(every, k.cast("int"))
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    mixed = direct * 0.85 + col("_ml") * 0.15
    apart = (n >= 3) & (F.sqrt(ratio(spread, n)) > 8)
    df = df.withColumn("_mixed", F.when(apart, mixed * 0.7 + middle * 0.3).otherwise(mixed))
    pull = F.coalesce((recent_total - col("_mixed")) * 0.1, F.lit(0.0))
    return df.withColumn(name, clip(col("_mixed") + pull, *MEMBER_CLIP)).drop(
        "_ml", "_every", "_n", "_mean", "_mixed"
    )
