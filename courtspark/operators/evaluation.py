"""Metrics, curves and reports over prediction tables (y_true, y_pred or y_proba)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.functions.scalars import clip, col, fill, flag, pearson, ratio, with_scalar
from courtspark.plans.ordering import exact_quantiles, running_totals
from courtspark.plans.sizes import row_count

# --- fixed values: reported tolerances, ranges, bins, grades --------------------------------
TOLERANCES = (1.0, 2.0, 2.5, 3.0, 5.0, 7.0, 10.0)
RANGES = ((80, 100), (100, 120), (120, 140), (70, 90), (90, 110), (110, 130), (130, 150))
CONFIDENCE_RANGES = ((0.0, 0.3, "very low"), (0.3, 0.4, "low"), (0.4, 0.6, "middle"),
                     (0.6, 0.7, "high"), (0.7, 0.8, "very high"), (0.8, 1.0, "extreme"))
ERROR_PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def _error() -> Column:
    return col("y_pred") - col("y_true")


def regression_aggregates(features: int | None = None) -> dict[str, Column]:
    """Algebraic regression metrics; all of them combine before the shuffle."""
    e, y = _error(), col("y_true")
    mse = F.avg(e * e)
    r2 = 1 - ratio(F.sum(e * e), F.var_pop(y) * F.count(y))
    n = F.count(y)
    out = {
        "n": n,
        "mae": F.avg(F.abs(e)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "r2": r2,
        "mean_error": F.avg(e),
        "std_error": F.stddev_pop(e),
        "cv_rmse": ratio(F.sqrt(mse), F.avg(y)),
        "pearson": pearson(col("y_true"), col("y_pred")),
    }
    if features is not None:
        out["r2_adjusted"] = 1 - ratio((1 - r2) * (n - 1), n - F.lit(features) - 1)
    return out


def regression_metrics(df: DataFrame, by: Sequence[str] = (), features: int | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in regression_aggregates(features).items()])


def median_absolute_error(df: DataFrame, limit: int | None = None) -> float | None:
    return exact_quantiles(df.select(F.abs(_error()).alias("e")), ["e"], [0.5], limit)["e"][0]


def smape_median(df: DataFrame, limit: int | None = None) -> float | None:
    """Median of the capped symmetric percentage error."""
    share = 200 * F.abs(_error()) / (F.abs("y_true") + F.abs("y_pred") + 1)
    return exact_quantiles(df.select(clip(share, 0.0, 100.0).alias("e")), ["e"], [0.5], limit)["e"][0]


def tolerance_accuracy(df: DataFrame, tolerances: Sequence[float] = TOLERANCES, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        *[
            (F.avg((F.abs(_error()) <= t).cast("double")) * 100).alias(f"accuracy_{t:g}".replace(".", "_"))
            for t in tolerances
        ]
    )


def mae_by_range(df: DataFrame, ranges: Sequence[tuple[int, int]] = RANGES) -> DataFrame:
    """MAE and count for every range, all in one aggregate; the ranges may overlap."""
    aggs = []
    for a, b in ranges:
        inside = (col("y_true") >= a) & (col("y_true") < b)
        aggs.append(F.avg(F.when(inside, F.abs(_error()))).alias(f"m{a}_{b}"))
        aggs.append(F.count(F.when(inside, 1)).alias(f"n{a}_{b}"))
    items = [
        F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), col(f"m{a}_{b}").alias("mae"), col(f"n{a}_{b}").alias("n"))
        for a, b in ranges
    ]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def residual_shape(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mean, population deviation, skewness, excess kurtosis and error percentiles."""
    e = -_error()
    row = df.agg(
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.skewness(e).alias("skewness"),
        F.kurtosis(e).alias("kurtosis"),
    )
    q = exact_quantiles(df.select(F.abs(e).alias("e")), ["e"], ERROR_PERCENTILES, limit)["e"]
    return row.select(
        "*", *[F.lit(v).cast("double").alias(f"p{round(p * 100)}") for p, v in zip(ERROR_PERCENTILES, q, strict=True)]
    )


def histogram(df: DataFrame, x: Column, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the range of each group; the last bin is closed."""
    values = df.select(*by, x.cast("double").alias("x")).where(col("x").isNotNull())
    ends = [F.min("x").alias("_lo"), F.max("x").alias("_hi")]
    if by:
        # one row per group: the groups are classes, and Spark measures before it broadcasts
        values = values.join(values.groupBy(*by).agg(*ends), list(by))
    else:
        values = with_scalar(values, values.agg(*ends))
    at = F.coalesce(F.floor(ratio((col("x") - col("_lo")) * bins, col("_hi") - col("_lo"))), F.lit(0))
    place = F.least(at, F.lit(bins - 1))
    return values.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def cumulative_distribution(df: DataFrame, x: Column, limit: int | None = None) -> DataFrame:
    """Share of rows at or below each distinct value."""
    counted = df.select(x.alias("x")).where(col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("n"))
    totals = running_totals(counted, [col("x")], {"upto": "n"}, limit, row_count(df))
    size = counted.agg(F.sum("n").alias("_all"))
    return with_scalar(totals, size).select("x", (col("upto") / col("_all")).alias("share"))


def quality_score(metrics: DataFrame) -> DataFrame:
    """Points for MAE, R2 and accuracy within 3 points; needs mae, r2, accuracy_3."""
    mae, r2, acc = col("mae"), col("r2"), col("accuracy_3")
    points = (
        F.when(mae < 2.0, 30).when(mae < 3.5, 20).otherwise(0)
        + F.when(r2 > 0.85, 30).when(r2 > 0.75, 20).otherwise(0)
        + F.when(acc > 70, 25).when(acc > 55, 15).otherwise(0)
    )
    advice = F.array_compact(
        F.array(
            F.when(mae >= 3.5, "improve projection features"),
            F.when(r2 <= 0.75, "review feature engineering"),
            F.when(acc <= 55, "improve calibration"),
        )
    )
    label = F.when(points >= 85, "excellent").when(points >= 70, "good").otherwise("needs work")
    return metrics.select(
        "*",
        points.alias("quality_score"),
        label.alias("quality"),
        F.array_join(advice, "; ").alias("advice"),
    )


# ------------------------------------------------------------------ classification


def predicted(threshold: float = 0.5) -> Column:
    return flag(col("y_proba") > threshold)


def confusion_aggregates(y: Column, p: Column) -> dict[str, Column]:
    return {
        "tp": F.count(F.when((y == 1) & (p == 1), 1)),
        "fp": F.count(F.when((y == 0) & (p == 1), 1)),
        "fn": F.count(F.when((y == 1) & (p == 0), 1)),
        "tn": F.count(F.when((y == 0) & (p == 0), 1)),
    }


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1, with 0 where a divisor is empty."""
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": fill(ratio(tp, tp + fp), 0.0),
        "recall": fill(ratio(tp, tp + fn), 0.0),
        "f1_score": fill(ratio(2 * tp, 2 * tp + fp + fn), 0.0),
    }


def weighted_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Class-weighted precision, recall and F1, and the Matthews coefficient."""
    one, zero = rates(tp, fp, fn, tn), rates(tn, fn, fp, tp)
    n1, n0 = tp + fn, tn + fp
    out = {
        f"{m}_weighted": (one[m] * n1 + zero[m] * n0) / (n1 + n0)
        for m in ("precision", "recall", "f1_score")
    }
    a, b, c, d = (x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn))
    out["mcc"] = fill(ratio(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt(a * b) * F.sqrt(c * d)), 0.0)
    return out


def probability_losses() -> dict[str, Column]:
    p = clip(col("y_proba"), 1e-15, 1 - 1e-15)
    y = col("y_true")
    return {
        "log_loss": -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)),
        "brier_score": F.avg((col("y_proba") - y) * (col("y_proba") - y)),
    }


def score_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy("y_proba").agg(
        F.sum(flag(col("y_true") == 1)).alias("pos"), F.sum(flag(col("y_true") == 0)).alias("neg")
    )


def score_curve(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Counts at or above every distinct score, with the totals of both classes."""
    counts = score_counts(df)
    curve = running_totals(counts, [col("y_proba").desc()], {"tp": "pos", "fp": "neg"}, limit, row_count(df))
    return with_scalar(
        curve, df.agg(F.count(F.when(col("y_true") == 1, 1)).alias("p_all"), F.count(F.when(col("y_true") == 0, 1)).alias("n_all"))
    )


def roc_points(curve: DataFrame) -> DataFrame:
    """True and false positive rate per threshold, and the trapezoid it adds to the area."""
    tpr, fpr = ratio(col("tp"), col("p_all")), ratio(col("fp"), col("n_all"))
    tpr_before = ratio(col("tp") - col("pos"), col("p_all"))
    step = ratio(col("neg"), col("n_all")) * (tpr + tpr_before) / 2
    return curve.select(col("y_proba").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), step.alias("area"))


def pr_points(curve: DataFrame) -> DataFrame:
    """Precision, recall and F1 per threshold, and the trapezoid it adds to the area."""
    seen = col("tp") + col("fp")
    precision, recall = ratio(col("tp"), seen), ratio(col("tp"), col("p_all"))
    before = seen - col("pos") - col("neg")
    precision_before = F.when(before > 0, ratio(col("tp") - col("pos"), before)).otherwise(1.0)
    step = ratio(col("pos"), col("p_all")) * (precision + precision_before) / 2
    f1 = 2 * precision * recall / (precision + recall + 1e-8)
    return curve.select(
        col("y_proba").alias("threshold"), precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), step.alias("area"),
    )


def auc(df: DataFrame, limit: int | None = None) -> DataFrame:
    """ROC area (0.5 when only one class is present) and precision-recall area, as one row."""
    curve = score_curve(df, limit)
    both = roc_points(curve).agg(F.sum("area").alias("auc_roc"))
    pr = pr_points(curve).agg(F.sum("area").alias("auc_pr"))
    return with_scalar(both, pr).withColumn("auc_roc", fill(col("auc_roc"), 0.5))


def classification_metrics(df: DataFrame, threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    counts = confusion_aggregates(col("y_true"), predicted(threshold))
    row = df.agg(*[c.alias(n) for n, c in (counts | probability_losses()).items()])
    four = [col(n) for n in ("tp", "fp", "fn", "tn")]
    row = row.withColumns(rates(*four) | weighted_rates(*four))
    return with_scalar(row, auc(df, limit))


def grouped_classification(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    counts = confusion_aggregates(col("y_true"), predicted(threshold))
    row = df.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in (counts | probability_losses()).items()])
    return row.withColumns(rates(*[col(n) for n in ("tp", "fp", "fn", "tn")]))


def confusion_matrix(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.groupBy("y_true", predicted(threshold).alias("y_pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    row = df.agg(*[c.alias(n) for n, c in confusion_aggregates(col("y_true"), predicted(threshold)).items()])
    tp, fp, fn, tn = (col(n) for n in ("tp", "fp", "fn", "tn"))
    items = []
    for label, args in ((1, (tp, fp, fn, tn)), (0, (tn, fn, fp, tp))):
        r = rates(*args)
        items.append(
            F.struct(
                F.lit(label).alias("label"), r["precision"].alias("precision"), r["recall"].alias("recall"),
                r["f1_score"].alias("f1_score"), (args[0] + args[2]).alias("support"),
            )
        )
    return row.select(F.inline(F.array(*items)))


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins (low, high]; a score of exactly 0 is in none of them."""
    place = F.ceil(col("y_proba") * bins)
    return (
        df.where((col("y_proba") > 0) & (col("y_proba") <= 1))
        .groupBy(place.alias("bin"))
        .agg(F.avg("y_proba").alias("mean_predicted"), F.avg("y_true").alias("share_positive"), F.count("*").alias("n"))
    )


def proba_distribution(df: DataFrame) -> DataFrame:
    p = col("y_proba")
    return df.agg(
        F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std")
    )


def _range_label(p: Column) -> Column:
    out = None
    for low, high, _ in CONFIDENCE_RANGES:
        hit = (p >= low) & (p < high)
        label = f"{low:.1f}-{high:.1f}"
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def confidence_ranges(df: DataFrame) -> DataFrame:
    """Metrics per score range; a score of exactly 1 falls in none."""
    size = df.agg(F.count("*").alias("_all"))
    counts = confusion_aggregates(col("y_true"), predicted())
    row = (
        df.withColumn("range", _range_label(col("y_proba")))
        .where(col("range").isNotNull())
        .groupBy("range")
        .agg(
            F.count("*").alias("n"), F.avg("y_proba").alias("mean_predicted"), F.avg("y_true").alias("win_rate"),
            *[c.alias(n) for n, c in counts.items()],
        )
    )
    r = rates(*[col(n) for n in ("tp", "fp", "fn", "tn")])
    return with_scalar(row, size).select(
        "range", "n", (col("n") / col("_all") * 100).alias("percentage"),
        r["accuracy"].alias("accuracy"), r["precision"].alias("precision"), r["recall"].alias("recall"),
        "mean_predicted", "win_rate", F.abs(col("mean_predicted") - col("win_rate")).alias("calibration_error"),
    )


def accuracy_by_context(df: DataFrame, context: str = "is_home") -> DataFrame:
    hit = (predicted() == col("y_true")).cast("double")
    return df.groupBy(context).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


# ------------------------------------------------------------------ several models


def model_comparison(predictions: DataFrame) -> DataFrame:
    """MAE, RMSE, R2 per model, the best by MAE, and the spread over models."""
    per_model = regression_metrics(predictions, ["model"]).select("model", "mae", "rmse", "r2")
    spread = per_model.agg(
        F.min_by("model", F.struct("mae", "model")).alias("best_model"),
        F.stddev_pop("mae").alias("mae_std"),
        (F.max("mae") - F.min("mae")).alias("mae_range"),
        F.stddev_pop("r2").alias("r2_std"),
        (F.max("r2") - F.min("r2")).alias("r2_range"),
    )
    return with_scalar(per_model, spread)


def overfit_gap(predictions: DataFrame) -> DataFrame:
    """Train against validation per model, in one pass, with the gap graded."""
    both = regression_metrics(predictions, ["model", "split"])
    acc = tolerance_accuracy(predictions, [3.0], ["model", "split"])
    long = both.join(acc, ["model", "split"])
    wide = long.groupBy("model").agg(
        *[
            F.max(F.when(col("split") == s, col(m))).alias(f"{m}_{s}")
            for m in ("mae", "r2", "accuracy_3")
            for s in ("train", "validation")
        ]
    )
    gaps = {f"{m}_gap": F.abs(col(f"{m}_train") - col(f"{m}_validation")) for m in ("mae", "r2", "accuracy_3")}
    wide = wide.withColumns(gaps)
    mae, r2, acc3 = col("mae_gap"), col("r2_gap"), col("accuracy_3_gap")
    label = (
        F.when((acc3 < 2) & (mae < 0.5) & (r2 < 0.05), "none")
        .when((acc3 < 5) & (mae < 1) & (r2 < 0.1), "slight")
        .otherwise("strong")
    )
    grade = (
        F.when((mae < 1) & (r2 < 0.03), "none").when((mae < 2) & (r2 < 0.08), "minimal")
        .when((mae < 3) & (r2 < 0.15), "slight").otherwise("strong")
    )
    return wide.withColumns({"overfit_total": label, "overfit_points": grade})


def accuracy_gap(predictions: DataFrame) -> DataFrame:
    """Classification twin: accuracy gap above .05 is moderate, above .1 high."""
    acc = grouped_classification(predictions, ["model", "split"]).groupBy("model").agg(
        *[F.max(F.when(col("split") == s, col("accuracy"))).alias(f"accuracy_{s}") for s in ("train", "validation")]
    )
    gap = col("accuracy_train") - col("accuracy_validation")
    label = F.when(gap > 0.1, "high").when(gap > 0.05, "moderate").otherwise("low")
    return acc.withColumns({"accuracy_gap": gap, "overfit": label})


def cv_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum of fold metrics."""
    out = []
    for m in metrics:
        out += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    return folds.groupBy(*by).agg(*out)


def stability_labels(summary: DataFrame) -> DataFrame:
    """Labels from the spread of fold MAE and accuracy; needs the columns of ``cv_summary``."""
    mae_cv = F.when(col("mae_mean") > 0, col("mae_std") / col("mae_mean")).otherwise(0.0)
    acc_cv = F.when(col("accuracy_3_mean") > 0, col("accuracy_3_std") / col("accuracy_3_mean")).otherwise(0.0)
    mae_range = col("mae_max") - col("mae_min")
    return summary.select(
        "*",
        mae_cv.alias("mae_cv"),
        acc_cv.alias("accuracy_cv"),
        mae_range.alias("mae_range"),
        F.when((mae_cv < 0.15) & (mae_range < 1), "very stable").when((mae_cv < 0.25) & (mae_range < 2), "stable")
        .when(mae_cv < 0.35, "moderate").otherwise("unstable").alias("stability_points"),
        F.when((mae_cv < 0.1) & (acc_cv < 0.1), "excellent").when((mae_cv < 0.2) & (acc_cv < 0.2), "good")
        .otherwise("low").alias("stability_total"),
    )
