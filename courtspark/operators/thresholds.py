"""Decision thresholds and levels. Scores are bucketed once; rows never meet thresholds pairwise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.functions.scalars import col, flag, with_scalar
from courtspark.operators.evaluation import confusion_aggregates, pr_points, rates, roc_points, score_curve
from courtspark.plans.ordering import exact_quantiles

STRATEGIES = ("balanced", "conservative", "aggressive", "high_confidence")

# --- fixed values: confidence limits per strategy, shared levels, fallbacks ------------------
MIN_CONFIDENCE = {"balanced": 0.3, "conservative": 0.6, "aggressive": 0.2, "high_confidence": 0.7}
HIGH_CONFIDENCE = {"balanced": 0.7, "conservative": 0.8, "aggressive": 0.6, "high_confidence": 0.85}
MEDIUM_CONFIDENCE = 0.6
OTHER_LEVELS = {"very_low_confidence": 0.1, "low_confidence": 0.3, "very_high_confidence": 0.9}


def strategy_thresholds(df: DataFrame, limit: int | None = None) -> dict[str, float]:
    """Decision threshold of each strategy, as numbers.

    The precision-recall curve ends in an extra point of precision 1 without a threshold, so
    the last point that reaches a wanted precision is always that one, and the rule for
    'conservative' gives the highest score. Recall at the lowest score is 1, so 'aggressive'
    gives the first score that keeps the wanted recall: the lowest.
    """
    points = pr_points(score_curve(df, limit))
    row = points.agg(
        F.max_by("threshold", F.struct(col("f1"), -col("threshold"))).alias("balanced"),
        F.max("threshold").alias("conservative"),
        F.min(F.when(col("recall") >= 0.8, col("threshold"))).alias("aggressive"),
    ).first()
    return {
        "balanced": row["balanced"],
        "conservative": row["conservative"] if row["conservative"] is not None else 0.7,
        "aggressive": row["aggressive"] if row["aggressive"] is not None else 0.3,
        "high_confidence": 0.5,
    }


def _struct(strategy: str, decision: float) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"),
        F.lit(float(decision)).alias("decision"),
        F.lit(MIN_CONFIDENCE[strategy]).alias("min_confidence"),
        F.lit(MEDIUM_CONFIDENCE).alias("medium_confidence"),
        F.lit(HIGH_CONFIDENCE[strategy]).alias("high_confidence"),
        *[F.lit(v).alias(k) for k, v in OTHER_LEVELS.items()],
    )


def threshold_table(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """The thresholds as one row per strategy."""
    one = df.agg(F.count("*").alias("scored"))
    return one.select("scored", F.inline(F.array(*[_struct(s, t) for s, t in thresholds.items()])))


def level(p: Column, low: Column, medium: Column, high: Column) -> Column:
    return (
        F.when(p >= high, "high_confidence")
        .when(p >= medium, "medium_confidence")
        .when(p >= low, "low_confidence")
        .otherwise("no_decision")
    )


def decision_levels(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Predicted win, level, absolute confidence and advice for every row and strategy."""
    wide = df.select("*", F.inline(F.array(*[_struct(s, t) for s, t in thresholds.items()])))
    p = col("y_proba")
    out = wide.withColumns(
        {
            "predicted_win": flag(p > col("decision")),
            "confidence_level": level(p, col("min_confidence"), col("medium_confidence"), col("high_confidence")),
            "absolute_confidence": F.abs(p - 0.5) * 2,
        }
    )
    side = F.when(col("predicted_win") == 1, "win").otherwise("loss")
    advice = (
        F.when(col("confidence_level") == "no_decision", F.lit("no decision"))
        .when(col("confidence_level") == "low_confidence", F.concat(side, F.lit(": low confidence, weigh other factors")))
        .when(col("confidence_level") == "medium_confidence", F.concat(side, F.lit(": reliable")))
        .otherwise(F.concat(side, F.lit(": very reliable")))
    )
    return out.withColumn("advice", advice).drop(
        "decision", "min_confidence", "medium_confidence", "high_confidence", *OTHER_LEVELS
    )


def evaluate_thresholds(decided: DataFrame) -> DataFrame:
    """Metrics per strategy over the rows with a decision."""
    taken = col("confidence_level") != "no_decision"
    y, p = F.when(taken, col("y_true")), F.when(taken, col("predicted_win"))
    levels = ("no_decision", "low_confidence", "medium_confidence", "high_confidence")
    row = decided.groupBy("strategy").agg(
        F.count("*").alias("total"),
        F.count(F.when(taken, 1)).alias("decided"),
        *[c.alias(n) for n, c in confusion_aggregates(y, p).items()],
        *[F.count(F.when(col("confidence_level") == n, 1)).alias(f"n_{n}") for n in levels],
    )
    four = [col(n) for n in ("tp", "fp", "fn", "tn")]
    return row.withColumns(rates(*four) | {"decision_rate": col("decided") / col("total")})


def compare_strategies(evaluation: DataFrame) -> DataFrame:
    """Best strategy per metric; the earlier strategy wins ties, and a best of 0 has none."""
    metrics = ("accuracy", "precision", "recall", "f1_score", "decision_rate")
    place = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), col("strategy"))
    long = evaluation.where(col("decided") > 0).select(
        "strategy", place.alias("place"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), col(m).alias("score")) for m in metrics])),
    )
    best = long.groupBy("metric").agg(
        F.max_by("strategy", F.struct(col("score"), -col("place"))).alias("strategy"), F.max("score").alias("score")
    )
    return best.withColumn("strategy", F.when(col("score") > 0, col("strategy")))


def confidence_summary(decided: DataFrame) -> DataFrame:
    """Counts per level, share of high confidence, predicted win rate and advice per strategy."""
    n = F.count("*")
    share = lambda name: F.count(F.when(col("confidence_level") == name, 1)) / n
    row = decided.groupBy("strategy").agg(
        n.alias("total"),
        F.sum("predicted_win").alias("wins"),
        F.avg("predicted_win").alias("win_rate_predicted"),
        share("no_decision").alias("no_decision_rate"),
        share("high_confidence").alias("high_confidence_rate"),
    )
    advice = F.array_compact(
        F.array(
            F.when(col("no_decision_rate") > 0.3, "many undecided"),
            F.when(col("high_confidence_rate") > 0.2, "many reliable"),
            F.when(col("high_confidence_rate") < 0.05, "few reliable"),
        )
    )
    return row.withColumn("advice", F.array_join(advice, "; "))


# ------------------------------------------------------------------ rare-event thresholds


def _grid(df: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    """Positives and negatives per grid cell: cell k holds scores in [t_k, t_k+1)."""
    width = (high - low) / (steps - 1)
    at = lambda k: F.lit(low) + k * F.lit(width)
    p = col("y_proba")
    guess = F.floor((p - low) / width) if width > 0 else F.lit(0)
    guess = F.when(p >= at(guess + 1), guess + 1).when(p < at(guess), guess - 1).otherwise(guess)
    cell = F.greatest(F.least(guess, F.lit(steps - 1)), F.lit(-1))
    return df.groupBy(cell.alias("cell")).agg(
        F.count(F.when(col("y_true") == 1, 1)).alias("pos"), F.count(F.when(col("y_true") == 0, 1)).alias("neg")
    )


def rare_event_thresholds(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Three thresholds for a rare positive class, bounded, evaluated, and the chosen one.

    Small tables only reach the driver: 100 grid cells, one row of extremes, one row per curve.
    """
    low, high, mean, actual, size = df.agg(
        F.min("y_proba"), F.max("y_proba"), F.avg("y_proba"), F.sum("y_true"), F.count("*")
    ).first()
    start, stop = max(0.05, low), min(0.95, high * 0.9)
    width = (stop - start) / 99
    cells = {r["cell"]: (r["pos"], r["neg"]) for r in _grid(df, start, stop, 100).collect()}
    best, grid_choice, tp, fp, scored = 0.0, mean, 0, 0, []
    for k in range(99, -1, -1):
        pos, neg = cells.get(k, (0, 0))
        tp, fp = tp + pos, fp + neg
        if tp + fp:
            precision, recall = tp / (tp + fp), tp / actual if actual else 0.0
            f1 = 2 * tp / (tp + fp + actual) if tp + fp + actual else 0.0
            scored.append((k, precision, 0.6 * f1 + 0.4 * recall))
    for k, precision, value in reversed(scored):
        if precision >= 0.10 and value > best:
            best, grid_choice = value, start + k * width
    curve = score_curve(df, limit)
    youden = roc_points(curve).agg(
        F.max_by("threshold", F.struct(col("tpr") - col("fpr"), col("threshold"))).alias("t"),
        F.max(col("tpr") - col("fpr")).alias("v"),
    ).first()
    by_youden = min(youden["t"] if youden["v"] and youden["v"] > 0 else high, high * 0.9)
    f1 = pr_points(curve).where(col("precision") >= 0.08)
    by_f1 = f1.agg(F.max_by("threshold", F.struct(col("f1"), -col("threshold")))).first()[0]
    by_f1 = mean if by_f1 is None else min(by_f1, high * 0.9)

    lower, upper = max(0.05, low), min(high * 0.60, 0.15)
    bounded = {}
    for name, t in (("f1_precision_balance", grid_choice), ("youden", by_youden), ("precision_recall_curve", by_f1)):
        bounded[name] = lower if t < lower else upper if t > upper else t
    flagged = df.agg(*[F.count(F.when(col("y_proba") >= t, 1)) for t in bounded.values()]).first()
    if any(n < actual * 0.2 for n in flagged):
        target = max(0.08, actual / size * 2.0)
        fallback = exact_quantiles(df, ["y_proba"], [max(0.0, 1 - target)], limit)["y_proba"][0]
        bounded = {
            n: fallback if k < actual * 0.2 else t for (n, t), k in zip(bounded.items(), flagged, strict=True)
        }
    items = F.array(*[F.struct(F.lit(n).alias("method"), F.lit(float(t)).alias("threshold")) for n, t in bounded.items()])
    hit = flag(col("y_proba") >= col("threshold"))
    per_method = (
        df.select("y_true", "y_proba", F.inline(items))
        .groupBy("method", "threshold")
        .agg(F.count("*").alias("n"), *[c.alias(k) for k, c in confusion_aggregates(col("y_true"), hit).items()])
    )
    r = rates(*[col(k) for k in ("tp", "fp", "fn", "tn")])
    table = per_method.select(
        "method", "threshold", r["precision"].alias("precision"), r["recall"].alias("recall"),
        r["f1_score"].alias("f1_score"), (col("tp") + col("fp")).alias("predicted"),
        ((col("tp") + col("fp")) / col("n")).alias("predicted_share"),
    )
    place = F.array_position(F.array(*[F.lit(n) for n in bounded]), col("method"))
    rank = F.struct((col("precision") >= 0.12).cast("int"), col("f1_score"), -place)
    chosen = table.agg(F.max_by("method", rank).alias("_best"))
    final = F.when(col("threshold") < 0.05, 0.05).when(col("threshold") > 0.9, 0.9).otherwise(col("threshold"))
    return (
        with_scalar(table, chosen)
        .withColumns({"chosen": flag(col("method") == col("_best")), "threshold": final})
        .drop("_best")
    )


def share_threshold(df: DataFrame, limit: int | None = None) -> float:
    """Older rule: the quantile that flags as many rows as are positive, at most 0.15."""
    rate = df.agg(F.avg("y_true")).first()[0]
    t = exact_quantiles(df, ["y_proba"], [1 - rate], limit)["y_proba"][0]
    return 0.10 if t > 0.15 else t
