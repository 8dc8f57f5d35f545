"""Splits, metrics, curves and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark import views
from courtspark.functions.scalars import col
from courtspark.operators import evaluation as ev
from courtspark.operators import splits, thresholds
from courtspark.registry.entry import Query, ask, tidy
from courtspark.views import (
    MODEL_PREDICTIONS, SCORED_BINARY, SCORED_REGRESSION, TEAM_GAMES, model_predictions, scored_binary,
    scored_regression, team_scores,
)

ORDER = ["Date", "game_id"]


def on(view, build):
    return lambda spark, sf_dir: tidy(build(view(spark, sf_dir)))


def date_split(df):
    return splits.by_date_quantile(df).select("game_id", "split")


def row_split(df):
    return splits.by_row_fraction(df, ORDER).select("game_id", "split")


def expanding(df):
    return splits.fold_report(df, ORDER, splits.expanding_bounds(df.count()))


def series(df):
    return splits.fold_report(df, ORDER, splits.series_bounds(df.count()))


def stratified_cv(df):
    folded = splits.stratified_folds(df, "y_true")
    per_fold = ev.grouped_classification(folded, ["fold"])
    return ev.cv_summary(per_fold, ["accuracy", "precision", "recall", "f1_score", "log_loss"])


def regression(df):
    out = ev.regression_metrics(df, features=8)
    return out.withColumn("median_abs_error", F.lit(ev.median_absolute_error(df)))


def quality(df):
    metrics = ev.regression_metrics(df, ["model"]).join(ev.tolerance_accuracy(df, [3.0], ["model"]), "model")
    return ev.quality_score(metrics).select("model", "mae", "r2", "accuracy_3", "quality_score", "quality", "advice")


def smape(df):
    return df.agg(F.count("*").alias("n")).withColumn("smape_median", F.lit(ev.smape_median(df)))


def shape_histogram(df):
    return ev.histogram(df, col("y_true") - col("y_pred"), 20)


def ecdf(df):
    return ev.cumulative_distribution(df, F.abs(col("y_true") - col("y_pred")))


def roc(df):
    return ev.roc_points(ev.score_curve(df))


def pr(df):
    return ev.pr_points(ev.score_curve(df))


def strategy_table(df):
    return thresholds.threshold_table(df, thresholds.strategy_thresholds(df))


def decided(df):
    return thresholds.decision_levels(df, thresholds.strategy_thresholds(df))


def levels(df):
    return decided(df).select("id", "strategy", "predicted_win", "confidence_level", "absolute_confidence", "advice")


def evaluate(df):
    return thresholds.evaluate_thresholds(decided(df)).drop("tp", "fp", "fn", "tn")


def compare(df):
    return thresholds.compare_strategies(thresholds.evaluate_thresholds(decided(df)))


def summary(df):
    return thresholds.confidence_summary(decided(df))


def legacy(df):
    return df.agg(F.count("*").alias("n")).withColumn("threshold", F.lit(thresholds.share_threshold(df)))


def fold_metrics(df):
    folded = df.withColumn("fold", (col("id") % 7).cast("int"))
    both = ev.regression_metrics(folded, ["model", "fold"])
    return both.join(ev.tolerance_accuracy(folded, [3.0], ["model", "fold"]), ["model", "fold"])


def cv_table(df):
    return ev.cv_summary(fold_metrics(df), ["mae", "r2", "accuracy_3"], ["model"])


def stability(df):
    return ev.stability_labels(cv_table(df)).select(
        "model", "mae_cv", "accuracy_cv", "mae_range", "stability_points", "stability_total"
    )


# --- SQL pieces ---------------------------------------------------------------------------
_REG = """count(*) AS n, avg(abs(y_pred - y_true)) AS mae, avg((y_pred - y_true) ** 2) AS mse, sqrt(avg((y_pred - y_true) ** 2)) AS rmse,
  1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)) AS r2"""
_C = "SELECT *, (y_proba > 0.5)::INT AS p FROM scored"
_COUNTS = """count(*) FILTER (y_true = 1 AND p = 1) AS tp, count(*) FILTER (y_true = 0 AND p = 1) AS fp,
  count(*) FILTER (y_true = 1 AND p = 0) AS fn, count(*) FILTER (y_true = 0 AND p = 0) AS tn"""
_RATES = """(tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score"""
_LOSS = """-avg(y_true * ln(greatest(least(y_proba, 1 - 1e-15), 1e-15)) + (1 - y_true) * ln(1 - greatest(least(y_proba, 1 - 1e-15), 1e-15))) AS log_loss,
  avg((y_proba - y_true) ** 2) AS brier_score"""
CURVE = SCORED_BINARY + """,
c0 AS (SELECT y_proba, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scored GROUP BY 1),
c1 AS (SELECT *, sum(pos) OVER (ORDER BY y_proba DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY y_proba DESC)::DOUBLE AS fp,
  sum(pos) OVER ()::DOUBLE AS p_all, sum(neg) OVER ()::DOUBLE AS n_all FROM c0),
curve AS (SELECT y_proba AS threshold, tp / p_all AS tpr, fp / n_all AS fpr, tp / (tp + fp) AS precision,
  (neg / n_all) * (tp / p_all + (tp - pos) / p_all) / 2 AS roc_area,
  (pos / p_all) * (tp / (tp + fp) + CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2 AS pr_area,
  2 * (tp / (tp + fp)) * (tp / p_all) / (tp / (tp + fp) + tp / p_all + 1e-8) AS f1 FROM c1)"""
TH = CURVE + """,
th AS (
  SELECT 'balanced' AS strategy, (SELECT threshold FROM curve ORDER BY f1 DESC, threshold LIMIT 1) AS decision, 0.3 AS lo, 0.6 AS md, 0.7 AS hi, 1 AS place
  UNION ALL SELECT 'conservative', (SELECT max(threshold) FROM curve), 0.6, 0.6, 0.8, 2
  UNION ALL SELECT 'aggressive', (SELECT min(threshold) FROM curve WHERE tpr >= 0.8), 0.2, 0.6, 0.6, 3
  UNION ALL SELECT 'high_confidence', 0.5, 0.7, 0.6, 0.85, 4),
decided AS (SELECT id, y_true, y_proba, strategy, place, (y_proba > decision)::INT AS predicted_win,
  CASE WHEN y_proba >= hi THEN 'high_confidence' WHEN y_proba >= md THEN 'medium_confidence' WHEN y_proba >= lo THEN 'low_confidence'
    ELSE 'no_decision' END AS confidence_level, abs(y_proba - 0.5) * 2 AS absolute_confidence FROM scored, th),
taken AS (SELECT strategy, place, count(*) AS total, count(*) FILTER (confidence_level <> 'no_decision') AS decided,
  count(*) FILTER (confidence_level <> 'no_decision' AND y_true = 1 AND predicted_win = 1) AS tp,
  count(*) FILTER (confidence_level <> 'no_decision' AND y_true = 0 AND predicted_win = 1) AS fp,
  count(*) FILTER (confidence_level <> 'no_decision' AND y_true = 1 AND predicted_win = 0) AS fn,
  count(*) FILTER (confidence_level <> 'no_decision' AND y_true = 0 AND predicted_win = 0) AS tn,
  count(*) FILTER (confidence_level = 'no_decision') AS n_no_decision, count(*) FILTER (confidence_level = 'low_confidence') AS n_low_confidence,
  count(*) FILTER (confidence_level = 'medium_confidence') AS n_medium_confidence, count(*) FILTER (confidence_level = 'high_confidence') AS n_high_confidence
  FROM decided GROUP BY 1, 2),
evaluated AS (SELECT strategy, place, total, decided, (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, decided::DOUBLE / total AS decision_rate,
  n_no_decision, n_low_confidence, n_medium_confidence, n_high_confidence FROM taken)"""
_RARE = CURVE + """,
ext AS (SELECT min(y_proba) AS lo, max(y_proba) AS hi, avg(y_proba) AS mn, sum(y_true) AS act, count(*) AS n FROM scored),
grid AS (SELECT k, greatest(0.05, lo) + k * ((least(0.95, hi * 0.9) - greatest(0.05, lo)) / 99) AS t FROM ext, range(100) AS r(k)),
gm AS (SELECT k, t, count(*) FILTER (y_true = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0)::DOUBLE AS fp FROM grid, scored WHERE y_proba >= t GROUP BY 1, 2),
gs AS (SELECT k, t, 0.6 * (2 * tp / (tp + fp + act)) + 0.4 * tp / act AS v FROM gm, ext WHERE tp / (tp + fp) >= 0.10),
raw AS (SELECT 'f1_precision_balance' AS method, 1 AS place, coalesce((SELECT t FROM gs ORDER BY v DESC, k LIMIT 1), mn) AS t FROM ext
  UNION ALL SELECT 'youden', 2, least((SELECT threshold FROM curve ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1), hi * 0.9) FROM ext
  UNION ALL SELECT 'precision_recall_curve', 3, least((SELECT threshold FROM curve WHERE precision >= 0.08 ORDER BY f1 DESC, threshold LIMIT 1), hi * 0.9) FROM ext),
bounded AS (SELECT method, place, CASE WHEN t < greatest(0.05, lo) THEN greatest(0.05, lo) WHEN t > least(hi * 0.6, 0.15) THEN least(hi * 0.6, 0.15) ELSE t END AS threshold FROM raw, ext),
m AS (SELECT method, place, threshold, count(*) AS n, count(*) FILTER (y_true = 1 AND y_proba >= threshold) AS tp,
  count(*) FILTER (y_true = 0 AND y_proba >= threshold) AS fp, count(*) FILTER (y_true = 1 AND y_proba < threshold) AS fn FROM bounded, scored GROUP BY 1, 2, 3),
mm AS (SELECT method, place, threshold, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1_score,
  tp + fp AS predicted, (tp + fp)::DOUBLE / n AS predicted_share FROM m)"""
_SPLITROWS = TEAM_GAMES + """, ix AS (SELECT game_id, "Date", row_number() OVER (ORDER BY "Date", game_id) - 1 AS ix, count(*) OVER () AS n FROM team_games)"""
_STRAT = SCORED_BINARY + """, sh AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('42-' || id), id) - 1 AS place,
  count(*) OVER (PARTITION BY y_true) AS size FROM scored)"""
_FOLD_SQL = """SELECT fold, role, count(*) AS rows, min("Date") AS first, max("Date") AS last FROM (
  SELECT fold, CASE WHEN ix < e THEN 'train' ELSE 'validation' END AS role, "Date" FROM ix JOIN b ON ix < s) GROUP BY 1, 2"""
_EXPANDING = _SPLITROWS + """, b AS (SELECT i AS fold, e, least(e + (n * 0.2::DOUBLE)::DOUBLE // 1, n) AS s FROM (
  SELECT i, n, floor(n * 0.6::DOUBLE) + floor((n - floor(n * 0.6::DOUBLE)) * i / 5) AS e FROM (SELECT count(*) AS n FROM ix), range(1, 6) AS r(i))
  WHERE least(e + floor(n * 0.2::DOUBLE), n) > e)"""
_SERIES = _SPLITROWS + """, b AS (SELECT i + 1 AS fold, n - (n // 8) * (7 - i) AS e, n - (n // 8) * (6 - i) AS s FROM (SELECT count(*) AS n FROM ix), range(7) AS r(i))"""
_SMAPE = "greatest(least(200 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred) + 1), 100), 0)"
_RANGE = "CASE " + " ".join(f"WHEN y_proba >= {a} AND y_proba < {b} THEN '{a:.1f}-{b:.1f}'" for a, b, _ in ev.CONFIDENCE_RANGES) + " END"
_TOL = {f"accuracy_{t:g}".replace(".", "_"): t for t in ev.TOLERANCES}
_PER_MODEL = f", pm AS (SELECT model, {_REG}, avg((abs(y_pred - y_true) <= 3)::INT) * 100 AS accuracy_3 FROM predictions GROUP BY model)"
_PER_SPLIT = f""", ps AS (SELECT model, split, {_REG}, avg((abs(y_pred - y_true) <= 3)::INT) * 100 AS accuracy_3 FROM predictions GROUP BY 1, 2),
w AS (SELECT a.model, a.mae AS mae_train, b.mae AS mae_validation, a.r2 AS r2_train, b.r2 AS r2_validation, a.accuracy_3 AS accuracy_3_train,
  b.accuracy_3 AS accuracy_3_validation, abs(a.mae - b.mae) AS mae_gap, abs(a.r2 - b.r2) AS r2_gap, abs(a.accuracy_3 - b.accuracy_3) AS accuracy_3_gap
  FROM ps a JOIN ps b ON a.model = b.model AND a.split = 'train' AND b.split = 'validation')"""
_FOLDS = f""", pf AS (SELECT model, id % 7 AS fold, {_REG}, avg((abs(y_pred - y_true) <= 3)::INT) * 100 AS accuracy_3 FROM predictions GROUP BY 1, 2),
cv AS (SELECT model, """ + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ("mae", "r2", "accuracy_3")) + " FROM pf GROUP BY model)"
_CV_NAMES = ", ".join(f"{m}_{s}" for m in ("mae", "r2", "accuracy_3") for s in ("mean", "std", "min", "max"))

QUERIES = {
    "split_by_date_quantile": Query(
        on(team_scores, date_split),
        ask(TEAM_GAMES, """SELECT game_id, CASE WHEN epoch_us("Date"::TIMESTAMP)::DOUBLE < (SELECT quantile_cont(epoch_us("Date"::TIMESTAMP)::DOUBLE, 0.8) FROM team_games)
            THEN 'train' ELSE 'test' END AS split FROM team_games""", "", "game_id", "split"),
    ),
    "split_by_row_fraction": Query(
        on(team_scores, row_split),
        ask(_SPLITROWS, "SELECT game_id, CASE WHEN ix < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM ix", "", "game_id", "split"),
    ),
    "split_stratified": Query(
        on(scored_binary, lambda df: splits.stratified(df, "y_true").select("id", "split")),
        ask(_STRAT, "SELECT id, CASE WHEN place < round(size * 0.8) THEN 'train' ELSE 'validation' END AS split FROM sh", "", "id", "split"),
    ),
    "cv_expanding_60": Query(on(team_scores, expanding), ask(_EXPANDING, _FOLD_SQL, "", "fold, rows", "role, first, last")),
    "cv_time_series": Query(on(team_scores, series), ask(_SERIES, _FOLD_SQL, "", "fold, rows", "role, first, last")),
    "cv_stratified": Query(
        on(scored_binary, stratified_cv),
        ask(_STRAT + f", f AS (SELECT *, place % 5 AS fold, (y_proba > 0.5)::INT AS p FROM sh), c AS (SELECT fold, {_COUNTS}, {_LOSS} FROM f GROUP BY fold), r AS (SELECT {_RATES}, log_loss FROM c)",
            "SELECT " + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max"
                                  for m in ("accuracy", "precision", "recall", "f1_score", "log_loss")) + " FROM r",
            ", ".join(f"{m}_{s}" for m in ("accuracy", "precision", "recall", "f1_score", "log_loss") for s in ("mean", "std", "min", "max"))),
    ),
    "regression_metrics": Query(
        on(scored_regression, regression),
        ask(SCORED_REGRESSION + f", r AS (SELECT {_REG}, avg(y_pred - y_true) AS mean_error, stddev_pop(y_pred - y_true) AS std_error, corr(y_true, y_pred) AS pearson, avg(y_true) AS my, median(abs(y_pred - y_true)) AS median_abs_error FROM scored)",
            "SELECT *, rmse / my AS cv_rmse, 1 - (1 - r2) * (n - 1) / (n - 8 - 1) AS r2_adjusted FROM r",
            "mae, mse, rmse, r2, mean_error, std_error, cv_rmse, pearson, r2_adjusted, median_abs_error", "n"),
    ),
    "tolerance_accuracy": Query(
        on(scored_regression, ev.tolerance_accuracy),
        ask(SCORED_REGRESSION, "SELECT " + ", ".join(f"avg((abs(y_pred - y_true) <= {t})::INT) * 100 AS {n}" for n, t in _TOL.items()) + " FROM scored", ", ".join(_TOL)),
    ),
    "mae_by_range": Query(
        on(scored_regression, ev.mae_by_range),
        ask(SCORED_REGRESSION, f"""SELECT low, high, avg(abs(y_pred - y_true)) AS mae, count(y_true) AS n FROM (VALUES {', '.join(map(str, ev.RANGES))}) AS r(low, high)
            LEFT JOIN scored ON y_true >= low AND y_true < high GROUP BY 1, 2""", "mae", "low, high, n"),
    ),
    "smape_median": Query(
        on(scored_regression, smape), ask(SCORED_REGRESSION, f"SELECT count(*) AS n, median({_SMAPE}) AS smape_median FROM scored", "smape_median", "n"),
    ),
    "residual_shape": Query(
        on(scored_regression, ev.residual_shape),
        ask(SCORED_REGRESSION + ", e AS (SELECT y_true - y_pred AS e FROM scored), s AS (SELECT avg(e) AS m, stddev_pop(e) AS sd FROM e)",
            """SELECT avg(e) AS mean, stddev_pop(e) AS std, avg(((e - m) / sd) ** 3) AS skewness, avg(((e - m) / sd) ** 4) - 3 AS kurtosis,
            quantile_cont(abs(e), 0.5) AS p50, quantile_cont(abs(e), 0.75) AS p75, quantile_cont(abs(e), 0.9) AS p90, quantile_cont(abs(e), 0.95) AS p95,
            quantile_cont(abs(e), 0.99) AS p99 FROM e, s""", "mean, std, skewness, kurtosis, p50, p75, p90, p95, p99"),
    ),
    "residual_histogram": Query(
        on(scored_regression, shape_histogram),
        ask(SCORED_REGRESSION + ", e AS (SELECT y_true - y_pred AS e FROM scored), x AS (SELECT min(e) AS lo, max(e) AS hi FROM e)",
            "SELECT least(floor((e - lo) * 20 / (hi - lo)), 19) AS bin, count(*) AS n FROM e, x GROUP BY 1", "", "bin, n"),
    ),
    "residual_ecdf": Query(
        on(scored_regression, ecdf),
        ask(SCORED_REGRESSION + ", e AS (SELECT abs(y_true - y_pred) AS x FROM scored)",
            "SELECT DISTINCT x, cume_dist() OVER (ORDER BY x) AS share FROM e", "x, share"),
    ),
    "quality_score": Query(
        on(model_predictions, quality),
        ask(MODEL_PREDICTIONS + _PER_MODEL + """, q AS (SELECT model, mae, r2, accuracy_3, (CASE WHEN mae < 2 THEN 30 WHEN mae < 3.5 THEN 20 ELSE 0 END) +
            (CASE WHEN r2 > 0.85 THEN 30 WHEN r2 > 0.75 THEN 20 ELSE 0 END) + (CASE WHEN accuracy_3 > 70 THEN 25 WHEN accuracy_3 > 55 THEN 15 ELSE 0 END) AS quality_score FROM pm)""",
            """SELECT *, CASE WHEN quality_score >= 85 THEN 'excellent' WHEN quality_score >= 70 THEN 'good' ELSE 'needs work' END AS quality,
            concat_ws('; ', CASE WHEN mae >= 3.5 THEN 'improve projection features' END, CASE WHEN r2 <= 0.75 THEN 'review feature engineering' END,
            CASE WHEN accuracy_3 <= 55 THEN 'improve calibration' END) AS advice FROM q""", "mae, r2, accuracy_3", "quality_score", "model, quality, advice"),
    ),
    "classification_metrics": Query(
        on(scored_binary, ev.classification_metrics),
        ask(CURVE + f", c AS ({_C}), k AS (SELECT {_COUNTS}, {_LOSS} FROM c), r AS (SELECT *, {_RATES} FROM k)",
            """SELECT *, (precision * (tp + fn) + (tn::DOUBLE / (tn + fn)) * (tn + fp)) / (tp + fp + fn + tn) AS precision_weighted, accuracy AS recall_weighted,
            (f1_score * (tp + fn) + (2.0 * tn / (2 * tn + fn + fp)) * (tn + fp)) / (tp + fp + fn + tn) AS f1_score_weighted,
            (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
            (SELECT sum(roc_area) FROM curve) AS auc_roc, (SELECT sum(pr_area) FROM curve) AS auc_pr FROM r""",
            "log_loss, brier_score, accuracy, precision, recall, f1_score, precision_weighted, recall_weighted, f1_score_weighted, mcc, auc_roc, auc_pr", "tp, fp, fn, tn"),
    ),
    "confusion_matrix": Query(
        on(scored_binary, ev.confusion_matrix), ask(SCORED_BINARY, "SELECT y_true, (y_proba > 0.5)::INT AS y_pred, count(*) AS n FROM scored GROUP BY 1, 2", "", "y_true, y_pred, n"),
    ),
    "class_report": Query(
        on(scored_binary, ev.class_report),
        ask(SCORED_BINARY + f", c AS ({_C}), k AS (SELECT {_COUNTS} FROM c), u AS (SELECT 1 AS label, tp, fp, fn, tn FROM k UNION ALL SELECT 0, tn, fn, fp, tp FROM k)",
            f"SELECT label, {_RATES}, tp + fn AS support FROM u", "precision, recall, f1_score", "label, support"),
    ),
    "roc_curve": Query(on(scored_binary, roc), ask(CURVE, "SELECT threshold, tpr, fpr, roc_area AS area FROM curve", "threshold, tpr, fpr, area")),
    "pr_curve": Query(on(scored_binary, pr), ask(CURVE, "SELECT threshold, precision, tpr AS recall, f1, pr_area AS area FROM curve", "threshold, precision, recall, f1, area")),
    "calibration_curve": Query(
        on(scored_binary, ev.calibration_curve),
        ask(SCORED_BINARY, "SELECT ceil(y_proba * 10) AS bin, avg(y_proba) AS mean_predicted, avg(y_true) AS share_positive, count(*) AS n FROM scored WHERE y_proba > 0 GROUP BY 1",
            "mean_predicted, share_positive", "bin, n"),
    ),
    "proba_distribution": Query(
        on(scored_binary, ev.proba_distribution),
        ask(SCORED_BINARY, "SELECT min(y_proba) AS min, max(y_proba) AS max, avg(y_proba) AS mean, stddev_pop(y_proba) AS std FROM scored", "min, max, mean, std"),
    ),
    "proba_histogram": Query(
        on(scored_binary, lambda df: ev.histogram(df, col("y_proba"), 30, ["y_true"])),
        ask(SCORED_BINARY + ", x AS (SELECT y_true, min(y_proba) AS lo, max(y_proba) AS hi FROM scored GROUP BY 1)",
            "SELECT y_true, least(floor((y_proba - lo) * 30 / (hi - lo)), 29) AS bin, count(*) AS n FROM scored JOIN x USING (y_true) GROUP BY 1, 2", "", "y_true, bin, n"),
    ),
    "confidence_ranges": Query(
        on(scored_binary, ev.confidence_ranges),
        ask(SCORED_BINARY + f", c AS ({_C}), k AS (SELECT {_RANGE} AS range, count(*) AS n, avg(y_proba) AS mean_predicted, avg(y_true) AS win_rate, {_COUNTS} FROM c GROUP BY 1)",
            f"""SELECT range, n, n * 100.0::DOUBLE / (SELECT count(*) FROM scored) AS percentage, {_RATES}, mean_predicted, win_rate, abs(mean_predicted - win_rate) AS calibration_error
            FROM k WHERE range IS NOT NULL""", "percentage, accuracy, precision, recall, mean_predicted, win_rate, calibration_error", "n", "range"),
    ),
    "optimize_threshold_strategy": Query(
        on(scored_binary, strategy_table),
        ask(TH, """SELECT (SELECT count(*) FROM scored) AS scored, strategy, decision, lo AS min_confidence, md AS medium_confidence, hi AS high_confidence,
            0.1 AS very_low_confidence, 0.3 AS low_confidence, 0.9 AS very_high_confidence FROM th""",
            "decision, min_confidence, medium_confidence, high_confidence, very_low_confidence, low_confidence, very_high_confidence", "scored", "strategy"),
    ),
    "optimize_threshold_dd": Query(
        on(scored_binary, thresholds.rare_event_thresholds),
        ask(_RARE, """SELECT method, threshold, precision, recall, f1_score, predicted, predicted_share,
            (method = (SELECT method FROM mm ORDER BY (precision >= 0.12) DESC, f1_score DESC, place LIMIT 1))::INT AS chosen FROM mm""",
            "threshold, precision, recall, f1_score, predicted_share", "predicted, chosen", "method"),
    ),
    "share_threshold": Query(
        on(scored_binary, legacy),
        ask(SCORED_BINARY + ", q AS (SELECT count(*) AS n, list(y_proba ORDER BY y_proba) AS l, (1 - avg(y_true)) * (count(*) - 1) AS pos FROM scored), u AS (SELECT n, l[floor(pos)::BIGINT + 1] + (pos - floor(pos)) * (l[least(floor(pos)::BIGINT + 2, n)] - l[floor(pos)::BIGINT + 1]) AS t FROM q)",
            "SELECT n, CASE WHEN t > 0.15 THEN 0.10 ELSE t END AS threshold FROM u", "threshold", "n"),
    ),
    "decision_levels": Query(
        on(scored_binary, levels),
        ask(TH, """SELECT id, strategy, predicted_win, confidence_level, absolute_confidence, CASE confidence_level WHEN 'no_decision' THEN 'no decision'
            ELSE (CASE WHEN predicted_win = 1 THEN 'win' ELSE 'loss' END) || (CASE confidence_level WHEN 'low_confidence' THEN ': low confidence, weigh other factors'
            WHEN 'medium_confidence' THEN ': reliable' ELSE ': very reliable' END) END AS advice FROM decided""",
            "absolute_confidence", "id, predicted_win", "strategy, confidence_level, advice"),
    ),
    "evaluate_thresholds": Query(
        on(scored_binary, evaluate),
        ask(TH, "SELECT * FROM evaluated", "accuracy, precision, recall, f1_score, decision_rate",
            "total, decided, n_no_decision, n_low_confidence, n_medium_confidence, n_high_confidence", "strategy"),
    ),
    "compare_strategies": Query(
        on(scored_binary, compare),
        ask(TH + ", u AS (UNPIVOT (SELECT strategy, place, accuracy, precision, recall, f1_score, decision_rate FROM evaluated WHERE decided > 0) ON accuracy, precision, recall, f1_score, decision_rate INTO NAME metric VALUE score)",
            "SELECT metric, max(score) AS score, CASE WHEN max(score) > 0 THEN first(strategy ORDER BY score DESC, place) END AS strategy FROM u GROUP BY metric",
            "score", "", "metric, strategy"),
    ),
    "confidence_summary": Query(
        on(scored_binary, summary),
        ask(TH + """, s AS (SELECT strategy, count(*) AS total, sum(predicted_win) AS wins, avg(predicted_win) AS win_rate_predicted,
            avg((confidence_level = 'no_decision')::INT) AS no_decision_rate, avg((confidence_level = 'high_confidence')::INT) AS high_confidence_rate FROM decided GROUP BY 1)""",
            """SELECT *, concat_ws('; ', CASE WHEN no_decision_rate > 0.3 THEN 'many undecided' END, CASE WHEN high_confidence_rate > 0.2 THEN 'many reliable' END,
            CASE WHEN high_confidence_rate < 0.05 THEN 'few reliable' END) AS advice FROM s""",
            "win_rate_predicted, no_decision_rate, high_confidence_rate", "total, wins", "strategy, advice"),
    ),
    "accuracy_by_context": Query(
        on(scored_binary, ev.accuracy_by_context),
        ask(SCORED_BINARY, "SELECT is_home, count(*) AS n, avg(((y_proba > 0.5)::INT = y_true)::INT) AS accuracy FROM scored GROUP BY 1", "accuracy", "is_home, n"),
    ),
    "model_comparison": Query(
        on(model_predictions, ev.model_comparison),
        ask(MODEL_PREDICTIONS + _PER_MODEL + ", s AS (SELECT first(model ORDER BY mae, model) AS best_model, stddev_pop(mae) AS mae_std, max(mae) - min(mae) AS mae_range, stddev_pop(r2) AS r2_std, max(r2) - min(r2) AS r2_range FROM pm)",
            "SELECT model, mae, rmse, r2, s.* FROM pm, s", "mae, rmse, r2, mae_std, mae_range, r2_std, r2_range", "", "model, best_model"),
    ),
    "overfit_gap": Query(
        on(model_predictions, ev.overfit_gap),
        ask(MODEL_PREDICTIONS + _PER_SPLIT, """SELECT *, CASE WHEN accuracy_3_gap < 2 AND mae_gap < 0.5 AND r2_gap < 0.05 THEN 'none' WHEN accuracy_3_gap < 5 AND mae_gap < 1 AND r2_gap < 0.1 THEN 'slight' ELSE 'strong' END AS overfit_total,
            CASE WHEN mae_gap < 1 AND r2_gap < 0.03 THEN 'none' WHEN mae_gap < 2 AND r2_gap < 0.08 THEN 'minimal' WHEN mae_gap < 3 AND r2_gap < 0.15 THEN 'slight' ELSE 'strong' END AS overfit_points FROM w""",
            "mae_train, mae_validation, r2_train, r2_validation, accuracy_3_train, accuracy_3_validation, mae_gap, r2_gap, accuracy_3_gap", "", "model, overfit_total, overfit_points"),
    ),
    "cv_summary": Query(on(model_predictions, cv_table), ask(MODEL_PREDICTIONS + _FOLDS, "SELECT * FROM cv", _CV_NAMES, "", "model")),
    "stability_labels": Query(
        on(model_predictions, stability),
        ask(MODEL_PREDICTIONS + _FOLDS + ", l AS (SELECT model, mae_std / mae_mean AS mae_cv, accuracy_3_std / accuracy_3_mean AS accuracy_cv, mae_max - mae_min AS mae_range FROM cv)",
            """SELECT *, CASE WHEN mae_cv < 0.15 AND mae_range < 1 THEN 'very stable' WHEN mae_cv < 0.25 AND mae_range < 2 THEN 'stable' WHEN mae_cv < 0.35 THEN 'moderate' ELSE 'unstable' END AS stability_points,
            CASE WHEN mae_cv < 0.1 AND accuracy_cv < 0.1 THEN 'excellent' WHEN mae_cv < 0.2 AND accuracy_cv < 0.2 THEN 'good' ELSE 'low' END AS stability_total FROM l""",
            "mae_cv, accuracy_cv, mae_range", "", "model, stability_points, stability_total"),
    ),
}
