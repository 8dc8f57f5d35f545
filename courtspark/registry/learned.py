"""Ensembles, matchups and learned models."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions import rolling
from courtspark.functions.scalars import clip, col, fill
from courtspark.operators import bundles, ensembles, evaluation, features, fitted, matchups, models, moments, selection, splits
from courtspark.plans.history import with_history
from courtspark.registry.entry import Query, ask, tidy
from courtspark.registry.history import GAMES, ORDER, PLAYER_ORDER, avg, box, over, scores
from courtspark.registry.rows import _direct, _mean3
from courtspark.sources.staging import stage, staging_folder
from courtspark.views import DOUBLE_LOG, MODEL_PREDICTIONS, double_log, model_predictions

WEIGHTS = {"forest": 0.35, "boosting": 0.30, "ridge": 0.25, "net": 0.10}


# ------------------------------------------------------------------ ensembles


def totals(spark, sf_dir):
    """Predicted totals of four models; one of them is far off."""
    df = model_predictions(spark, sf_dir)
    shift = F.when(col("model") == "net", 60.0).otherwise(0.0)
    return df.select("id", "model", (col("y_true") * 2).alias("y_true"), (col("y_pred") * 2 + shift).alias("y_pred"))


TOTALS = MODEL_PREDICTIONS + """, totals AS (SELECT id, model, y_true * 2 AS y_true, y_pred * 2 + CASE WHEN model = 'net' THEN 60 ELSE 0 END AS y_pred FROM predictions)"""


def weighted(spark, sf_dir):
    df = totals(spark, sf_dir)
    a = ensembles.weighted_ensemble(df, WEIGHTS).withColumnRenamed("y_pred", "weighted")
    b = ensembles.weighted_ensemble(df, WEIGHTS, "best_models_only", ("forest", "boosting", "ridge"))
    c = ensembles.weighted_ensemble(df, WEIGHTS, "robust_median")
    return tidy(a.join(b.withColumnRenamed("y_pred", "best_models"), "id").join(c.withColumnRenamed("y_pred", "median"), "id"))


def metric_weights(spark, sf_dir):
    return tidy(ensembles.metric_weights(totals(spark, sf_dir)))


def metric_combined(spark, sf_dir):
    df = totals(spark, sf_dir)
    rows = ensembles.metric_weights(df).collect()  # one row per model
    return tidy(ensembles.combine_by_weights(df, {r["model"]: r["weight"] for r in rows}))


def confidence(spark, sf_dir):
    return tidy(ensembles.ensemble_confidence(totals(spark, sf_dir)))


def voting(spark, sf_dir):
    return tidy(ensembles.voting_average(totals(spark, sf_dir)))


# ------------------------------------------------------------------ matchups


def total_base_games(spark, sf_dir):
    return box(spark, sf_dir).withColumns(
        {n: c for n, c in features.total_base().items() if n in ("direct_scoring_projection", "weighted_shot_volume", "total_expected_shots")}
    )


def fixtures(df):
    return df.select("game_id", col("Team").alias("team1"), col("Opp").alias("team2"), col("is_home").alias("is_team1_home"))


MATCH_FEATURES = ["PTS", "FG%", "FGA", "is_home", "total_expected_shots"]


def matchup(spark, sf_dir):
    df = total_base_games(spark, sf_dir)
    mean = matchups.matchup_rows(fixtures(df), df, MATCH_FEATURES, ORDER)
    return tidy(mean.withColumnsRenamed({n: f"m_{n}" for n in MATCH_FEATURES}).drop("team1", "team2", "is_team1_home"))


def matchup_latest(spark, sf_dir):
    df = total_base_games(spark, sf_dir)
    made = matchups.matchup_rows(fixtures(df), df, ["PTS", "FG%", "direct_scoring_projection", "is_home"], ORDER, latest=True)
    return tidy(made.select("game_id", col("PTS").alias("pts_mean"), col("FG%").alias("fg_mean"), col("direct_scoring_projection").alias("projection_sum"), col("is_home").alias("home")))


def rule(spark, sf_dir):
    df = total_base_games(spark, sf_dir)
    return tidy(matchups.rule_predictor(fixtures(df), df, ORDER).select("game_id", "by_latest", "by_stats", "by_default", "rule_total"))


def hybrid(spark, sf_dir):
    df = total_base_games(spark, sf_dir)
    ruled = matchups.rule_predictor(fixtures(df), df, ORDER)
    actual = df.select("game_id", clip(col("PTS") + col("PTS_Opp"), 200.0, 250.0).alias("ensemble"), (col("PTS") * 2).alias("recent"))
    out = ruled.join(actual, "game_id")
    members = {"extra_trees": col("ensemble"), "gradient_boost": col("ensemble") + 12, "ridge": col("ensemble") - 20}
    made = {m: ensembles.hybrid(col("ensemble"), col("rule_total"), m) for m in ensembles.HYBRID_SHARES}
    out = ensembles.older_hybrid(out, members, col("rule_total"), col("recent"))
    return tidy(out.select("game_id", *[c.alias(n) for n, c in made.items()], "older"))


# ------------------------------------------------------------------ models

INPUTS = ["rate_5g", "rate_10g", "pts_avg_5g", "pts_avg_10g", "allowed_avg_10g", "days_rest", "is_home", "pts_std_5g"]


def model_table(spark, sf_dir):
    """History of each team: eight inputs, the points and the win."""

    def build(w):
        return {
            "rate_5g": rolling.win_rate(w, 5), "rate_10g": rolling.win_rate(w, 10),
            "pts_avg_5g": rolling.rolled(w, col("PTS"), 5), "pts_avg_10g": rolling.rolled(w, col("PTS"), 10),
            "allowed_avg_10g": rolling.rolled(w, col("PTS_Opp"), 10), "days_rest": rolling.days_rest(w),
            "pts_std_5g": rolling.rolled(w, col("PTS"), 5, "std", 2),
        }

    return with_history(scores(spark, sf_dir), ["Team"], ORDER, build, 10)


def prepared(spark, sf_dir, target="PTS", shuffled=False):
    return models.prepare(model_table(spark, sf_dir), INPUTS, target, ORDER, shuffled=shuffled)


def scale(spark, sf_dir):
    p = prepared(spark, sf_dir)
    scaled = models.scaled_columns(models.fit_scaler(p.train).transform(p.train.unionByName(p.validation)), p.features)
    return tidy(scaled.select("game_id", "split", *[f"{f}_scaled" for f in ("pts_avg_10g", "days_rest", "rate_5g")]))


def regression_report(names, target="PTS"):
    def run(spark, sf_dir):
        p = prepared(spark, sf_dir, target)
        chosen = {n: e for n, e in models.regressors("points", None, p.train.count()).items() if n in names}
        return tidy(evaluation.regression_metrics(models.predict_all(models.fit_all(p, chosen), p), ["model", "split"]))

    return run


def classifier_report(names):
    def run(spark, sf_dir):
        p = prepared(spark, sf_dir, "is_win", shuffled=True)
        chosen = {n: e for n, e in models.classifiers("win").items() if n in names}
        scored = models.predict_all(models.fit_all(p, chosen), p, probability=True)
        return tidy(evaluation.grouped_classification(scored, ["model", "split"]))

    return run


def early(spark, sf_dir):
    p = prepared(spark, sf_dir, "is_win", shuffled=True)
    model, trees = models.early_stopped_boosting(p.train, p.validation)
    scored = models.predict_probability(model, p.validation, "boosting")
    return tidy(evaluation.grouped_classification(scored, ["model"]).withColumn("trees", F.lit(trees)))


def sweep(spark, sf_dir):
    p = prepared(spark, sf_dir, "is_win", shuffled=True)
    _, _, tried = models.forest_sweep(p.train, p.validation)
    items = F.array(*[F.struct(F.lit(n).alias("trees"), F.lit(a).alias("auc")) for n, a in tried])
    return tidy(p.validation.agg(F.count("*").alias("rows")).select("rows", F.inline(items)))


def weights(spark, sf_dir):
    df = double_log(spark, sf_dir).select("game_id", "double_double")
    fixed_weight = models.class_weights(df, "double_double").withColumnRenamed("weight", "weight_fixed")
    return tidy(models.class_weights(fixed_weight, "double_double", "balanced"))


def stacking(spark, sf_dir):
    p = prepared(spark, sf_dir)
    bases = {n: e for n, e in models.regressors("points", None, p.train.count()).items() if n in ("forest", "ridge")}
    meta, fitted = models.fit_stack(p, bases)
    return tidy(evaluation.regression_metrics(models.predict_stack(meta, fitted, p.validation), ["model"]))


def stacking_win(spark, sf_dir):
    p = prepared(spark, sf_dir, "is_win", shuffled=True)
    bases = {n: e for n, e in models.classifiers("win").items() if n in ("forest", "logistic")}
    meta, fitted = models.fit_stack(p, bases, models.STACK_PLANS["win"], probability=True, order=ORDER)
    return tidy(evaluation.grouped_classification(models.predict_stack(meta, fitted, p.validation, probability=True), ["model"]))


def fold_plans(spark, sf_dir):
    """Rows and share of wins of every fold of the three plans."""
    df = scores(spark, sf_dir).select("game_id", "Date", col("is_win").alias("y"))
    out = None
    for target, (kind, folds) in models.STACK_PLANS.items():
        part = splits.fold_plan(df, kind, folds, ORDER).groupBy("fold").agg(F.count("*").alias("rows"), F.sum("y").alias("wins"))
        part = part.withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


def search(spark, sf_dir):
    p = prepared(spark, sf_dir)
    rows, at_once = models.narrow(p.train, p.train.count())
    _, tried = models.random_search(rows, parallelism=at_once)
    items = F.array(*[F.struct(F.lit(i + 1).alias("trial"), F.lit(str(sorted(s.items()))).alias("settings"), F.lit(m).alias("mae")) for i, (s, m) in enumerate(tried)])
    return tidy(p.train.agg(F.count("*").alias("rows")).select("rows", F.inline(items)))


def permuted(spark, sf_dir):
    p = prepared(spark, sf_dir)
    model = models.regressors("points")["forest"].fit(p.train)
    return tidy(models.permutation_importance(model, p.validation, p.features))


def known_inputs(spark, sf_dir, target="PTS"):
    return models.split_rows(model_table(spark, sf_dir), INPUTS, target, ORDER)


LINEAR = {"ridge": moments.Moments.ridge, "elastic": moments.Moments.elastic}


def linear(name):
    """A linear model from the sums of the training rows."""
    return lambda spark, sf_dir: tidy(moments.holdout(known_inputs(spark, sf_dir), INPUTS, {name: LINEAR[name]}))


def curve(spark, sf_dir):
    return tidy(moments.learning_curve(known_inputs(spark, sf_dir).where("split = 'train'"), INPUTS))


def cross_validated(bounds, target="PTS"):
    """Ridge fitted and scored in every fold of an ordered table: one scan for all fits, one for all scores."""

    def run(spark, sf_dir):
        rows = known_inputs(spark, sf_dir, target)
        return tidy(moments.cross_validate(rows, INPUTS, ORDER, bounds(rows.count()), {"ridge": LINEAR["ridge"]}))

    return run


def cross_validated_classes(spark, sf_dir):
    """Logistic regression fitted and scored in five stratified folds."""
    p = prepared(spark, sf_dir, "is_win", shuffled=True)
    whole = p.train.unionByName(p.validation)
    folded = stage(models.spread(splits.stratified_folds(whole.drop("features"), "y", "game_id"), whole.count(), "game_id"), "folds")
    table = models.assemble(folded, p.features, p.fills)
    role = lambda k: F.when(col("fold") == k, "validation").otherwise("train")
    parts = F.array(*[F.struct(F.lit(k + 1).alias("fold"), role(k).alias("role")) for k in range(5)])
    logistic = {"logistic": models.classifiers("win")["logistic"]}
    return tidy(models.cross_validate(table.withColumn("parts", parts), logistic, 5, probability=True))


def save_load(spark, sf_dir):
    """A saved and reloaded pipeline predicts the same values."""
    df = model_table(spark, sf_dir).withColumn("y", col("PTS"))
    doubles = df.select("game_id", "y", *[col(f).cast("double").alias(f) for f in INPUTS])
    model = models.fit_pipeline(doubles, INPUTS, models.regressors("points")["ridge"])
    path = f"{staging_folder(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(model, path, doubles, INPUTS, {"trees": models.LEVELS["points"]["forest_trees"]})
    again, bundle = models.load_model(spark, path)
    one = model.transform(doubles).select("game_id", col("prediction").alias("a"))
    two = again.transform(doubles).select("game_id", col("prediction").alias("b"))
    same = (col("a") == col("b")).cast("int")
    return tidy(one.join(two, "game_id").agg(F.count("*").alias("rows"), F.sum(same).alias("same")).withColumn("features", F.lit(len(bundle["features"]))))


def evaluate(spark, sf_dir):
    p = prepared(spark, sf_dir, "is_win", shuffled=True)
    model = models.classifiers("win")["logistic"].fit(p.train)
    scored = models.predict_probability(model, p.validation, "logistic")
    return tidy(evaluation.classification_metrics(scored))


def summary(spark, sf_dir):
    """Per model and for their stack: accuracy and AUC on both parts and over five folds, gap, rows, inputs, share of wins."""
    p = prepared(spark, sf_dir, "is_win", shuffled=True)
    return tidy(models.training_summary(p, models.classifiers("win"), order=ORDER))


def model_importance(spark, sf_dir):
    p = prepared(spark, sf_dir)
    fitted = models.fit_all(p, {n: e for n, e in models.regressors("points").items() if n in ("forest", "boosting")})
    return tidy(models.importances(fitted, p.features, p.train))


FLOWS = ("win", "points", "total", "double")


def flow_table(spark, sf_dir, target):
    """Feature table, label, selection rule and order of one of the four flows."""
    if target == "double":
        players = double_log(spark, sf_dir).withColumns({"is_home": rolling_home(), "is_started": F.when(col("GS") == "*", 1).otherwise(0)})
        return features.double_features(players, PLAYER_ORDER), "double_double", "double", PLAYER_ORDER
    games = box(spark, sf_dir)
    if target == "win":
        return features.win_features(games), "is_win", "win", ORDER
    if target == "points":
        return features.points_features(games), "PTS", "correlation", ORDER
    return features.total_features(games).withColumn("total_points", col("PTS") + col("PTS_Opp")), "total_points", "correlation", ORDER


def train_flow(spark, sf_dir, target):
    """Split rows, the fitted feature stages with a forest behind them, and its predictions of all rows."""
    df, label, rule, order = flow_table(spark, sf_dir, target)
    names = selection.feature_columns(df, target)
    rows = models.split_rows(df, names, label, order)
    train = rows.where(col("split") == "train")
    stages = fitted.fit_features(train, names, "y", rule=rule, winsor="iqr" if rule == "correlation" else None)
    vectors = stages.transform(train).select("y", "features")
    if rule == "correlation":
        forest = models.regressors("points")["forest"].fit(vectors)
    else:
        forest = models.classifiers(target, None, "weight")["forest"].fit(models.class_weights(vectors, "y", "balanced"))
    return rows, bundles.Bundle(stages, {"forest": forest}, label)


def train_targets(spark, sf_dir):
    """The four flows, each on its own feature table: inputs chosen from training rows, metrics on the later part
    of the log, from the saved and reloaded bundle."""
    parts = []
    for target in FLOWS:
        rows, bundle = train_flow(spark, sf_dir, target)
        path = f"{staging_folder(spark)}/bundle-{target}-{uuid.uuid4().hex}"
        bundles.save_bundle(spark, path, bundle)
        bundle = bundles.load_bundle(spark, path)
        later = bundle.features.transform(rows.where(col("split") != "train"))
        if target in ("win", "double"):
            m = evaluation.grouped_classification(models.predict_probability(bundle.models["forest"], later, "forest"), ["model"])
            m = m.select("n", F.lit("f1_score").alias("metric"), col("f1_score").alias("value"))
        else:
            m = evaluation.regression_metrics(models.predict_value(bundle.models["forest"], later, "forest"), ["model"])
            m = m.select("n", F.lit("mae").alias("metric"), col("mae").alias("value"))
        parts.append(m.withColumns({"target": F.lit(target), "inputs": F.lit(len(bundle.names))}))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return tidy(out)


def train_selection(spark, sf_dir):
    """Inputs that a fitted selector keeps: learned from the training rows, the strongest if none is strong."""
    train = models.split_rows(model_table(spark, sf_dir), INPUTS, "PTS", ORDER).where("split = 'train'")
    out = None
    for limit in (0.08, 0.0):
        chosen = fitted.FeatureSelector(features=INPUTS, label="y", atLeast=limit, fallback=3).fit(train).value("features")
        found = selection.correlate_with_target(train, "y", chosen, None).withColumn("at_least", F.lit(limit))
        out = found if out is None else out.unionByName(found)
    return tidy(out)


def rolling_home():
    return F.when(col("Away") == "@", 0).otherwise(1)


TOTAL_BASE = ["PTS", "PTS_Opp", "FG%", "FGA", "total_expected_shots"]
TOTAL_INPUTS = [f"h_{i}" for i in range(len(TOTAL_BASE))]


def train_total(df):
    """Bundle of a forest and a ridge for total points, from what was known of both sides before each past game."""
    past = matchups.matchup_history(df, TOTAL_BASE, ORDER).withColumnsRenamed(dict(zip(TOTAL_BASE, TOTAL_INPUTS, strict=True)))
    past = past.join(df.select("game_id", "Date", (col("PTS") + col("PTS_Opp")).alias("total")), "game_id")
    rows = models.split_rows(past, TOTAL_INPUTS, "total", ORDER).where("split = 'train'")
    stages = fitted.fit_features(rows, TOTAL_INPUTS, "y", atLeast=0.0, above=1.0, strict=True)
    vectors = stage(stages.transform(rows).select("game_id", "y", "features"), "vectors")
    estimators = {n: e for n, e in models.regressors("points", None, vectors.count()).items() if n in ("forest", "ridge")}
    return bundles.Bundle(stages, {n: e.fit(vectors) for n, e in estimators.items()}, "total", notes={"weights": {"forest": 0.7, "ridge": 0.3}})


def total_bundle(spark, sf_dir, df):
    """The bundle of these tables: loaded if it was saved, else trained and saved. Its place is named by the
    files read, their rows and the settings."""
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")]
    about = [[sorted(t.inputFiles()), t.count()] for t in tables] + [models.LEVELS["points"], TOTAL_BASE]
    path = f"{staging_folder(spark)}/bundles/total-{hashlib.md5(json.dumps(about).encode()).hexdigest()}"
    found = bundles.load_bundle(spark, path)
    if found is None:
        bundles.save_bundle(spark, path, train_total(df))
        found = bundles.load_bundle(spark, path)
    return found, path


def train_total_bundle(spark, sf_dir):
    """Versions of the saved bundle that ``score_games`` reads."""
    _, path = total_bundle(spark, sf_dir, stage(total_base_games(spark, sf_dir), "base"))
    return bundles.versions(spark, path).select("version", "target", "models", "features")


def score_games(spark, sf_dir):
    """Fixtures scored by the models of a saved bundle, mixed with the rule, with confidence."""
    df = stage(total_base_games(spark, sf_dir), "base")
    bundle, _ = total_bundle(spark, sf_dir, df)
    games = fixtures(df)
    rows = matchups.matchup_rows(games, df, TOTAL_BASE, ORDER).withColumnsRenamed(dict(zip(TOTAL_BASE, TOTAL_INPUTS, strict=True)))
    long = stage(bundle.score(rows), "scored")  # read by the means, the mix and the confidence
    ensemble = ensembles.weighted_ensemble(long, bundle.notes["weights"])
    ruled = matchups.rule_predictor(games, df, ORDER).select(col("game_id").alias("id"), "rule_total")
    out = ensemble.join(ruled, "id").join(ensembles.ensemble_confidence(long).select("id", "confidence"), "id")
    return tidy(out.select("id", "y_pred", "rule_total", ensembles.hybrid(col("y_pred"), col("rule_total")).alias("total_points"), "confidence"))


# --- SQL pieces ---------------------------------------------------------------------------
_MAIN = TOTALS + """, mm AS (SELECT model, avg(y_pred) AS m FROM totals GROUP BY 1), wt AS (SELECT * FROM (VALUES ('forest', 0.35), ('boosting', 0.30), ('ridge', 0.25), ('net', 0.10)) AS w(model, w)),
ok AS (SELECT model, w FROM wt JOIN mm USING (model) WHERE m BETWEEN 200 AND 250)"""
_MW = TOTALS + """, pm AS (SELECT model, avg(abs(y_pred - y_true)) AS mae, avg((abs(y_pred - y_true) <= 3)::INT) * 100 - avg((y_pred < 190 OR y_pred > 270)::INT) * 20 AS accuracy,
  avg((abs(y_pred - y_true) <= 2)::INT) * 100 AS accuracy_strict FROM totals GROUP BY 1),
g AS (SELECT *, accuracy > 60 AND mae < 8 AS good, max((accuracy > 60 AND mae < 8)::INT) OVER () AS anygood FROM pm),
rw AS (SELECT *, CASE WHEN good OR anygood = 0 THEN (accuracy / 100) ** 2 * 0.7 + 0.3 / (mae + 1e-6) ELSE 0 END AS raw FROM g),
wts AS (SELECT model, mae, accuracy, accuracy_strict, raw / sum(raw) OVER () AS weight FROM rw)"""
_TB = GAMES + f""", tb AS (SELECT *, {_direct('')} AS dsp, ("FGA" + "FGA_Opp" + "FTA" + "FTA_Opp") * ({_mean3('')} + {_mean3('_Opp')}) / 2 AS wsv, "FGA" + "3PA" * 0.4 + "FTA" * 0.44 AS tes,
  row_number() OVER (PARTITION BY "Team" ORDER BY "Date" DESC, game_id DESC) AS k FROM g),
r3 AS (SELECT "Team", avg("PTS") AS pts, avg("FG%") AS fg, avg("FGA") AS fga, avg(is_home) AS h, avg(tes) AS tes, avg(dsp) AS dsp FROM tb WHERE k <= 3 GROUP BY 1),
l1 AS (SELECT "Team", "PTS" AS pts, "FG%" AS fg, "FGA" AS fga, dsp, wsv, is_home AS h FROM tb WHERE k = 1)"""
_RULE = _TB + """, t10 AS (SELECT avg(t) AS t FROM (SELECT "PTS" + "PTS_Opp" AS t FROM g ORDER BY "Date" DESC, game_id DESC LIMIT 10)),
e AS (SELECT g.game_id, g."PTS", g."PTS_Opp", g.is_home, a.dsp + b.dsp AS m1, a.wsv + b.wsv AS m2, a.fg * a.fga * 2.2 + b.fg * b.fga * 2.2 AS m3,
  (x.dsp + y.dsp) * (0.8 + (x.fg + y.fg) / 2 * 0.4) * (0.9 + (x.tes + y.tes) / 200 * 0.2) + CASE WHEN g.is_home = 1 THEN 3.2 ELSE -3.2 END AS st
  FROM g LEFT JOIN l1 a ON a."Team" = g."Team" LEFT JOIN l1 b ON b."Team" = g."Opp" LEFT JOIN r3 x ON x."Team" = g."Team" LEFT JOIN r3 y ON y."Team" = g."Opp"),
f AS (SELECT *, coalesce((m1 BETWEEN 180 AND 280)::INT, 0) AS o1, coalesce((m2 BETWEEN 180 AND 280)::INT, 0) AS o2, coalesce((m3 BETWEEN 180 AND 280)::INT, 0) AS o3 FROM e),
h AS (SELECT *, CASE WHEN o1 + o2 + o3 > 0 THEN (o1 * coalesce(m1, 0) * 0.3 + o2 * coalesce(m2, 0) * 0.2 + o3 * coalesce(m3, 0) * 0.1) / (o1 * 0.3 + o2 * 0.2 + o3 * 0.1)
  WHEN m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL THEN (least(greatest(m1, 200), 260) * 0.3 + least(greatest(m2, 200), 260) * 0.2 + least(greatest(m3, 200), 260) * 0.1) / 0.6 END
  + CASE WHEN is_home = 1 THEN 2.5 ELSE -2.5 END AS lt FROM f),
i AS (SELECT game_id, "PTS", "PTS_Opp", CASE WHEN lt IS NOT NULL THEN least(greatest(lt, 190), 270) END AS by_latest, CASE WHEN st IS NOT NULL THEN least(greatest(st, 200), 250) END AS by_stats,
  least(greatest(t, 200), 240) AS by_default FROM h, t10),
ru AS (SELECT *, least(greatest((coalesce(by_latest * 0.5, 0) + coalesce(by_stats * 0.3, 0) + by_default * 0.2) / (0.2 + CASE WHEN by_latest IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN by_stats IS NOT NULL THEN 0.3 ELSE 0 END), 195), 265) AS rule_total FROM i)"""
_HY = _RULE + """, z AS (SELECT *, least(greatest("PTS" + "PTS_Opp", 200), 250) AS en FROM ru),
z1 AS (SELECT *, (CASE WHEN en BETWEEN 180 AND 280 THEN en * 0.4 ELSE 0 END + CASE WHEN en + 12 BETWEEN 180 AND 280 THEN (en + 12) * 0.4 ELSE 0 END + CASE WHEN en - 20 BETWEEN 180 AND 280 THEN (en - 20) * 0.2 ELSE 0 END) /
  nullif(CASE WHEN en BETWEEN 180 AND 280 THEN 0.4 ELSE 0 END + CASE WHEN en + 12 BETWEEN 180 AND 280 THEN 0.4 ELSE 0 END + CASE WHEN en - 20 BETWEEN 180 AND 280 THEN 0.2 ELSE 0 END, 0) AS ml FROM z),
z2 AS (SELECT *, rule_total * 0.85 + ml * 0.15 AS mx, list_filter([rule_total, ml, en, en + 12, en - 20], lambda v: v BETWEEN 180 AND 280) AS l FROM z1),
z3 AS (SELECT *, CASE WHEN len(l) >= 3 AND list_stddev_pop(l) > 8 THEN mx * 0.7 + list_median(l) * 0.3 ELSE mx END AS sx FROM z2)"""

_INPUT_SQL = GAMES + f""", inputs AS (SELECT game_id, "PTS" AS y, row_number() OVER (ORDER BY "Date", game_id) - 1 AS ix, count(*) OVER () AS n,
  coalesce({avg('is_win', 5)}, 0.5) AS rate_5g, coalesce({avg('is_win', 10)}, 0.5) AS rate_10g, {avg('"PTS"', 5)} AS pts_avg_5g, {avg('"PTS"', 10)} AS pts_avg_10g, {avg('"PTS_Opp"', 10)} AS allowed_avg_10g,
  coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2)::DOUBLE AS days_rest, is_home::DOUBLE AS is_home,
  CASE WHEN count("PTS") {over(5)} >= 2 THEN stddev_samp("PTS") {over(5)} END AS pts_std_5g FROM g)"""

_METRICS = """count(y) AS n, avg(abs(y_pred - y)) AS mae, avg((y_pred - y) ** 2) AS mse, sqrt(avg((y_pred - y) ** 2)) AS rmse, 1 - sum((y_pred - y) ** 2) / (var_pop(y) * count(y)) AS r2,
  avg(y_pred - y) AS mean_error, stddev_pop(y_pred - y) AS std_error, sqrt(avg((y_pred - y) ** 2)) / avg(y) AS cv_rmse, corr(y, y_pred) AS pearson"""
_METRIC_NAMES = "mae, mse, rmse, r2, mean_error, std_error, cv_rmse, pearson"


def _ordered(bounds):
    """Rows of every fold that trains on rows before ``lo`` and is validated on those before ``hi``."""
    return f"SELECT fit, CASE WHEN ix < lo THEN 'train' ELSE 'validation' END AS role, i.* FROM inputs i, (WITH size AS (SELECT max(n) AS n FROM inputs) {bounds}) WHERE ix < hi AND lo < hi"


def _ridge(members, alpha=50):
    """CTEs that end in predicted (fit, role, y, y_pred): a ridge per fit from its rows with role train, solved by elimination."""
    p = len(INPUTS)
    every = lambda text, sep=", ": sep.join(text.format(n=n, i=i + 1) for i, n in enumerate(INPUTS))
    matrix = ", ".join("[" + ", ".join([*(f"avg(z{i} * z{j})" + (f" + {alpha}::DOUBLE / count(*)" if i == j else "") for j in range(1, p + 1)), f"avg(z{i} * (y - my))"]) + "]" for i in range(1, p + 1))
    return "RECURSIVE " + _INPUT_SQL + f""", members AS ({members}),
  fills AS (SELECT fit, {every('avg({n}) AS a{i}')} FROM members WHERE role = 'train' GROUP BY fit),
  whole AS (SELECT fit, role, y, {every('coalesce({n}, a{i}, 0)::DOUBLE AS x{i}')} FROM members JOIN fills USING (fit)),
  shape AS (SELECT fit, avg(y) AS my, {every('avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}')} FROM whole WHERE role = 'train' GROUP BY fit),
  standard AS (SELECT fit, role, y, my, {every('CASE WHEN s{i} > 1e-9 THEN (x{i} - m{i}) / s{i} ELSE 0 END AS z{i}')} FROM whole JOIN shape USING (fit)),
  steps AS (SELECT fit, 0 AS k, [{matrix}] AS m FROM standard WHERE role = 'train' GROUP BY fit
    UNION ALL SELECT fit, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / m[k + 1][k + 1])
      ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM steps WHERE k < {p}),
  predicted AS (SELECT fit, role, y, my + {every(f'z{{i}} * m[{{i}}][{p + 1}]', ' + ')} AS y_pred FROM standard JOIN (SELECT fit, m FROM steps WHERE k = {p}) USING (fit))"""


QUERIES = {
    "voting_average": Query(voting, ask(TOTALS, "SELECT id, avg(y_pred) AS y_pred FROM totals GROUP BY 1", "y_pred", "id")),
    "weighted_ensemble": Query(
        weighted,
        ask(_MAIN, """SELECT id, least(greatest(sum(y_pred * w) / sum(w), 200), 250) AS weighted, least(greatest(avg(y_pred) FILTER (t.model IN ('forest', 'boosting', 'ridge')), 200), 250) AS best_models,
            least(greatest(median(y_pred), 200), 250) AS median FROM totals t LEFT JOIN ok USING (model) GROUP BY 1""", "weighted, best_models, median", "id"),
    ),
    "metric_weights": Query(metric_weights, ask(_MW, "SELECT * FROM wts", "mae, accuracy, accuracy_strict, weight", "", "model")),
    "metric_weighted_total": Query(
        metric_combined,
        ask(_MW, "SELECT id, sum(least(greatest(y_pred, 195), 265) * weight) AS y_pred FROM totals JOIN wts USING (model) WHERE weight > 0.01 GROUP BY 1", "y_pred", "id"),
    ),
    "ensemble_confidence": Query(
        confidence,
        ask(TOTALS + ", c AS (SELECT id, count(*) FILTER (y_pred BETWEEN 180 AND 280) AS n, stddev_pop(y_pred) FILTER (y_pred BETWEEN 180 AND 280) AS s, avg(y_pred) FILTER (y_pred BETWEEN 180 AND 280) AS m FROM totals GROUP BY 1)",
            """SELECT id, CASE WHEN n < 2 THEN 70 ELSE least(greatest(greatest(0, 100 - s * 8) * 0.7 + 0.3 * CASE WHEN m BETWEEN 210 AND 240 THEN 100 ELSE greatest(70, 100 - abs(m - 225) * 2) END, 70), 95) END AS confidence,
            CASE WHEN n < 3 THEN 70 ELSE least(greatest(greatest(70, 95 - s * 5) + CASE WHEN m BETWEEN 210 AND 240 THEN 5 ELSE 0 END - CASE WHEN s > 10 THEN 10 ELSE 0 END, 70), 95) END AS confidence_simple FROM c""",
            "confidence, confidence_simple", "id"),
    ),
    "matchup_rows": Query(
        matchup,
        ask(_TB, """SELECT game_id, coalesce(a.pts, 0) + coalesce(b.pts, 0) AS "m_PTS", (coalesce(a.fg, 0) + coalesce(b.fg, 0)) / 2 AS "m_FG%", (coalesce(a.fga, 0) + coalesce(b.fga, 0)) / 2 AS "m_FGA", g.is_home AS m_is_home,
            coalesce(a.tes, 0) + coalesce(b.tes, 0) AS m_total_expected_shots FROM g LEFT JOIN r3 a ON a."Team" = g."Team" LEFT JOIN r3 b ON b."Team" = g."Opp" """,
            "m_PTS, m_FG%, m_FGA, m_is_home, m_total_expected_shots", "game_id"),
    ),
    "matchup_latest": Query(
        matchup_latest,
        ask(_TB, """SELECT game_id, (coalesce(a.pts, 0) + coalesce(b.pts, 0)) / 2 AS pts_mean, (coalesce(a.fg, 0) + coalesce(b.fg, 0)) / 2 AS fg_mean, coalesce(a.dsp, 0) + coalesce(b.dsp, 0) AS projection_sum, is_home AS home
            FROM g LEFT JOIN l1 a ON a."Team" = g."Team" LEFT JOIN l1 b ON b."Team" = g."Opp" """, "pts_mean, fg_mean, projection_sum, home", "game_id"),
    ),
    "rule_predictor": Query(rule, ask(_RULE, "SELECT * FROM ru", "by_latest, by_stats, by_default, rule_total", "game_id")),
    "hybrid_prediction": Query(
        hybrid,
        ask(_HY, """SELECT game_id, least(greatest(rule_total * 0.7 + en * 0.3, 200), 250) AS optimized_70_30, least(greatest(rule_total * 0.5 + en * 0.5, 200), 250) AS balanced_50_50,
            least(greatest(rule_total * 0.8 + en * 0.2, 200), 250) AS conservative_80_20, least(greatest(sx + coalesce(("PTS" * 2 - sx) * 0.1, 0), 195), 265) AS older FROM z3""",
            "optimized_70_30, balanced_50_50, conservative_80_20, older", "game_id"),
    ),
    "class_weights": Query(
        weights,
        ask(DOUBLE_LOG, """SELECT game_id, double_double, CASE WHEN double_double = 1 THEN 12 ELSE 1 END AS weight_fixed,
            CASE WHEN double_double = 1 THEN count(*) OVER () / (2.0 * sum(double_double) OVER ()) ELSE count(*) OVER () / (2.0 * (count(*) OVER () - sum(double_double) OVER ())) END AS weight FROM double_log""",
            "weight_fixed, weight", "game_id, double_double"),
    ),
    "scale_features": Query(
        scale,
        ask(GAMES + f""", t AS (SELECT game_id, row_number() OVER (ORDER BY "Date", game_id) - 1 AS ix, count(*) OVER () AS n, {avg('"PTS"', 10)} AS a,
            coalesce("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", game_id), 2)::DOUBLE AS b, coalesce({avg('is_win', 5)}, 0.5) AS c FROM g),
            u AS (SELECT *, ix < floor(n * 0.8::DOUBLE) AS tr FROM t), f AS (SELECT game_id, tr, coalesce(a, (SELECT median(a) FROM u WHERE tr)) AS a, b, c FROM u)""",
            "SELECT game_id, CASE WHEN tr THEN 'train' ELSE 'validation' END AS split, " + ", ".join(
                f"({x} - (SELECT avg({x}) FROM f WHERE tr)) / (SELECT stddev_samp({x}) FROM f WHERE tr) AS {n}_scaled"
                for x, n in (("a", "pts_avg_10g"), ("b", "days_rest"), ("c", "rate_5g"))) + " FROM f", "pts_avg_10g_scaled, days_rest_scaled, rate_5g_scaled", "game_id", "split"),
    ),
    "train_forest": Query(regression_report(("forest",))),
    "train_forest_classifier": Query(classifier_report(("forest",))),
    "train_forest_sweep": Query(sweep),
    "train_gbt": Query(early),
    "train_linear": Query(
        linear("ridge"),
        ask(_ridge("SELECT 0 AS fit, CASE WHEN ix < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS role, i.* FROM inputs i"),
            f"SELECT 'ridge' AS model, role AS split, {_METRICS} FROM predicted GROUP BY role", _METRIC_NAMES, "n", "model, split"),
    ),
    "train_elastic": Query(linear("elastic")),
    "train_logistic": Query(classifier_report(("logistic",))),
    "stacking": Query(stacking),
    "fold_plans": Query(
        fold_plans,
        ask(GAMES + """, k AS (SELECT game_id, is_win, row_number() OVER (ORDER BY "Date", game_id) - 1 AS ix, count(*) OVER () AS n,
              row_number() OVER (PARTITION BY is_win ORDER BY md5('42-' || game_id), game_id) - 1 AS place FROM g),
            b AS (SELECT *, n // 7 AS size, n % 7 AS longer FROM k)""",
            """SELECT 'points' AS target, CASE WHEN ix < longer * (size + 1) THEN ix // (size + 1) ELSE longer + (ix - longer * (size + 1)) // size END AS fold, count(*) AS rows, sum(is_win) AS wins FROM b GROUP BY 2
            UNION ALL SELECT t, place % 3, count(*), sum(is_win) FROM k, (VALUES ('win'), ('double')) AS v(t) GROUP BY 1, 2""", "", "fold, rows, wins", "target"),
    ),
    "stacking_classifier": Query(stacking_win),
    "random_search": Query(search),
    "permutation_importance": Query(permuted),
    "learning_curve": Query(
        curve,
        ask(_ridge("""SELECT k * 10 + s AS fit, CASE WHEN d1 % 5 = k THEN 'validation' ELSE 'train' END AS role, i.*
              FROM (SELECT *, ('0x' || substr(h, 1, 7))::BIGINT AS d1, ('0x' || substr(h, 9, 7))::BIGINT AS d9 FROM (SELECT *, md5('42-' || game_id) AS h FROM inputs WHERE ix < floor(n * 0.8::DOUBLE))) i,
              range(5) AS a(k), range(10) AS b(s) WHERE d1 % 5 = k OR d9 < floor((s + 1) / 10::DOUBLE * 268435456)"""),
            """SELECT size, role, avg(n) AS rows, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std FROM (SELECT (fit % 10 + 1) / 10 AS size, role, count(*) AS n, """
            """1 - sum((y_pred - y) ** 2) / (var_pop(y) * count(*)) AS r2 FROM predicted GROUP BY fit, role) GROUP BY size, role""", "size, rows, r2_mean, r2_std", "", "role"),
    ),
    "cv_fit_expanding": Query(
        cross_validated(splits.expanding_bounds),
        ask(_ridge(_ordered("SELECT k AS fit, (floor(n * 0.6::DOUBLE) + floor((n - floor(n * 0.6::DOUBLE)) * k / 5))::BIGINT AS lo, least((floor(n * 0.6::DOUBLE) + floor((n - floor(n * 0.6::DOUBLE)) * k / 5))::BIGINT + floor(n * 0.2::DOUBLE)::BIGINT, n) AS hi FROM size, range(1, 6) AS r(k)")),
            f"SELECT fit AS fold, role, 'ridge' AS model, {_METRICS} FROM predicted GROUP BY fit, role", _METRIC_NAMES, "fold, n", "role, model"),
    ),
    "cv_fit_time_series": Query(
        cross_validated(splits.series_bounds),
        ask(_ridge(_ordered("SELECT k + 1 AS fit, n - n // 8 * (7 - k) AS lo, n - n // 8 * (6 - k) AS hi FROM size, range(7) AS r(k)")),
            f"SELECT fit AS fold, role, 'ridge' AS model, {_METRICS} FROM predicted GROUP BY fit, role", _METRIC_NAMES, "fold, n", "role, model"),
    ),
    "cv_fit_stratified": Query(cross_validated_classes),
    "model_save_load": Query(save_load, ask("", "SELECT count(*) AS rows, count(*) AS same, 8 AS features FROM orders", "", "rows, same, features")),
    "evaluate_model": Query(evaluate),
    "training_summary": Query(summary),
    "model_importance": Query(model_importance),
    "train_targets": Query(train_targets),
    "train_selection": Query(
        train_selection,
        ask(_INPUT_SQL + """, known AS (SELECT * FROM inputs WHERE ix < floor(n * 0.8::DOUBLE)), r AS (""" + " UNION ALL ".join(
            f"SELECT '{n}' AS feature, abs(corr({n}, y)) AS correlation FROM known" for n in INPUTS) + """), passed AS (SELECT count(*) AS k FROM r WHERE correlation >= 0.08),
            chosen AS (SELECT *, row_number() OVER (ORDER BY correlation DESC, feature) AS place FROM r)""",
            """SELECT feature, correlation, 0.08 AS at_least FROM chosen, passed WHERE CASE WHEN k = 0 THEN place <= 3 ELSE correlation >= 0.08 END
            UNION ALL SELECT feature, correlation, 0.0 AS at_least FROM chosen""", "correlation, at_least", "", "feature"),
    ),
    "train_total_bundle": Query(train_total_bundle),
    "score_games": Query(score_games),
}
