"""Learned models: better than the mean, leak-free splits, same results after reload."""

import pytest
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.operators import ensembles, evaluation, matchups, models, splits
from courtspark.sources.staging import staging_folder

NAMES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    x = F.rand(1) * 10
    df = spark.range(1200).select(
        col("id").alias("game_id"), F.expr("date_add(date'2024-01-01', cast(id div 20 as int))").alias("Date"),
        x.alias("a"), F.rand(2).alias("b"), F.rand(3).alias("noise"),
    )
    df = df.withColumn("target", 3 * col("a") + col("b") + F.rand(4))
    return df.withColumn("win", (col("a") > 5).cast("int")).withColumn("b", F.when(col("game_id") % 9 > 0, col("b"))).cache()


@pytest.fixture(scope="module")
def prepared(table):
    return models.prepare(table, NAMES, "target")


def test_split_is_in_time_order(prepared):
    last = prepared.train.agg(F.max(F.struct("Date", "game_id"))).first()[0]
    first = prepared.validation.agg(F.min(F.struct("Date", "game_id"))).first()[0]
    assert last < first
    assert prepared.train.count() == 960 and prepared.validation.count() == 240


def test_models_beat_the_mean_and_stack(prepared):
    chosen = {n: e for n, e in models.regressors("points", 8, 960).items() if n in ("forest", "ridge")}
    scored = models.predict_all(models.fit_all(prepared, chosen), prepared).where("split = 'validation'")
    assert all(r["r2"] > 0.8 for r in evaluation.regression_metrics(scored, ["model"]).collect())
    meta, bases = models.fit_stack(prepared, chosen, ("blocks", 2))
    stacked = evaluation.regression_metrics(models.predict_stack(meta, bases, prepared.validation)).first()
    assert stacked["r2"] > 0.9


def test_permutation_importance_finds_the_cause(prepared):
    model = models.regressors("points", 8, 960)["ridge"].fit(prepared.train)
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(model, prepared.validation, NAMES, 2).collect()}
    assert got["a"] > 3 and abs(got["noise"]) < 0.2


def test_scaler_is_fitted_on_train(prepared):
    scaled = models.scaled_columns(models.fit_scaler(prepared.train).transform(prepared.train), NAMES)
    row = scaled.agg(F.avg("a_scaled").alias("m"), F.stddev_samp("a_scaled").alias("s")).first()
    assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1)


def test_classifier_and_weights(table):
    p = models.prepare(table, NAMES, "win", shuffled=True)
    weighted = models.class_weights(p.train, "y", "balanced")
    sums = {r["y"]: r["w"] for r in weighted.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0.0] == pytest.approx(sums[1.0])
    model = models.classifiers("win", 8, "weight")["forest"].fit(weighted)
    got = evaluation.auc(models.predict_probability(model, p.validation, "forest")).first()
    assert got["auc_roc"] > 0.95


def test_saved_pipeline(spark, table):
    df = table.withColumn("y", col("target"))
    model = models.fit_pipeline(df, NAMES, models.regressors("points", 8, 1200)["ridge"])
    path = f"{staging_folder(spark)}/saved-test"
    models.save_model(model, path, df, NAMES, {"mae": 1.0})
    again, bundle = models.load_model(spark, path)
    a = [r[0] for r in model.transform(df).orderBy("game_id").select("prediction").collect()]
    b = [r[0] for r in again.transform(df).orderBy("game_id").select("prediction").collect()]
    assert a == b and bundle["features"] == NAMES


def test_ensembles(spark):
    data = [(1, "extra_trees", 220.0), (1, "ridge", 230.0), (1, "random_forest", 900.0), (2, "extra_trees", 210.0), (2, "ridge", 215.0), (2, "random_forest", 910.0)]
    df = spark.createDataFrame(data, "id int, model string, y_pred double")
    got = {r["id"]: r["y_pred"] for r in ensembles.weighted_ensemble(df).collect()}
    assert got[1] == pytest.approx((220 * 0.35 + 230 * 0.10) / 0.45)
    far = df.withColumn("y_pred", F.lit(900.0))
    assert {r["y_pred"] for r in ensembles.weighted_ensemble(far).collect()} == {250.0}
    conf = {r["id"]: r["confidence"] for r in ensembles.ensemble_confidence(df).collect()}
    assert conf[1] == pytest.approx((100 - 5 * 8) * 0.7 + 100 * 0.3)


def test_older_hybrid_with_nothing_plausible(spark):
    df = spark.createDataFrame([(500.0, None)], "x double, r double")
    members = {m: col("x") for m in ("extra_trees", "gradient_boost", "ridge")}
    assert ensembles.older_hybrid(df, members, col("x"), col("r")).first()["older"] == 265.0


def test_matchup_combines_by_name(spark):
    games = spark.createDataFrame([("A", "2024-01-01", 1, 100.0, 0.4), ("A", "2024-01-02", 2, 110.0, 0.5), ("B", "2024-01-01", 3, 90.0, 0.6)], "Team string, Date string, game_id int, PTS double, `FG%` double")
    fixtures = spark.createDataFrame([("A", "B", 1), ("A", "Z", 0)], "team1 string, team2 string, is_team1_home int")
    got = {r["team2"]: r for r in matchups.matchup_rows(fixtures, games, ["PTS", "FG%"]).collect()}
    assert got["B"]["PTS"] == pytest.approx(105 + 90) and got["B"]["FG%"] == pytest.approx((0.45 + 0.6) / 2)
    assert got["Z"]["PTS"] == pytest.approx(105)


def test_a_fit_in_every_fold(table):
    from courtspark.operators import splits

    p = models.prepare(table, NAMES, "target")
    whole = p.train.unionByName(p.validation)
    bounds = splits.series_bounds(1200, 4)
    chosen = {"ridge": models.regressors("points", 8, 1200)["ridge"]}
    got = models.cross_validate(splits.with_parts(whole, ["Date", "game_id"], bounds), chosen, 4).collect()
    assert {(r["fold"], r["role"]): r["n"] for r in got} == {(k + 1, role): n for k, (a, b) in enumerate(bounds) for role, n in (("train", a), ("validation", b - a))}
    assert all(r["r2"] > 0.9 for r in got)
    # the second fold is the fit on all rows before its bound
    end, stop = bounds[1]
    model = chosen["ridge"].fit(whole.where(col("game_id") < end))
    scored = model.transform(whole.where((col("game_id") >= end) & (col("game_id") < stop)))
    mae = scored.agg(F.avg(F.abs(col("prediction") - col("y")))).first()[0]
    assert next(r["mae"] for r in got if r["fold"] == 2 and r["role"] == "validation") == pytest.approx(mae)


def test_learning_curve_sizes(prepared):
    ridge = models.regressors("points", 8, 960)["ridge"]
    got = {(r["size"], r["role"]): r for r in models.learning_curve(prepared.train, ridge, (0.2, 1.0), folds=3).collect()}
    assert set(got) == {(s, r) for s in (0.2, 1.0) for r in ("train", "validation")}
    assert got[1.0, "train"]["rows"] == pytest.approx(640) and got[1.0, "validation"]["rows"] == pytest.approx(320)
    assert 60 < got[0.2, "train"]["rows"] < 200 and got[1.0, "validation"]["r2_mean"] > 0.9


def test_matchups_of_past_games_look_back_only(spark):
    data = []
    for i, (t, o, home, pts, pct) in enumerate([("a", "b", 1, 10, 0.5), ("b", "a", 0, 20, 0.4), ("a", "c", 0, 30, 0.3), ("c", "a", 1, 40, 0.2), ("a", "b", 1, 50, 0.1), ("a", "b", 0, 70, 0.9), ("b", "c", 1, 90, 0.8)]):
        data.append((i, f"2024-01-{i // 2 + 1:02d}", t, o, home, float(pts), pct))
    df = spark.createDataFrame(data, "game_id int, Date string, Team string, Opp string, is_home int, PTS double, `FG%` double")
    got = {r["game_id"]: r for r in matchups.matchup_history(df, ["PTS", "FG%", "is_home"], n=2).collect()}
    for g, _, team, opp, home, *_rest in data:
        def mean(side, k, g=g):
            mine = [r[k] for r in data if r[0] < g and r[2] == side][-2:]
            return sum(mine) / len(mine) if mine else 0.0

        assert got[g]["PTS"] == pytest.approx(mean(team, 5) + mean(opp, 5))
        assert got[g]["FG%"] == pytest.approx((mean(team, 6) + mean(opp, 6)) / 2) and got[g]["is_home"] == home


def test_sweep_values_are_those_of_cut_off_forests(table):
    p = models.prepare(table, NAMES, "win", shuffled=True)
    forest, chosen, tried = models.forest_sweep(p.train, p.validation, (2, 3, 7))
    assert [n for n, _ in tried] == [2, 3, 7] and chosen in (2, 3, 7) and forest.getNumTrees == 7
    got = {r["game_id"]: r for r in models.prefix_votes(forest, p.validation, (2, 3, 7), ["game_id"], step=3).collect()}
    rows = p.validation.select("game_id", "features").limit(40).collect()
    trees = forest.trees
    for r in rows:
        votes = [t.predictProbability(r["features"])[1] for t in trees]
        for n in (2, 3, 7):
            assert got[r["game_id"]][f"first_{n}"] == pytest.approx(sum(votes[:n]) / n)
        assert got[r["game_id"]]["first_7"] == pytest.approx(forest.predictProbability(r["features"])[1])
    with pytest.raises(ValueError):
        models.prefix_votes(forest, p.validation, (8,), ["game_id"])


@pytest.mark.parametrize("plan", [("blocks", 7), ("stratified", 3)])
def test_no_row_is_predicted_by_a_model_that_saw_it(table, plan):
    """A tree deep enough to know every row by its id gives each training row's own value back."""
    from pyspark.ml.regression import DecisionTreeRegressor

    known = table.limit(200).withColumn("own", col("game_id").cast("double")).withColumn("target", F.rand(9) * 1000)
    p = models.prepare(known, ["own"], "target", share=0.99)
    train = p.train.withColumn("value", col("y")).withColumn("y", (col("game_id") % 2).cast("double")) if plan[0] == "stratified" else p.train
    tree = {"tree": DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=12, maxBins=256)}
    scored = models.out_of_fold(train, tree, plan).cache()
    n = train.count()
    assert scored.count() == n and scored.select("game_id").distinct().count() == n
    assert scored.select("fold").distinct().count() == plan[1]
    folds = scored.groupBy("fold").agg(F.count("*").alias("n"), F.avg("y").alias("share"), F.min("game_id").alias("a"), F.max("game_id").alias("b")).orderBy("fold").collect()
    assert max(f["n"] for f in folds) - min(f["n"] for f in folds) <= (1 if plan[0] == "blocks" else 2)
    if plan[0] == "blocks":
        assert all(x["b"] < y["a"] for x, y in zip(folds, folds[1:]))  # in time order
        assert scored.where(F.abs(col("base_tree") - col("y")) < 1e-9).count() <= 2
    else:
        assert all(abs(f["share"] - 0.5) < 0.02 for f in folds)


def test_fold_plans_by_name(table):
    with pytest.raises(ValueError):
        splits.fold_plan(table, "hashed", 3)
    sizes = splits.block_folds(table.limit(10), ["game_id"], 4).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]


def test_fits_work_in_even_parts(spark, prepared):
    """Every core gets its share of the training rows, however few files the history was written in."""
    cores = spark.sparkContext.defaultParallelism
    sizes = prepared.train.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= cores and max(r["count"] for r in sizes) <= 2 * 960 / cores
    assert models.regressors("points")["forest"].getCacheNodeIds() and models.classifiers("win")["forest"].getCacheNodeIds()
    many = models.spread(spark.range(10), 20 * models.FIT_ROWS * cores, "id")
    assert many.rdd.getNumPartitions() == 20 * cores


def test_search_fits_settings_of_one_shape_once(prepared, monkeypatch):
    """The same errors as a fit per setting and fold, from fewer fits."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    fits, plain = [], GBTRegressor.fit
    space = {"maxIter": (2, 4, 5), "maxDepth": (2,), "stepSize": (0.3,), "subsamplingRate": (0.8,)}
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: fits.append(self.getMaxIter()) or plain(self, df))
    best, tried = models.random_search(prepared.train, 4, 2, space=space)
    assert len(fits) == 2 + 1
    folded = prepared.train.withColumn("_fold", F.pmod(F.xxhash64(col("game_id")), F.lit(2)).cast("int"))
    mae = RegressionEvaluator(labelCol="y", metricName="mae")
    for settings, got in tried:
        boost = GBTRegressor(featuresCol="features", labelCol="y", seed=models.SEED, **settings)
        own = [mae.evaluate(plain(boost, folded.where(col("_fold") != k)).transform(folded.where(col("_fold") == k))) for k in (0, 1)]
        assert got == pytest.approx(sum(own) / 2, abs=1e-9)
    assert best.getNumTrees == min(tried, key=lambda x: x[1])[0]["maxIter"]


def test_training_summary_has_auc_folds_and_stack(table):
    p = models.prepare(table, NAMES, "win", shuffled=True)
    chosen = {n: e for n, e in models.classifiers("win", 4).items() if n in ("forest", "logistic")}
    got = {r["model"]: r for r in models.training_summary(p, chosen, 3, ("stratified", 2)).collect()}
    assert set(got) == {"forest", "logistic", "stacking"}
    scored = models.predict_probability(chosen["logistic"].fit(p.train), p.validation, "logistic")
    assert got["logistic"]["auc_validation"] == pytest.approx(evaluation.auc(scored).first()["auc_roc"])
    # the folds again, one at a time
    folded = splits.stratified_folds(p.train.unionByName(p.validation).drop("features"), "y", "game_id", 3)
    areas, hits = [], []
    for k in range(3):
        fit = folded.where(col("fold") != k)
        fills = models.fills_by_median(fit, NAMES)
        held = models.predict_probability(chosen["logistic"].fit(models.assemble(fit, NAMES, fills)), models.assemble(folded.where(col("fold") == k), NAMES, fills), "logistic")
        areas.append(evaluation.auc(held).first()["auc_roc"])
        hits.append(evaluation.grouped_classification(held, ["model"]).first()["accuracy"])
    mean = lambda xs: sum(xs) / len(xs)
    std = lambda xs: mean([(x - mean(xs)) ** 2 for x in xs]) ** 0.5
    row = got["logistic"]
    assert (row["cv_auc_mean"], row["cv_accuracy_mean"]) == pytest.approx((mean(areas), mean(hits)), abs=1e-6)
    assert (row["cv_auc_std"], row["cv_accuracy_std"]) == pytest.approx((std(areas), std(hits)), abs=1e-6)
    assert all(r["auc_validation"] > 0.95 and r["train_rows"] + r["validation_rows"] == 1200 and r["features"] == 3 for r in got.values())
    assert row["positive_share"] == pytest.approx(p.train.unionByName(p.validation).agg(F.avg("y")).first()[0])


def test_fits_of_few_rows_take_few_tasks(prepared):
    cores = prepared.train.sparkSession.sparkContext.defaultParallelism
    rows, at_once = models.narrow(prepared.train, 960)
    assert rows.rdd.getNumPartitions() == 1 and at_once == 2 * cores
    many, few_at_once = models.narrow(prepared.train, 100 * cores * models.FIT_ROWS)
    assert many.rdd.getNumPartitions() == prepared.train.rdd.getNumPartitions() and few_at_once == models.FITS_AT_ONCE


def test_sweep_scores_all_sizes_in_one_call(table):
    p = models.prepare(table, NAMES, "win", shuffled=True)
    forest = models.ForestClassifier(featuresCol="features", labelCol="y", numTrees=7, maxDepth=3, seed=1).fit(p.train)
    plan = models.prefix_votes(forest, p.validation, (2, 3, 7), ["game_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one scan by MLlib is a function call per tree and row
