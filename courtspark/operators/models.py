"""Learned models on MLlib: scaling, fitting, stacking, searching, importance, scoring.

Every fit reads a table that was written once, so the feature plan runs once.
"""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from courtspark.functions.scalars import col, with_scalar
from courtspark.operators import evaluation
from courtspark.operators.cleaning import fill_missing, fills_by_median
from courtspark.operators.forests import ForestClassifier, ForestRegressor, QuickClassification, quick
from courtspark.operators.loading import check_trainable
from courtspark.operators.splits import by_row_fraction, fold_plan, stratified, stratified_folds
from courtspark.plans.ordering import row_index
from courtspark.plans.sizes import row_count
from courtspark.sources.staging import stage

# --- fixed values: model settings per level -----------------------------------------------------
LEVELS = {
    "moderate": {"forest_trees": 500, "forest_depth": 12, "forest_leaf": 4, "forest_share": 0.7,
                 "boost_trees": 300, "boost_rate": 0.05, "boost_depth": 6, "boost_sample": 0.8,
                 "ridge": 50.0, "elastic": 10.0, "elastic_mix": 0.5},
    "ultra_conservative": {"forest_trees": 200, "forest_depth": 8, "forest_leaf": 10,
                           "forest_share": 0.5, "boost_trees": 100, "boost_rate": 0.01,
                           "boost_depth": 4, "boost_sample": 0.6, "ridge": 100.0, "elastic": 20.0,
                           "elastic_mix": 0.7},
    "aggressive": {"forest_trees": 800, "forest_depth": 15, "forest_leaf": 2, "forest_share": 0.5,
                   "boost_trees": 500, "boost_rate": 0.1, "boost_depth": 8, "boost_sample": 0.6,
                   "ridge": 10.0, "elastic": 5.0, "elastic_mix": 0.7},
    "win": {"forest_trees": 50, "forest_depth": 4, "forest_leaf": 25, "forest_share": 0.4,
            "boost_trees": 50, "boost_rate": 0.02, "boost_depth": 3, "boost_sample": 0.5},
    "points": {"forest_trees": 300, "forest_depth": 8, "forest_leaf": 8, "forest_share": 0.6,
               "boost_trees": 300, "boost_rate": 0.03, "boost_depth": 5, "boost_sample": 0.75,
               "ridge": 50.0, "elastic": 10.0, "elastic_mix": 0.5},
    "double": {"forest_trees": 150, "forest_depth": 6, "forest_leaf": 8, "forest_share": 0.5,
               "boost_trees": 120, "boost_rate": 0.03, "boost_depth": 4, "boost_sample": 0.85},
}
POSITIVE_WEIGHT = 12.0
META_POSITIVE_WEIGHT = 15.0
SEARCH_SPACE = {"maxIter": (20, 30, 40), "maxDepth": (3, 4, 5), "stepSize": (0.02, 0.03, 0.05), "subsamplingRate": (0.7, 0.8)}
SWEEP_TREES = tuple(range(50, 201, 25))
# fixed values: folds that a stack's base predictions come from
STACK_PLANS = {"points": ("blocks", 7), "win": ("stratified", 3), "double": ("stratified", 3)}
SEED = 42
#: Fits that are submitted to Spark at a time; each is a distributed job of its own.
FITS_AT_ONCE = 4
#: Rows of one task of a fit.
FIT_ROWS = 500_000


@dataclass(frozen=True)
class Prepared:
    """A written table with ``y``, a feature vector and the columns it was made of."""

    train: DataFrame
    validation: DataFrame
    features: list[str]
    fills: dict[str, float]


def assemble(df: DataFrame, features: Sequence[str], fills: Mapping[str, float]) -> DataFrame:
    """Known finite doubles in one vector column ``features``."""
    filled = fill_missing(df, {f: fills.get(f, 0.0) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Narrow rows dealt out by ``key``, evenly over all cores and at most about ``FIT_ROWS`` to a task: fits and scores work in
    the files that a table was written in, and a history leaves a file per few entities."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // FIT_ROWS)), key)


def split_rows(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[str] = ("Date", "game_id"),
    share: float = 0.8,
    key: str = "game_id",
    shuffled: bool = False,
) -> DataFrame:
    """Key, order, ``y``, the features as doubles and ``split`` in time order (or per class), written once."""
    check_trainable(df, list(features), target)
    known = df.where(col(target).isNotNull()).select(
        *dict.fromkeys([key, *order]), col(target).cast("double").alias("y"), *[col(f).cast("double").alias(f) for f in features if f not in (key, *order)]
    )
    rows = row_count(known.select(*order))
    split = stratified(known, "y", key, share) if shuffled else by_row_fraction(known, order, share, rows=rows)
    return stage(spread(split, rows, key), "prepared")


def prepare(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[str] = ("Date", "game_id"),
    share: float = 0.8,
    key: str = "game_id",
    shuffled: bool = False,
) -> Prepared:
    """Split in time order (or per class), fit the fills on train only, write once."""
    whole = split_rows(df, features, target, order, share, key, shuffled)
    fills = fills_by_median(whole.where(col("split") == "train"), list(features))
    vectors = assemble(whole, features, fills)
    return Prepared(
        vectors.where(col("split") == "train"), vectors.where(col("split") != "train"), list(features), fills
    )


# ------------------------------------------------------------------ scaling


def fit_scaler(train: DataFrame, out: str = "scaled"):
    """Centre and divide by the sample deviation of the training rows."""
    return StandardScaler(inputCol="features", outputCol=out, withMean=True, withStd=True).fit(train)


def scaled_columns(df: DataFrame, features: Sequence[str], column: str = "scaled") -> DataFrame:
    values = vector_to_array(col(column))
    return df.withColumns({f"{f}_scaled": values[i] for i, f in enumerate(features)})


# ------------------------------------------------------------------ estimators


def _settings(level: str, trees: int | None) -> dict:
    """Settings of a level; ``trees`` replaces the sizes of forests and boosting."""
    s = dict(LEVELS[level])
    if trees is not None:
        s |= {"forest_trees": trees, "boost_trees": trees}
    return s


def regressors(level: str = "points", trees: int | None = None, rows: int = 1) -> dict[str, object]:
    """Forest, boosting, ridge and elastic net. MLlib scales penalties by the number of rows."""
    s = _settings(level, trees)
    common = {"featuresCol": "features", "labelCol": "y", "seed": SEED}
    out = {
        "forest": ForestRegressor(
            cacheNodeIds=True,  # where MLlib does the fit
            numTrees=s["forest_trees"], maxDepth=s["forest_depth"], minInstancesPerNode=s["forest_leaf"],
            featureSubsetStrategy=str(s["forest_share"]), **common),
        "boosting": GBTRegressor(
            maxIter=s["boost_trees"], maxDepth=s["boost_depth"], stepSize=s["boost_rate"],
            subsamplingRate=s["boost_sample"], **common),
    }
    if "ridge" in s:
        out["ridge"] = LinearRegression(
            featuresCol="features", labelCol="y", regParam=s["ridge"] / max(rows, 1), elasticNetParam=0.0
        )
        out["elastic"] = LinearRegression(
            featuresCol="features", labelCol="y", regParam=s["elastic"], elasticNetParam=s["elastic_mix"]
        )
    return out


def classifiers(level: str = "win", trees: int | None = None, weight: str | None = None) -> dict[str, object]:
    s = _settings(level, trees)
    extra = {"weightCol": weight} if weight else {}
    common = {"featuresCol": "features", "labelCol": "y", "seed": SEED, **extra}
    return {
        "forest": ForestClassifier(
            cacheNodeIds=True,
            numTrees=s["forest_trees"], maxDepth=s["forest_depth"], minInstancesPerNode=s["forest_leaf"],
            featureSubsetStrategy=str(s["forest_share"]), **common),
        "boosting": GBTClassifier(
            maxIter=s["boost_trees"], maxDepth=s["boost_depth"], stepSize=s["boost_rate"],
            subsamplingRate=s["boost_sample"], **common),
        "logistic": LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01, **extra),
    }


def early_stopped_boosting(train: DataFrame, validation: DataFrame, level: str = "win", trees: int | None = None):
    """Boosting that stops when the validation error no longer falls; returns model and size."""
    s = _settings(level, trees)
    both = train.withColumn("_held", F.lit(False)).unionByName(validation.withColumn("_held", F.lit(True)))
    model = GBTClassifier(
        featuresCol="features", labelCol="y", maxIter=s["boost_trees"], maxDepth=s["boost_depth"],
        stepSize=s["boost_rate"], validationIndicatorCol="_held", validationTol=1e-3, seed=SEED,
    ).fit(both)
    return model, model.getNumTrees


def prefix_votes(forest, df: DataFrame, sizes: Sequence[int], keep: Sequence[str], step: int = 25) -> DataFrame:
    """``keep`` and, for every size n, the mean vote of the forest's first n trees for class 1 (``first_n``): what a forest
    cut off after n trees gives.

    Every tree scores a row once. Trees are taken ``step`` at a time, and their votes are added to a running sum, so
    a row carries one number and the wanted means. A forest of two classes does so within one scan of a batch."""
    forest = quick(forest)
    if max(sizes) <= forest.getNumTrees and isinstance(forest, QuickClassification):
        rising, names = sorted(set(sizes)), [col(c) for c in dict.fromkeys(keep)]
        rows = df.select(*dict.fromkeys([*keep, "features"])).withColumn("_means", forest.means(rising))
        return rows.select(*names, *[F.element_at("_means", i + 1).alias(f"first_{n}") for i, n in enumerate(rising)])
    trees = forest.trees[: max(sizes)]
    if max(sizes) > len(trees):
        raise ValueError(f"{max(sizes)} trees wanted, the forest has {len(trees)}")
    marks = sorted({*sizes, *range(0, len(trees), step), len(trees)})
    names = list(keep)
    out = df.select(*[col(c) for c in dict.fromkeys([*keep, "features"])]).withColumn("_votes", F.lit(0.0))
    for a, b in zip(marks, marks[1:], strict=False):
        scored, votes = out, col("_votes")
        for i in range(a, b):
            tree = trees[i].setPredictionCol("").setProbabilityCol(f"_t{i}").setRawPredictionCol("")
            scored = tree.transform(scored)
            votes = votes + vector_to_array(col(f"_t{i}"))[1]
        columns = [col(c) for c in dict.fromkeys([*names, "features"])]
        out = scored.select(*columns, votes.alias("_votes"))
        if b in sizes:
            out = out.withColumn(f"first_{b}", col("_votes") / b)
            names.append(f"first_{b}")
    return out.select(*[col(c) for c in dict.fromkeys(names)])


def forest_sweep(train: DataFrame, validation: DataFrame, sizes: Sequence[int] = SWEEP_TREES, level: str = "win"):
    """One forest of the largest size and the validation AUC of each of its first n trees. Gives the forest, the smallest
    n with the best AUC and (n, AUC) of all."""
    s = LEVELS[level]
    forest = ForestClassifier(
        featuresCol="features", labelCol="y", numTrees=max(sizes), maxDepth=s["forest_depth"],
        minInstancesPerNode=s["forest_leaf"], seed=SEED,
    ).fit(train)
    votes = stage(prefix_votes(forest, validation, sizes, ["y"]), "votes")
    best, chosen, tried = -1.0, None, []
    for n in sorted(sizes):
        scored = votes.select(col("y").cast("int").alias("y_true"), col(f"first_{n}").alias("y_proba"))
        auc = evaluation.auc(scored).first()["auc_roc"]
        tried.append((n, auc))
        if auc > best + 1e-4:
            best, chosen = auc, n
    return forest, chosen, tried


def class_weights(df: DataFrame, label: str, positive: float | str = POSITIVE_WEIGHT) -> DataFrame:
    """Weight 1 for negatives and a fixed weight for positives, or 'balanced': n / (2 * n_class)."""
    y = col(label)
    if positive == "balanced":
        counts = df.agg(F.count("*").alias("_all"), F.sum(y).alias("_pos"))
        w = F.when(y == 1, col("_all") / (2 * col("_pos"))).otherwise(col("_all") / (2 * (col("_all") - col("_pos"))))
        return with_scalar(df, counts).withColumn("weight", w).drop("_all", "_pos")
    return df.withColumn("weight", F.when(y == 1, F.lit(float(positive))).otherwise(1.0))


# ------------------------------------------------------------------ prediction


def predict_value(model, df: DataFrame, name: str, key: str = "game_id") -> DataFrame:
    return model.transform(df).select(
        col(key).alias("id"), F.lit(name).alias("model"), "split", col("y").alias("y_true"), col("prediction").alias("y_pred")
    )


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(col(column))[1]


def predict_probability(model, df: DataFrame, name: str, key: str = "game_id") -> DataFrame:
    return model.transform(df).select(
        col(key).alias("id"), F.lit(name).alias("model"), "split", col("y").cast("int").alias("y_true"),
        positive_probability().alias("y_proba"),
    )


def _together(jobs: Sequence, at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent fits, several submitted to Spark at a time."""
    with ThreadPool(max(1, min(at_once, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(j) for j in jobs])


def narrow(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``n`` rows in as few tasks as may be, and how many fits on them to run at a time: a fit of hundreds of
    small jobs spends its time on starting tasks, so fits share the cores rather than each taking all."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // FIT_ROWS))
    return rows.coalesce(tasks) if tasks < cores else rows, max(FITS_AT_ONCE, 2 * cores // tasks)


def fit_all(prepared: Prepared, estimators: Mapping[str, object]) -> dict[str, object]:
    fitted = _together([lambda e=e: e.fit(prepared.train) for e in estimators.values()])
    return dict(zip(estimators, fitted, strict=True))


def predict_all(models: Mapping[str, object], prepared: Prepared, probability: bool = False) -> DataFrame:
    """Long predictions of all models for both parts of the split."""
    whole = prepared.train.unionByName(prepared.validation)
    wide = _chain(models, whole, probability)
    value = "y_proba" if probability else "y_pred"
    items = F.array(*[F.struct(F.lit(n).alias("model"), col(f"base_{n}").alias(value)) for n in models])
    truth = col("y").cast("int") if probability else col("y")
    return wide.select(col("game_id").alias("id"), "split", truth.alias("y_true"), F.inline(items)).select("id", "model", "split", "y_true", value)


def importances(models: Mapping[str, object], features: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, model, importance) of the models that have importances."""
    rows = [
        F.struct(F.lit(f).alias("feature"), F.lit(name).alias("model"), F.lit(float(v)).alias("importance"))
        for name, m in models.items()
        if hasattr(m, "featureImportances")
        for f, v in zip(features, m.featureImportances.toArray(), strict=True)
    ]
    return df.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*rows)))


# ------------------------------------------------------------------ stacking


def _chain(models: Mapping[str, object], df: DataFrame, probability: bool) -> DataFrame:
    """Predictions of several models side by side: transforms in a row, no join."""
    keep = df.columns
    for name, m in models.items():
        scored = m.transform(df)
        value = positive_probability() if probability else col("prediction")
        df = scored.select(*[col(c) for c in keep], value.alias(f"base_{name}"))
        keep = df.columns
    return df


def out_of_fold(
    train: DataFrame, estimators: Mapping[str, object], plan: tuple[str, int] = STACK_PLANS["points"], key: str = "game_id",
    probability: bool = False, order: Sequence[str] = ("Date", "game_id"),
) -> DataFrame:
    """Base predictions of every training row from models that have not seen it, and the ``fold`` it was in."""
    kind, folds = plan
    # the plan names a fold per row once, written; fits and scores only filter it
    names = stage(fold_plan(train.select(*dict.fromkeys([key, "y", *order])), kind, folds, order, "y", key).select(key, "fold"), "folds")
    folded = stage(spread(train.join(names, key), names.count(), key), "folded")
    pairs = [(k, n) for k in range(folds) for n in estimators]
    fitted = dict(zip(pairs, _together([lambda k=k, n=n: estimators[n].fit(folded.where(col("fold") != k)) for k, n in pairs]), strict=True))
    parts = []
    for k in range(folds):
        parts.append(_chain({n: fitted[k, n] for n in estimators}, folded.where(col("fold") == k), probability))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_stack(
    prepared: Prepared, estimators: Mapping[str, object], plan: tuple[str, int] = STACK_PLANS["points"], key: str = "game_id",
    probability: bool = False, order: Sequence[str] = ("Date", "game_id"), positive: float = META_POSITIVE_WEIGHT,
):
    """Meta-model on out-of-fold predictions, and the base models fitted on all training rows."""
    names = [f"base_{n}" for n in estimators]
    oof = out_of_fold(prepared.train, estimators, plan, key, probability, order).select(key, "y", *names)
    table = class_weights(stage(oof, "stack"), "y", positive)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(table)
    if probability:
        meta = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=0.01)
    else:
        meta = LinearRegression(featuresCol="features", labelCol="y", regParam=0.1)
    return meta.fit(vectors), fit_all(prepared, estimators)


def predict_stack(meta, bases: Mapping[str, object], df: DataFrame, key: str = "game_id", probability: bool = False) -> DataFrame:
    names = [f"base_{n}" for n in bases]
    wide = _chain(bases, df, probability).drop("features")
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
    one = predict_probability if probability else predict_value
    return one(meta, vectors, "stacking", key)


def predict_with_stack(meta, bases: Mapping[str, object], df: DataFrame) -> DataFrame:
    """(model, split, y_true, y_proba) of the base classifiers and of their stack, from one scan."""
    names = [f"base_{n}" for n in bases]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(_chain(bases, df, True).drop("features"))
    scored = meta.transform(vectors).withColumn("base_stacking", positive_probability())
    items = F.array(*[F.struct(F.lit(n).alias("model"), col(f"base_{n}").alias("y_proba")) for n in (*bases, "stacking")])
    return scored.select("split", col("y").cast("int").alias("y_true"), F.inline(items))


def training_summary(
    prepared: Prepared, estimators: Mapping[str, object], folds: int = 5, plan: tuple[str, int] = STACK_PLANS["win"],
    key: str = "game_id", order: Sequence[str] = ("Date", "game_id"),
) -> DataFrame:
    """One row per classifier and one for their stack: accuracy and AUC on both parts and the gap; mean and deviation of both
    over stratified folds of all rows, in which everything is fitted anew, fills too; rows, inputs and share of positives. The stack weighs both classes alike."""
    whole = prepared.train.unionByName(prepared.validation).drop("features")
    folded = stage(spread(stratified_folds(whole, "y", key, folds), row_count(whole.select(key)), key), "folds")
    parts = [prepared]
    for k in range(folds):
        rows = folded.withColumn("split", F.when(col("fold") == k, "validation").otherwise("train")).drop("fold")
        fills = fills_by_median(rows.where(col("split") == "train"), prepared.features)
        vectors = assemble(rows, prepared.features, fills)
        parts.append(Prepared(vectors.where(col("split") == "train"), vectors.where(col("split") != "train"), prepared.features, fills))
    out = None
    stacks = _together([lambda part=part: fit_stack(part, estimators, plan, key, True, order, 1.0) for part in parts], 2)
    for k, (part, (meta, bases)) in enumerate(zip(parts, stacks, strict=True)):  # part 0 is the holdout, of which both sides are scored
        scored = part.validation if k else part.train.unionByName(part.validation)
        long = predict_with_stack(meta, bases, scored).withColumn("part", F.lit(k))
        out = long if out is None else out.unionByName(long)
    out = stage(out, "scored")
    cells = [(k, split, n) for k in range(folds + 1) for split in ("train", "validation") if not k or split != "train" for n in (*estimators, "stacking")]
    area = lambda k, split, n: evaluation.auc(out.where((col("part") == k) & (col("split") == split) & (col("model") == n))).first()["auc_roc"]
    areas = _together([lambda c=c: area(*c) for c in cells])
    auc = out.sparkSession.createDataFrame([(*c, a) for c, a in zip(cells, areas, strict=True)], "part int, split string, model string, auc double")
    by_fold = evaluation.grouped_classification(out.where("part > 0"), ["part", "split", "model"]).join(auc, ["part", "split", "model"])
    cv = evaluation.cv_summary(by_fold, ["accuracy", "auc"], ["model"])
    holdout = out.where("part = 0")
    is_train = col("split") == "train"
    sizes = holdout.groupBy("model").agg(
        F.count(F.when(is_train, 1)).alias("train_rows"), F.count(F.when(~is_train, 1)).alias("validation_rows"), F.avg("y_true").alias("positive_share"))
    both = auc.where("part = 0").groupBy("model").agg(*[F.max(F.when(col("split") == s, col("auc"))).alias(f"auc_{s}") for s in ("train", "validation")])
    cv = cv.select("model", *[col(f"{m}_{x}").alias(f"cv_{m}_{x}") for m in ("accuracy", "auc") for x in ("mean", "std")])
    row = evaluation.accuracy_gap(holdout).join(both, "model").join(cv, "model").join(sizes, "model")
    return row.withColumn("features", F.lit(len(prepared.features)))


# ------------------------------------------------------------------ search and curves


def random_params(n: int = 15, seed: int = SEED, space: Mapping[str, Sequence] = SEARCH_SPACE) -> list[dict]:
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in space.items()} for _ in range(n)]


def random_search(train: DataFrame, n: int = 15, folds: int = 5, parallelism: int = FITS_AT_ONCE, key: str = "game_id", space=SEARCH_SPACE):
    """Cross-validated boosting over random settings, by mean absolute error; the best setting is fitted on all rows.

    Settings that differ in ``maxIter`` alone are one fit per fold: boosting of fewer rounds is the first trees of
    one of more, and one scan of the fold gives the error after every round."""
    tried = random_params(n, space=space)
    shape = lambda p: tuple(sorted((k, v) for k, v in p.items() if k != "maxIter"))
    rounds: dict[tuple, int] = {}
    for p in tried:
        rounds[shape(p)] = max(rounds.get(shape(p), 0), p["maxIter"])
    boost = lambda p: GBTRegressor(featuresCol="features", labelCol="y", seed=SEED, **p)
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(col(key)), F.lit(folds)).cast("int"))

    def errors(p: tuple, k: int) -> list[float]:
        model = boost(dict(p) | {"maxIter": rounds[p]}).fit(folded.where(col("_fold") != k))
        return model.evaluateEachIteration(folded.where(col("_fold") == k), "absolute")

    jobs = [(p, k) for p in rounds for k in range(folds)]
    found = dict(zip(jobs, _together([lambda p=p, k=k: errors(p, k) for p, k in jobs], parallelism), strict=True))
    means = [sum(found[shape(p), k][p["maxIter"] - 1] for k in range(folds)) / folds for p in tried]
    best = tried[means.index(min(means))]
    return boost(best).fit(train), list(zip(tried, means, strict=True))


def permutation_importance(
    model, df: DataFrame, features: Sequence[str], repeats: int = 5, key: str = "game_id", limit: int | None = None
) -> DataFrame:
    """Rise of the mean absolute error when one column is shuffled, mean and deviation.

    Rows get an index; a repeat pairs index i with (a*i + b) mod n, a permutation since a and n
    share no divisor. One equi-join per repeat moves all columns; each row is then scored once
    per feature with that single value exchanged.
    """
    import math

    from pyspark.ml.functions import array_to_vector

    known = df.select(key, "y", *features)
    n = row_count(known)
    # scoring walks every tree once per feature and repeat: even parts for all cores
    rows = stage(spread(row_index(known, [col(key)], "_ix", limit, n), n * len(features) * repeats, "_ix"), "indexed")
    base = _mae(model, rows.withColumn("features", array_to_vector(_values(features))))
    rng, parts = random.Random(SEED), []
    for r in range(repeats):
        a = next(x for x in iter(lambda: rng.randrange(1, max(n, 2)), None) if math.gcd(x, n) == 1)
        b = rng.randrange(max(n, 1))
        other = rows.select(
            ((col("_ix") * a + b) % n).alias("_ix"), *[col(f).alias(f"_p_{f}") for f in features]
        )
        pairs = rows.join(other, "_ix")
        parts.append(spread(pairs, n * len(features), "_ix").withColumn("repeat", F.lit(r)))
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    variants = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.array(*[col(f"_p_{g}" if g == f else g).cast("double") for g in features]).alias("values"),
            )
            for f in features
        ]
    )
    scored = model.transform(
        joined.select("repeat", "y", F.inline(variants)).withColumn("features", array_to_vector("values"))
    )
    mae = scored.groupBy("feature", "repeat").agg(F.avg(F.abs(col("prediction") - col("y"))).alias("mae"))
    return mae.groupBy("feature").agg(
        F.avg(col("mae") - base).alias("importance"), F.stddev_pop("mae").alias("std")
    )


def _values(features: Sequence[str]) -> Column:
    return F.array(*[col(f).cast("double") for f in features])


def _mae(model, df: DataFrame) -> float:
    return model.transform(df).agg(F.avg(F.abs(col("prediction") - col("y")))).first()[0]


def learning_curve(
    df: DataFrame, estimator, sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, key: str = "game_id"
) -> DataFrame:
    """Train and validation R2 for nested shares of the training rows, mean over folds."""
    draw = F.pmod(F.xxhash64(col(key), F.lit(SEED)), F.lit(10_000)) / 10_000
    folded = df.withColumns({"_fold": F.pmod(F.xxhash64(col(key)), F.lit(folds)), "_draw": draw})
    jobs = [(i, k) for i in range(len(sizes)) for k in range(folds)]
    fit = lambda i, k: estimator.fit(folded.where((col("_fold") != k) & (col("_draw") < sizes[i])))
    fitted = dict(zip(jobs, _together([lambda i=i, k=k: fit(i, k) for i, k in jobs]), strict=True))
    out = None
    for k in range(folds):  # the models of all sizes score a fold's rows in one scan
        wide = _chain({str(i): fitted[i, k] for i in range(len(sizes))}, folded, False)
        items = F.array(*[F.struct(F.lit(float(x)).alias("size"), col(f"base_{i}").alias("y_pred")) for i, x in enumerate(sizes)])
        role = F.when(col("_fold") == k, "validation").otherwise("train")
        long = wide.select(role.alias("role"), col("y").alias("y_true"), "_draw", F.inline(items))
        long = long.where((col("role") == "validation") | (col("_draw") < col("size")))
        part = evaluation.regression_metrics(long, ["size", "role"]).select("size", "role", "n", "r2")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("size", "role").agg(F.avg("n").alias("rows"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))


def cross_validate(table: DataFrame, estimators: Mapping[str, object], folds: int, probability: bool = False) -> DataFrame:
    """A fit per fold and model. ``table`` has y, features and ``parts``: one (fold, role) struct for
    every part a row belongs to, role "train" or "validation"; fold from 1 to ``folds``. Gives
    (fold, role, model, metrics of the predictions) from one scan per fold."""
    mine = lambda k, role: F.exists("parts", lambda p: (p["fold"] == k) & (p["role"] == role))
    jobs = [(k, n) for k in range(1, folds + 1) for n in estimators]
    fits = _together([lambda k=k, n=n: estimators[n].fit(table.where(mine(k, "train"))) for k, n in jobs])
    fitted = dict(zip(jobs, fits, strict=True))
    value, out = "y_proba" if probability else "y_pred", None
    for k in range(1, folds + 1):
        rows = table.withColumn("role", F.when(mine(k, "validation"), "validation").when(mine(k, "train"), "train")).where("role IS NOT NULL")
        wide = _chain({n: fitted[k, n] for n in estimators}, rows, probability)
        items = F.array(*[F.struct(F.lit(n).alias("model"), col(f"base_{n}").alias(value)) for n in estimators])
        truth = col("y").cast("int") if probability else col("y")
        long = wide.select(F.lit(k).alias("fold"), "role", truth.alias("y_true"), F.inline(items))
        metrics = evaluation.grouped_classification if probability else evaluation.regression_metrics
        part = metrics(long, ["fold", "role", "model"])
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ saving


def fit_pipeline(df: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    """Imputer, assembler and estimator in one pipeline that can be saved."""
    outs = [f"_f{i}" for i in range(len(features))]
    stages = [
        Imputer(inputCols=list(features), outputCols=outs, strategy="median", relativeError=0.0001),
        VectorAssembler(inputCols=outs, outputCol="features"),
        estimator,
    ]
    return Pipeline(stages=stages).fit(df)


def save_model(model: PipelineModel, path: str, df: DataFrame, features: Sequence[str], metrics: Mapping[str, float]) -> None:
    """The pipeline and, beside it, one metadata row: features, metrics, time."""
    model.write().overwrite().save(f"{path}/pipeline")
    meta = json.dumps({"features": list(features), "metrics": dict(metrics)})
    row = df.agg(F.count("*").alias("rows"))
    row.select("rows", F.lit(meta).alias("bundle"), F.current_timestamp().alias("saved")).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    row = spark.read.schema("rows long, bundle string, saved timestamp").json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/pipeline"), json.loads(row["bundle"])
