"""Linear fits from sums of products: the same as fits on the rows, for every fold, gaps included."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.operators import evaluation
from courtspark.operators import moments as M

NAMES = ["a", "b%", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    a, b, c = r.normal(5, 2, 600), r.normal(0, 1, 600), r.normal(100, 30, 600)
    y = 3 * a - 2 * b + 0.05 * c + r.normal(0, 1, 600)
    data = [(i, float(y[i]), None if i % 7 == 0 else float(a[i]), float("nan") if i % 11 == 0 else float(b[i]), float(c[i]), 4.0, i % 3) for i in range(600)]
    return spark.createDataFrame(data, "game_id long, y double, a double, `b%` double, c double, flat double, cell int").cache()


def matrix(rows, where="true"):
    got = rows.where(where).orderBy("game_id").select("y", *[col(n) for n in NAMES]).collect()
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in got], float)
    return x, np.array([r[0] for r in got])


def plain_ridge(x, y, alpha=M.RIDGE):
    fills = np.nanmean(x, axis=0)
    full = np.where(np.isnan(x), fills, x)
    mean, s = full.mean(0), full.std(0)
    s[s < 1e-9] = np.inf
    z = (full - mean) / s
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda new: y.mean() + ((np.where(np.isnan(new), fills, new) - mean) / s) @ b


def test_ridge_of_cells_is_the_fit_on_their_rows(rows):
    moments = M.cell_moments(rows, NAMES, "y")
    assert set(moments) == {0, 1, 2} and moments[0].gaps == ["a", "b%"]
    for cells in ([0], [0, 2], [0, 1, 2]):
        fit = M.fit_cells(moments, cells)
        got = [r[0] for r in rows.orderBy("game_id").select(fit.predict()).collect()]
        want = plain_ridge(*matrix(rows, f"cell IN ({', '.join(map(str, cells))})"))(matrix(rows)[0])
        assert np.allclose(got, want, atol=1e-8)


@pytest.fixture(scope="module")
def full(rows):
    return rows.na.drop().where("NOT isnan(`b%`)").select("game_id", "y", "cell", *[col(n) for n in NAMES]).cache()


def test_lasso_is_that_of_the_library(full):
    """With a part for squares the library divides it by the deviation of the target, so only mix 1 is compared."""
    fit = M.fit_cells(M.cell_moments(full, ["a", "b%", "c"], "y"), [0, 1, 2], lambda m: m.elastic(0.5, 1.0))
    vectors = VectorAssembler(inputCols=["a", "b%", "c"], outputCol="features").transform(full)
    library = LinearRegression(labelCol="y", regParam=0.5, elasticNetParam=1.0, tol=1e-12, maxIter=1000).fit(vectors)
    assert np.allclose(list(fit.coefficients.values()), library.coefficients.toArray(), rtol=5e-3)
    none = M.fit_cells(M.cell_moments(full, ["a"], "y"), [0, 1, 2], lambda m: m.elastic(1e6))
    assert none.coefficients == {"a": 0.0} and none.intercept == pytest.approx(full.agg(F.avg("y")).first()[0])


@pytest.mark.parametrize("alpha,mix", [(0.5, 0.5), (2.0, 0.7), (0.1, 0.0)])
def test_elastic_net_is_at_its_minimum(full, alpha, mix):
    fit = M.fit_cells(M.cell_moments(full, NAMES, "y"), [0, 1, 2], lambda m: m.elastic(alpha, mix))
    x, y = matrix(full)
    s = np.where(x.std(0) > 1e-9, x.std(0), 1)
    z, b = (x - x.mean(0)) / s, np.array(list(fit.coefficients.values())) * s
    pull = z.T @ (y - y.mean() - z @ b) / len(y) - alpha * (1 - mix) * b
    assert np.allclose(pull[b != 0], alpha * mix * np.sign(b[b != 0]), atol=1e-8)
    assert (np.abs(pull[b == 0]) <= alpha * mix + 1e-8).all() and b[3] == 0


@pytest.mark.parametrize("limit", [None, 50])
def test_ordered_folds_fill_and_fit_on_their_own_rows(rows, limit):
    bounds = [(100, 200), (300, 450), (450, 600)]
    got = {(r["fold"], r["role"]): r for r in M.cross_validate(rows, NAMES, ["game_id"], bounds, {"ridge": M.Moments.ridge}, limit).collect()}
    assert len(got) == 6
    for k, (end, stop) in enumerate(bounds):
        model = plain_ridge(*matrix(rows, f"game_id < {end}"))
        for role, where in (("train", f"game_id < {end}"), ("validation", f"game_id >= {end} AND game_id < {stop}")):
            x, y = matrix(rows, where)
            assert got[k + 1, role]["n"] == len(y)
            assert got[k + 1, role]["mae"] == pytest.approx(np.abs(model(x) - y).mean(), abs=1e-9)


def test_learning_curve_is_made_of_fits_on_its_rows(rows):
    got = {(r["size"], r["role"]): r for r in M.learning_curve(rows, NAMES, sizes=(0.3, 1.0), folds=3).collect()}
    drawn = rows.select("game_id", M.drawn(col("game_id"), 42, 1).alias("f"), M.drawn(col("game_id"), 42, 9).alias("d"))
    with_draw = rows.join(drawn.withColumn("f", col("f") % 3), "game_id").cache()
    for size in (0.3, 1.0):
        scores = []
        for k in range(3):
            model = plain_ridge(*matrix(with_draw, f"f <> {k} AND d < {int(size * M.BUCKETS)}"))
            x, y = matrix(with_draw, f"f = {k}")
            scores.append(1 - ((model(x) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert got[size, "validation"]["r2_mean"] == pytest.approx(np.mean(scores), abs=1e-9)
        assert got[size, "validation"]["r2_std"] == pytest.approx(np.std(scores), abs=1e-9)


def test_no_rows_to_fit(rows):
    with pytest.raises(ValueError):
        M.fit_cells(M.cell_moments(rows, NAMES, "y"), [9])


def test_rows_are_not_multiplied_by_fits(rows, monkeypatch):
    cells = rows.withColumns({"fold": M.drawn(col("game_id"), 42, 1) % 3})
    moments = M.cell_moments(cells, NAMES, "y", "fold")
    fits = {(k,): (M.fit_cells(moments, [j for j in range(3) if j != k]), F.when(col("fold") == k, "validation").otherwise("train")) for k in range(3)}
    order = ["fit", "role"]
    got = M.cell_r2(cells, fits, ["fit"], ["fold"]).orderBy(order).collect()
    want = evaluation.regression_metrics(M.scored(cells, fits, ["fit"]), order).orderBy(order).collect()
    assert [(r["fit"], r["role"], r["n"]) for r in got] == [(r["fit"], r["role"], r["n"]) for r in want]
    assert [r["r2"] for r in got] == pytest.approx([r["r2"] for r in want], abs=1e-9)
    monkeypatch.setattr(M, "scored", None)
    assert M.learning_curve(rows, NAMES, sizes=(0.5, 1.0), folds=2).count() == 4
