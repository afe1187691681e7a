import numpy as np
import pytest

from helpers import SF001
from sparkrisk.operators import least_squares as L


def table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(float(x), float(1e6 + 1e-3 * z), f"g{g}", float(3 * x + g * g + e)) for x, z, g, e in
            zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n) / 10)]
    return spark.createDataFrame(rows, "x double, big double, g string, y double"), rows


def test_equals_the_pseudo_inverse(spark):
    df, rows = table(spark)
    model = L.least_squares(df.repartition(13), "y", ["x"], ["g"])
    design = np.array([[1, r[0], *[r[2] == f"g{i}" for i in range(5)]] for r in rows], float)
    scale = np.sqrt((design ** 2).sum(axis=0))
    want = np.linalg.pinv(design / scale, rcond=1e-10) @ np.array([r[3] for r in rows]) / scale
    assert model.rank == 6 and model.rows == 3000
    np.testing.assert_allclose(model.coefficients, want, rtol=1e-9)
    y = np.array([r[3] for r in rows])
    assert model.r2 == pytest.approx(1 - ((design @ want - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert model.terms() == ["(intercept)", "x", "g=g0", "g=g1", "g=g2", "g=g3", "g=g4"]


def test_fitted_values_are_group_means(spark):
    df, rows = table(spark)
    model = L.least_squares(df, "y", [], ["g"])
    fitted = {r.g: r.prediction for r in model.transform(df).select("g", "prediction").distinct().collect()}
    for g in fitted:
        assert fitted[g] == pytest.approx(np.mean([r[3] for r in rows if r[2] == g]), rel=1e-10)


def test_nearly_collinear_columns(spark):
    """A column that hardly differs from a constant: normal equations would lose it."""
    df, rows = table(spark)
    df = df.selectExpr("x", "big", "3 * x + 500 * (big - 1000000) AS y")
    model = L.least_squares(df, "y", ["x", "big"])
    assert model.rank == 3 and model.coefficients[2] == pytest.approx(500, rel=.01)


def test_gaps_and_odd_tables(spark):
    df = spark.createDataFrame([(1.0, "a", 2.0), (2.0, None, 5.0), (None, "a", 9.0), (float("nan"), "b", 9.0), (3.0, "a", None)], "`x 1` double, g string, y double")
    model = L.least_squares(df, "y", ["x 1"], ["g"])
    assert model.rows == 2 and [None if r.p is None else round(r.p, 6) for r in model.transform(df, "p").collect()][:4] == [2.0, 5.0, None, None]
    none = L.least_squares(df.where("false"), "y", ["x 1"], ["g"])
    assert none.rank == 0 and none.rows == 0 and not none.coefficients.any()


def test_more_tasks_than_the_first_merge(spark):
    df, _ = table(spark, 500)
    one, many = L.least_squares(df.coalesce(1), "y", ["x"], ["g"]), L.least_squares(df.repartition(30), "y", ["x"], ["g"])
    np.testing.assert_allclose(one.coefficients, many.coefficients, rtol=1e-10)
