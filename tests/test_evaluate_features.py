"""Metrics on hand-worked cases, distribution functions, encoders."""

import math

import pytest
from pyspark.sql import functions as F

from sparkrisk.functions import stats
from sparkrisk.operators import evaluate as E
from sparkrisk.operators import features as FE


def confusion(spark):
    # truth/pred: tp=3, fp=1, fn=2, tn=4
    data = ([("y", "y")] * 3 + [("n", "y")] + [("y", "n")] * 2 + [("n", "n")] * 4)
    return spark.createDataFrame(data, "truth string, pred string")


def test_confusion_stats_hand_worked(spark):
    s = E.confusion_stats(confusion(spark), "pred", "truth", "y").first()
    assert (s.tp, s.fp, s.fn, s.tn) == (3, 1, 2, 4)
    assert s.accuracy == pytest.approx(0.7)
    pe = (4 * 5 + 6 * 5) / 100
    assert s.kappa == pytest.approx((0.7 - pe) / (1 - pe))
    assert s.sensitivity == pytest.approx(0.6) and s.specificity == pytest.approx(0.8)
    assert s.ppv == pytest.approx(0.75) and s.npv == pytest.approx(4 / 6)
    assert s.balanced_accuracy == pytest.approx(0.7) and s.no_information_rate == pytest.approx(0.5)
    r = E.recall(confusion(spark), "pred", "truth", "y").first()
    assert r.recall == pytest.approx(0.6)


def test_three_class_confusion(spark):
    data = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("c", "a")]
    df = spark.createDataFrame(data, "truth string, pred string")
    cm = {(r.truth, r.prediction): r.n for r in E.confusion_matrix(df, "pred", "truth").collect()}
    assert cm == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1, ("c", "c"): 1, ("c", "a"): 1}
    per = {r["class"]: r for r in E.per_class_stats(df, "pred", "truth").collect()}
    assert per["a"].recall == 0.5 and per["a"].precision == 0.5 and per["b"].precision == 0.5


def test_special_functions():
    assert stats.betainc(1, 1, 0.3) == pytest.approx(0.3)
    assert stats.betainc(3, 1, 0.5) == pytest.approx(0.125)
    lo, hi = stats.clopper_pearson(0, 10)
    assert lo == 0 and hi == pytest.approx(1 - 0.025 ** (1 / 10), rel=1e-9)
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert stats.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert stats.binom_sf(6, 10, 0.5) == pytest.approx(386 / 1024)
    assert stats.mcnemar_p(10, 10) == stats.mcnemar_p(1, 1) == 1.0
    assert stats.mcnemar_p(12, 8) == pytest.approx(math.erfc(math.sqrt(9 / 20 / 2)))
    # normal limit at large n, where lgamma terms would cancel
    assert stats.binom_sf(500_001_000_001, 10**12, 0.5) == pytest.approx(0.0227501, rel=1e-4)
    t = E.confusion_tests(3, 1, 2, 4)
    assert 0 < t["accuracy_lower"] < 0.7 < t["accuracy_upper"] < 1


def test_regression_metrics_errors_fixture(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.5, 0.0), (-1.0, -2.0), (4.0, 4.0)], "pred double, y double")
    m = E.regression_metrics(df, "pred", "y").first()
    errs = [-1.0, 0.5, 1.0, 0.0]
    assert m.mae == pytest.approx(sum(abs(e) for e in errs) / 4)
    assert m.rmse == pytest.approx(math.sqrt(sum(e * e for e in errs) / 4))
    assert m.mape == pytest.approx((1 / 2 + 1 / -2 + 0) / 3)  # y = 0 left out, signed denominator
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "pred double, y double")
    assert E.regression_metrics(perfect, "pred", "y").first().r2 == 1.0


def test_one_hot_null_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = FE.one_hot(df, ["c"]).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_standardize_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, c double")
    z = FE.standardize(df, ["x", "c"])
    agg = z.agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("c"))).first()
    assert agg[0] == pytest.approx(0, abs=1e-12) and agg[1] == pytest.approx(1) and agg[2] == 0.0


def test_fit_levels_joint(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("z",), (None,)], "c string")
    assert FE.fit_levels([a, b], ["c"]) == {"c": ["x", "y", "z"]}


def test_rank_features_with_unobserved_cells(spark):
    import numpy as np
    from sparkrisk.operators import select as SEL
    data = [("a", "y")] * 6 + [("a", "n")] * 2 + [("b", "y")] * 1 + [("b", "n")] * 5 + [("c", "y")] * 4
    df = spark.createDataFrame(data, "f string, label string")
    r = SEL.rank_features(df, "label", ["f"], p_values=True).first()
    table = np.array([[6, 2], [1, 5], [4, 0]], dtype=float)          # value 'c' never has label 'n'
    n = table.sum()
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / n
    chi2 = ((table - e) ** 2 / e).sum()
    nz = table > 0
    mi = (table[nz] / n * np.log(table[nz] * n / (table.sum(1, keepdims=True) * table.sum(0, keepdims=True))[nz])).sum()
    assert r.chi2 == pytest.approx(chi2, rel=1e-12) and r.dof == 2
    assert r.info_gain == pytest.approx(mi, rel=1e-12)
    assert r.cramers_v == pytest.approx(np.sqrt(chi2 / n), rel=1e-12)
    assert r.p_value == pytest.approx(np.exp(-chi2 / 2), rel=1e-9)             # chi2 survival with 2 dof


def test_quantile_bins_equal_frequency(spark):
    from sparkrisk.operators import select as SEL
    df = spark.range(0, 1000).select((F.col("id") * 1.0).alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    binned = SEL.quantile_bins(df, ["x"], 4)
    sizes = sorted(r["count"] for r in binned.groupBy("x").count().collect())
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2
    r = {x.feature: x for x in SEL.rank_features(df, "y", numeric=["x"], cuts="quantile", bins=4).collect()}
    assert r["x"].dof == 3 and r["x"].chi2 < 1.0
