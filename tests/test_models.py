"""Model invariants and learnability on a separable fixture."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helpers import SF001
from sparkrisk.operators import evaluate as E
from sparkrisk.operators import impute as IM
from sparkrisk.operators import models as M


@pytest.fixture(scope="module")
def separable(spark):
    df = spark.range(0, 2000).select(
        F.col("id").alias("k"),
        (F.pmod(F.col("id") * 7919, F.lit(1000)) / 10.0).alias("x"),
        (F.pmod(F.col("id") * 104729, F.lit(97)) / 1.0).alias("noise"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("cat"))
    return df.withColumn("y", F.when(F.col("x") > 40, "yes").otherwise("no")).cache()


def _acc(scored, pred="predicted"):
    return scored.agg(F.avg((F.col(pred) == F.col("y")).cast("double"))).first()[0]


def test_random_forest_learns_and_importance(spark, separable):
    m = M.random_forest(separable, "y", ["x", "noise"], ["cat"], trees=10, mtry=2, max_depth=5, key="k",
                        class_weights={"no": 2.0, "yes": 1.0})
    assert _acc(M.score(m, separable)) > 0.95
    imp = M.feature_importance(m, separable).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    assert imp[0].feature == "x" and imp[0]["rank"] == 1


def test_forest_layout_independent(spark, separable):
    a = M.random_forest(separable.repartition(3), "y", ["x", "noise"], trees=5, mtry=1, max_depth=4, key="k")
    b = M.random_forest(separable.repartition(7), "y", ["x", "noise"], trees=5, mtry=1, max_depth=4, key="k")
    pa = M.score(a, separable).select("k", "probability")
    pb = M.score(b, separable).select("k", "probability")
    diff = pa.join(pb.withColumnRenamed("probability", "q"), "k").where(
        F.col("probability").cast("string") != F.col("q").cast("string"))
    assert diff.count() == 0


def test_cost_sensitive_equals_rule(spark, separable):
    m = M.decision_tree(separable, "y", ["x", "noise"], max_depth=3, key="k")
    labels = M.labels_of(m)
    costs = M.cost_matrix(["no", "yes"], 1.2, 0.2)
    scored = M.cost_sensitive(M.score(m, separable), labels, costs)
    p = vector_to_array("probability")
    i_yes, i_no = labels.index("yes"), labels.index("no")
    rule = F.when(p[i_yes] * 1.2 > p[i_no] * 0.2, "yes").otherwise("no")
    assert scored.where(rule != F.col("predicted")).count() == 0


def test_boosting_one_round_equals_tree(spark, separable):
    b = M.boosted_tree(separable, "y", ["x", "noise"], ["cat"], rounds=1, max_depth=3, key="k")
    t = M.decision_tree(separable, "y", ["x", "noise"], ["cat"], max_depth=3, key="k", min_instances=1)
    sb = M.boosted_score(b, separable).select("k", F.col("predicted").alias("pb"))
    st = M.score(t, separable).select("k", F.col("predicted").alias("pt"))
    agree = sb.join(st, "k").agg(F.avg((F.col("pb") == F.col("pt")).cast("double"))).first()[0]
    assert agree == 1.0
    b3 = M.boosted_tree(separable, "y", ["x", "noise"], ["cat"], rounds=3, max_depth=1, key="k")
    assert _acc(M.boosted_score(b3, separable)) >= _acc(M.boosted_score(
        M.boosted_tree(separable, "y", ["x", "noise"], ["cat"], rounds=1, max_depth=1, key="k"), separable))


def test_poly_svm_learns(spark, separable):
    m = M.poly_svm(separable, "y", ["x", "noise"], ["cat"], dims=128, max_iter=50)
    assert _acc(m.transform(separable)) > 0.9
    w = M.poly_svm(separable, "y", ["x", "noise"], ["cat"], dims=128, max_iter=50,
                   class_weights={"no": 0.1, "yes": 0.2})        # weighted fit (DOR5)
    assert _acc(w.transform(separable)) > 0.9


def test_linear_regression_equals_sql(spark):
    df = spark.range(0, 500).select((F.col("id") % 37).cast("double").alias("x"),
                                    (3.0 * (F.col("id") % 37) + F.pmod(F.col("id") * 13, F.lit(7))).alias("y"))
    m = M.linear_regression(df, "y", ["x"])
    coef = {r.term: r.estimate for r in M.linear_coefficients(m, df).collect()}
    ref = df.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x"), F.regr_r2("y", "x")).first()
    assert coef["x"] == pytest.approx(ref[0], rel=1e-9)
    assert coef["(intercept)"] == pytest.approx(ref[1], rel=1e-9)
    assert coef["r2"] == pytest.approx(ref[2], rel=1e-9)


def test_rf_regressor(spark, separable):
    df = separable.withColumn("t", F.col("x") * 2.0)
    m = M.random_forest_regressor(df, "t", ["x", "noise"], trees=10, max_depth=6, key="k")
    r2 = E.regression_metrics(m.transform(df), "prediction", "t").first().r2
    assert r2 > 0.95


def test_impute_cart_fills_with_observed(spark, separable):
    df = separable.withColumn("cat2", F.when(F.col("k") % 5 == 0, None).otherwise(F.col("y")))
    out = IM.impute_cart(df, ["cat2"], "k", ["x", "noise"], ["cat"], sweeps=2, seed=3, max_depth=4)
    assert out.count() == df.count() and out.where(F.col("cat2").isNull()).count() == 0
    assert {r.cat2 for r in out.select("cat2").distinct().collect()} <= {"yes", "no"}
    same = out.join(df.select("k"), "k")
    unchanged = (out.alias("o").join(df.alias("d"), "k")
                 .where(F.col("d.cat2").isNotNull() & (F.col("o.cat2") != F.col("d.cat2"))).count())
    assert unchanged == 0 and same.count() == 2000
    acc = (out.alias("o").join(df.alias("d"), "k").where(F.col("d.cat2").isNull())
           .agg(F.avg((F.col("o.cat2") == F.col("d.y")).cast("double"))).first()[0])
    assert acc > 0.9  # donors come from the right leaf


def test_impute_multinomial_only_fills_gaps(spark, separable):
    df = separable.withColumn("c2", F.when(F.col("k") % 4 == 0, None).otherwise(F.col("y")))
    _, (filled,) = IM.impute_multinomial(df, "c2", ["x"], ["cat"])
    changed = (filled.alias("f").join(df.alias("d"), "k")
               .where(F.col("d.c2").isNotNull() & (F.col("f.c2") != F.col("d.c2"))).count())
    assert changed == 0 and filled.where(F.col("c2").isNull()).count() == 0


def test_impute_median_fit_apply(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),), (10.0,)], "v double")
    out = [r.v for r in IM.impute_median(df, ["v"]).collect()]
    assert out == [1.0, 3.0, 3.0, 3.0, 10.0]


def test_impute_cart_salting_is_exact(spark, separable, monkeypatch):
    df = separable.withColumn("cat2", F.when(F.col("k") % 3 == 0, None).otherwise(F.col("y")))
    base = IM.impute_cart(df, ["cat2"], "k", ["x", "noise"], ["cat"], sweeps=1, seed=5, max_depth=3)
    monkeypatch.setattr(IM, "JOIN_KEY_ROWS", 1)        # every leaf salted into many keys
    salted = IM.impute_cart(df, ["cat2"], "k", ["x", "noise"], ["cat"], sweeps=1, seed=5, max_depth=3)
    a = sorted((r.k, r.cat2) for r in base.select("k", "cat2").collect())
    b = sorted((r.k, r.cat2) for r in salted.select("k", "cat2").collect())
    assert a == b and len(a) == 2000


def test_impute_cart_numeric_and_chained(spark, separable):
    df = (separable.withColumn("cat2", F.when(F.col("k") % 5 == 0, None).otherwise(F.col("y")))
                   .withColumn("x2", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("x"))))
    out = IM.impute_cart(df, ["cat2", "x2"], "k", ["x2", "noise"], ["cat", "cat2"], sweeps=2, seed=9, max_depth=5)
    assert out.count() == 2000
    assert out.where(F.col("cat2").isNull() | F.col("x2").isNull()).count() == 0
    observed = {r.x2 for r in df.where(F.col("x2").isNotNull()).select("x2").distinct().collect()}
    assert {r.x2 for r in out.select("x2").distinct().collect()} <= observed      # donors are observed values
    kept = (out.alias("o").join(df.alias("d"), "k")
            .where(F.col("d.x2").isNotNull() & (F.col("o.x2") != F.col("d.x2"))).count())
    assert kept == 0
    err = (out.alias("o").join(df.alias("d"), "k").where(F.col("d.x2").isNull())
           .agg(F.avg(F.abs(F.col("o.x2") - F.col("d.x"))).alias("e")).first().e)
    assert err < 25          # leaf donors are close to the truth (x spans 0..100)


def test_impute_cart_fits_a_tree_once_where_its_rows_stay(spark, separable, monkeypatch):
    """A column whose predictors are not imputed has one tree for all sweeps; every sweep draws anew. Chained columns refit."""
    fits = []
    plain = IM.canonical_layout
    monkeypatch.setattr(IM, "canonical_layout", lambda *a: fits.append(1) or plain(*a))   # once a fit
    df = separable.withColumn("v", F.when(F.col("k") % 5 == 0, None).otherwise(F.col("k").cast("string")))
    out = {}
    for sweeps in (1, 2, 3):
        fits.clear()
        filled = IM.impute_cart(df, ["v"], "k", ["x"], ["cat"], sweeps=sweeps, seed=3, max_depth=4, min_instances=50)
        out[sweeps] = {r.k: r.v for r in filled.collect()}
        assert len(fits) == 1 and filled.columns == df.columns and len(out[sweeps]) == 2000
        assert all(v == str(k) if k % 5 else int(v) % 5 for k, v in out[sweeps].items())
    assert out[1] != out[2] != out[3]
    fits.clear()
    both = df.withColumn("x2", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("x")))
    IM.impute_cart(both.withColumn("v", F.substring("v", 1, 1)), ["v", "x2"], "k", ["x2"], ["cat", "v"], sweeps=2, seed=3, max_depth=3)
    assert len(fits) == 4


def test_a_keyed_fit_reads_its_rows_once(spark):
    """Encoders, split candidates and the fit share one laid out copy, which goes when the fit is done."""
    read = spark.sparkContext.accumulator(0)

    def told(i):
        read.add(1)
        return i, float(i % 17), "ab"[i % 2], "high" if i % 17 > 5 else "low"

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(500), 3).map(told), "id long, x double, c string, y string")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = M.decision_tree(df, "y", ["x"], ["c"], max_depth=4, key="id", class_weights={"high": 2.0})
    assert read.value == 500
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert M.score(model, df).where("y = predicted").count() == 500


def test_cost_rule_on_counted_leaves_equals_that_on_rows(spark):
    """mdl5_cost_sensitive: rows counted by leaf first, the same statistics as rows judged one by one."""
    from sparkrisk.plans import model_queries as Q
    data = Q._split_data(spark, SF001)
    model = M.decision_tree(data.where("split = 'train'"), Q.LABEL, Q.NUMERIC, Q.CATEGORICAL, max_depth=Q.DEPTH, seed=Q.SEED, key=Q.LINEITEM_KEY)
    costs = M.cost_matrix(["low", "high"], Q.COSTS_CV["miss"], Q.COSTS_CV["false_alarm"])
    one_by_one = Q._stats(M.cost_sensitive(M.score(model, data), M.labels_of(model), costs), by="split").orderBy("part").collect()
    got = Q.mdl5_cost_sensitive(spark, SF001)
    assert got.orderBy("part").collect() == one_by_one and len(one_by_one) == 2
    assert got.columns == list(one_by_one[0].asDict())
