"""NULL, NaN, clashing names and wide categories in sampling, fits, imputation and flows."""

import math

import pytest
from pyspark.sql import functions as F

from sparkrisk.functions import rank, stats
from sparkrisk.functions.rank import shuffle_rank
from sparkrisk.operators import evaluate as E
from sparkrisk.operators import features as FE
from sparkrisk.operators import impute as IM
from sparkrisk.operators import models as M
from sparkrisk.operators import sample as SM
from sparkrisk.plans import flows
from sparkrisk.sources.io import normalise_names

NAN = float("nan")


@pytest.fixture(scope="module")
def gappy(spark):
    rows = []
    for i in range(240):
        rows.append((i, None if i % 4 == 0 else float(i % 17), NAN if i % 7 == 0 else float(i % 5),
                     None if i % 6 == 0 else f"c{i % 3}", "yes" if (i % 17) > 8 else "no", None))
    return spark.createDataFrame(rows, "id int, x double, y double, c string, label string, void double")


def test_null_labels_are_split_too(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("label"))
    out = SM.stratified_split(df, "label", "id")
    assert out.count() == 100
    sizes = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert sizes[(None, "train")] == math.ceil(0.7 * 25) and sizes[(None, "test")] == 25 - math.ceil(0.7 * 25)


def test_two_level_offsets_equal_one_level(spark, monkeypatch):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"))
    for within in (None, "g"):
        one = sorted(map(tuple, shuffle_rank(df, "id", within=within, digits=2).collect()), key=str)
        monkeypatch.setattr(rank, "ONE_LEVEL", 1)
        two = sorted(map(tuple, shuffle_rank(df, "id", within=within, digits=3).collect()), key=str)
        monkeypatch.undo()
        assert one == two and len(one) == 500


def test_fits_take_gaps(gappy):
    num = ["x", "y"]
    for model in (M.random_forest(gappy, "label", num, ["c"], trees=3, mtry="all", max_depth=3),
                  M.decision_tree(gappy, "label", num, ["c"], max_depth=3)):
        scored = M.score(model, gappy)
        assert scored.count() == 240 and scored.where("predicted IS NULL").count() == 0
    assert M.linear_regression(gappy.withColumn("t", F.col("id").cast("double")), "t", num, ["c"]).transform(gappy).count() == 240
    forest = M.random_forest_regressor(gappy.withColumn("t", F.col("id").cast("double")), "t", num, ["c"], trees=2, max_depth=3)
    assert forest.transform(gappy).where("prediction IS NULL").count() == 0
    assert {r.feature for r in M.feature_importance(M.decision_tree(gappy, "label", num, ["c"]), gappy).collect()} >= {"x__filled", "x__missing"}


def test_boosted_score_keeps_every_column(gappy):
    df = gappy.withColumn("_batch", F.lit(1)).withColumn("c__idx2", F.lit("kept"))
    model = M.boosted_tree(df, "label", ["x", "y"], ["c"], rounds=2, max_depth=2)
    scored = M.boosted_score(model, df)
    assert scored.columns == [*df.columns, "probability", "predicted"]


def test_many_levels_and_depth(spark):
    df = spark.range(400).select("id", F.concat(F.lit("v"), F.col("id") % 100).alias("c"),
                                 F.when(F.col("id") % 100 < 50, "a").otherwise("b").alias("label"), (F.col("id") % 3).cast("double").alias("x"))
    model = M.decision_tree(df, "label", ["x"], ["c"], max_depth=2)
    assert M.score(model, df).where("predicted = label").count() == 400
    with pytest.raises(ValueError):
        M.decision_tree(df, "label", ["x"], max_depth=31)


def test_cart_fills_nan_and_leaves_empty_columns(gappy):
    out = IM.impute_cart(gappy, ["x", "y", "c", "void"], "id", ["x", "y", "void"], ["c"], sweeps=1, max_depth=3)
    assert out.columns == gappy.columns and out.count() == 240
    assert out.where("x IS NULL OR y IS NULL OR isnan(y) OR c IS NULL").count() == 0
    assert out.where("void IS NOT NULL").count() == 0
    kept = out.alias("o").join(gappy.alias("g"), "id").where("g.x IS NOT NULL AND o.x <> g.x").count()
    assert kept == 0
    partly = IM.impute_cart(gappy.drop("void"), ["c"], "id", ["x", "y"], ["c"], sweeps=1, max_depth=3)
    assert partly.where("c IS NULL").count() == 0 and partly.where("x IS NULL").count() == gappy.where("x IS NULL").count()


@pytest.mark.parametrize("how", ["cart", "multinomial"])
def test_flow_fills_every_gap_in_every_frame(gappy, how):
    full = gappy.drop("void").where("x IS NOT NULL AND NOT isnan(y) AND c IS NOT NULL")
    frames, cat, num = flows.prepare(full, [gappy.drop("void")], "id", "label", ["c"], ["x", "y"], None, impute=how)
    assert [f.count() for f in frames] == [full.count(), 240]
    for f in frames:
        assert f.where("x IS NULL OR y IS NULL OR isnan(y) OR c IS NULL").count() == 0


def test_integer_median_is_not_cut(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id int, v int")
    assert sorted(r.v for r in IM.impute_median(df, ["v"]).collect()) == [2, 2.5, 3]


def test_names_stay_apart(spark):
    assert normalise_names(["a", "a_2", "a", "A"]) == ["a", "a_2", "a_3", "A_4"]
    df = spark.createDataFrame([(1, "a b"), (2, "a-b"), (3, "a_b")], "c_a_b int, c string")
    out = FE.one_hot(df, ["c"])
    assert len(set(out.columns)) == 4 and [sum(r[c] for r in out.collect()) for c in out.columns[1:]] == [1, 1, 1]


def test_residuals_without_a_value(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (NAN, 1.0), (None, 1.0), (0.0, 3.0)], "p double, y double")
    out = {r.bin: r.n for r in E.residual_histogram(df, "p", "y", bins=2).collect()}
    assert out == {1: 1, 2: 2} and E.missing_residuals(df, "p", "y") == 2


def test_no_silent_loss_of_convergence(monkeypatch):
    monkeypatch.setattr(stats, "MAX_STEPS", 5)
    with pytest.raises(ArithmeticError):
        stats.betainc(5000.0, 5000.0, 0.5)
    with pytest.raises(ArithmeticError):
        stats.gammainc_upper(500.0, 480.0)


def test_profiles_take_zero_signs_and_nan(spark):
    from sparkrisk.operators import profile as P
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (NAN,), (None,)], "v double")
    row = P.schema_profile(df).first()
    assert (row.n_rows, row.n_null, row.n_distinct) == (5, 1, 3)
    near = P.near_constant(df).first()
    assert (near.top_value, near.top_n, near.n_distinct) == ("0.0", 2, 2)


def test_undefined_statistics_stay_null(spark):
    """A statistic without rows to divide by (nothing predicted negative) passes the rounding as NULL."""
    from sparkrisk.plans.tables import sig_all
    df = spark.createDataFrame([(1, 0.25), (2, None), (3, NAN)], "k int, v double")
    out = {r.k: r.v for r in sig_all(df).collect()}
    assert out[1] == 0.25 and out[2] is None and math.isnan(out[3])
    told = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, predicted string")
    stats_ = sig_all(E.confusion_stats(told, "predicted", "y", "a")).first()
    assert stats_.npv is None and stats_.sensitivity == 1.0
