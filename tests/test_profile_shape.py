"""Profiles, joins and scalar recodes on micro-fixtures (FIXTURES.md section 3)."""

import math

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from sparkrisk.functions import scalar as S
from sparkrisk.operators import profile as P
from sparkrisk.operators import radix as R
from sparkrisk.operators import shape as SH


def sentinel_mix(spark):
    data = [("a", 1.0), ("?", None), (None, float("nan")), ("", 2.0), ("?", 3.0)]
    return spark.createDataFrame(data, "s string, x double")


def test_missing_profile_counts(spark):
    prof = {r.column: r for r in P.missing_profile(sentinel_mix(spark), "?").collect()}
    assert (prof["s"].n_null, prof["s"].n_nan, prof["s"].n_sentinel) == (1, 0, 2)
    assert (prof["x"].n_null, prof["x"].n_nan, prof["x"].n_sentinel) == (1, 1, 0)
    assert prof["s"].missing_ratio == 3 / 5


def test_drop_sparse(spark):
    df = sentinel_mix(spark)
    assert P.drop_sparse(df, 0.5, "?").columns == ["x"]          # s: 3 of 5 missing
    assert P.drop_sparse(df, 0.3, "?").columns == []


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=500), np.full(400, 2.5), rng.integers(0, 5, 300)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(6)
    got = {r.p: r.value for r in P.exact_quantiles(df, ["v"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p, v in got.items():
        assert math.isclose(v, float(np.percentile(vals, p * 100)), rel_tol=1e-12, abs_tol=1e-12)


def test_sorted_quantiles_and_radix_passes_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(size=700), np.full(350, -1.0)])  # a third of the rows on one value
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(5)
    probs = [0.05, 0.5, 0.77, 1.0]
    got = {r.p: r.value for r in P.exact_quantiles_sorted(df, ["v"], probs).collect()}
    coarse = {r.p: r.value for r in P.exact_quantiles(df, ["v"], probs).collect()}
    monkeypatch.setattr(R, "DIGIT", 4)        # many passes of small digits, counts leaving the tasks in pieces
    monkeypatch.setattr(R, "CELLS", 5)
    narrowed, failed = P.quantile_values(df, ["v"], probs)
    assert not failed
    for p in probs:
        ref = float(np.percentile(vals, p * 100))
        assert math.isclose(got[p], ref, rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(coarse[p], ref, rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(narrowed[("v", p)], ref, rel_tol=1e-12, abs_tol=1e-12)


def test_numeric_summary_ignores_nan(spark):
    out = P.numeric_summary(sentinel_mix(spark), ["x"]).first()
    assert out["count"] == 3 and out["mean"] == 2.0 and out["q50"] == 2.0 and out["min"] == 1.0


def test_duplicate_keys_with_null(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,), (None,), (None,)], "k int")
    assert set(rows(P.duplicate_keys(df, "k"))) == {(2, 2), (3, 3), (None, 2)}


def test_join_audit_unmatched_and_nulls(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    a = SH.join_audit(left, right, "k").first().asDict()
    assert a == {"left_rows": 4, "right_rows": 3, "joined_rows": 2, "left_unmatched": 2, "right_unmatched": 2}
    assert SH.join_on(left, right, "k").count() == 2


def test_categorical_summary_lumps_other(spark):
    data = [(f"v{i}",) for i in range(9) for _ in range(10 - i)] + [(None,)]
    out = P.categorical_summary(spark.createDataFrame(data, "c string"), ["c"], top=6).collect()
    values = [r.value for r in sorted(out, key=lambda r: r["rank"])]
    assert values[:6] == [f"v{i}" for i in range(6)] and values[6] == "(Other)" and values[7] == "NA's"
    assert [r.n for r in out if r.value == "(Other)"] == [4 + 3 + 2]   # v6, v7, v8


def test_near_constant(spark):
    df = spark.createDataFrame([(1, "a")] * 99 + [(2, "a")], "x int, c string")
    out = {r.column: r for r in P.near_constant(df, max_top_share=0.99).collect()}
    assert out["c"].near_constant and out["c"].top_share == 1.0 and out["c"].n_distinct == 1
    assert out["x"].near_constant and out["x"].top_value == "1"


def test_schema_profile(spark):
    out = {r.column: r for r in P.schema_profile(sentinel_mix(spark)).collect()}
    assert out["s"].type == "string" and out["s"].n_null == 1 and out["s"].n_distinct == 3


def test_frequency_with_levels(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "v int")
    out = P.frequency(df, "v", levels=[1, 2, 3], order="level").collect()
    assert [(r.v, r.n) for r in out] == [(1, 2), (2, 0), (3, 1)]


def test_bad_dates(spark):
    df = spark.createDataFrame([("2020-02-29",), ("2019-02-29",), ("",), (None,), ("junk",)], "d string")
    got = [r[0] for r in df.select(S.parse_date("d")).collect()]
    assert str(got[0]) == "2020-02-29" and got[1:] == [None, None, None, None]


def test_levels_and_recode(spark):
    df = spark.createDataFrame([(1,), (8,), (9,), (19,)], "v int")
    assert [r.v for r in S.restrict_levels(df, "v", S.level_range(1, 8)).collect()] == [1, 8, None, None]
    rec = S.recode(df, "v", {"Expired": [19, 20, 21]}).collect()
    assert [r.v for r in rec] == ["1", "8", "9", "Expired"]
    assert S.prefixed_levels("D", 1, 3) == ["D1", "D2", "D3"]


def test_count_values_in_null_semantics(spark):
    df = spark.createDataFrame([("Up", "Down", "No"), ("Up", None, "Steady")], "a string, b string, c string")
    r = S.count_values_in(df, ["a", "b", "c"], ["Up", "Down"], "n").collect()
    assert [x.n for x in r] == [2, None]
    r2 = S.count_values_in(df, ["a", "b", "c"], ["Up", "Down"], "n", null_as_zero=True).collect()
    assert [x.n for x in r2] == [2, 1]


def test_null_sentinel_and_fill(spark):
    df = S.null_sentinel(sentinel_mix(spark), ["s"], "?")
    assert df.where(F.col("s").isNull()).count() == 3
    filled = S.fill_value(sentinel_mix(spark), {"x": 0.0}).collect()
    assert [r.x for r in filled] == [1.0, 0.0, 0.0, 2.0, 3.0]


def test_stack_tagged_roundtrip(spark):
    a = spark.createDataFrame([(1, "x")], "k int, y string")
    b = spark.createDataFrame([(2,)], "k int")
    t = SH.stack_tagged({"train": a, "test": b})
    parts = SH.split_tagged(t, ["train", "test"])
    assert rows(parts["train"]) == [(1, "x")] and rows(parts["test"]) == [(2, None)]


def test_numeric_sentinel(spark):
    df = spark.createDataFrame([(-1, -1.0, "-1"), (2, 2.5, "x"), (-1, None, None)], "i int, d double, s string")
    prof = {r.column: r.n_sentinel for r in P.missing_profile(df, "-1").collect()}
    assert prof == {"i": 2, "d": 1, "s": 1}
    assert {r.column: r.n_sentinel for r in P.missing_profile(df, "?").collect()} == {"i": 0, "d": 0, "s": 0}


def test_hot_key_audit_and_duplicates(spark):
    # one key holds a third of all rows on the left side
    left = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"))
    a = SH.join_audit(left, right, "k").first().asDict()
    joined = left.join(right, "k").count()
    assert a["joined_rows"] == joined and a["left_rows"] == 3000 and a["right_rows"] == 1500
    assert a["left_unmatched"] == left.join(right, "k", "left_anti").count()
    dup = {r.k: r.n for r in P.duplicate_keys(left, "k").collect()}
    assert dup == {7: 1001}          # 1000 multiples of 3, plus id 7 itself
