"""Seeded order, folds and re-sampling: exact sizes, layout independence."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from sparkrisk.functions.rank import fold_of, seeded_md5, shuffle_rank
from sparkrisk.operators import sample as SM


def cut_fold(i: int, n: int, k: int) -> int:
    """Right-closed equal-width intervals over [1, n] (outer limits widened), exact arithmetic."""
    if n == 1:
        return 1
    for j in range(1, k + 1):
        if Fraction(i) <= 1 + Fraction((n - 1) * j, k):
            return j
    return k


def test_fold_formula_matches_interval_cut(spark):
    cases = [(i, n) for n in range(1, 61) for i in range(1, n + 1)]
    df = spark.createDataFrame(cases, "rn long, n long").withColumn("fold", fold_of("rn", "n", 5))
    got = {(r.rn, r.n): r.fold for r in df.collect()}
    assert all(got[(i, n)] == cut_fold(i, n, 5) for i, n in cases)


def test_fold_sizes_n12(spark):
    df = spark.range(12).withColumnRenamed("id", "k")
    folds = SM.assign_folds(df, "k", 5, 7).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [3, 2, 2, 2, 3]


def test_rank_is_a_permutation_and_layout_independent(spark):
    base = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = shuffle_rank(base.repartition(3), "k", 11, digits=2)
    b = shuffle_rank(base.repartition(7), "k", 11, digits=3)
    ra, rb = rows(a, "k", "rn"), rows(b, "k", "rn")
    assert ra == rb
    assert sorted(r[1] for r in ra) == list(range(1, 5001))


def test_rank_equals_single_window(spark):
    base = spark.range(0, 3000).withColumnRenamed("id", "k").withColumn("g", (F.col("k") % 3).cast("string"))
    ours = shuffle_rank(base, "k", 5, within="g", total=None)
    w = Window.partitionBy("g").orderBy(seeded_md5(5, "k"), "k")
    ref = base.withColumn("rn", F.row_number().over(w).cast("long"))
    assert rows(ours, "k", "g", "rn") == rows(ref, "k", "g", "rn")


@pytest.mark.parametrize("n", [0, 1, 2, 5, 12])
def test_folds_partition_rows(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    out = SM.assign_folds(df, "k", 5, 1)
    assert out.count() == n
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    if n:
        assert max(sizes) - min(sizes) <= 1 or n < 5


def _labelled(spark, n_pos, n_neg):
    data = [(i, "pos" if i < n_pos else "neg") for i in range(n_pos + n_neg)]
    return spark.createDataFrame(data, "k long, y string")


def test_down_sample_equal_classes_subset(spark):
    df = _labelled(spark, 5, 95)
    out = SM.down_sample(df, "y", "k", 3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {"pos": 5, "neg": 5}
    assert set(rows(out)) <= set(rows(df))


def test_up_sample_keeps_originals(spark):
    df = _labelled(spark, 5, 95)
    out = SM.up_sample(df, "y", "k", 3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {"pos": 95, "neg": 95}
    assert set(rows(df)) <= set(rows(out))
    extra = out.where("y = 'pos'").groupBy("k").count()
    assert extra.agg(F.sum("count")).first()[0] == 95


def test_one_class_unchanged(spark):
    df = _labelled(spark, 7, 0)
    assert rows(SM.down_sample(df, "y", "k")) == rows(df)
    assert rows(SM.up_sample(df, "y", "k")) == rows(df)


def test_stratified_and_random_split_sizes(spark):
    df = _labelled(spark, 10, 33)
    s = SM.stratified_split(df, "y", "k", 0.7, 9)
    got = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got[("pos", "train")] == math.ceil(0.7 * 10)
    assert got[("neg", "train")] == math.ceil(0.7 * 33)
    r = SM.random_split(df, "k", 0.3, 9)
    assert r.where("split = 'test'").count() == math.ceil(0.3 * 43)


def test_split_same_under_repartition(spark):
    df = _labelled(spark, 40, 60)
    a = SM.stratified_split(df.repartition(2), "y", "k", 0.7, 4)
    b = SM.stratified_split(df.repartition(5), "y", "k", 0.7, 4)
    assert rows(a) == rows(b)


def test_up_sample_draws_span_chunks(spark, monkeypatch):
    monkeypatch.setattr(SM, "DRAW_CHUNK", 7)        # many chunks per class, classes share chunks
    data = [(i, "a" if i < 3 else ("b" if i < 10 else "c")) for i in range(60)]
    df = spark.createDataFrame(data, "k long, y string")
    out = SM.up_sample(df, "y", "k", 5)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {"a": 50, "b": 50, "c": 50}
    monkeypatch.setattr(SM, "DRAW_CHUNK", 1_000_000)
    assert rows(SM.up_sample(df, "y", "k", 5)) == rows(out)   # chunking does not change the draws


try:
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(n=st.integers(1, 5000), k=st.integers(1, 12), data=st.data())
    def test_fold_closed_form_property(n, k, data):
        i = data.draw(st.integers(1, n))
        closed = 1 if n == 1 else max(1, -(-((i - 1) * k) // (n - 1)))
        assert closed == cut_fold(i, n, k)
        sizes = [0] * (k + 1)
        if n <= 200:
            for j in range(1, n + 1):
                sizes[cut_fold(j, n, k)] += 1
            assert sum(sizes) == n

    @settings(max_examples=4, deadline=None)
    @given(n_pos=st.integers(1, 12), n_neg=st.integers(1, 40), seed=st.integers(0, 10_000))
    def test_down_sample_property(spark, n_pos, n_neg, seed):
        df = _labelled(spark, n_pos, n_neg)
        out = SM.down_sample(df, "y", "k", seed)
        counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
        assert set(counts.values()) == {min(n_pos, n_neg)}
        assert set(rows(out)) <= set(rows(df))
except ImportError:  # hypothesis is optional
    pass


def test_up_sample_hot_class(spark, monkeypatch):
    # a class with one row must be drawn (largest - 1) times: every copy is that row
    data = [(0, "rare")] + [(i, "common") for i in range(1, 301)] + [(i, "mid") for i in range(301, 331)]
    df = spark.createDataFrame(data, "k long, y string")
    out = SM.up_sample(df, "y", "k", 1)
    assert out.where("y = 'rare'").count() == 300
    assert out.where("y = 'rare'").select("k").distinct().count() == 1
    monkeypatch.setattr(SM, "COPY_CHUNK", 7)      # heavy rows: copies cut into chunks over tasks
    split = SM.up_sample(df, "y", "k", 1)
    assert rows(split) == rows(out)


def test_null_labels_belong_to_no_class(spark):
    data = [(i, "a" if i < 4 else ("b" if i < 20 else None)) for i in range(25)]
    df = spark.createDataFrame(data, "k long, y string")
    down = {r.y: r["count"] for r in SM.down_sample(df, "y", "k").groupBy("y").count().collect()}
    up = {r.y: r["count"] for r in SM.up_sample(df, "y", "k").groupBy("y").count().collect()}
    assert down == {"a": 4, "b": 4} and up == {"a": 16, "b": 16}
