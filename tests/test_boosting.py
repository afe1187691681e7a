import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from sparkrisk.operators import boosting as B
from sparkrisk.operators import ensembles as EN
from sparkrisk.operators import forest as H
from sparkrisk.operators import models as M
from sparkrisk.operators import sample as SM


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    made = []
    for i in range(2000):
        x, c = rnd.random(), rnd.choice(["a", "b", None])
        y = "high" if (x > 0.3) != (rnd.random() < 0.1) else "low"
        made.append((i, i % 7, x, c, y if rnd.random() > 0.03 else None))
    df = spark.createDataFrame(made, "id int, line int, x double, c string, y string")
    return SM.assign_folds(df, ["id", "line"], 3, 42).cache()


def told(trees):
    return [(t.feature.tolist(), t.first.tolist(), t.goes.tolist(), t.counts.tolist()) for t in trees]


def test_copies_are_those_of_up_sample(spark, data, monkeypatch):
    for bits in (62, 3):  # all folds in a word; several words
        monkeypatch.setattr(B, "WORD_BITS", bits)
        out, place = B.with_copies(data, "y", ["id", "line"], [1, 2, 3], 42)
        for f, (name, shift, mask) in zip((1, 2, 3), place):
            up = SM.up_sample(data.where(F.col("fold") != f), "y", ["id", "line"], 42).groupBy("id").agg(F.count("*").alias("n"))
            here = out.where((F.col("fold") != f) & F.col("y").isNotNull()).select(
                "id", (F.shiftright(name, shift).bitwiseAND(F.lit(mask)) + 1).alias("n"))
            assert rows(here) == rows(up)
    assert len({p[0] for p in place}) > 1 and out.count() == data.count()


def test_copies_grow_the_tree_of_repeated_rows(spark, data):
    bins = H.fit_bins(data, "y", ["x"], ["c"])
    out, (place, *_) = B.with_copies(data, "y", "id", [0], 42)  # a fold that no row is in
    up = SM.up_sample(data, "y", "id", 42)
    spec = H.Spec("t", trees=1, bagged=False)
    one = H.grow(H.bin_table(up, bins, "id"), bins, [spec], 4, "entropy")
    weighed = H.Spec("t", trees=1, bagged=False, weigh=H.Weigh(place))
    for n in (1, 5):
        table = H.bin_table(out.repartition(n), bins, "id", keep=[place[0]])
        assert told(H.grow(table, bins, [weighed], 4, "entropy").trees) == told(one.trees)


def test_rounds_weigh_missed_rows(spark, data):
    bins = H.fit_bins(data, "y", ["x"], ["c"])
    table = H.bin_table(data, bins, "id")
    grown = B.boost(table, bins, [H.Spec("a"), H.Spec("b", features=("x",))], 3, 2)
    first, second = grown.of(0)[:2]
    leaves = first.counts[first.feature < 0]
    wrong, total = (leaves.sum(axis=1) - leaves.max(axis=1)).sum(), leaves.sum()
    assert first.vote == pytest.approx(math.log((total - wrong) / wrong)) and {t.spec for t in grown.trees} == {0, 1}
    # after the update the missed rows weigh as much as the others (two classes)
    missed = table.select("_y", B._missed(table, [(0, first)], 2).alias("m")).where("_y >= 0").groupBy("m").count().collect()
    assert {r.m: r["count"] for r in missed} == {0: total - wrong, 1: wrong}
    root = second.counts[0].sum()
    unit = root / (2 * (total - wrong))
    assert root == pytest.approx(unit * (total - wrong) + unit * wrong * math.exp(first.vote)) and unit > 1e6


def test_cross_validation_equals_one_model_after_another(spark, data):
    """Sizes of the parts are those of rebalanced folds, results do not depend on partitioning, and it learns as MLlib's does."""
    costs = M.cost_matrix(["low", "high"], 1.2, 0.2)
    seen = []
    for n in (1, 6):
        votes, classes = B.cross_validate_boosted(data.repartition(n), "y", ["id", "line"], ["x"], ["c"], 3, 3, 3)
        counts = M.cost_sensitive(votes, classes, costs, out="prediction").cache()
        seen.append(rows(counts.groupBy("rebalance", "fold", "part", "truth", "prediction").agg(F.sum("n").alias("n"))))
    assert seen[0] == seen[1] and classes == ["high", "low"]
    size = {(r[0], r[1], r[2], r[3]): 0 for r in seen[0]}
    for r in seen[0]:
        size[r[:4]] += r[5]
    hits = {}
    for how, sample in (("down", SM.down_sample), ("up", SM.up_sample)):
        for f in (1, 2, 3):
            train = sample(data.where(F.col("fold") != f), "y", ["id", "line"], 42).drop("fold").cache()
            held = data.where((F.col("fold") == f) & F.col("y").isNotNull())
            for part, df in (("train", train), ("held_out", held)):
                assert {c: size[how, f, part, c] for c in classes} == {r.y: r["count"] for r in df.groupBy("y").count().collect()}
            model = M.boosted_tree(train, "y", ["x"], ["c"], rounds=3, max_depth=3, key=["id", "line"])
            theirs = M.cost_sensitive(M.boosted_score(model, held), model.labels, costs).where("y = predicted").count() / held.count()
            ours = sum(r[5] for r in seen[0] if r[:3] == (how, f, "held_out") and r[3] == r[4]) / held.count()
            hits[how, f] = abs(ours - theirs)
    assert sum(hits.values()) / len(hits) < 0.04  # the cuts are not MLlib's


def test_leaves_that_agree_are_joined(spark):
    df = spark.createDataFrame([(i, float(i), "u" if i < 4 else "v" if i % 3 else "u") for i in range(40)], "id int, x double, y string")
    bins = H.fit_bins(df, "y", ["x"])
    table = H.bin_table(df, bins, "id")
    whole = H.grow(table, bins, [H.Spec("t", trees=1, bagged=False)], 3, "entropy").trees[0]
    small = B.merged(whole)
    kids = [set(small.counts[[int(small.first[n]), int(small.first[n]) + 1]].argmax(axis=1)) for n in range(len(small.feature))
            if small.feature[n] >= 0 and (small.feature[[int(small.first[n]), int(small.first[n]) + 1]] < 0).all()]
    assert len(small.feature) < len(whole.feature) and all(len(k) == 2 for k in kids)
    assert small.counts[small.feature < 0].sum() == 40


def test_odd_tables(spark):
    one = spark.createDataFrame([(i, float(i), "u", 1 + i % 2) for i in range(10)], "id int, x double, y string, fold int")
    votes, classes = B.cross_validate_boosted(one, "y", "id", ["x"], [], 2, 2, 2)
    assert classes == ["u"] and {tuple(r.probability) for r in votes.collect()} == {(1.0,)}
    assert EN.NO_FOLD == 0
