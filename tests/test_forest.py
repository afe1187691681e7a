import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SF001
from sparkrisk.functions.rank import seeded_md5
from sparkrisk.operators import ensembles as E
from sparkrisk.operators import forest as H
from sparkrisk.operators import sample as SM


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        x, z, c = rnd.random(), rnd.choice([None, 1.0, 2.0, float("nan")]), rnd.choice(["a", "b", "c", "d", None])
        y = "high" if (x > 0.4) != (c in ("b", "d")) else "low"
        rows.append((i, x, z, c, y if rnd.random() > 0.05 else None))
    return spark.createDataFrame(rows, "id int, x double, z double, c string, y string")


def trees(forest):
    return [(t.feature.tolist(), t.first.tolist(), t.goes.tolist(), t.counts.tolist()) for t in forest.trees]


def test_equal_trees_on_any_partitioning(spark, data, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 700)
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"], 16)
    specs = [H.Spec("one", mtry=2, trees=4), H.Spec("two", features=("x", "c"), trees=2, bagged=False)]
    grown = [H.grow(H.bin_table(data.repartition(n), bins, "id"), bins, specs, 5) for n in (1, 7)]
    monkeypatch.setattr(H, "CELLS", 300)  # open nodes dealt to many passes
    grown.append(H.grow(H.bin_table(data, bins, "id"), bins, specs, 5))
    assert trees(grown[0]) == trees(grown[1]) == trees(grown[2])
    assert len({str(t) for t in trees(grown[0])[:4]}) == 4  # bags and candidates differ by tree


def plain(bins, y, sizes, ordered, depth, criterion="gini"):
    """Nested dict of the best binary splits by trying every cut; numeric features only, or categories by class share."""
    def imp(c):
        p = c / c.sum()
        return 1 - (p * p).sum() if criterion == "gini" else -(p[p > 0] * np.log(p[p > 0])).sum()

    whole = np.bincount(y, minlength=2)
    best = None
    if depth and (whole > 0).all():
        for f in range(len(sizes)):
            order = np.arange(sizes[f])
            if not ordered[f]:
                n = np.array([max((bins[f] == b).sum(), 0) for b in order])
                share = np.array([(y[bins[f] == b] == 1).mean() if n[b] else np.inf for b in order])
                order = np.argsort(share, kind="stable")
            for cut in range(sizes[f] - 1):
                left = np.isin(bins[f], order[:cut + 1])
                if left.any() and not left.all():
                    gain = imp(whole) - left.mean() * imp(np.bincount(y[left], minlength=2)) - (~left).mean() * imp(np.bincount(y[~left], minlength=2))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = gain, f, left
    if best is None:
        return whole.tolist()
    _, f, left = best
    sub = lambda m: plain([b[m] for b in bins], y[m], sizes, ordered, depth - 1, criterion)
    return f, sub(left), sub(~left)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.counts[node].tolist()
    return int(tree.feature[node]), nested(tree, tree.first[node]), nested(tree, tree.first[node] + 1)


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_tree_equals_the_plain_one(spark, data, criterion):
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"], 16)
    table = H.bin_table(data, bins, "id")
    grown = H.grow(table, bins, [H.Spec("t", trees=1, bagged=False)], 3, criterion)
    rows = table.where("_y >= 0").toPandas()
    want = plain([rows[f"_b{i}"].to_numpy() for i in range(3)], rows["_y"].to_numpy(), bins.sizes(), bins.ordered(), 3, criterion)
    assert nested(grown.trees[0]) == want


def test_bins(spark, data):
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"], 8)
    x = sorted(r.x for r in data.collect())
    assert bins.cuts["x"] == [x[i * 3000 // 8] for i in range(1, 8)] and bins.cuts["z"] == [1.0] and bins.classes == ["high", "low"]
    assert bins.levels["c"] == ["a", "b", "c", "d"] and bins.sizes().tolist() == [9, 3, 5]
    rows = {r.id: r for r in H.bin_table(data, bins, "id", keep=["id"]).collect()}
    for r in data.collect():
        b = rows[r.id]
        assert b._b0 == sum(v < r.x for v in bins.cuts["x"])
        assert b._b1 == (2 if r.z is None or math.isnan(r.z) else int(r.z > 1.0))
        assert b._b2 == ("abcd".index(r.c) if r.c else 4) and b._y == {"high": 0, "low": 1, None: -1}[r.y]


def test_bag_is_poisson_and_keyed(spark, data):
    h = data.select(F.conv(F.substring(seeded_md5(42, "id"), 1, 8), 16, 10).cast("bigint").alias("a"),
                    F.conv(F.substring(seeded_md5(42, "id"), 9, 8), 16, 10).cast("bigint").alias("b")).toPandas()
    a, b = h["a"].to_numpy(), h["b"].to_numpy()
    one, two = H.bag(a, b, 42, 0), H.bag(a, b, 42, 1)
    u = [(int(x) * H.bag_factors(42, 0)[0] + int(y) * H.bag_factors(42, 0)[1] + H.bag_factors(42, 0)[2]) % 2**64 // 2**32 for x, y in zip(a, b)]
    assert one.tolist() == [sum(int(p) <= v for p in H.POISSON) for v in u]
    assert abs(one.mean() - 1) < .08 and abs((one == 0).mean() - math.exp(-1)) < .04 and abs(np.corrcoef(one, two)[0, 1]) < .08
    many = np.array([H.bag(a, b, 42, t) for t in range(200)])
    assert abs(many.var(axis=0).mean() - 1) < .1


def test_forest_learns_and_parts_are_counted_once(spark, data):
    folds = SM.assign_folds(data, "id", 3).checkpoint()
    counts = E.cross_validate_forests(folds, "y", "id", ["x", "z"], ["c"], k=3, mtry=[2, 3], trees=10, max_depth=6).toPandas()
    labelled = folds.where("y IS NOT NULL").groupBy("fold").count().collect()
    for m in (2, 3):
        for f, n in labelled:
            held = counts[(counts.mtry == m) & (counts.fold == f) & (counts.part == "held_out")]
            assert held.n.sum() == n
            assert held[held.truth == held.prediction].n.sum() > .93 * n
    with_ = SM.down_sample(folds.where("fold <> 1"), "y", "id")
    train = counts[(counts.mtry == 2) & (counts.fold == 1) & (counts.part == "train")]
    assert train.groupby("truth").n.sum().to_dict() == {r.y: r["count"] for r in with_.groupBy("y").count().collect()}


def test_fold_members_are_the_down_sampled_rows(spark, data):
    folds = SM.assign_folds(data, "id", 4).checkpoint()
    bits = folds.withColumn("m", E.fold_members(folds, "y", "id", [1, 2, 3, 4, E.NO_FOLD])).collect()
    for i, f in enumerate([1, 2, 3, 4, E.NO_FOLD]):
        want = {r.id for r in SM.down_sample(folds.where(F.col("fold") != f), "y", "id").collect()}
        assert {r.id for r in bits if r.m >> i & 1} == want


def test_out_of_bag_votes(spark, data):
    """Each row is judged by the trees that did not draw it, worked out row by row."""
    bins = H.fit_bins(data, "y", ["x"], ["c"], 16)
    table = H.bin_table(data, bins, "id")
    grown = H.grow(table, bins, [H.Spec("m", trees=5)], 3)
    rows = table.where("_y >= 0").toPandas()
    h1, h2 = rows["_h1"].to_numpy(), rows["_h2"].to_numpy()
    b = np.array([rows["_b0"], rows["_b1"]], np.int16)
    voted = wrong = 0
    times = [H.bag(h1, h2, 42, t) for t in range(5)]
    for i in range(len(rows)):
        out = [t for t in range(5) if times[t][i] == 0]
        if out:
            share = sum(grown.shares(grown.trees[t])[grown.trees[t].walk(b, np.array([i]), 3)[0]] for t in out)
            voted += 1
            wrong += int(share.argmax() != rows["_y"][i])
    assert E.oob_error(table, grown) == {"m": (voted, wrong)}


def test_tune_stops_where_the_error_does_not_fall(spark, data):
    out = E.tune_mtry_oob(data, "y", "id", ["x", "z"], ["c"], start=7, trees=8, max_depth=5).collect()
    assert {r.mtry for r in out} >= {2, 3} and sum(r.best for r in out) == 1
    best = next(r for r in out if r.best)
    assert best.oob_error == min(r.oob_error for r in out) and best.oob_error < .1


def test_leave_one_out(spark, data):
    split = SM.stratified_split(data, "y", "id")
    out = E.leave_one_out_forests(split, "y", "id", ["x", "z"], ["c"], trees=8, max_depth=5).toPandas()
    right = {d: g[(g.part == "test") & (g.truth == g.prediction)].n.sum() / g[g.part == "test"].n.sum() for d, g in out.groupby("dropped")}
    assert right["z"] > .93 and right["x"] < .85 and right["c"] < .85


def test_probabilities_and_importances(spark, data):
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"])
    table = H.bin_table(data, bins, "id", keep=["id", "y"])
    grown = H.grow(table, bins, [H.Spec("m", trees=6, mtry=2)], 5)
    out = H.probabilities(table, grown).select("id", "y", "probability", "predicted").collect()
    assert len(out) == 3000 and all(abs(sum(r.probability) - 1) < 1e-9 for r in out)
    assert sum(r.y == r.predicted for r in out if r.y) > .93 * sum(r.y is not None for r in out)
    imp = H.importances(grown)
    assert abs(sum(v for _, v in imp) - 1) < 1e-9 and {imp[0][0], imp[1][0]} == {"x", "c"}


def test_gain_ratio_tree(spark, data):
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"], 16)
    table = H.bin_table(data, bins, "id")
    full, short = E.gain_ratio_tree(table, bins, cf=None), E.gain_ratio_tree(table, bins, cf=0.25)
    t, s = full.trees[0], short.trees[0]
    c = np.flatnonzero(t.feature == 2)
    assert len(c) and t.goes[c].max() >= 3  # a child a level
    assert len(s.feature) <= len(t.feature) and s.counts[0].tolist() == t.counts[0].tolist()
    rows = table.where("_y >= 0").toPandas()
    b, y = np.array([rows[f"_b{i}"] for i in range(3)], np.int16), rows["_y"].to_numpy()
    for tree in (t, s):  # every node holds the rows that walk to it
        leaf = tree.walk(b, np.arange(len(y)), 10)
        assert (tree.feature[leaf] < 0).all()
        assert np.array_equal(np.array([np.bincount(y[leaf == n], minlength=2) for n in np.unique(leaf)]), tree.counts[np.unique(leaf)])
    out = E.tree_rows(short, spark).collect()
    assert len(out) == len(s.feature) and sum(r.n for r in out if r.feature is None) == len(y)


def test_gain_ratio_by_hand():
    """Two categories of 4 and 12 rows: gain, split information and their ratio worked out."""
    counts = np.array([[[4, 0], [6, 6], [0, 0]]])
    work = H.Work(0, np.array([0]), np.array([[0]]), np.array([[0]]), 3, 0)
    out = H.Splitter(np.array([3]), np.array([False]), np.ones(2), "gain_ratio", 2, 1e-9)(work, counts[0])
    h = lambda *p: -sum(q * math.log(q) for q in p if q)
    assert out["gain"][0] == pytest.approx(h(10 / 16, 6 / 16) - 12 / 16 * h(.5, .5))
    assert out["children"].tolist() == [2] and out["below"].tolist() == [[4, 0], [6, 6]] and out["own"].tolist() == [[10, 6]]
    assert out["goes"][0].tolist() == [0, 1, 1]  # a level without rows goes with the larger child


def test_upper_errors():
    assert E.upper_errors(0, 6, .25) == pytest.approx(6 * (1 - .25 ** (1 / 6)))
    for wrong, rows in ((1, 10), (3, 40), (39, 40)):
        q = E.upper_errors(wrong, rows, .25) / rows
        assert sum(math.comb(rows, i) * q**i * (1 - q)**(rows - i) for i in range(wrong + 1)) == pytest.approx(.25, rel=1e-6)
    assert E.upper_errors(5, 5, .25) == 5 and E.upper_errors(0, 0, .25) == 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id int, x double, c string, y string")
    bins = H.fit_bins(empty, "y", ["x"], ["c"])
    assert bins.classes == [] and bins.sizes().tolist() == [2, 1]
    with pytest.raises(ValueError):
        H.grow(H.bin_table(empty, bins, "id"), bins, [H.Spec("m")])
    one = spark.createDataFrame([(1, 1.0, "a", "u"), (2, None, None, "u"), (2, None, None, None)], "id int, x double, c string, y string")
    bins = H.fit_bins(one, "y", ["x"], ["c"])
    table = H.bin_table(one, bins, "id")
    grown = H.grow(table, bins, [H.Spec("m", trees=3)])
    assert all(t.feature.tolist() == [-1] for t in grown.trees)
    assert [r.predicted for r in H.probabilities(table, grown).collect()] == ["u"] * 3


def test_binned_table_is_dealt_to_all_cores(spark):
    """One row group of many rows must not leave a forest's passes to one task."""
    df = spark.range(0, 200_000, 1, 1).selectExpr("id", "cast(id % 100 as double) AS x", "if(id % 7 > 2, 'a', 'b') AS y")
    bins = H.fit_bins(df, "y", ["x"])
    table = H.bin_table(df, bins, "id")
    sizes = [r["n"] for r in table.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) >= cores and sum(sizes) == 200_000 and max(sizes) <= 1.1 * 200_000 / len(sizes)


def test_walk_at_once_equals_walk_by_steps(spark, data):
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"], 16)
    table = H.bin_table(data, bins, "id")
    grown = H.grow(table, bins, [H.Spec("m", mtry=2, trees=3)], 8)
    grown.trees += E.gain_ratio_tree(table, bins, cf=None).trees  # a child a level
    rows = table.toPandas()
    b, every = np.array([rows[f"_b{i}"] for i in range(3)], np.int16), np.arange(len(rows))
    for tree in grown.trees:
        assert tree.jump and tree.jump[0] >= 4
        for steps in range(9):
            node = np.zeros(len(every), np.int64)
            for _ in range(steps):
                f = tree.feature[node]
                node = tree.first[node] + tree.goes[node, b[np.maximum(f, 0), every]]
            assert np.array_equal(tree.walk(b, every, steps), node)


def test_bag_table_equals_search():
    rng = np.random.default_rng(1)
    u = np.concatenate([np.array([p + d for p in H.POISSON.tolist() for d in (-1, 0, 1) if p + d < 2**32], np.uint64), rng.integers(0, 2**32, 5000).astype(np.uint64)])
    top = H._POISSON_TOP[(u >> np.uint64(16)).astype(int)]
    assert np.array_equal(np.where(top < 0, np.searchsorted(H.POISSON, u, side="right"), top), np.searchsorted(H.POISSON, u, side="right"))


def test_regression_tree_equals_the_plain_one(spark, data):
    """Splits by fall of variance over all cuts, categories by mean, worked out row by row; leaves predict means."""
    df = data.selectExpr("id", "x", "z", "c", "if(id % 50 = 0, NULL, 3 * x + coalesce(ascii(c) % 3, 0) + (id % 7) / 10 - 4) AS v")
    bins = H.fit_bins(df, "v", ["x", "z"], ["c"], 16, regression=True)
    table = H.bin_table(df, bins, "id", keep=["id", "v"])
    grown = H.grow(table, bins, [H.Spec("t", trees=1, bagged=False)], 4, "variance", min_gain=H.LEAST_FALL)
    rows = table.where("v IS NOT NULL").toPandas()
    b, v, t = np.array([rows[f"_b{i}"] for i in range(3)]), rows["v"].to_numpy(float), grown.trees[0]

    def check(node, of, depth):
        assert t.counts[node, 0] == len(of)
        best = 0.0
        for f in range(3):
            order = np.arange(bins.sizes()[f])
            if not bins.ordered()[f]:
                order = np.array(sorted(order, key=lambda k: v[of][b[f][of] == k].mean() if (b[f][of] == k).any() else np.inf))
            for cut in range(len(order) - 1):
                left = np.isin(b[f][of], order[:cut + 1])
                if 0 < left.sum() < len(of):
                    best = max(best, v[of].var() - left.mean() * v[of][left].var() - (~left).mean() * v[of][~left].var())
        if t.feature[node] < 0:
            assert depth == 4 or best < 1e-9
            return
        way = t.goes[node][b[t.feature[node]][of]]
        parts = [of[way == 0], of[way == 1]]
        assert best == pytest.approx(v[of].var() - sum(len(p) / len(of) * v[p].var() for p in parts), rel=1e-6)
        for k, p in enumerate(parts):
            check(t.first[node] + k, p, depth + 1)

    check(0, np.arange(len(v)), 0)
    leaf = t.walk(b, np.arange(len(v)), 4)
    want = {i: v[leaf == n].mean() for i, n in zip(rows["id"], leaf)}
    got = {r.id: r.prediction for r in H.RegressionForest(grown).transform(df).where("v IS NOT NULL").collect()}
    assert got == pytest.approx(want, rel=1e-8)


def test_regression_forest_is_the_same_on_any_partitioning(spark, data):
    from sparkrisk.operators import models as M
    df = data.selectExpr("id", "x", "z", "c", "3 * x + coalesce(ascii(c) % 3, 0) AS v")
    models = [M.random_forest_regressor(df.repartition(n), "v", ["x", "z"], ["c"], trees=8, max_depth=8, key="id") for n in (1, 5)]
    assert trees(models[0].forest) == trees(models[1].forest)
    scored = models[0].transform(df).selectExpr("avg(pow(prediction - v, 2)) AS e", "var_pop(v) AS s").first()
    assert scored.e < .02 * scored.s


def _dummies(data):
    """Standardised dummies of a category with a rare and a missing level, beside a number."""
    df = data.selectExpr("id", "x", "case when id % 97 = 0 then 'rare' else c end AS c", "id % 4 AS d", "3 * x + coalesce(ascii(c) % 3, 0) + id % 4 AS v")
    names = {c: sorted(r[0] for r in df.select(F.col(c).cast("string")).distinct().collect() if r[0] is not None) for c in ("c", "d")}
    cols = {c: [f"{c}_{v}" for v in vs] for c, vs in names.items()}
    hot = [((F.coalesce(F.col(c).cast("string"), F.lit("")) == v).cast("double") * 7 - 0.3).alias(f"{c}_{v}") for c, vs in names.items() for v in vs]
    return df.select("id", "x", "v", *hot), ["x", *cols["c"], *cols["d"]], list(cols.values())


def test_dummies_counted_together_grow_the_same_trees(spark, data):
    df, features, groups = _dummies(data)
    grow = lambda ex: H.regression_forest(df, "v", "id", features, trees=6, max_depth=8, exclusive=ex).forest
    one_by_one, together = grow(()), grow(groups)
    assert trees(one_by_one) == trees(together) and any(1 <= f < len(features) for t in together.trees for f in t.feature)
    assert together.bins.features == features and not together.bins.groups
    for a, b in zip(one_by_one.trees, together.trees):
        assert (a.goes == b.goes).all() and (a.counts == b.counts).all()
    bins = H.fit_bins(df, "v", features, regression=True)
    assert len(H.group_exclusive(df, bins, groups).features) == 3


def test_groups_that_do_not_hold_are_not_used(spark, data):
    df, features, (c, d) = _dummies(data)
    bins = H.fit_bins(df, "v", features, regression=True)
    for other in (df.withColumn(c[0], F.when(F.col("id") != 5, F.col(c[0]))),           # a missing member
                  df.withColumn(c[0], F.lit(100.0)), df.withColumn(c[1], F.col(c[0]))):  # two above their cuts
        grouped = H.group_exclusive(other, bins, [c, d])
        assert list(grouped.groups.values()) == [d] and set(c) < set(grouped.features)
    assert H.group_exclusive(df, bins, [["x", c[0]], ["none", c[0]], [c[0]]]) == bins
    assert H.group_exclusive(df, bins, [c, [c[0], d[0]]]).groups.values() != [] and len(H.group_exclusive(df, bins, [c, [c[0], d[0]]]).groups) == 1


def test_candidates_are_counted_in_tables_of_their_own(monkeypatch):
    """Where all features are tried, a block adds up as many numbers as the tree's table has, not as many a candidate."""
    rng = np.random.default_rng(4)
    n, sizes = 500, np.array([4, 3, 5])
    block = (np.array([rng.integers(0, k, n) for k in sizes], np.int16), rng.integers(0, 1 << 32, n), np.ones(n, np.int64),
             rng.integers(0, 1 << 32, n), rng.integers(0, 1 << 32, n))
    tree = H.Tree(0, 3, np.array([0, -1, -1]), np.array([1, 1, 2]), np.array([[0, 0, 1, 1, 1], [0] * 5, [0] * 5], np.uint8),
                  np.zeros((3, 2), np.int64), np.zeros(3), np.array([0, 1, 1]))
    tried = np.tile(np.arange(3), (2, 1))
    at = np.concatenate([[0], np.cumsum(sizes[tried].ravel())])
    work = H.Work(0, np.array([1, 2]), tried, at[:-1].reshape(2, 3), int(at[-1]), 1)
    out, made, bincount = np.zeros(work.cells * 2, np.int64), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, w, size: made.append(size) or bincount(x, w, size))
    H._counts(H.Spec("r"), tree, work, H.Members(block, 2, True), out)
    assert sum(made) == 2 * work.cells
    times, want = H.bag(block[3].view(np.uint64), block[4].view(np.uint64), 42, 3), np.zeros((work.cells, 2), np.int64)
    for i in range(n):
        node = int(block[0][0, i] >= 2)
        for j in range(3):
            want[work.at[node, j] + block[0][j, i]] += times[i], times[i] * block[1][i]
    assert (out.reshape(-1, 2) == want).all()
