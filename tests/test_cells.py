import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrisk.operators import cells as C
from sparkrisk.operators import ensembles as E
from sparkrisk.operators import forest as H
from sparkrisk.operators import sample as SM


@pytest.fixture(scope="module")
def data(spark):
    """Few values a column, so that rows share cells; one cell holds a third of all rows; gaps and rows without a label."""
    rnd = random.Random(7)
    rows = []
    for i in range(4000):
        x, z, c = (3.0, 1.0, "a") if i % 3 == 0 else (float(rnd.randint(1, 9)), rnd.choice([None, 1.0, 2.0, float("nan")]), rnd.choice(["a", "b", "c", None]))
        y = "high" if (x > 4) != (c == "b") else "low"
        rows.append((i, x, z, c, (y if rnd.random() > .1 else "low") if rnd.random() > .05 else None))
    return SM.assign_folds(spark.createDataFrame(rows, "id int, x double, z double, c string, y string"), "id", 3).checkpoint()


def trees(forest):
    return [(t.feature.tolist(), t.first.tolist(), t.goes.tolist(), t.counts.tolist(), t.gain.tolist(), t.depth.tolist()) for t in forest.trees]


def told(counts):
    return sorted(tuple(r) for r in counts.select("model", "part", "truth", "prediction", "n").collect())


@pytest.fixture(scope="module")
def binned(spark, data):
    bins = H.fit_bins(data, "y", ["x", "z"], ["c"], 16)
    member = E.fold_members(data, "y", "id", [1, 2, 3])
    return H.bin_table(data, bins, "id", keep=[F.col("fold").alias("_fold")], member=member), bins


SPECS = [H.Spec("0/0", 0, None, 1, 3), H.Spec("1/1", 1, None, 2, 3), H.Spec("2/2", 2, ("x", "c"), 0, 2, bagged=False)]
PART = {s.name: f"CASE WHEN _fold = {s.bit + 1} THEN 'held_out' WHEN (_member & {1 << s.bit}L) <> 0 THEN 'train' END" for s in SPECS}


@pytest.mark.parametrize("small", [False, True])
def test_trees_and_counts_of_cells_are_those_of_rows(spark, binned, monkeypatch, small):
    table, bins = binned
    if small:  # cells and pieces cut anywhere
        for name, value in (("PIECE", 300), ("HELD", 4000), ("PART_ROWS", 700), ("BLOCK", 50), ("CODE_BITS", 6)):
            monkeypatch.setattr(C, name, value)
        monkeypatch.setattr(H, "TASK_ROWS", 100)
        monkeypatch.setattr(H, "CELLS", 200)
    cells = C.fold_rows(table, bins, E._bags(SPECS), ["_fold"])
    for weights in (None, {"high": 2.0, "low": 1.0}):
        by_row = H.grow(table, bins, SPECS, 5, class_weights=weights)
        by_cell = C.grow(cells, SPECS, 5, class_weights=weights)
        assert trees(by_row) == trees(by_cell)
        assert told(H.confusion(table, by_row, PART)) == told(C.confusion(cells, by_cell, PART))


def test_totals_of_cells_are_sums_over_rows(spark, binned):
    table, bins = binned
    cells = C.fold_rows(table, bins, E._bags(SPECS), ["_fold"])
    starts, codes, y = cells.codes()
    rows = table.where("_y >= 0").toPandas()
    assert codes.shape[1] <= rows.drop_duplicates(["_b0", "_b1", "_b2", "_y"]).shape[0] + len(starts) < len(rows) / 2
    drawn = rows[(rows["_member"].to_numpy() & 1) == 1]
    want = {}
    for b0, b1, b2, cls, n in zip(*(drawn[c] for c in ("_b0", "_b1", "_b2", "_y")), H.bag(drawn["_h1"].to_numpy(), drawn["_h2"].to_numpy(), 42, 1)):
        want[b0, b1, b2, cls] = want.get((b0, b1, b2, cls), 0) + int(n)
    found = {}
    for r in cells.chunks.where(F.col("measure") == cells.measures[C.tree_measure(cells, SPECS[0], 1)]).collect():
        a = starts[r["chunk"]]
        for key, n in zip(map(tuple, np.vstack([codes, y])[:, a:a + r["n"]].T.tolist()), C._numbers(r["data"], r["n"]).tolist()):
            found[key] = found.get(key, 0) + n
    assert {k: n for k, n in found.items() if n} == {k: n for k, n in want.items() if n}


def test_many_cells_are_grown_by_row(spark, data, binned, monkeypatch):
    few = E.cross_validate_forests(data, "y", "id", ["x", "z"], ["c"], 3, [1, 2], 4, 4, 16, down_sampled=False)
    few = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(C, "MAX_CELLS", 10)
    assert C.fold_rows(*binned, E._bags(SPECS), ["_fold"]) is None
    assert sorted(map(tuple, E.cross_validate_forests(data, "y", "id", ["x", "z"], ["c"], 3, [1, 2], 4, 4, 16, down_sampled=False).collect())) == few


def test_a_growth_runs_no_pass_a_level(spark, binned):
    """Before, a growth ran a job (or more) for each level over all rows."""
    table, bins = binned
    cells = C.fold_rows(table, bins, E._bags(SPECS), ["_fold"])
    cells.codes()
    sc = spark.sparkContext
    sc.setJobGroup("growth", "growth")
    try:
        assert C.grow(cells, SPECS, 5).depth() == 5
        assert len(sc.statusTracker().getJobIdsForGroup("growth")) <= 2
    finally:
        sc._jsc.clearJobGroup()


def test_out_of_bag_search_by_cells_and_by_rows(spark, data, monkeypatch):
    run = lambda: sorted(map(tuple, E.tune_mtry_oob(data, "y", "id", ["x", "z"], ["c"], trees=6, max_depth=4, max_bins=16).collect()))
    by_cell = run()
    monkeypatch.setattr(C, "MAX_CELLS", 10)
    assert run() == by_cell


def test_hash_column_stands_for_the_key(spark, data):
    """Bags, folds and down-samples by a written hash are those by the key, also without the key's columns."""
    from sparkrisk.functions.rank import with_hash
    plain = SM.assign_folds(data.drop("fold"), "id", 3)
    hashed = SM.assign_folds(with_hash(data.drop("fold"), "id"), "id", 3)
    assert sorted(map(tuple, hashed.select("id", "fold").collect())) == sorted(map(tuple, plain.select("id", "fold").collect()))
    bare = hashed.withColumn("no", F.col("id")).drop("id").checkpoint()
    bits = lambda df, k: sorted(map(tuple, df.select(k, E.fold_members(df, "y", "id", [1, 2, 3, E.NO_FOLD])).collect()))
    assert bits(bare, "no") == bits(data, "id")
    bins = H.fit_bins(data, "y", ["x"], [], 8)
    rows = lambda df, k: sorted(map(tuple, H.bin_table(df, bins, "id", keep=[F.col(k).alias("k")], even=False).select("k", "_h1", "_h2", "_b0").collect()))
    assert rows(bare, "no") == rows(data, "id")
    with pytest.raises(Exception):
        E.fold_members(data.drop("id"), "y", "id", [1])


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_fold_members_near_the_cuts(spark, data, monkeypatch, most):
    """Cuts found among the rows of their first digits, or among all rows where digits would be too many."""
    monkeypatch.setattr(E, "FIRST_COUNTS", max(most, 1000))
    bits = data.withColumn("m", E.fold_members(data, "y", "id", [1, 2, 3])).collect()
    for i, f in enumerate([1, 2, 3]):
        want = {r.id for r in SM.down_sample(data.where(F.col("fold") != f), "y", "id").collect()}
        assert {r.id for r in bits if r.m >> i & 1} == want


def test_boosting_by_cells_and_by_rows(spark, data, monkeypatch):
    """Same votes of the same trees for down- and up-sampled folds, without a pass that writes down what a round missed."""
    from sparkrisk.operators import boosting as B
    run = lambda: sorted((tuple(r[:4]), tuple(r[4]), r[5]) for r in B.cross_validate_boosted(data, "y", "id", ["x", "z"], ["c"], 3, 3, 3)[0].collect())
    by_cell = run()
    assert {r[0][0] for r in by_cell} == {"down", "up"}
    monkeypatch.setattr(C, "MAX_CELLS", 10)
    by_row = run()
    assert by_cell == by_row
    monkeypatch.undo()
    monkeypatch.setattr(B, "_missed", None)
    assert run() == by_row
