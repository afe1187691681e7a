import math
import random

import numpy as np
import pytest

from sparkrisk.operators import kernel_svm as K


def test_exact_map_is_the_kernel():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 7)), rng.normal(size=(30, 7))
    for degree, gamma, coef0 in ((3, None, 0.0), (2, 0.5, 1.0), (1, 1.0, 0.0), (3, 0.3, 2.0)):
        m = K.PolyMap(7, degree, 0, gamma, coef0)
        want = ((1 / 7 if gamma is None else gamma) * x @ y.T + coef0) ** degree
        np.testing.assert_allclose(m(x) @ m(y).T, want, rtol=1e-9, atol=1e-9)
        assert m.dims == math.comb(7 + (coef0 > 0) + degree - 1, degree)


def test_tensor_sketch_error_at_the_reference_width():
    """132 standardised columns, degree 3: the mean over sketches is the kernel, and 2,048 numbers keep the kernel matrix of
    random rows within a tenth of its norm (most of which lies on the diagonal)."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 132))
    want = (x @ x.T / 132) ** 3
    errors = []
    for seed in range(4):
        z = K.PolyMap(132, 3, 2048, seed=seed)(x)
        errors.append(np.linalg.norm(z @ z.T - want) / np.linalg.norm(want))
    assert np.mean(errors) < .25
    small = np.mean([np.linalg.norm((z := K.PolyMap(132, 3, 128, seed=s)(x)) @ z.T - want) for s in range(4)])
    assert small > 2.5 * np.mean(errors) * np.linalg.norm(want)
    many = np.mean([(z := K.PolyMap(6, 3, 64, seed=s)(x[:, :6])) @ z.T for s in range(400)], axis=0)
    exact = (x[:, :6] @ x[:, :6].T / 6) ** 3
    assert np.linalg.norm(many - exact) < .1 * np.linalg.norm(exact)


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(2500):
        a, b, c = rnd.gauss(0, 1), rnd.gauss(5, 3), rnd.choice(["u", "v", None])
        y = "yes" if a * a * a + (b - 5) * a * (2 if c == "u" else -1) > 0 else "no"
        rows.append((i, a if rnd.random() > .02 else None, b, c, y if rnd.random() > .02 else None, 1 + i % 3))
    return spark.createDataFrame(rows, "id int, a double, b double, c string, y string, fold int")


def loss(w, z, y, c):
    hinge = np.maximum(0, 1 - y * (z @ w))
    return .5 * (w[:-1] ** 2).sum() + .5e-6 * w[-1] ** 2 + (c * hinge ** 2).sum()


def test_newton_reaches_the_minimum(spark, data):
    scaled = K.fit_scaled(data, "y", ["a", "b"], ["c"])
    table = K.scale_table(data.repartition(5), scaled)
    fitted = K.fit_machines(table, scaled, [K.Machine("all")], class_weights={"yes": 2.0})
    rows = table.where("_y <> 0").toPandas()
    x = rows[[f"_x{i}" for i in range(len(scaled.columns))]].to_numpy()
    z, y = np.hstack([fitted.map(x), np.ones((len(x), 1))]), rows["_y"].to_numpy()
    c = np.where(y > 0, 2.0, 1.0)
    w = fitted.weights[0]
    best = loss(w, z, y, c)
    rng = np.random.default_rng(0)
    for scale in (1e-3, 1e-2, 1e-1):
        assert all(loss(w + scale * rng.normal(size=len(w)) * np.abs(w).mean(), z, y, c) >= best * (1 - 1e-6) for _ in range(20))
    assert ((z @ w > 0) == (y > 0)).mean() > .93 and fitted.steps < K.STEPS


def test_folds_together_equal_folds_alone(spark, data):
    scaled = K.fit_scaled(data, "y", ["a", "b"], ["c"])
    member = "CAST(CASE fold WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 3 END + 8 AS BIGINT)"
    from pyspark.sql import functions as F
    table = K.scale_table(data, scaled, [F.col("fold").alias("_fold")], F.expr(member))
    specs = [K.Machine("f1", 0), K.Machine("f2", 1), K.Machine("f3", 2), K.Machine("final", 3)]
    together = K.fit_machines(table, scaled, specs)
    for i, s in enumerate(specs):
        alone = K.fit_machines(table, scaled, [s])
        np.testing.assert_allclose(together.weights[i], alone.weights[0], rtol=1e-6, atol=1e-8)
    part = {f"f{i}": f"CASE WHEN _fold = {i} THEN 'held_out' ELSE 'train' END" for i in (1, 2, 3)} | {"final": "'train'"}
    counts = K.confusion(table, together, part).toPandas()
    labelled = {r.fold: r["count"] for r in data.where("y IS NOT NULL").groupBy("fold").count().collect()}
    for i in (1, 2, 3):
        held = counts[(counts.model == f"f{i}") & (counts.part == "held_out")]
        assert held.n.sum() == labelled[i] and held[held.truth == held.prediction].n.sum() > .9 * labelled[i]
    out = K.decisions(table, together, 3).select("_y", "decision", "predicted").collect()
    right = sum(r.predicted == {1: "yes", -1: "no"}[r._y] for r in out if r._y)
    final = counts[counts.model == "final"]
    assert right == final[final.truth == final.prediction].n.sum()


def test_sketched_machine_learns(spark, data):
    scaled = K.fit_scaled(data, "y", ["a", "b"], ["c"])
    table = K.scale_table(data, scaled)
    fitted = K.fit_machines(table, scaled, [K.Machine("s")], dims=256)
    counts = K.confusion(table, fitted, {"s": "'all'"}).toPandas()
    assert counts[counts.truth == counts.prediction].n.sum() > .88 * counts.n.sum()


def test_odd_tables(spark, data):
    one = data.where("y = 'yes' OR y IS NULL")
    scaled = K.fit_scaled(one, "y", ["a"], ["c"])
    fitted = K.fit_machines(K.scale_table(one, scaled), scaled, [K.Machine("m")])
    assert not fitted.weights.any()
    empty = data.limit(0)
    scaled = K.fit_scaled(empty, "y", ["a"], ["c"])
    assert scaled.columns == [] and scaled.classes == []
    with pytest.raises(ValueError):
        K.PolyMap(132, 3, 0)
    with pytest.raises(ValueError):
        K.fit_scaled(data, "fold", ["a"])


def test_products_of_overlapping_models():
    """Sets of models that many rows share, and sets of a single row, give each model's own product."""
    import numpy as np
    from sparkrisk.operators import kernel_svm as K
    rng = np.random.default_rng(4)
    z, fold = rng.normal(size=(900, 7)), rng.integers(0, 9, 900)
    inside = (fold[:, None] != np.arange(9)) & (rng.random((900, 9)) < np.where(np.arange(900) < 800, 1, .5)[:, None])
    inside[5] = False
    for j, h in enumerate(K._products(z, inside)):
        assert np.allclose(h, z[inside[:, j]].T @ z[inside[:, j]], rtol=1e-12, atol=1e-12)


def test_scaled_table_is_dealt_to_all_cores(spark):
    from pyspark.sql import functions as F
    from sparkrisk.operators import kernel_svm as K
    df = spark.range(0, 200_000, 1, 1).selectExpr("id", "cast(id % 100 as double) AS x", "if(id % 7 > 2, 'a', 'b') AS y")
    table = K.scale_table(df, K.fit_scaled(df, "y", ["x"]))
    assert table.count() == 200_000 and table.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("coef0", [0.0, 1.0])
def test_sums_by_pattern_are_those_of_rows(spark, data, coef0):
    """Gradient, Hessian and loss taken over the numbers' monomials of each pattern of dummies."""
    from pyspark.sql import functions as F
    wide = data.withColumn("e", F.concat(F.lit("e"), F.col("id") % 7))
    scaled = K.fit_scaled(wide, "y", ["a", "b"], ["c", "e"])
    table = K.scale_table(wide.repartition(3), scaled, member=F.expr("CAST(CASE fold WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS BIGINT)"))
    mapped = K.PolyMap(len(scaled.columns), coef0=coef0)
    packed = K.pack(table, scaled, mapped)
    assert len(packed.powers) == math.comb(5, 3) < mapped.dims / 2 and len(packed.turn) == 21
    rng, specs = np.random.default_rng(2), [K.Machine("one", 0), K.Machine("two", 1)]
    fitted = K.Machines(scaled, mapped, specs, rng.normal(size=(2, mapped.dims + 1)), 0)
    for open_ in ([0, 1], [1]):
        by_row, by_pattern = (f(t, fitted, open_, np.array([1.0, 2.0])) for f, t in ((K._sums, table), (K._packed_sums, packed)))
        for m in open_:
            for want, got in zip(by_row[m], by_pattern[m]):
                np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-7)


def test_many_patterns_are_summed_by_row(spark, data, monkeypatch):
    scaled = K.fit_scaled(data, "y", ["a"], ["c", "y"])
    table = K.scale_table(data, scaled)
    mapped = K.PolyMap(len(scaled.columns))
    assert K.pack(table, scaled, mapped) is not None
    monkeypatch.setattr(K, "MAX_PATTERNS", 2)
    assert K.pack(table, scaled, mapped) is None and K.pack(table, scaled, K.PolyMap(len(scaled.columns), dims=64)) is None
