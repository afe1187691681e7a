import math
import random

import numpy as np
import pytest

from helpers import SF001
from sparkrisk.operators import profile as P
from sparkrisk.operators import radix as R


def test_keys_order_like_numbers():
    v = np.array([-math.inf, -1e300, -2.5, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e300, math.inf])
    keys = R.order_keys(v)
    assert (np.diff(keys.astype(object)) > 0).all() and np.array_equal(R._doubles(keys), v)
    assert R.order_keys(np.array([-0.0]))[0] == R.order_keys(np.array([0.0]))[0]


def table(spark, seed=0, n=4000):
    rnd = random.Random(seed)
    rows = [(rnd.gauss(0, 1e6), rnd.choice([None, 1.0, 2.0, float("nan"), -0.0, 0.0]), 7 if rnd.random() < .4 else rnd.randrange(-10**9, 10**9),
             1.0 + rnd.randrange(50) * 2.0 ** -52, None, rnd.choice([math.inf, -math.inf, 3.0])) for _ in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c bigint, near double, none double, inf double"), rows


@pytest.mark.parametrize("digit", [8, 16])
def test_every_rank_equals_the_sorted_column(spark, monkeypatch, digit):
    monkeypatch.setattr(R, "CELLS", 500)  # counts leave a task in pieces
    monkeypatch.setattr(R, "DIGIT", digit)
    df, rows = table(spark)
    cols = df.columns
    want = {c: sorted(float(r[i]) for r in rows if r[i] is not None and not math.isnan(r[i])) for i, c in enumerate(cols)}
    ranks = {c: [0, 1, 17, len(want[c]) // 2, len(want[c]) - 1, len(want[c]), -1] for c in cols}
    got = R.rank_values(df.repartition(7), ranks)
    assert got == {(c, k): want[c][k] for c in cols for k in ranks[c] if 0 <= k < len(want[c])}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double")
    assert R.rank_values(empty, {"a": [0]}) == {} and R.rank_values(empty, {}) == {}
    odd = spark.createDataFrame([(1.5,), (None,)], "`a b.c` double")
    assert R.rank_values(odd, {"a b.c": [0, 1]}) == {("a b.c", 0): 1.5}


def test_many_columns_in_few_jobs(spark):
    """Fifty columns and five probabilities: the driver gets a row a rank and pass, nothing is collected into lists."""
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount")
    wide = li.selectExpr(*[f"l_extendedprice * {1 + k / 7} + l_quantity AS x{k}" for k in range(50)])
    probs = [0.0, 0.1, 0.25, 0.5, 1.0]
    values, failed = P.quantile_values(wide, wide.columns, probs)
    assert not failed
    pdf = wide.toPandas()
    for c in wide.columns:
        for p in probs:
            assert values[(c, p)] == pytest.approx(float(np.quantile(pdf[c], p)), rel=1e-12)
