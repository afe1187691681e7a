import math
import random

import pytest

from helpers import rows
from sparkrisk.operators import discretise as D
from sparkrisk.operators import select as SEL


def brute(pairs, classes):
    """Recursive best cuts, every cut point tried."""
    values = sorted({x for x, _ in pairs})
    count = lambda ps: [sum(y == c for _, y in ps) for c in classes]
    best = None
    for v in values[:-1]:
        left = [p for p in pairs if p[0] <= v]
        right = [p for p in pairs if p[0] > v]
        gain = D._bits(count(pairs)) - sum(len(p) / len(pairs) * D._bits(count(p)) for p in (left, right))
        if best is None or gain > best[0] + 1e-12:
            best = gain, v, left, right
    if best is None or not D.pays(count(pairs), count(best[2])):
        return []
    return sorted(brute(best[2], classes) + [best[1]] + brute(best[3], classes))


@pytest.mark.parametrize("seed", range(2))
def test_cuts_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = []
    for _ in range(500):
        a, b, c = rnd.randrange(40) / 4, rnd.gauss(0, 1), rnd.random()
        y = "u" if (2 <= a < 5) != (rnd.random() < .05) else rnd.choice("vw") if b > 0.7 else "v"
        data.append((a, b if rnd.random() > .1 else rnd.choice([None, float("nan")]), c, y if rnd.random() > .05 else None))
    df = spark.createDataFrame(data, "a double, `b x` double, c double, y string").repartition(7)
    got = D.entropy_cuts(df, "y", ["a", "b x", "c"])
    for i, c in enumerate(df.columns[:3]):
        pairs = [(r[i], r[3]) for r in data if r[3] and r[i] is not None and not math.isnan(r[i])]
        assert got[c] == brute(pairs, ["u", "v", "w"])
    assert len(got["a"]) >= 2 and got["c"] == []
    binned = D.entropy_bins(df, "y", ["a", "b x"])
    assert sorted(r[0] for r in binned.select("a").distinct().collect()) == list(range(1, len(got["a"]) + 2))
    assert binned.where("`b x` IS NULL").count() == sum(r[1] is None or math.isnan(r[1]) for r in data)
    ranks = {r.feature: r for r in SEL.rank_features(df.withColumnRenamed("b x", "b"), "y", [], ["a", "b", "c"], cuts="entropy").collect()}
    assert ranks["a"].rank == 1 and ranks["c"].info_gain == pytest.approx(0, abs=1e-9)


def test_odd_tables(spark):
    one = spark.createDataFrame([(1.0, "u"), (2.0, "u"), (None, None)], "x double, y string")
    assert D.entropy_cuts(one, "y", ["x"]) == {"x": []} and D.entropy_cuts(one.limit(0), "y", ["x"]) == {"x": []}
    assert rows(D.entropy_bins(one, "y", ["x"]), "x") == rows(spark.createDataFrame([(1,), (1,), (None,)], "x int"))


def test_pays():
    assert D.pays([50, 50], [50, 0]) and not D.pays([50, 50], [25, 25]) and not D.pays([1, 1], [0, 0])


def test_a_pass_tries_no_row_for_every_interval(spark):
    """Each value meets its own interval only, however many are open; infinite values and closed parts included."""
    inf = float("inf")
    values = [(f, v) for f in ("x0", "x1", "x2") for v in [-inf, *[i / 4 for i in range(-8, 80)], inf]]
    prefix = spark.createDataFrame([(f, v, i, 2 * i) for i, (f, v) in enumerate(values)], "feature string, value double, c0 bigint, c1 bigint")
    open_ = [("x0", None, 0.0, [0, 0], [9, 9]), ("x1", 3.0, 4.0, [0, 0], [9, 9]), ("x0", 5.0, None, [0, 0], [9, 9]), ("x0", 0.0, 2.5, [0, 0], [9, 9])]
    got = {(r.feature, r.value): r.i for r in prefix.select("feature", "value", D._interval(open_)("feature", "value").alias("i")).collect()}
    for f, v in values:
        fits = [i for i, (g, lo, hi, *_) in enumerate(open_) if f == g and (lo is None or v > lo) and (hi is None or v <= hi)]
        assert got[f, v] == (fits[0] if fits else None)


def test_few_values_are_cut_in_one_pass(spark, monkeypatch):
    """The same cuts whether an interval is cut by passes over all tasks or to the end in one; few passes in the second case."""
    rnd = random.Random(9)
    data = [(float(i), rnd.gauss(0, 1), "uv"[(i // 150) % 2 if rnd.random() > .02 else 0]) for i in range(2400)]
    df = spark.createDataFrame(data, "a double, b double, y string").repartition(5)
    seen, passes = [], []
    plain = D.best_cuts
    monkeypatch.setattr(D, "best_cuts", lambda *a: passes.append(1) or plain(*a))
    for few in (0, 700, 50_000):
        monkeypatch.setattr(D, "FEW", few)
        passes.clear()
        seen.append((D.entropy_cuts(df, "y", ["a", "b"]), len(passes)))
    assert seen[0][0] == seen[1][0] == seen[2][0] and len(seen[0][0]["a"]) >= 15
    assert seen[2][1] == 0 < seen[1][1] < seen[0][1]


def test_thousands_of_cuts_bin_a_table(spark, monkeypatch):
    points = [float(i) for i in range(5000)]
    monkeypatch.setattr(D, "entropy_cuts", lambda *a: {"a": points})
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (4998.5,), (9999.0,), (None,), (float("nan"),)], "a double")
    assert rows(D.entropy_bins(df, "y", ["a"])) == rows(spark.createDataFrame([(1,), (1,), (2,), (5000,), (5001,), (None,), (None,)], "a int"))
