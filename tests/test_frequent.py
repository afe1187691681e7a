import random
from collections import Counter

import pytest

from helpers import SF001, rows
from sparkrisk.operators import frequent as Q


@pytest.mark.parametrize("seed", range(20))
def test_counters_miss_at_most_their_share(seed):
    rnd = random.Random(seed)
    k, counters, true = rnd.randint(2, 9), {}, Counter()
    for _ in range(30):
        part = Counter(rnd.choices("abcdefghijklmnop", [2 ** -i for i in range(16)], k=50))
        true.update(part)
        for v, n in part.items():
            counters[v] = counters.get(v, 0) + n
        Q.shrink(counters, k)
    n = sum(true.values())
    assert len(counters) <= k
    assert all(true[v] - n / (k + 1) <= counters.get(v, 0) <= true[v] for v in true)


def brute(pdf_rows, cols, share):
    out, n = [], len(pdf_rows)
    for i, c in enumerate(cols):
        count = Counter(r[i] + 0.0 if isinstance(r[i], float) else r[i] for r in pdf_rows if r[i] is not None and r[i] == r[i])
        out += [(c, v, m) for v, m in count.items() if m > share * n]
    return out


def test_equals_plain_counts(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([0.0, -0.0, 1.5, None, float("nan")]), rnd.choice("aaaab") if rnd.random() < .5 else str(rnd.random()),
             rnd.randrange(1000), rnd.random() < .3, None) for _ in range(5000)]
    df = spark.createDataFrame(data, "d double, s string, i int, b boolean, none string").repartition(9)
    for share in (.01, .05, .3, 1.0):
        want = sorted((c, str(v).lower() if isinstance(v, bool) else str(v), n) for c, v, n in brute(data, df.columns, share))
        got = sorted((r.column, r.value, r.n) for r in Q.frequent_values(df, min_share=share).collect())
        assert got == want, share


def test_dates_and_timestamps_read_as_spark_writes_them(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    df = o.selectExpr("cast('2020-01-02 03:04:05' as timestamp_ntz) AS t", "date'2020-01-02' AS d", "cast(1.5 as decimal(5,2)) AS m", "array(1) AS a")
    got = {r.column: r.value for r in Q.frequent_values(df).collect()}
    assert got == {"t": "2020-01-02 03:04:05", "d": "2020-01-02", "m": "1.50", "a": "[1]"}


def test_odd_tables_and_top_values(spark):
    empty = spark.createDataFrame([], "`a b` int, c string")
    assert rows(Q.frequent_values(empty)) == []
    df = spark.createDataFrame([("x", i) for i in range(300)] + [("y", 1)], "`a.b` string, n int")
    out = {r.column: r for r in Q.top_values(df).collect()}
    assert (out["a.b"].top_value, out["a.b"].top_n, out["a.b"].near_constant) == ("x", 300, True)
    assert (out["n"].top_value, out["n"].top_n, out["n"].n_rows, out["n"].near_constant) == (None, 0, 301, False)
    with pytest.raises(ValueError):
        Q.frequent_values(df, min_share=0)
