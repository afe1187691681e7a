"""Every registered query without oracle SQL runs over whole sf0.001 tables and returns rows."""

import pytest

from helpers import SF001
from sparkrisk.plans import model_queries  # noqa: F401  (registers model queries)
from sparkrisk.plans.registry import ORACLE_SQL, QUERIES

ROWS_ONLY = sorted(n for n in QUERIES if n not in ORACLE_SQL)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF001)
    rows = df.collect()
    assert len(rows) > 0
    assert len(df.columns) == len(set(df.columns))


def test_fill_check_knows_every_level(spark, tmp_path):
    """Fills on more than a hundred observed levels are all told as observed, others are not."""
    from sparkrisk.plans import model_queries as Q
    levels = [(k, f"level {k:03d}") for k in range(300)] + [(300, Q.PRIORITY_SENTINEL), (301, Q.PRIORITY_SENTINEL)]
    spark.createDataFrame(levels, "o_orderkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    filled = spark.createDataFrame([*levels[:300], (300, "level 299"), (301, "never seen")], "o_orderkey bigint, o_orderpriority string")
    out = {r.o_orderkey: r for r in Q._fill_check(spark, str(tmp_path), filled).collect()}
    assert len(out) == 302 and [k for k, r in out.items() if not r.filled_with_observed] == [301]
    assert out[300].was_gap and out[300].known_value is None and out[5].known_value == "level 005"
