import re

import oracle
import pandas as pd
import pytest

import __spark_entry__
from sparkrisk.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_one_query_per_operator():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    want = oracle.duck(SF).execute(ORACLE_SQL[name]).df()
    want = want.astype(object).where(want.notna(), None)
    got = got.astype(object).where(got.notna(), None)
    integral = lambda f: f.map(lambda v: int(v) if isinstance(v, float) else v)
    assert oracle.frame_hash(integral(got)) == oracle.frame_hash(integral(want))
