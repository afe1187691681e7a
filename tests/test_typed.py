import pytest

from helpers import SF001, rows
from sparkrisk.sources import typed as T


def csv(tmp_path, text, name="a.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_narrowest_type_of_each_column(spark, tmp_path):
    path = csv(tmp_path, "i,d,b,day,t,s,mixed,none,2 x,late\n"
                         "1,1,true,2020-01-02,2020-01-02 03:04:05,a,1,,7,2020-01-01\n"
                         "-20,1.5e3,FALSE,1999-12-31,2020-01-02,5d,x,,8,2020-02-30\n"
                         ",,,,,,,,,\n")
    good, bad, kinds = T.read_typed(spark, path)
    assert kinds == {"i": "bigint", "d": "double", "b": "boolean", "day": "date", "t": "timestamp", "s": "string", "mixed": "string",
                     "none": "string", "X2_x": "bigint", "late": "string"}
    assert [str(v) for v in good.collect()[1]][:4] == ["-20", "1500.0", "False", "1999-12-31"]
    assert good.count() == 3 and bad.count() == 0 and all(v is None for v in good.collect()[2])


def test_broken_lines_go_to_quarantine(spark, tmp_path):
    path = csv(tmp_path, "a,b\n1,2\n3\n4,5,6\n7,8\nx,y,z,w\n")
    good, bad, kinds = T.read_typed(spark, path)
    assert kinds == {"a": "bigint", "b": "bigint"}  # broken lines do not widen a type
    assert rows(good) == [(1, 2), (7, 8)] and sorted(r.line for r in bad.collect()) == ["3", "4,5,6", "x,y,z,w"]
    assert good.select("b").count() == 2 and rows(good.select("a")) == [(1,), (7,)]


def test_many_files_and_no_header(spark, tmp_path):
    paths = [csv(tmp_path, "1;q\n2;r\n", "a.csv"), csv(tmp_path, "9999999999;s\n1.5;t\n", "b.csv")]
    good, bad, kinds = T.read_typed(spark, paths, header=["n", "N"], sep=";")
    assert kinds == {"n": "double", "N_2": "string"} and good.count() == 4 and bad.count() == 0


def test_empty_file(spark, tmp_path):
    good, bad, kinds = T.read_typed(spark, csv(tmp_path, "a,b\n"))
    assert kinds == {"a": "string", "b": "string"} and good.count() == 0 and bad.count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_orderstatus")
        li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber")
        one = T.write_bucketed(o, "orders", "o_orderkey", 4)
        two = T.write_bucketed(li, "lineitem", "l_orderkey", 4)
        both = two.join(one, two.l_orderkey == one.o_orderkey)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows(both) == rows(li.join(o, li.l_orderkey == o.o_orderkey))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
