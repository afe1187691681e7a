"""Sources, sinks, streaming scoring, driver entry points."""

import os

from pyspark.sql import functions as F

from helpers import SF001, rows
from sparkrisk.operators import models as M
from sparkrisk.sources import io
from sparkrisk.streaming.scoring import score_stream, write_predictions


def test_normalise_names():
    assert io.normalise_names(["metformin-rosiglitazone", "a.b", "1x", "a_b", "a b"]) == \
        ["metformin_rosiglitazone", "a_b", "X1x", "a_b_2", "a_b_3"]


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.5), (2, None, None)], "k long, s string, v double")
    path = str(tmp_path / "out")
    io.write_csv(df, path)
    back = io.read_csv(spark, path, schema="k long, s string, v double")
    assert rows(back) == rows(df)
    raw = io.read_csv(spark, path, infer_schema=True)
    assert raw.columns == ["k", "s", "v"]


def test_stream_scoring(spark, tmp_path):
    train = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") % 100).cast("double").alias("x"))
    train = train.withColumn("y", F.when(F.col("x") > 50, "hi").otherwise("lo"))
    model = M.decision_tree(train, "y", ["x"], max_depth=3, key="k")
    src = str(tmp_path / "src")
    train.drop("y").write.parquet(src)
    stream = spark.readStream.schema("k long, x double").parquet(src)
    q = write_predictions(score_stream(model, stream, "k"), str(tmp_path / "pred"), str(tmp_path / "ckpt"),
                          trigger_once=True)
    q.awaitTermination(120)
    out = io.read_csv(spark, str(tmp_path / "pred"), schema="k long, predicted string")
    assert out.count() == 400
    batch = M.score(model, train).select("k", F.col("predicted").alias("batch"))
    assert out.join(batch, "k").where(F.col("predicted") != F.col("batch")).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["attr", "value", "o_orderstatus", "n", "share"]
    assert df.count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 55
    assert os.path.isdir(SF001)
