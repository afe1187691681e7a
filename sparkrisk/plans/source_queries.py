"""Queries of the sources: typed CSV scan with quarantine (SRC1), joins of bucketed tables (JN3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import typed as T
from .registry import register
from .tables import table

BROKEN = "1-URGENT"   # orders of this priority are written a second time, as lines with a field too many
BUCKETS = 16


@register("src1_typed_scan", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority,
       'bigint,bigint,string,double,date,string' AS types, (SELECT count(*) FROM orders WHERE o_orderpriority = '{BROKEN}') AS n_broken
FROM orders
""")
def src1_typed_scan(spark, d):
    """Orders written as CSV with broken lines between, scanned back: types found, values equal, broken lines set aside."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/typed/{uuid.uuid4().hex}"
    o.write.csv(f"{run}/good")
    broken = o.where(F.col("o_orderpriority") == BROKEN).select(F.concat_ws(",", *[F.col(c).cast("string") for c in o.columns], F.lit("extra")))
    broken.write.text(f"{run}/broken")
    good, bad, kinds = T.read_typed(spark, [f"{run}/good", f"{run}/broken"], header=o.columns)
    return good.select(*[c for c in o.columns if c != "day"], F.date_format("day", "yyyy-MM-dd").alias("day"),
                       F.lit(",".join(kinds[c] for c in o.columns)).alias("types"), F.lit(bad.count()).alias("n_broken"))


@register("jn3_bucketed", """
SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def jn3_bucketed(spark, d):
    """Lineitem and orders written once, bucketed and sorted by the order key: their join moves no row."""
    li = T.write_bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "lineitem", "l_orderkey", BUCKETS)
    o = T.write_bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "orders", "o_orderkey", BUCKETS)
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderstatus")
