"""Flagship flow: the classification preparation (audit, join, type, derive, profile) on the order tables.

orders ⋈ customer, nation name looked up in place of the nation key (JN1-JN3),
closed level list on the priority (SCL1), order age in days and month (SCL4,
SCL5), then the class distribution of the order status by attribute (AGG4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import profile as P
from ..operators import shape as SH
from .tables import table

PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def prepared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with customer segment, nation name and date features."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                                    F.col("n_name").alias("c_nation"))
    joined = SH.join_on(orders, customer, ("o_custkey", "c_custkey"))
    joined = SH.map_columns(joined, nation, "c_nationkey", drop_key=True)
    typed = S.restrict_levels(joined, "o_orderpriority", PRIORITY_LEVELS)
    last_day = F.to_date(F.lit("2001-12-31"))
    return typed.withColumns({"age_days": S.day_diff(last_day, "o_orderdate"),
                              "month": S.month_of("o_orderdate")})


def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attr, value, o_orderstatus, n, share) over segment, nation, priority and month."""
    prepared = prepared_orders(spark, sf_dir)
    return P.class_distribution(prepared, "o_orderstatus", ["c_mktsegment", "c_nation", "o_orderpriority", "month"])
