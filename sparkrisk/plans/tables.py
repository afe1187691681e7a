"""Access to the driver's Parquet tables and shared presentation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# lineitem has no single-column key; these columns identify a row (without the date one pair is equal at sf0.001)
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]

SIG_DIGITS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def sig(c: str | Column, digits: int = SIG_DIGITS) -> Column:
    """Round a double to ``digits`` significant digits (via '%.{digits-1}e').

    Aggregates summed in a different order differ in the last bits between
    engines; the oracle SQL applies the same formatting (printf), so compared
    values are equal. NULL (a statistic that is not defined) stays NULL.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), F.format_string(f"%.{digits - 1}e", col.cast("double")).cast("double"))


def sig_sql(expr: str, digits: int = SIG_DIGITS) -> str:
    """DuckDB counterpart of :func:`sig`."""
    return f"CAST(printf('%.{digits - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def sig_all(df: DataFrame, digits: int = SIG_DIGITS) -> DataFrame:
    """Apply :func:`sig` to every double column."""
    return df.select(*[sig(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
