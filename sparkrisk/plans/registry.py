"""Query registry: every operator bound to the driver's tables, plus oracle SQL.

Each query takes (spark, sf_dir), reads whole tables and returns a DataFrame.
Where the operator is expressible in SQL, ``ORACLE_SQL[name]`` computes the
same result in DuckDB over the same Parquet files (views named as the tables).
Model queries (fits) have no oracle: the driver checks their rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.rank import shuffle_rank
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import impute as IM
from ..operators import profile as P
from ..operators import sample as SM
from ..operators import select as SEL
from ..operators import shape as SH
from .tables import sig_all, sig_sql, table

SEED = 42

# Fixed values of the bindings -------------------------------------------------
PRIORITY_SENTINEL = "4-NOT SPECIFIED"       # plays the role of '?' in orders
LANG_SENTINEL = "en"                        # plays the role of '?' in documents
KEPT_TYPES = ["ECONOMY", "LARGE", "PROMO", "SMALL"]
DISCOUNT_TYPES = ["PROMO", "ECONOMY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CHANGE_VALUES = ["R", "O"]
RESID_INTERCEPT, RESID_SLOPE = 52872.3473, 7.1617

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def _md5_sql(*exprs: str, seed: int = SEED) -> str:
    return "md5(concat_ws('-', '{}', {}))".format(seed, ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs))


def _union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------------------
# Keys, profiles, frequencies
# ----------------------------------------------------------------------------
@register("agg1_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def agg1_duplicate_keys(spark, d):
    return P.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("agg2_frequency", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
""")
def agg2_frequency(spark, d):
    return P.frequency(table(spark, d, "orders"), "o_orderpriority")


@register("agg2_frequency_levels", """
SELECT CAST(l.range AS INTEGER) AS p_size, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(1, 51) l LEFT JOIN (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) c
  ON c.p_size = l.range
""")
def agg2_frequency_levels(spark, d):
    return P.frequency(table(spark, d, "part"), "p_size", levels=S.level_range(1, 50), order="level")


@register("agg3_contingency", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg3_contingency(spark, d):
    return P.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register("agg3_contingency_wide", """
SELECT l_returnflag,
       count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY l_returnflag
""")
def agg3_contingency_wide(spark, d):
    return P.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", wide=True,
                         b_levels=["F", "O"])


@register("agg4_class_distribution", """
WITH long AS (
  SELECT 'o_orderpriority' AS attr, o_orderpriority AS value, o_orderstatus FROM orders
  UNION ALL
  SELECT 'o_month', strftime(o_orderdate, '%m'), o_orderstatus FROM orders),
c AS (SELECT attr, value, o_orderstatus, count(*) AS n FROM long GROUP BY attr, value, o_orderstatus)
SELECT attr, value, o_orderstatus, n, n / sum(n) OVER (PARTITION BY attr, value) AS share FROM c
""")
def agg4_class_distribution(spark, d):
    o = table(spark, d, "orders").withColumn("o_month", S.month_of("o_orderdate"))
    return P.class_distribution(o, "o_orderstatus", ["o_orderpriority", "o_month"])


ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
DOCUMENT_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                 ("n_chars", "bigint")]
PART_COLS = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")]


def _missing_sql(tbl: str, cols, sentinel: str) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        nan = f"count(*) FILTER (WHERE isnan({c}))" if t == "double" else "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT {i + 1} AS pos, '{c}' AS \"column\", count(*) AS n_rows, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, {nan} AS n_nan, "
            f"count(*) FILTER (WHERE CAST({c} AS VARCHAR) = '{sentinel}') AS n_sentinel FROM {tbl}")
    return ("SELECT *, CAST(n_null + n_nan + n_sentinel AS DOUBLE) / n_rows AS missing_ratio FROM (\n"
            + _union_sql(parts) + "\n)")


@register("agg5_missing_profile", _missing_sql("orders", ORDERS_COLS, PRIORITY_SENTINEL))
def agg5_missing_profile(spark, d):
    return P.missing_profile(table(spark, d, "orders"), PRIORITY_SENTINEL)


@register("agg6_sparse_columns",
          "SELECT \"column\", missing_ratio, missing_ratio > 0.5 AS dropped FROM (\n"
          + _missing_sql("documents", DOCUMENT_COLS, LANG_SENTINEL) + "\n)")
def agg6_sparse_columns(spark, d):
    prof = P.missing_profile(table(spark, d, "documents"), LANG_SENTINEL)
    return prof.select("column", "missing_ratio", (F.col("missing_ratio") > 0.5).alias("dropped"))


@register("agg6_drop_sparse", """
SELECT doc_id, text, source, n_chars FROM documents
""")
def agg6_drop_sparse(spark, d):
    return P.drop_sparse(table(spark, d, "documents"), 0.5, LANG_SENTINEL)


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary_sql(tbl: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, {sig_sql(f'avg({c})')} AS mean, "
            f"{sig_sql(f'stddev_samp({c})')} AS std, {sig_sql(f'min({c})')} AS min, "
            f"{sig_sql(f'quantile_cont({c}, 0.25)')} AS q25, {sig_sql(f'quantile_cont({c}, 0.5)')} AS q50, "
            f"{sig_sql(f'quantile_cont({c}, 0.75)')} AS q75, {sig_sql(f'max({c})')} AS max FROM {tbl}")
    return _union_sql(parts)


@register("agg7_numeric_summary", _summary_sql("lineitem", LINE_NUMERIC))
def agg7_numeric_summary(spark, d):
    return sig_all(P.numeric_summary(table(spark, d, "lineitem"), LINE_NUMERIC))


@register("agg8_categorical_summary", """
WITH long AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part
              UNION ALL SELECT 'p_type', p_type FROM part),
c AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY "column", value),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk,
             count(*) OVER (PARTITION BY "column") AS levels FROM c)
SELECT "column", value, n, CAST(rk AS INTEGER) AS rank FROM r WHERE levels <= 7 OR rk <= 6
UNION ALL
SELECT "column", '(Other)', CAST(sum(n) AS BIGINT), 7 FROM r WHERE levels > 7 AND rk > 6 GROUP BY "column"
""")
def agg8_categorical_summary(spark, d):
    return P.categorical_summary(table(spark, d, "part"), ["p_brand", "p_type"], top=6)


def _near_constant_sql(tbl: str, cols, threshold: float) -> str:
    long = _union_sql([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {tbl}" for c, _ in cols])
    return f"""
WITH long AS ({long}),
c AS (SELECT "column", value, count(*) AS n FROM long GROUP BY "column", value),
top AS (SELECT "column", value AS top_value, n AS top_n,
               row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk
        FROM c WHERE value IS NOT NULL),
per AS (SELECT "column", CAST(sum(n) AS BIGINT) AS n_rows, count(value) AS n_distinct FROM c GROUP BY "column")
SELECT per."column", top.top_value, CAST(coalesce(top.top_n, 0) AS BIGINT) AS top_n, per.n_rows,
       CAST(coalesce(top.top_n, 0) AS DOUBLE) / per.n_rows AS top_share, per.n_distinct,
       CAST(coalesce(top.top_n, 0) AS DOUBLE) / per.n_rows >= {threshold} AS near_constant
FROM per LEFT JOIN top ON top."column" = per."column" AND top.rk = 1
"""


@register("agg14_near_constant", _near_constant_sql("part", PART_COLS, 0.99))
def agg14_near_constant(spark, d):
    return P.near_constant(table(spark, d, "part"), max_top_share=0.99)


def _schema_sql(tbl: str, cols) -> str:
    parts = [f"SELECT {i + 1} AS pos, '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, "
             f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {tbl}"
             for i, (c, t) in enumerate(cols)]
    return _union_sql(parts)


@register("prj10_schema_profile", _schema_sql("orders", ORDERS_COLS))
def prj10_schema_profile(spark, d):
    return P.schema_profile(table(spark, d, "orders"))


# ----------------------------------------------------------------------------
# Projections, joins, set operations
# ----------------------------------------------------------------------------
@register("prj5_select_by_type", """
SELECT o_orderstatus, o_orderpriority FROM orders
""")
def prj5_select_by_type(spark, d):
    return SH.select_by_type(table(spark, d, "orders"), "string")


@register("prj3_drop_columns", """
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def prj3_drop_columns(spark, d):
    return SH.drop_columns(table(spark, d, "customer"), ["c_name"])


@register("prj4_select_columns", """
SELECT p_partkey, p_brand, p_size FROM part
""")
def prj4_select_columns(spark, d):
    return SH.select_columns(table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"])


@register("jn1_join_on", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority,
       c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def jn1_join_on(spark, d):
    # timestamps are left out of compared outputs (engines return different resolutions)
    orders = table(spark, d, "orders").drop("o_orderdate")
    return SH.join_on(orders, table(spark, d, "customer"), ("o_custkey", "c_custkey"))


@register("jn2_map_columns", """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name AS c_nation
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def jn2_map_columns(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                               F.col("n_name").alias("c_nation"))
    return SH.map_columns(table(spark, d, "customer"), nation, "c_nationkey", drop_key=True)


@register("jn3_join_chain", """
SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderstatus, c_mktsegment, n_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def jn3_join_chain(spark, d):
    # the order side is joined to its dimensions first and lineitem last, so the largest table is
    # shuffled once (Spark keeps the written join order unless CBO has table statistics)
    orders = SH.join_chain(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [
        (table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ("o_custkey", "c_custkey")),
        (table(spark, d, "nation").select("n_nationkey", "n_name"), ("c_nationkey", "n_nationkey"),
         SH.LOOKUP_MAX_ROWS),
    ])
    out = SH.join_on(table(spark, d, "lineitem"), orders, ("l_orderkey", "o_orderkey"))
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderstatus", "c_mktsegment", "n_name")


@register("jn4_join_audit", """
WITH l AS (SELECT l_orderkey AS k, count(*) AS nl FROM lineitem GROUP BY l_orderkey),
     r AS (SELECT o_orderkey AS k, count(*) AS nr FROM orders GROUP BY o_orderkey),
     b AS (SELECT l.k AS lk, r.k AS rk, coalesce(nl, 0) AS nl, coalesce(nr, 0) AS nr
           FROM l FULL OUTER JOIN r ON l.k = r.k)
SELECT CAST(sum(nl) AS BIGINT) AS left_rows, CAST(sum(nr) AS BIGINT) AS right_rows,
       CAST(coalesce(sum(nl * nr) FILTER (WHERE lk IS NOT NULL AND rk IS NOT NULL), 0) AS BIGINT) AS joined_rows,
       CAST(coalesce(sum(nl) FILTER (WHERE lk IS NULL OR rk IS NULL), 0) AS BIGINT) AS left_unmatched,
       CAST(coalesce(sum(nr) FILTER (WHERE lk IS NULL OR rk IS NULL), 0) AS BIGINT) AS right_unmatched
FROM b
""")
def jn4_join_audit(spark, d):
    return SH.join_audit(table(spark, d, "lineitem"), table(spark, d, "orders"), ("l_orderkey", "o_orderkey"))


@register("prj8_bind_columns", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def prj8_bind_columns(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return SH.bind_columns(docs, table(spark, d, "labels"), "doc_id")


@register("set1_stack", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'
""")
def set1_stack(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return SH.stack(*[o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")])


@register("set2_stack_tagged", """
SELECT o_orderkey, o_orderstatus, o_totalprice, 'train' AS part FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL
SELECT o_orderkey, NULL, o_totalprice, 'test' FROM orders WHERE o_orderstatus = 'P'
""")
def set2_stack_tagged(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    test = o.where(F.col("o_orderstatus") == "P").drop("o_orderstatus")
    return SH.stack_tagged({"train": o.where(F.col("o_orderstatus").isin("F", "O")), "test": test})


# ----------------------------------------------------------------------------
# Scalar recodes and derived columns
# ----------------------------------------------------------------------------
@register("scl6_null_sentinel", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       nullif(o_orderpriority, '{PRIORITY_SENTINEL}') AS o_orderpriority
FROM orders
""")
def scl6_null_sentinel(spark, d):
    orders = table(spark, d, "orders").drop("o_orderdate")
    return S.null_sentinel(orders, ["o_orderpriority"], PRIORITY_SENTINEL)


@register("flt4_split_missing", f"""
SELECT o_orderkey, nullif(o_orderpriority, '{PRIORITY_SENTINEL}') AS o_orderpriority,
       CASE WHEN o_orderpriority = '{PRIORITY_SENTINEL}' THEN 'unknown' ELSE 'known' END AS part
FROM orders
""")
def flt4_split_missing(spark, d):
    o = S.null_sentinel(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                        ["o_orderpriority"], PRIORITY_SENTINEL)
    known, unknown = SH.split_missing(o, "o_orderpriority")
    return SH.stack_tagged({"known": known, "unknown": unknown})


@register("scl1_restrict_levels", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL') THEN p_type END AS p_type FROM part
""")
def scl1_restrict_levels(spark, d):
    return S.restrict_levels(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", KEPT_TYPES)


@register("dor1_recode", """
SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'DISCOUNT' ELSE p_type END AS p_type FROM part
""")
def dor1_recode(spark, d):
    return S.recode(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", {"DISCOUNT": DISCOUNT_TYPES})


@register("fe4_stay_features", """
SELECT l_orderkey, l_linenumber,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS n_days,
       strftime(o_orderdate, '%m') AS month
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def fe4_stay_features(spark, d):
    j = SH.join_on(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"),
                   table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ("l_orderkey", "o_orderkey"))
    return S.stay_features(j, "o_orderdate", "l_shipdate", drop_dates=True)


@register("scl3_parse_date", """
SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE)) AS DOUBLE)
       AS days_since
FROM orders
""")
def scl3_parse_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.select("o_orderkey", S.day_diff(S.parse_date("day"), F.lit("1995-01-01")).alias("days_since"))


@register("scl2_as_category", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_type FROM part
""")
def scl2_as_category(spark, d):
    return S.as_category(table(spark, d, "part").select("p_partkey", "p_size", "p_type"), ["p_size", "p_type"])


@register("scl10_to_number", """
SELECT o_orderkey, TRY_CAST(o_orderstatus AS DOUBLE) AS status_number,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_rank
FROM orders
""")
def scl10_to_number(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.to_number("o_orderstatus").alias("status_number"),
                    S.to_number(F.substring("o_orderpriority", 1, 1), "int").alias("priority_rank"))


@register("agg12_count_values_in", """
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_returnflag IN ('R', 'O') AS INTEGER) + CAST(l_linestatus IN ('R', 'O') AS INTEGER) AS INTEGER)
       AS n_changes
FROM lineitem
""")
def agg12_count_values_in(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    out = S.count_values_in(li, ["l_returnflag", "l_linestatus"], CHANGE_VALUES, "n_changes")
    return out.select("l_orderkey", "l_linenumber", "n_changes")


# ----------------------------------------------------------------------------
# Features and imputation
# ----------------------------------------------------------------------------
def _one_hot_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v.replace('-', '_').replace(' ', '_')}\""
        for v in PRIORITIES)
    return f"SELECT o_orderkey, {cols} FROM orders"


@register("fe1_one_hot", _one_hot_sql())
def fe1_one_hot(spark, d):
    return FE.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register("fe3_standardize", """
SELECT p_partkey,
  round((p_size - avg(p_size) OVER ()) / CASE WHEN stddev_pop(p_size) OVER () = 0 THEN 1
        ELSE stddev_pop(p_size) OVER () END, 6) AS p_size,
  round((p_retailprice - avg(p_retailprice) OVER ()) / CASE WHEN stddev_pop(p_retailprice) OVER () = 0
        THEN 1 ELSE stddev_pop(p_retailprice) OVER () END, 6) AS p_retailprice
FROM part
""")
def fe3_standardize(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    z = FE.standardize(p, ["p_size", "p_retailprice"])
    return z.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@register("fe2_fit_levels", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'train' ELSE 'test' END AS part,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS "o_orderpriority_1_URGENT",
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS "o_orderpriority_2_HIGH",
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS "o_orderpriority_3_MEDIUM",
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "o_orderpriority_4_NOT_SPECIFIED",
       CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS "o_orderpriority_5_LOW"
FROM orders
""")
def fe2_fit_levels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    train = o.where(F.col("o_orderstatus").isin("F", "O")).drop("o_orderstatus")
    test = o.where(~F.col("o_orderstatus").isin("F", "O")).drop("o_orderstatus")
    levels = FE.fit_levels([train, test], ["o_orderpriority"])      # joint levels: equal columns
    both = SH.stack_tagged({"train": train, "test": test})
    return FE.one_hot(both, ["o_orderpriority"], levels)


@register("dor2_scale_only", """
SELECT p_partkey,
  round(p_size / CASE WHEN stddev_pop(p_size) OVER () = 0 THEN 1 ELSE stddev_pop(p_size) OVER () END, 6) AS p_size,
  round(p_retailprice / CASE WHEN stddev_pop(p_retailprice) OVER () = 0 THEN 1
        ELSE stddev_pop(p_retailprice) OVER () END, 6) AS p_retailprice
FROM part
""")
def dor2_scale_only(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    z = FE.standardize(p, ["p_size", "p_retailprice"], with_mean=False)
    return z.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@register("imp1_impute_median", """
WITH x AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS c_acctbal
           FROM customer)
SELECT c_custkey, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM x)) AS c_acctbal FROM x
""")
def imp1_impute_median(spark, d):
    c = table(spark, d, "customer")
    x = c.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None))
                 .otherwise(F.col("c_acctbal")).cast("double").alias("c_acctbal"))
    return IM.impute_median(x, ["c_acctbal"])


# ----------------------------------------------------------------------------
# Sampling
# ----------------------------------------------------------------------------
@register("srt1_shuffle_rank", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {_md5_sql('o_orderkey')}, o_orderkey) AS rn FROM orders
""")
def srt1_shuffle_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return shuffle_rank(o, "o_orderkey", SEED, total=None)


@register("smp2_assign_folds", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_md5_sql('o_orderkey')}, o_orderkey) AS rn,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey,
       CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((rn - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS fold
FROM r
""")
def smp2_assign_folds(spark, d):
    return SM.assign_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, SEED)


@register("smp3_stratified_split", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5_sql('o_orderkey')}, o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= ceil(0.7 * n) THEN 'train' ELSE 'test' END AS split FROM r
""")
def smp3_stratified_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SM.stratified_split(o, "o_orderstatus", "o_orderkey", 0.7, SEED)


@register("smp4_random_split", f"""
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_md5_sql('c_custkey')}, c_custkey) AS rn,
                  count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN rn <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS split FROM r
""")
def smp4_random_split(spark, d):
    return SM.random_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.3, SEED)


@register("smp5_down_sample", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_md5_sql('doc_id')}, doc_id) AS rn
           FROM labels)
SELECT doc_id, quality, toxic FROM r
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
""")
def smp5_down_sample(spark, d):
    return SM.down_sample(table(spark, d, "labels"), "quality", "doc_id", SEED)


@register("smp6_up_sample", f"""
WITH counts AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
mx AS (SELECT max(n) AS m FROM counts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_md5_sql('doc_id')}, doc_id) AS rn
           FROM labels),
draws AS (SELECT quality, n, unnest(range(1, m - n + 1)) AS j FROM counts, mx WHERE m > n),
picks AS (SELECT quality,
                 1 + CAST(('0x' || substr({_md5_sql('quality', 'j')}, 1, 8)) AS BIGINT) % n AS rn FROM draws)
SELECT doc_id, quality, toxic FROM ranked
UNION ALL
SELECT r.doc_id, r.quality, r.toxic FROM picks p JOIN ranked r ON p.quality = r.quality AND p.rn = r.rn
""")
def smp6_up_sample(spark, d):
    return SM.up_sample(table(spark, d, "labels"), "quality", "doc_id", SEED)


# ----------------------------------------------------------------------------
# Evaluation on rule-made predictions (exactly checkable)
# ----------------------------------------------------------------------------
def _rule_scored(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("truth"),
                     F.when(F.col("l_discount") > 0.05, "yes").otherwise("no").alias("pred"))


_RULE_SQL = ("SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS truth, "
             "CASE WHEN l_discount > 0.05 THEN 'yes' ELSE 'no' END AS pred FROM lineitem")


@register("evl1_recall", f"""
WITH s AS ({_RULE_SQL}),
c AS (SELECT count(*) FILTER (WHERE truth = 'yes' AND pred = 'yes') AS tp,
             count(*) FILTER (WHERE truth = 'yes' AND pred <> 'yes') AS fn FROM s)
SELECT tp, fn, CAST(tp AS DOUBLE) / (tp + fn) AS recall FROM c
""")
def evl1_recall(spark, d):
    return E.recall(_rule_scored(spark, d), "pred", "truth", "yes")


@register("evl2_confusion_matrix", f"""
WITH s AS ({_RULE_SQL}) SELECT truth, pred AS prediction, count(*) AS n FROM s GROUP BY truth, pred
""")
def evl2_confusion_matrix(spark, d):
    return E.confusion_matrix(_rule_scored(spark, d), "pred", "truth")


@register("evl2_confusion_stats", f"""
WITH s AS ({_RULE_SQL}),
c AS (SELECT count(*) FILTER (WHERE truth = 'yes' AND pred = 'yes') AS tp,
             count(*) FILTER (WHERE truth <> 'yes' AND pred = 'yes') AS fp,
             count(*) FILTER (WHERE truth = 'yes' AND pred <> 'yes') AS fn,
             count(*) FILTER (WHERE truth <> 'yes' AND pred <> 'yes') AS tn FROM s),
d AS (SELECT tp, fp, fn, tn, CAST(tp AS DOUBLE) AS dtp, CAST(fp AS DOUBLE) AS dfp, CAST(fn AS DOUBLE) AS dfn,
             CAST(tn AS DOUBLE) AS dtn, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM c),
e AS (SELECT *, (dtp + dtn) / n AS acc,
             ((dtp + dfp) * (dtp + dfn) + (dfn + dtn) * (dfp + dtn)) / (n * n) AS pe,
             dtp / (dtp + dfn) AS sens, dtn / (dtn + dfp) AS spec FROM d)
SELECT tp, fp, fn, tn, {sig_sql('acc')} AS accuracy, {sig_sql('(acc - pe) / (1 - pe)')} AS kappa,
       {sig_sql('sens')} AS sensitivity, {sig_sql('spec')} AS specificity,
       {sig_sql('dtp / (dtp + dfp)')} AS ppv, {sig_sql('dtn / (dtn + dfn)')} AS npv,
       {sig_sql('(dtp + dfn) / n')} AS prevalence, {sig_sql('dtp / n')} AS detection_rate,
       {sig_sql('(dtp + dfp) / n')} AS detection_prevalence, {sig_sql('(sens + spec) / 2')} AS balanced_accuracy,
       {sig_sql('greatest(dtp + dfn, dfp + dtn) / n')} AS no_information_rate
FROM e
""")
def evl2_confusion_stats(spark, d):
    return sig_all(E.confusion_stats(_rule_scored(spark, d), "pred", "truth", "yes"))


_MULTI_SQL = ("SELECT l_returnflag AS truth, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' "
              "ELSE 'R' END AS pred FROM lineitem")


@register("evl2_per_class_stats", f"""
WITH s AS ({_MULTI_SQL}),
t AS (SELECT truth AS cls, count(*) AS n_truth, count(*) FILTER (WHERE pred = truth) AS tp FROM s GROUP BY truth),
p AS (SELECT pred AS cls, count(*) AS n_pred FROM s GROUP BY pred)
SELECT coalesce(t.cls, p.cls) AS "class", CAST(coalesce(n_truth, 0) AS BIGINT) AS n_truth,
       CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred,
       {sig_sql('CAST(coalesce(tp, 0) AS DOUBLE) / n_truth')} AS recall,
       {sig_sql('CAST(coalesce(tp, 0) AS DOUBLE) / n_pred')} AS precision
FROM t FULL OUTER JOIN p ON t.cls = p.cls
""")
def evl2_per_class_stats(spark, d):
    li = table(spark, d, "lineitem")
    pred = (F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R"))
    scored = li.select(F.col("l_returnflag").alias("truth"), pred.alias("pred"))
    return sig_all(E.per_class_stats(scored, "pred", "truth"))


_REG_SQL = (f"SELECT {RESID_INTERCEPT} + {RESID_SLOPE} * l_quantity AS pred, l_extendedprice AS y FROM lineitem")


def _reg_scored(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.lit(RESID_INTERCEPT) + F.lit(RESID_SLOPE) * F.col("l_quantity")).alias("pred"),
                     F.col("l_extendedprice").alias("y"))


@register("evl3_regression_metrics", f"""
WITH s AS ({_REG_SQL}),
a AS (SELECT count(*) AS n, sum((pred - y) * (pred - y)) AS sse, var_pop(y) AS vy, avg(abs(pred - y)) AS mae,
             avg((pred - y) * (pred - y)) AS mse,
             avg(CASE WHEN y <> 0 THEN abs(pred - y) / y END) AS mape FROM s)
SELECT n, {sig_sql('1 - sse / (vy * n)')} AS r2, {sig_sql('mae')} AS mae, {sig_sql('mse')} AS mse,
       {sig_sql('sqrt(mse)')} AS rmse, {sig_sql('mape')} AS mape FROM a
""")
def evl3_regression_metrics(spark, d):
    return sig_all(E.regression_metrics(_reg_scored(spark, d), "pred", "y"))


@register("evl8_residual_histogram", f"""
WITH s AS (SELECT y - pred AS residual FROM ({_REG_SQL})),
mm AS (SELECT min(residual) AS lo, max(residual) AS hi FROM s),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM mm),
b AS (SELECT CAST(least(CAST(floor((residual - lo) / width) AS INTEGER), 19) + 1 AS INTEGER) AS bin, lo, width
      FROM s, w)
SELECT bin, {sig_sql('lo + (bin - 1) * width')} AS lower, {sig_sql('lo + bin * width')} AS upper, count(*) AS n
FROM b GROUP BY bin, lo, width
""")
def evl8_residual_histogram(spark, d):
    return sig_all(E.residual_histogram(_reg_scored(spark, d), "pred", "y", bins=20))


# ----------------------------------------------------------------------------
# Feature ranking
# ----------------------------------------------------------------------------
RANK_NUMERIC = ["l_quantity", "l_discount", "l_tax"]


def _rank_sql() -> str:
    bins = []
    for c in RANK_NUMERIC:
        bins.append(
            f"CAST(least(CAST(floor((CAST({c} AS DOUBLE) - (SELECT min({c}) FROM lineitem)) / "
            f"(SELECT CASE WHEN max({c}) <> min({c}) THEN (CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)) / 10 "
            f"ELSE 1.0 END FROM lineitem)) AS INTEGER), 9) + 1 AS VARCHAR) AS {c}")
    long = _union_sql(
        ["SELECT 'l_returnflag' AS feature, l_returnflag AS value, _y FROM b"]
        + [f"SELECT '{c}', {c}, _y FROM b" for c in RANK_NUMERIC])
    return f"""
WITH b AS (SELECT l_linestatus AS _y, l_returnflag, {', '.join(bins)} FROM lineitem WHERE l_linestatus IS NOT NULL),
long AS ({long}),
cells AS (SELECT feature, value, _y, count(*) AS o FROM long WHERE value IS NOT NULL GROUP BY feature, value, _y),
vals AS (SELECT feature, value, sum(o) AS n_v FROM cells GROUP BY feature, value),
labs AS (SELECT feature, _y, sum(o) AS n_y FROM cells GROUP BY feature, _y),
tot AS (SELECT feature, sum(n_v) AS n, count(*) AS r FROM vals GROUP BY feature),
grid AS (SELECT v.feature, v.value, l._y, CAST(v.n_v AS DOUBLE) AS nv, CAST(l.n_y AS DOUBLE) AS ny,
                CAST(t.n AS DOUBLE) AS n, t.r, CAST(coalesce(c.o, 0) AS DOUBLE) AS o
         FROM vals v JOIN labs l ON v.feature = l.feature JOIN tot t ON v.feature = t.feature
         LEFT JOIN cells c ON c.feature = v.feature AND c.value = v.value AND c._y = l._y),
per AS (SELECT feature, sum((o - nv * ny / n) * (o - nv * ny / n) / (nv * ny / n)) AS chi2, max(n) AS n,
               sum(CASE WHEN o > 0 THEN o / n * ln(o * n / (nv * ny)) ELSE 0 END) AS info_gain,
               max(r) AS r, count(DISTINCT _y) AS c FROM grid GROUP BY feature)
SELECT feature, {sig_sql('info_gain')} AS info_gain, {sig_sql('chi2')} AS chi2,
       CAST((r - 1) * (c - 1) AS INTEGER) AS dof,
       {sig_sql('CASE WHEN least(r, c) - 1 > 0 THEN sqrt(chi2 / (n * (least(r, c) - 1))) END')} AS cramers_v,
       CAST(row_number() OVER (ORDER BY info_gain DESC, feature) AS INTEGER) AS rank
FROM per
"""


@register("mdl13_rank_features", _rank_sql())
def mdl13_rank_features(spark, d):
    li = table(spark, d, "lineitem")
    out = SEL.rank_features(li, "l_linestatus", ["l_returnflag"], RANK_NUMERIC, bins=10)
    return sig_all(out)


@register("srt4_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def srt4_top_k(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return SEL.top_k(o, "o_totalprice", 20, tie="o_orderkey")

