"""Column and key profiles (PRJ10, AGG1-AGG8, AGG14).

Design rules
------------
* Many columns -> one wide ``agg`` (one scan) then ``inline`` into one row per
  column; or one ``unpivot`` + one ``groupBy`` when values must be grouped.
  Never one job per column.
* Grouped counts always aggregate partially before the shuffle, so a value that
  holds a third of all rows costs one partial-aggregate row per task.
* Only per-column / per-level results are ever collected, behind a row bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_bounded, cut_lineage
from .radix import rank_values

FLOAT_TYPES = ("double", "float")
NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(df.columns) if cols is None else list(cols)


def _as_value(df: DataFrame, c: str):
    """NaN -> NULL for floating columns (pandas/R treat NaN as missing)."""
    t = dict(df.dtypes)[c]
    col = F.col(c)
    return F.nanvl(col, F.lit(None).cast(t)) if t in FLOAT_TYPES else col


def _long_strings(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (), nan_missing: bool = False) -> DataFrame:
    """Unpivot ``cols`` into (column, value) with values cast to string.

    -0.0 is the value 0.0; NaN is a value, or NULL with ``nan_missing``.
    """
    floats = {c for c, t in df.dtypes if t in FLOAT_TYPES}

    def text(c: str):
        col = _as_value(df, c) if nan_missing else F.col(c)
        return ((col + F.lit(0.0)).cast(dict(df.dtypes)[c]) if c in floats else col).cast("string").alias(c)

    cast = df.select(*id_cols, *[text(c) for c in cols])
    return cast.unpivot(list(id_cols), list(cols), "column", "value")


# AGG1 / FLT2 ------------------------------------------------------------------
def duplicate_keys(df: DataFrame, keys: str | Sequence[str], n_col: str = "n") -> DataFrame:
    """``SELECT keys, count(1) ... GROUP BY keys HAVING count(1) > 1``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_col))
              .where(F.col(n_col) > 1))


# AGG2 / SRT2 ------------------------------------------------------------------
def frequency(df: DataFrame, col: str, levels: Sequence | None = None,
              order: str = "count", n_col: str = "n") -> DataFrame:
    """One-way frequency of non-NULL values.

    ``levels`` adds zero-count levels and drops values outside them (factor table);
    ``order='count'`` sorts by n descending then value, ``order='level'`` keeps
    level order (needs ``levels``).
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(n_col))
    if levels is not None:
        spark = df.sparkSession
        lv = spark.createDataFrame([(v, i) for i, v in enumerate(levels)],
                                   f"{col} {dict(df.dtypes)[col]}, _lvl int")
        counts = (lv.join(counts, col, "left")
                  .select(col, F.coalesce(F.col(n_col), F.lit(0)).cast("bigint").alias(n_col), "_lvl"))
        if order == "level":
            return counts.orderBy("_lvl").drop("_lvl")
        counts = counts.drop("_lvl")
    return counts.orderBy(F.desc(n_col), F.asc(col))


# AGG3 -------------------------------------------------------------------------
def contingency(df: DataFrame, a: str, b: str, wide: bool = False,
                b_levels: Sequence | None = None, n_col: str = "n") -> DataFrame:
    """Two-way table. Long: (a, b, n) for observed pairs. Wide: one column per b level."""
    data = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if not wide:
        return data.groupBy(a, b).agg(F.count(F.lit(1)).alias(n_col))
    pivoted = (data.groupBy(a).pivot(b, list(b_levels) if b_levels is not None else None)
               .agg(F.count(F.lit(1))))
    return pivoted.fillna(0)


# AGG4 -------------------------------------------------------------------------
def class_distribution(df: DataFrame, label: str, attrs: Sequence[str]) -> DataFrame:
    """(attr, value, label, n, share): label counts per attribute value, share within value."""
    long = _long_strings(df, attrs, id_cols=[label]).withColumnRenamed("column", "attr")
    counts = long.groupBy("attr", "value", label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("attr", "value")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


# AGG5 / UDF2 ------------------------------------------------------------------
def _sentinel_count(col, dtype: str, sentinel: str | None):
    """count of values equal to the sentinel, without formatting numbers per row:
    strings compare directly, numbers only match a numeric sentinel."""
    if sentinel is None:
        return F.lit(0).cast("bigint")
    if dtype == "string":
        return F.count_if(col == F.lit(sentinel))
    if dtype in NUMERIC_TYPES:
        try:
            number = float(sentinel)
        except ValueError:
            return F.lit(0).cast("bigint")
        return F.count_if(col.cast("double") == F.lit(number))
    return F.count_if(col.cast("string") == F.lit(sentinel))


def missing_profile(df: DataFrame, sentinel: str | None = "?",
                    cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, NULLs, NaNs, sentinel hits and the missing ratio; one scan."""
    cols = _cols(df, cols)
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        col = F.col(c)
        aggs.append(F.count_if(col.isNull()).alias(f"_null{i}"))
        aggs.append((F.count_if(F.isnan(col)) if types[c] in FLOAT_TYPES
                     else F.lit(0).cast("bigint")).alias(f"_nan{i}"))
        aggs.append(_sentinel_count(col, types[c], sentinel).alias(f"_sent{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("column"),
                 F.col("_rows").alias("n_rows"), F.col(f"_null{i}").alias("n_null"),
                 F.col(f"_nan{i}").alias("n_nan"), F.col(f"_sent{i}").alias("n_sentinel"))
        for i, c in enumerate(cols)])
    out = wide.select(F.inline(rows))
    missing = F.col("n_null") + F.col("n_nan") + F.col("n_sentinel")
    return out.withColumn("missing_ratio", F.try_divide(missing.cast("double"), F.col("n_rows")))


# AGG6 -------------------------------------------------------------------------
def sparse_columns(df: DataFrame, threshold: float = 0.5, sentinel: str | None = "?",
                   cols: Sequence[str] | None = None) -> list[str]:
    """Names of columns whose missing ratio is above ``threshold`` (one row per column)."""
    prof = missing_profile(df, sentinel, cols).where(F.col("missing_ratio") > threshold)
    return [r["column"] for r in collect_bounded(prof.select("column"), 100_000, "sparse_columns")]


def drop_sparse(df: DataFrame, threshold: float = 0.5, sentinel: str | None = "?",
                cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with more than ``threshold`` missing (NULL, NaN or sentinel)."""
    return df.drop(*sparse_columns(df, threshold, sentinel, cols))


# AGG7 / AGG9 ------------------------------------------------------------------
def _quantile_targets(n: int, p: float) -> tuple[float, int, int]:
    """(position p * (n - 1), the ranks below and above it), 0-based."""
    pos = p * (n - 1)
    return pos, int(math.floor(pos)), int(math.ceil(pos))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles (``quantile_cont``) per column: (column, p, value).

    See :func:`quantile_values`; columns whose bracket check failed are
    answered by :func:`exact_quantiles_sorted`.
    """
    values, failed = quantile_values(df, cols, probs)
    rows = [(c, p, v) for (c, p), v in values.items()]
    out = df.sparkSession.createDataFrame(rows, "column string, p double, value double")
    if failed:
        out = out.unionByName(exact_quantiles_sorted(df, sorted(failed), probs))
    return out


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    counts: dict[str, int] | None = None) -> tuple[dict, set]:
    """({(column, p): value}, columns that need the sorted fallback).

    Every needed rank of every column is found by radix selection (:mod:`.radix`): passes of fixed-size digit counts, no
    sort, no list of values and no sketch; at most one row a rank and pass reaches the driver.
    """
    cols = list(cols)
    probs = [float(p) for p in probs]
    if counts is None:
        first = df.agg(*[F.count(_as_value(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        counts = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    ranks = {c: sorted({r for p in probs for r in _quantile_targets(counts[c], p)[1:]}) if counts[c] else [] for c in cols}
    found = rank_values(df, ranks)
    failed = {c for c in cols if any((c, r) not in found for r in ranks[c])}  # rows that changed between the passes
    values = {}
    for c in cols:
        n = counts[c]
        if not n or c in failed:
            continue
        for p in probs:
            pos, klo, khi = _quantile_targets(n, p)
            vlo, vhi = found[(c, klo)], found[(c, khi)]
            values[(c, p)] = vlo + (pos - klo) * (vhi - vlo)
    return values, failed


def exact_quantiles_sorted(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles by one distributed sort (fallback of :func:`exact_quantiles`).

    One range-partitioned sort of the non-missing values (ties are split by a
    row id, so one hot value spreads over many tasks), per-partition counts ->
    running offsets (one row per column and partition), then only the rows at
    the needed ranks are joined back.
    """
    src = df.select(F.monotonically_increasing_id().alias("_q_row"),
                    *[_as_value(df, c).cast("double").alias(c) for c in cols])
    long = (src.unpivot("_q_row", list(cols), "column", "v")
               .where(F.col("v").isNotNull()))
    ordered = (long.repartitionByRange("column", "v", "_q_row")
                   .sortWithinPartitions("column", "v", "_q_row")
                   .withColumn("_q_id", F.monotonically_increasing_id()))
    ordered = ordered.select(
        "column", "v",
        F.shiftright("_q_id", 33).alias("_q_p"),
        F.col("_q_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_q_l"))
    ordered = cut_lineage(ordered)  # one fixed order for both branches below
    parts = ordered.groupBy("column", "_q_p").agg(F.count(F.lit(1)).alias("_q_c"),
                                                  F.min("_q_l").alias("_q_l0"))
    w_run = Window.partitionBy("column").orderBy("_q_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("column", "_q_p", "_q_l0",
                         F.coalesce(F.sum("_q_c").over(w_run), F.lit(0)).alias("_q_off"),
                         F.sum("_q_c").over(Window.partitionBy("column")).alias("_q_n"))
    targets = (parts.select("column", "_q_n").distinct()
               .select("column", "_q_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
               .withColumn("_q_pos", F.col("p") * (F.col("_q_n") - 1))
               .withColumn("_q_lo", F.floor("_q_pos").cast("bigint"))
               .withColumn("_q_hi", F.ceil("_q_pos").cast("bigint")))
    need = (targets.select("column", F.explode(F.array("_q_lo", "_q_hi")).alias("_q_r")).distinct())
    ranked = (ordered.join(F.broadcast(parts.select("column", "_q_p", "_q_l0", "_q_off")), ["column", "_q_p"])
                     .select("column", "v", (F.col("_q_off") + F.col("_q_l") - F.col("_q_l0")).alias("_q_r")))
    picked = ranked.join(F.broadcast(need), ["column", "_q_r"])
    lo = picked.select("column", F.col("_q_r").alias("_q_lo"), F.col("v").alias("_v_lo"))
    hi = picked.select("column", F.col("_q_r").alias("_q_hi"), F.col("v").alias("_v_hi"))
    res = targets.join(lo, ["column", "_q_lo"]).join(hi, ["column", "_q_hi"])
    frac = F.col("_q_pos") - F.col("_q_lo")
    value = F.col("_v_lo") + frac * (F.col("_v_hi") - F.col("_v_lo"))
    return res.select("column", "p", value.alias("value"))


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                    probs: Sequence[float] = (0.25, 0.5, 0.75), digits: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column (describe()).

    NaN counts as missing. One moments aggregate, then (exact) the radix
    passes of :func:`quantile_values`; ``exact=False`` adds the GK
    sketch to the moments aggregate instead (a single pass). One row per
    column comes back; nothing row-sized reaches the driver.
    """
    if cols is None:
        cols = [c for c, t in df.dtypes if t in NUMERIC_TYPES]
    cols = list(cols)
    probs = [float(p) for p in probs]
    aggs = []
    for i, c in enumerate(cols):
        v = _as_value(df, c).cast("double")
        aggs += [F.count(v).alias(f"_n{i}"), F.avg(v).alias(f"_m{i}"),
                 F.stddev_samp(v).alias(f"_s{i}"), F.min(v).alias(f"_lo{i}"),
                 F.max(v).alias(f"_hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(v, probs, 100_000).alias(f"_q{i}"))
    row = df.agg(*aggs).first()
    qnames = [f"q{int(round(p * 100))}" for p in probs]
    if exact:
        values, failed = quantile_values(df, cols, probs, {c: row[f"_n{i}"] for i, c in enumerate(cols)})
        if failed:
            for r in exact_quantiles_sorted(df, sorted(failed), probs).collect():
                values[(r["column"], r["p"])] = r["value"]
        quant = {c: [values.get((c, p)) for p in probs] for c in cols}
    else:
        quant = {c: (list(row[f"_q{i}"]) if row[f"_q{i}"] is not None else [None] * len(probs))
                 for i, c in enumerate(cols)}

    def rnd(x):
        return round(x, digits) if (digits is not None and x is not None) else x

    data = [(c, row[f"_n{i}"], rnd(row[f"_m{i}"]), rnd(row[f"_s{i}"]), rnd(row[f"_lo{i}"]),
             *[rnd(q) for q in quant[c]], rnd(row[f"_hi{i}"])) for i, c in enumerate(cols)]
    schema = ("column string, count bigint, mean double, std double, min double, "
              + ", ".join(f"{q} double" for q in qnames) + ", max double")
    return df.sparkSession.createDataFrame(data, schema)


def median_of(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, float]:
    """Median of each column (NULL/NaN ignored) as a small dict on the driver."""
    if exact:
        values, failed = quantile_values(df, cols, [0.5])
        out = {c: values.get((c, 0.5)) for c in cols}
        if failed:
            for r in exact_quantiles_sorted(df, sorted(failed), [0.5]).collect():
                out[r["column"]] = r["value"]
        return out
    row = df.agg(*[F.percentile_approx(_as_value(df, c), 0.5, 100_000).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


# AGG8 -------------------------------------------------------------------------
def categorical_summary(df: DataFrame, cols: Sequence[str], top: int = 6) -> DataFrame:
    """Counts of the most frequent levels per column, the rest lumped as '(Other)'.

    With at most ``top + 1`` levels every level is listed; otherwise the ``top``
    most frequent (ties by value) and one '(Other)' row. NULLs form an "NA's" row.
    Output: (column, value, n, rank).

    Scales with the number of levels: level counts and totals are aggregates,
    and the top-k filter is a plain ``row_number() <= k`` so Spark applies a
    map-side group limit before the shuffle (no task sees all levels of a column).
    """
    long = _long_strings(df, cols)
    # the (column, value) table is read by three branches: written once instead of scanning three times
    counts = cut_lineage(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    known = counts.where(F.col("value").isNotNull())
    per_col = known.groupBy("column").agg(F.count(F.lit(1)).alias("_levels"), F.sum("n").alias("_total"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    best = known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top + 1)
    best = best.join(per_col, "column")
    keep_all = F.col("_levels") <= top + 1
    shown = best.where(keep_all | (F.col("rank") <= top)).select("column", "value", "n", "rank")
    other = (best.where(~keep_all & (F.col("rank") <= top))
             .groupBy("column").agg(F.sum("n").alias("_shown"), F.first("_total").alias("_total"))
             .select("column", F.lit("(Other)").alias("value"),
                     (F.col("_total") - F.col("_shown")).cast("bigint").alias("n"), F.lit(top + 1).alias("rank")))
    nas = (counts.where(F.col("value").isNull())
           .select("column", F.lit("NA's").alias("value"), "n", F.lit(top + 2).alias("rank")))
    return shown.unionByName(other).unionByName(nas).withColumn("rank", F.col("rank").cast("int"))


# AGG14 ------------------------------------------------------------------------
def near_constant(df: DataFrame, cols: Sequence[str] | None = None,
                  max_top_share: float = 0.99) -> DataFrame:
    """(column, top_value, top_n, n_rows, top_share, n_distinct, near_constant).

    The top value is the most frequent non-NULL value (ties: smallest value); NaN is missing, like NULL.
    """
    cols = _cols(df, cols)
    long = _long_strings(df, cols, nan_missing=True)
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per_col = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.struct(F.col("value").isNull(), -F.col("n"), F.col("value")))
         .alias("top_value"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_n"),
    )
    out = per_col.select(
        "column", "top_value", F.coalesce("top_n", F.lit(0)).cast("bigint").alias("top_n"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.try_divide(F.coalesce("top_n", F.lit(0)).cast("double"), F.col("n_rows")).alias("top_share"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"))
    return out.withColumn("near_constant", F.col("top_share") >= F.lit(max_top_share))


# PRJ10 ------------------------------------------------------------------------
def schema_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(pos, column, type, n_rows, n_null, n_distinct) for every column, like str().

    Exact: one scan; rows, NULLs and distinct values all come from the
    (column, value) count table (partial aggregation before the shuffle).
    ``exact=False``: one wide aggregate with HyperLogLog distinct counts.
    """
    cols = list(df.columns)
    types = dict(df.dtypes)
    if not exact:
        base = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.count_if(F.col(c).isNull()).alias(f"_null{i}") for i, c in enumerate(cols)],
                      *[F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(cols)])
        rows = F.array(*[
            F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                     F.col("_rows").alias("n_rows"), F.col(f"_null{i}").alias("n_null"),
                     F.col(f"_d{i}").alias("n_distinct"))
            for i, c in enumerate(cols)])
        return base.select(F.inline(rows))
    counts = _long_strings(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_null"),
        F.count("value").cast("bigint").alias("n_distinct"))
    meta = df.sparkSession.createDataFrame([(i + 1, c, types[c]) for i, c in enumerate(cols)],
                                           "pos int, column string, type string")
    return (meta.join(F.broadcast(per), "column", "left")          # one row per column on both sides
            .select("pos", "column", "type", "n_rows", "n_null", "n_distinct"))
