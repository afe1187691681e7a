"""Scalar column functions (SCL1-SCL11, AGG12, FE4, DOR1).

All are built-in Spark expressions, so they stay inside whole-stage codegen and
fuse into the scan stage; none needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# SCL1 -----------------------------------------------------------------------
def restrict_levels(df: DataFrame, col: str, levels: Iterable, out: str | None = None) -> DataFrame:
    """Keep values inside a closed level list; anything else becomes NULL (factor(levels=))."""
    levels = list(levels)
    return df.withColumn(out or col, F.when(F.col(col).isin(levels), F.col(col)))


def level_range(lo: int, hi: int) -> list[int]:
    """Integer levels lo..hi inclusive (the ``1:26`` style level lists)."""
    return list(range(lo, hi + 1))


def prefixed_levels(prefix: str, lo: int, hi: int) -> list[str]:
    """Levels such as D1..D19 built from a prefix and a range."""
    return [f"{prefix}{i}" for i in range(lo, hi + 1)]


# DOR1 -----------------------------------------------------------------------
def recode(df: DataFrame, col: str, mapping: Mapping[str, Sequence], out: str | None = None) -> DataFrame:
    """Replace groups of values by a name: ``{'Expired': [19, 20, 21]}``; others kept."""
    expr = None
    for name, values in mapping.items():
        cond = F.col(col).isin(list(values))
        expr = (F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name)))
    if expr is None:
        return df
    return df.withColumn(out or col, expr.otherwise(F.col(col).cast("string")))


# SCL2 / SCL10 ---------------------------------------------------------------
def as_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Treat columns as categories: stored as strings (levels come from the data)."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def to_number(c: str | Column, dtype: str = "double") -> Column:
    """Lenient numeric cast: unparsable values become NULL instead of raising (ANSI)."""
    return _c(c).try_cast(dtype)


# SCL3 -----------------------------------------------------------------------
def parse_date(c: str | Column, fmt: str | None = None) -> Column:
    """Parse a date; impossible, empty or malformed input becomes NULL."""
    col = _c(c)
    return F.try_to_date(col.cast("string"), F.lit(fmt)) if fmt else F.try_to_date(col.cast("string"))


# SCL4 -----------------------------------------------------------------------
def day_diff(end: str | Column, start: str | Column) -> Column:
    """end - start in days, as a double (difftime(..., units='days'))."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start))).cast("double")


# SCL5 -----------------------------------------------------------------------
def month_of(c: str | Column) -> Column:
    """Two-digit month string '01'..'12'."""
    return F.date_format(_c(c), "MM")


# FE4 ------------------------------------------------------------------------
def stay_features(df: DataFrame, start: str, end: str, days: str = "n_days",
                  month: str = "month", drop_dates: bool = False) -> DataFrame:
    """Length of stay in days and the month of the start date."""
    out = df.withColumns({days: day_diff(end, start), month: month_of(start)})
    return out.drop(start, end) if drop_dates else out


# SCL6 -----------------------------------------------------------------------
def null_sentinel(df: DataFrame, cols: Sequence[str], sentinel: str = "?") -> DataFrame:
    """Sentinel value -> NULL in the named columns (compared as strings)."""
    return df.withColumns({
        c: F.when(F.col(c).cast("string") == F.lit(sentinel), F.lit(None)).otherwise(F.col(c))
        for c in cols})


# SCL7 -----------------------------------------------------------------------
def fill_value(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULL (and NaN for floating columns) with a constant per column."""
    types = dict(df.dtypes)
    exprs = {}
    for c, v in values.items():
        col = F.col(c)
        if types[c] in ("double", "float"):
            col = F.nanvl(col, F.lit(None).cast(types[c]))
        exprs[c] = F.coalesce(col, F.lit(v).cast(types[c]))
    return df.withColumns(exprs)


# SCL11 / AGG12 / FE5 --------------------------------------------------------
def count_values_in(df: DataFrame, cols: Sequence[str], values: Sequence, out: str,
                    null_as_zero: bool = False) -> DataFrame:
    """Row-wise count of columns whose value is in ``values`` (#Up + #Down).

    A NULL in any of the columns makes the count NULL, as a sum over NA does;
    ``null_as_zero=True`` counts NULL as 'not in values' instead.
    """
    terms = []
    for c in cols:
        hit = F.col(c).isin(list(values)).cast("int")
        terms.append(F.coalesce(hit, F.lit(0)) if null_as_zero else hit)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total.cast("int"))


def indicator_sum(c: str | Column, value) -> Column:
    """``sum(x == value)`` as an aggregate (NULLs do not count)."""
    return F.count_if(_c(c) == F.lit(value))
