"""Projections, joins, filters and set operations (PRJ*, JN*, FLT*, SET*).

Joins are plain equi-joins so Catalyst/AQE pick the strategy. A side is only
broadcast explicitly after :func:`sparkrisk.session.bounded` proved its row
count; otherwise the size-based automatic broadcast and AQE's runtime re-plan
(including skew-join splitting) apply.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded

LOOKUP_MAX_ROWS = 2_000_000


def _key_pair(key) -> tuple[list[str], list[str]]:
    """key: 'k' | ('lk', 'rk') | [('lk1','rk1'), 'k2', ...] -> (left names, right names)."""
    if isinstance(key, str):
        return [key], [key]
    if isinstance(key, tuple) and len(key) == 2 and all(isinstance(k, str) for k in key):
        return [key[0]], [key[1]]
    lefts, rights = [], []
    for k in key:
        lk, rk = _key_pair(k)
        lefts += lk
        rights += rk
    return lefts, rights


# PRJ3 / PRJ4 / PRJ5 / PRJ6 ----------------------------------------------------
def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop by name; ``strict`` raises on unknown names (Spark would ignore them)."""
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise KeyError(f"unknown columns: {missing}")
    return df.drop(*names)


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select by name (positions are never used)."""
    return df.select(*names)


def select_by_type(df: DataFrame, *types: str) -> DataFrame:
    """Columns whose Spark type name is one of ``types`` (e.g. 'string')."""
    return df.select(*[c for c, t in df.dtypes if t in types])


def split_label(df: DataFrame, label: str) -> tuple[str, list[str]]:
    """(label, feature names): column lists only, no data moves."""
    if label not in df.columns:
        raise KeyError(label)
    return label, [c for c in df.columns if c != label]


# JN1 / PRJ1 -------------------------------------------------------------------
def join_on(left: DataFrame, right: DataFrame, key, how: str = "inner",
            broadcast_max_rows: int | None = None) -> DataFrame:
    """Equi-join keeping one copy of the key (named as on the left side).

    ``key`` is a shared name, a (left, right) pair, or a list of either.
    ``broadcast_max_rows`` broadcasts ``right`` only when it is proven that small.
    """
    lk, rk = _key_pair(key)
    r = right
    for a, b in zip(lk, rk):
        if a != b:
            r = r.withColumnRenamed(b, a)
    if broadcast_max_rows is not None and bounded(r, broadcast_max_rows):
        r = F.broadcast(r)
    return left.join(r, lk, how)


# JN2 / PRJ2 -------------------------------------------------------------------
def map_columns(df: DataFrame, mapping: DataFrame, key, replace: Sequence[str] | None = None,
                drop_key: bool = False, how: str = "inner",
                broadcast_max_rows: int = LOOKUP_MAX_ROWS) -> DataFrame:
    """Lookup join whose mapped columns replace same-named columns of ``df``.

    ``replace`` defaults to every non-key column of ``mapping``. The lookup is
    broadcast when it has at most ``broadcast_max_rows`` rows, else it is joined
    by shuffle.
    """
    lk, rk = _key_pair(key)
    m = mapping
    for a, b in zip(lk, rk):
        if a != b:
            m = m.withColumnRenamed(b, a)
    replace = [c for c in m.columns if c not in lk] if replace is None else list(replace)
    m = m.select(*lk, *replace)
    out = join_on(df.drop(*[c for c in replace if c not in lk]), m, lk, how, broadcast_max_rows)
    return out.drop(*lk) if drop_key else out


# JN3 --------------------------------------------------------------------------
def join_chain(base: DataFrame, steps: Sequence[tuple], how: str = "inner") -> DataFrame:
    """Join a chain of tables: ``base ⋈ steps[0] ⋈ steps[1] ...`` on each step's key.

    A step is ``(table, key)`` or ``(table, key, max_rows)``: the table is then
    broadcast once proven to have at most ``max_rows`` rows (a lookup with few
    keys must not be joined by a shuffle on those few keys). Joins run in the
    written order (Spark reorders only with CBO and table statistics): put the
    largest table last, joining it to the already joined smaller tables, so it
    is shuffled once.
    """
    out = base
    for step in steps:
        other, key = step[0], step[1]
        out = join_on(out, other, key, how, step[2] if len(step) > 2 else None)
    return out


# JN4 --------------------------------------------------------------------------
def join_audit(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """One row: left_rows, right_rows, joined_rows, left_unmatched, right_unmatched.

    Each side is first reduced to (key, rows) with a partial aggregate, so a hot
    key never crosses the shuffle as many rows; the two key tables then meet in a
    1:1 full outer join.
    """
    lk, rk = _key_pair(key)
    lcount = left.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(lk)]).agg(
        F.count(F.lit(1)).alias("_nl"))
    rcount = right.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(rk)]).agg(
        F.count(F.lit(1)).alias("_nr"))
    keys = [f"_k{i}" for i in range(len(lk))]
    # NULL keys never match: keep them out of the join but count their rows
    lnull = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    both = lcount.join(rcount, keys, "full_outer")
    nl = F.coalesce("_nl", F.lit(0))
    nr = F.coalesce("_nr", F.lit(0))
    matched = F.col("_nl").isNotNull() & F.col("_nr").isNotNull() & ~lnull
    return both.agg(
        F.sum(nl).cast("bigint").alias("left_rows"),
        F.sum(nr).cast("bigint").alias("right_rows"),
        F.coalesce(F.sum(F.when(matched, nl * nr)), F.lit(0)).cast("bigint").alias("joined_rows"),
        F.coalesce(F.sum(F.when(~matched, nl)), F.lit(0)).cast("bigint").alias("left_unmatched"),
        F.coalesce(F.sum(F.when(~matched, nr)), F.lit(0)).cast("bigint").alias("right_unmatched"),
    )


# PRJ8 -------------------------------------------------------------------------
def bind_columns(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Column-bind two row-aligned frames through their shared row key (1:1)."""
    return join_on(left, right, key, "inner")


# PRJ9 -------------------------------------------------------------------------
def submission(scored: DataFrame, key: str, prediction: str = "prediction", name: str = "prediction",
               labels: Sequence[str] | None = None) -> DataFrame:
    """(key, predicted label): index predictions are mapped back to label names."""
    pred = F.col(prediction)
    if labels is not None:
        pred = F.element_at(F.array(*[F.lit(v) for v in labels]), pred.cast("int") + 1)
    return scored.select(key, pred.alias(name))


# FLT1 / FLT3 / FLT4 -----------------------------------------------------------
def fold_split(df: DataFrame, i: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(training part, held-out part) for fold ``i``."""
    return df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)


def split_missing(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows where ``col`` is known, rows where it is NULL)."""
    return df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())


# SET1 / SET2 ------------------------------------------------------------------
def stack(*dfs: DataFrame) -> DataFrame:
    """Row-bind by column name, duplicates kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def stack_tagged(parts: Mapping[str, DataFrame], tag: str = "part",
                 allow_missing: bool = True) -> DataFrame:
    """Union of named frames with a tag column (missing columns become NULL)."""
    out = None
    for name, d in parts.items():
        t = d.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=allow_missing)
    return out


def split_tagged(df: DataFrame, names: Sequence[str], tag: str = "part") -> dict[str, DataFrame]:
    """Inverse of :func:`stack_tagged`: one frame per tag value, tag column dropped."""
    return {n: df.where(F.col(tag) == n).drop(tag) for n in names}
