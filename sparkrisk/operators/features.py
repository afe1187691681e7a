"""Encoding and scaling (FE1-FE3, FE6, DOR2).

Fitting is one aggregate (or one distinct per categorical column, bounded by
the level count); applying is a projection that fuses into the scan stage.
Fit on the training part and apply to both parts - or fit on all rows
(``fit_scope='all'``) to reproduce fitting before the split.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded

MAX_LEVELS = 10_000


# FE2 --------------------------------------------------------------------------
def fit_levels(dfs: Sequence[DataFrame] | DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted non-NULL levels per column over one or more frames (joint encoding).

    One unpivot + distinct over all columns; at most MAX_LEVELS per column reach
    the driver.
    """
    if isinstance(dfs, DataFrame):
        dfs = [dfs]
    parts = None
    for d in dfs:
        long = (d.select(*[F.col(c).cast("string").alias(c) for c in cols])
                 .unpivot([], list(cols), "column", "value"))
        parts = long if parts is None else parts.unionByName(long)
    levels = parts.where(F.col("value").isNotNull()).distinct()
    rows = collect_bounded(levels, MAX_LEVELS * max(1, len(cols)), "fit_levels")
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def _dummy_name(col: str, value) -> str:
    return f"{col}_{re.sub(r'[^0-9A-Za-z_]', '_', str(value))}"


# FE1 --------------------------------------------------------------------------
def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence] | None = None,
            drop_original: bool = True) -> DataFrame:
    """Wide one-hot: an int column ``col_value`` per level, every level kept.

    NULL (or a value outside ``levels``) gives zeros in every dummy column.
    """
    levels = dict(levels) if levels is not None else fit_levels(df, cols)
    kept = [x for x in df.columns if not (drop_original and x in cols)]
    exprs, taken = [], {x.lower() for x in kept}
    for c in cols:
        for v in levels[c]:
            name, k = _dummy_name(c, v), 1
            while name.lower() in taken:       # levels that differ in signs only, or a column of that name
                k += 1
                name = f"{_dummy_name(c, v)}_{k}"
            taken.add(name.lower())
            exprs.append(F.when(F.col(c).cast("string") == F.lit(str(v)), 1).otherwise(0).alias(name))
    return df.select(*kept, *exprs)


# FE3 / AGG10 / DOR2 ----------------------------------------------------------
def fit_standardize(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{col: (mean, population std)}; one aggregate, one row to the driver."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_standardize(df: DataFrame, params: Mapping[str, tuple[float, float]],
                      with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """(x - mean) / std; a zero-variance column is divided by 1."""
    exprs = {}
    for c, (mean, std) in params.items():
        e = F.col(c).cast("double")
        if with_mean:
            e = e - F.lit(mean if mean is not None else 0.0)
        if with_std:
            e = e / F.lit(std if std else 1.0)
        exprs[c] = e
    return df.withColumns(exprs)


def standardize(df: DataFrame, cols: Sequence[str], with_mean: bool = True,
                with_std: bool = True) -> DataFrame:
    """Population z-score: fit (one aggregate, one row back) then apply (literals)."""
    return apply_standardize(df, fit_standardize(df, cols), with_mean, with_std)


# FE6 --------------------------------------------------------------------------
def gappy_columns(df: DataFrame, numeric: Sequence[str]) -> list[str]:
    """Numeric columns with a NULL or NaN; one aggregate pass, one row to the driver."""
    if not numeric:
        return []
    row = df.agg(*[F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(f"g{i}")
                   for i, c in enumerate(numeric)]).first()
    return [c for i, c in enumerate(numeric) if row[f"g{i}"]]


def assembler_pipeline(numeric: Sequence[str], categorical: Sequence[str], out: str = "features",
                       one_hot_encode: bool = True, gappy: Sequence[str] = ()) -> Pipeline:
    """StringIndexer (unseen -> extra index) [+ OneHotEncoder] + VectorAssembler.

    Trees take ``one_hot_encode=False``: indexed columns keep nominal metadata,
    so splits treat them as categories. ``gappy`` numeric columns (see
    :func:`gappy_columns`) enter as a filled value and a missing indicator,
    since no MLlib fit takes NaN.
    """
    stages = []
    fills = {c: (f"{c}__filled", f"{c}__missing") for c in gappy if c in numeric}
    if fills:
        made = ", ".join(f"coalesce(nanvl(double(`{c}`), NULL), 0D) AS `{v}`, "
                         f"double(`{c}` IS NULL OR isnan(double(`{c}`))) AS `{m}`" for c, (v, m) in fills.items())
        stages.append(SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"))
    idx = [f"{c}__idx" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
    inputs = [x for c in numeric for x in fills.get(c, (c,))]
    if categorical and one_hot_encode:
        oh = [f"{c}__oh" for c in categorical]
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=False, handleInvalid="keep"))
        inputs += oh
    elif categorical:
        inputs += idx
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def encoder_levels(model) -> list[int]:
    """Levels of every string-indexed column inside a (nested) fitted pipeline."""
    out = []
    for stage in getattr(model, "stages", []):
        out += [len(v) for v in stage.labelsArray] if isinstance(stage, StringIndexerModel) else encoder_levels(stage)
    return out


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Slot names of an assembled vector column (from its ML attribute metadata)."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    slots = []
    for group in attrs.values():
        slots += [(a["idx"], a.get("name", str(a["idx"]))) for a in group]
    if not slots:
        return [str(i) for i in range(meta.get("num_attrs", 0))]
    return [n for _, n in sorted(slots)]
