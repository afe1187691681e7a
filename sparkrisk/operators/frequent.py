"""Frequent values of many columns by mergeable counters and one exact count (AGG14).

One pass keeps, for each column, at most ``k`` counters a task (a value's counter never exceeds its rows, and misses at
most rows / (k + 1) of them); the counters of all tasks are added up by Spark. Every value whose share exceeds the
threshold keeps a counter above a known bound, so what is above the bound are candidates: at most 2 / threshold a
column. A second pass counts the candidates exactly. Columns stay as they are, in their own types: nothing is turned
into rows of text, and distinct values are never all counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded

#: Columns at most; the driver sees 2 / threshold rows for each.
MAX_COLUMNS = 10_000


def shrink(counters: dict, k: int) -> int:
    """Cuts the counters to ``k`` by taking the (k + 1)-th largest off all; returns what was taken off."""
    if len(counters) <= k:
        return 0
    off = sorted(counters.values(), reverse=True)[k]
    for v in [v for v, n in counters.items() if n <= off]:
        del counters[v]
    for v in counters:
        counters[v] -= off
    return off


def _value_counts(column: pa.Array) -> tuple[list[str], list[int]]:
    """Distinct values as text, with their rows; NULL and NaN left out. The text names one value of the type."""
    column = column.drop_null()
    if pa.types.is_floating(column.type):
        column = pc.add(column.filter(pc.invert(pc.is_nan(column))), pa.scalar(0.0, column.type))  # -0.0 is 0.0
    counts = column.value_counts()
    return counts.field("values").cast(pa.string()).to_pylist(), counts.field("counts").to_pylist()


def _passable(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns under plain names; types that have no text in Arrow are read as Spark's text."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean", "date", "timestamp", "timestamp_ntz")
    kinds = dict(df.dtypes)
    return df.select(*[(F.col(f"`{c}`") if kinds[c] in plain else F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(cols)])


def frequent_values(df: DataFrame, cols: Sequence[str] | None = None, min_share: float = 0.05) -> DataFrame:
    """(column, value, n, n_rows, share): every value that more than ``min_share`` of all rows hold, counted exactly.

    ``value`` is the value as Spark's text of it; NULL and NaN are no values, but their rows count in ``n_rows``. The
    columns' order, names that clash and empty tables make no difference; a column without a frequent value has no row.
    """
    if not 0 < min_share <= 1:
        raise ValueError(f"min_share {min_share}: over 0 and at most 1")
    cols = list(df.columns if cols is None else cols)
    if len(cols) > MAX_COLUMNS:
        raise ValueError(f"{len(cols)} columns: at most {MAX_COLUMNS}")
    spark, k = df.sparkSession, math.ceil(2 / min_share)
    data = _passable(df, cols)
    schema = "col int, value string, n bigint"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [{} for _ in cols], 0
        for batch in batches:
            rows += batch.num_rows
            for counters, column in zip(held, batch.columns):
                for v, n in zip(*_value_counts(column)):
                    counters[v] = counters.get(v, 0) + n
                if len(counters) > 4 * k:
                    shrink(counters, k)
        for counters in held:
            shrink(counters, k)
        yield _rows([(i, v, n) for i, counters in enumerate(held) for v, n in counters.items()] + [(-1, None, rows)])

    summed = data.mapInArrow(sketch, schema).groupBy("col", "value").agg(F.sum("n").alias("n")).persist()
    try:
        total = summed.where("col = -1").agg(F.sum("n")).first()[0] or 0
        # a counter misses at most rows / (k + 1) in each task, together at most total / (k + 1)
        bound = total * (min_share - 1 / (k + 1))
        found = collect_bounded(summed.where((F.col("col") >= 0) & (F.col("n") >= bound)), (2 * k + 2) * len(cols), "frequent_values")
    finally:
        summed.unpersist()
    wanted: dict[int, list[str]] = {}
    for r in found:
        wanted.setdefault(r["col"], []).append(r["value"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: dict.fromkeys(vs, 0) for i, vs in wanted.items()}
        for batch in batches:
            for i, counters in held.items():
                for v, n in zip(*_value_counts(batch.column(i))):
                    if v in counters:
                        counters[v] += n
        yield _rows([(i, v, n) for i, counters in held.items() for v, n in counters.items()])

    counts = data.mapInArrow(exact, schema).groupBy("col", "value").agg(F.sum("n").alias("n")).where(F.col("n") > total * min_share) if wanted else None
    rows = collect_bounded(counts, (2 * k + 2) * len(cols), "frequent_values") if counts is not None else []
    text = _spark_text(spark, data, [(r["col"], r["value"]) for r in rows])
    out = [(cols[r["col"]], text[r["col"], r["value"]], r["n"], total, r["n"] / total) for r in rows]
    return spark.createDataFrame(out, "column string, value string, n bigint, n_rows bigint, share double")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()))], ["col", "value", "n"])


def _spark_text(spark, data: DataFrame, values: list[tuple[int, str]]) -> dict[tuple[int, str], str]:
    """Arrow's text of a value of a column -> Spark's text of it (they differ for some doubles and timestamps)."""
    kinds = dict(data.dtypes)
    out = {(c, v): v for c, v in values}
    some = [(c, v) for c, v in values if kinds[f"c{c}"] in ("float", "double", "timestamp", "timestamp_ntz", "boolean", "date")]
    for start in range(0, len(some), 500):
        part = some[start:start + 500]
        cells = F.array(*[F.lit(v).cast(kinds[f"c{c}"]).cast("string") for c, v in part])
        for (c, v), text in zip(part, spark.range(1).select(cells.alias("t")).first()["t"]):
            out[c, v] = text
    return out


def top_values(df: DataFrame, cols: Sequence[str] | None = None, max_top_share: float = 0.99) -> DataFrame:
    """(column, top_value, top_n, n_rows, top_share, near_constant): near-constant columns without counting all values.

    Columns whose most frequent value has at most half of ``max_top_share`` of the rows come without it (NULL, 0 rows).
    """
    cols = list(df.columns if cols is None else cols)
    found = frequent_values(df, cols, max_top_share / 2)
    best = found.groupBy("column").agg(F.max_by("value", F.col("n")).alias("top_value"), F.max("n").alias("top_n"))
    rows = df.count()
    names = df.sparkSession.createDataFrame([(c, rows) for c in cols], "column string, n_rows bigint")
    out = names.join(F.broadcast(best), "column", "left")
    n = F.coalesce("top_n", F.lit(0)).cast("bigint")
    share = F.try_divide(n.cast("double"), F.col("n_rows"))
    return out.select("column", "top_value", n.alias("top_n"), "n_rows", share.alias("top_share"), (share >= max_top_share).alias("near_constant"))
