"""Minimum-norm least squares by a tall, skinny QR (MDL9).

All-level dummies beside an intercept are rank deficient: the normal equations have no unique solution, and squaring the
condition number loses half the digits. Here each task reduces its rows, block by block, to the triangular factor of
the matrix (predictors, label); factors are merged in a tree (a factor of stacked factors is the factor of all rows), so
only one small square matrix reaches the driver. Its singular values give the rank, and the coefficients are the
solution of the smallest norm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import fit_levels

#: Rows of a block.
BLOCK = 4096
#: Columns of the design matrix at most: a factor has the square of it.
MAX_TERMS = 4000
#: Singular values below this share of the largest count as zero.
RCOND = 1e-10


@dataclass
class LeastSquares:
    """Terms with their coefficients ("(intercept)" first, then numeric, then ``column=level``)."""

    numeric: list[str]
    levels: dict[str, list[str]]
    coefficients: np.ndarray
    rank: int
    rows: int
    r2: float
    mean: float

    def terms(self) -> list[str]:
        return ["(intercept)", *self.numeric, *[f"{c}={v}" for c, vs in self.levels.items() for v in vs]]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the fitted value; NULL where a numeric predictor is NULL or NaN; a NULL or unseen level adds nothing."""
        value = F.lit(float(self.coefficients[0]))
        for c, b in zip(self.numeric, self.coefficients[1:]):
            value = value + F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) * F.lit(float(b))
        at = 1 + len(self.numeric)
        for c, vs in self.levels.items():
            if vs:
                pairs = [F.lit(x) for v, b in zip(vs, self.coefficients[at:at + len(vs)]) for x in (v, float(b))]
                value = value + F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(f"`{c}`").cast("string")), F.lit(0.0))
            at += len(vs)
        return df.withColumn(out, value)


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _packed(r: np.ndarray, width: int) -> bytes:
    full = np.zeros((width, width))
    full[:len(r)] = r
    return full.tobytes()


def triangular_factor(df: DataFrame, label: str, numeric: Sequence[str], levels: dict[str, list[str]]) -> np.ndarray:
    """The triangular factor of (1, numeric, dummies, label) over all complete rows, merged in a tree."""
    numeric = list(numeric)
    known = [pa.array(v, pa.string()) for v in levels.values()]
    width = 2 + len(numeric) + sum(map(len, known))
    if width > MAX_TERMS:
        raise ValueError(f"{width} columns: the design matrix may have {MAX_TERMS}")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r = np.zeros((0, width))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = np.zeros((part.num_rows, width))
                x[:, 0] = 1
                for i in range(len(numeric) + 1):
                    x[:, i + 1 if i < len(numeric) else -1] = part.column(i).fill_null(float("nan")).to_numpy(zero_copy_only=False)
                at = 1 + len(numeric)
                for i, v in enumerate(known):
                    hit = pc.index_in(part.column(len(numeric) + 1 + i), v).fill_null(-1).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(hit >= 0)
                    x[rows, at + hit[rows]] = 1
                    at += len(v)
                x = x[~np.isnan(x).any(axis=1)]
                if len(x):
                    r = _factor(np.vstack([r, x]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(r, width)], pa.binary())], ["task", "r"])

    def merge(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, task = np.zeros((0, width)), None
        for batch in group:
            for t, raw in zip(batch.column("task").to_pylist(), batch.column("r").to_pylist()):
                task = t if task is None else min(t, task)
                r = _factor(np.vstack([r, np.frombuffer(raw).reshape(width, width)]))
        if task is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([_packed(r, width)], pa.binary())], ["task", "r"])

    cols = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*numeric, label])]
    cols += [F.col(f"`{c}`").cast("string").alias(f"s{i}") for i, c in enumerate(levels)]
    factors = df.select(*cols).mapInArrow(reduce, "task bigint, r binary")
    first = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    for fan in (first, max(1, round(first ** 0.5))):
        factors = factors.repartition(fan, F.col("task") % fan).mapInArrow(merge, "task bigint, r binary")
    r = np.zeros((0, width))
    for row in sorted(factors.collect(), key=lambda x: x["task"]):  # as many rows as the last step has tasks
        r = _factor(np.vstack([r, np.frombuffer(row["r"]).reshape(width, width)]))
    return r if len(r) == width else np.vstack([r, np.zeros((width - len(r), width))])


def least_squares(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), rcond: float = RCOND) -> LeastSquares:
    """Least squares of ``label`` on an intercept, numeric predictors and a dummy for every level of every category.

    Rows with a NULL or NaN label or numeric predictor are left out; a NULL level has no dummy. Columns are scaled to
    norm 1 for the rank decision and the solution is of minimum norm in the scaled terms, so that it does not depend on
    units. Without complete rows all coefficients are 0.
    """
    levels = fit_levels(df, list(categorical)) if categorical else {}
    r = triangular_factor(df, label, numeric, levels)
    a, b = r[:-1, :-1], r[:-1, -1]
    scale = np.sqrt((a * a).sum(axis=0))
    scale[scale == 0] = 1
    u, s, vt = np.linalg.svd(a / scale)
    keep = s > rcond * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    beta = (vt[keep].T @ ((u[:, keep].T @ b) / s[keep])) / scale
    n = int(round(float((a[:, 0] ** 2).sum())))
    mean = float(a[:, 0] @ b) / n if n else 0.0
    total = float((r[:, -1] ** 2).sum()) - n * mean * mean
    residual = float(((a @ beta - b) ** 2).sum() + r[-1, -1] ** 2)
    return LeastSquares(list(numeric), levels, beta, int(keep.sum()), n, 1 - residual / total if total > 0 else float("nan"), mean)


def coefficients(model: LeastSquares, spark) -> DataFrame:
    """(term, estimate) of every term."""
    return spark.createDataFrame([(t, float(v)) for t, v in zip(model.terms(), model.coefficients)], "term string, estimate double")
