"""Entropy cuts of numbers by minimum description length (MDL13).

A feature's values are counted by class, ordered across tasks, and given the class counts of all smaller values. With
these prefix counts every cut point of every open interval of every feature is judged in one aggregate a level; the
driver sees the best cut of each interval, keeps it if it pays for its own description, and opens the two parts. Intervals
of few distinct values are cut to the end at once, one group each, so passes do not grow with the depth of the cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_bounded, cut_lineage

#: Classes, and intervals of a feature, at most.
MAX_CLASSES, MAX_INTERVALS = 100, 1_000_000
#: Distinct values up to which one task cuts an interval to the end.
FEW = 50_000


def _bits(counts: Sequence[float]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def pays(whole: Sequence[int], left: Sequence[int]) -> bool:
    """Does a cut save more bits of class labels than it takes to tell (Fayyad and Irani's criterion)?"""
    right = [a - b for a, b in zip(whole, left)]
    n, parts = sum(whole), (left, right)
    if n < 2 or not sum(left) or not sum(right):
        return False
    gain = _bits(whole) - sum(sum(p) / n * _bits(p) for p in parts)
    k, *ks = (sum(1 for c in p if c) for p in (whole, *parts))
    delta = math.log2(3 ** k - 2) - (k * _bits(whole) - sum(j * _bits(p) for j, p in zip(ks, parts)))
    return gain > (math.log2(n - 1) + delta) / n


def classes_of(df: DataFrame, label: str) -> list:
    """The label's classes in order."""
    return [r[0] for r in collect_bounded(df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label), MAX_CLASSES, "classes")]


def prefix_counts(df: DataFrame, label: str, numeric: Sequence[str], classes: Sequence) -> DataFrame:
    """(feature, value, c0, c1 ...: rows of each class up to and with the value, values: distinct ones up to and with it).

    NULL and NaN values and NULL labels are left out; -0.0 is 0.0. Written once; one shuffle of the distinct values by
    range, so no task orders more than a partition of them.
    """
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) + F.lit(0.0)
    long = (df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), *[number(c).alias(f"x{i}") for i, c in enumerate(numeric)])
            .unpivot("y", [f"x{i}" for i in range(len(numeric))], "feature", "value").where(F.col("value").isNotNull()))
    names = [f"c{i}" for i in range(len(classes))]
    counts = long.groupBy("feature", "value").agg(*[F.count_if(F.col("y") == F.lit(c)).alias(n) for n, c in zip(names, classes)])
    counts, names = counts.withColumn("values", F.lit(1).cast("bigint")), [*names, "values"]
    ordered = cut_lineage(counts.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("feature", "part").agg(*[F.sum(n).alias(n) for n in names])  # a row a feature and partition
    parts = parts.select("feature", "part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o{n}") for n in names])
    upto = Window.partitionBy("feature", "part").orderBy("value")
    sums = (ordered.select("feature", "part", "value", *[F.sum(n).over(upto).alias(n) for n in names]).join(F.broadcast(parts), ["feature", "part"])
            .select("feature", "value", *[(F.col(n) + F.col(f"o{n}")).alias(n) for n in names]))
    return cut_lineage(sums)


def _entropy(counts: list[Column]) -> Column:
    n = sum(counts, F.lit(0.0))
    return -sum((F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))


def _interval(intervals: list[tuple]):
    """The number of the interval that holds a feature's value, if one does; the intervals of a feature do not overlap."""
    ends: dict[str, list] = {}
    for i, (f, lo, hi, *_) in enumerate(intervals):
        ends.setdefault(f, []).append((-np.inf if lo is None else lo, np.inf if hi is None else hi, i, lo is None))
    sides = {f: tuple(np.array(x) for x in zip(*sorted(v))) for f, v in ends.items()}

    @F.arrow_udf("int")
    def of(features: pa.Array, values: pa.Array) -> pa.Array:
        x, names = values.to_numpy(zero_copy_only=False), features.dictionary_encode()
        code, out = names.indices.to_numpy(zero_copy_only=False), np.full(len(x), -1)
        for j, name in enumerate(names.dictionary.to_pylist()):
            if name not in sides:
                continue
            low, high, number, first = sides[name]
            rows = np.flatnonzero(code == j)
            v = x[rows]
            at = np.maximum(np.searchsorted(low, v, side="left") - 1, 0)  # the last one that starts under the value
            inside = ((v > low[at]) | first[at]) & (v <= high[at])
            out[rows] = np.where(inside, number[at], -1)
        return pa.array(out, pa.int32(), mask=out < 0)

    return of


def best_cuts(prefix: DataFrame, intervals: list[tuple], k: int) -> dict[int, tuple[float, float, list[int], int]]:
    """{interval: (cut, gain in bits, class counts in it up to the cut, ``values`` at the cut)} over all cut points; ties go to
    the smallest cut.

    An interval is (feature, low, high, counts up to low, counts inside): its values are over ``low`` and up to ``high``
    (None: without end).
    """
    spark = prefix.sparkSession
    rows = [(i, f, lo, hi, *base, *inside) for i, (f, lo, hi, base, inside, *_) in enumerate(intervals)]
    kinds = ", ".join([f"b{j} bigint" for j in range(k)] + [f"t{j} bigint" for j in range(k)])
    table = spark.createDataFrame(rows, f"interval int, feature string, low double, high double, {kinds}")
    # a row's interval is looked up, not tried: the rows of a pass do not grow with the intervals of a feature
    at = prefix.select("*", _interval(intervals)("feature", "value").alias("interval")).where("interval IS NOT NULL")
    at = at.join(F.broadcast(table.drop("feature")), "interval")
    left = [(F.col(f"c{j}") - F.col(f"b{j}")).cast("double") for j in range(k)]
    right = [F.col(f"t{j}").cast("double") - x for j, x in enumerate(left)]
    whole = [F.col(f"t{j}").cast("double") for j in range(k)]
    nl, nr = sum(left, F.lit(0.0)), sum(right, F.lit(0.0))
    gain = _entropy(whole) - (nl * _entropy(left) + nr * _entropy(right)) / (nl + nr)
    judged = at.where(nr > 0).select("interval", "value", "values", gain.alias("gain"), F.array(*[x.cast("bigint") for x in left]).alias("left"))
    best = judged.groupBy("interval").agg(F.max(F.struct("gain", (-F.col("value")).alias("minus"), "left", "values")).alias("m"))
    return {r["interval"]: (-r["m"]["minus"], r["m"]["gain"], list(r["m"]["left"]), r["m"]["values"]) for r in best.collect()}  # a row an interval


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Bits of each row of class counts."""
    n = counts.sum(axis=1)
    out = np.zeros(len(counts))
    for c in counts.T:
        p = np.where(c > 0, c, n) / np.maximum(n, 1)
        out -= p * (np.log(np.where(p > 0, p, 1.0)) / math.log(2)) * (c > 0)
    return out


def cuts_within(values: np.ndarray, counts: np.ndarray) -> list[float]:
    """All cuts that pay, of ascending values with their class counts (a row each)."""
    cuts, open_ = [], [(0, len(values))]
    upto = np.vstack([np.zeros((1, counts.shape[1]), np.int64), counts.cumsum(axis=0)])
    while open_:
        a, b = open_.pop()
        left = upto[a + 1:b] - upto[a]  # up to each value but the last
        if not len(left):
            continue
        whole = upto[b] - upto[a]
        right = whole - left
        nl, nr = left.sum(axis=1), right.sum(axis=1)
        gain = _entropies(whole[None, :].astype(float)) - (nl * _entropies(left.astype(float)) + nr * _entropies(right.astype(float))) / (nl + nr)
        best = int(gain.argmax())
        if pays(whole.tolist(), left[best].tolist()):
            cuts.append(float(values[a + best]))
            open_ += [(a, a + best + 1), (a + best + 1, b)]
    return cuts


def _cut_to_the_end(prefix: DataFrame, intervals: list[tuple], k: int) -> list[tuple[int, float]]:
    """(interval, cut) of all cuts inside the intervals, a group of at most FEW values each."""
    bases = {i: np.array(t[3], np.int64) for i, t in enumerate(intervals)}

    def cut(group: pa.Table) -> pa.Table:
        i = group.column("interval")[0].as_py()
        group = group.sort_by("value")
        upto = np.column_stack([group.column(f"c{j}").to_numpy() for j in range(k)])
        cuts = cuts_within(group.column("value").to_numpy(), np.diff(upto, axis=0, prepend=bases[i][None, :]))
        return pa.table({"interval": pa.array([i] * len(cuts), pa.int32()), "cut": pa.array(cuts, pa.float64())})

    at = prefix.select("value", *[f"c{j}" for j in range(k)], _interval(intervals)("feature", "value").alias("interval"))
    return [tuple(r) for r in at.where("interval IS NOT NULL").groupBy("interval").applyInArrow(cut, "interval int, cut double").collect()]


def entropy_cuts(df: DataFrame, label: str, numeric: Sequence[str]) -> dict[str, list[float]]:
    """{feature: ascending cuts}: a value belongs to the bin of the number of cuts below it.

    The best cut of an interval is kept, and both parts are cut on, while it pays (see :func:`pays`). A feature that says
    nothing of the label has no cut. At most MAX_INTERVALS intervals a feature (an error beyond).
    """
    numeric = list(numeric)
    cuts: dict[str, list[float]] = {c: [] for c in numeric}
    classes = classes_of(df, label)
    k = len(classes)
    if k < 2 or not numeric:
        return cuts
    prefix = prefix_counts(df, label, numeric, classes)
    ends = prefix.groupBy("feature").agg(*[F.max(c).alias(c) for c in [*[f"c{j}" for j in range(k)], "values"]]).collect()
    # (feature, low, high, class counts up to low, class counts inside, distinct values up to low, and inside)
    open_ = [(r["feature"], None, None, [0] * k, [r[f"c{j}"] for j in range(k)], 0, r["values"]) for r in ends]
    few: list[tuple] = []

    def keep(feature: str, cut: float) -> None:
        mine = cuts[numeric[int(feature[1:])]]
        mine.append(cut)
        if len(mine) >= MAX_INTERVALS:
            raise ValueError(f"{numeric[int(feature[1:])]}: {MAX_INTERVALS} intervals or more")

    while True:
        few += [t for t in open_ if t[6] <= FEW]
        open_ = [t for t in open_ if t[6] > FEW]
        if not open_:
            break
        found = best_cuts(prefix, open_, k)
        nxt = []
        for i, (f, lo, hi, base, inside, low_values, n_values) in enumerate(open_):
            if i not in found or not pays(inside, found[i][2]):
                continue
            cut, _, left, values = found[i]
            keep(f, cut)
            nxt.append((f, lo, cut, base, left, low_values, values - low_values))
            nxt.append((f, cut, hi, [a + b for a, b in zip(base, left)], [a - b for a, b in zip(inside, left)], values, low_values + n_values - values))
        open_ = nxt
    for i, cut in _cut_to_the_end(prefix, few, k) if few else ():
        keep(few[i][0], cut)
    return {c: sorted(v) for c, v in cuts.items()}


def _bin(points: list[float]):
    """1 and the number of cuts below a value, however many there are."""
    edges = np.array(points, np.float64)

    @F.arrow_udf("int")
    def of(values: pa.Array) -> pa.Array:
        x = values.fill_null(0.0).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, x, side="left") + 1, pa.int32(), mask=values.is_null().to_numpy(zero_copy_only=False))

    return of


def entropy_bins(df: DataFrame, label: str, numeric: Sequence[str]) -> DataFrame:
    """``df`` with each numeric column replaced by its bin (from 1; NULL and NaN stay NULL)."""
    cuts = entropy_cuts(df, label, numeric)
    out = {c: _bin(points)(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))) for c, points in cuts.items()}
    return df.withColumns(out)
