"""Exact order statistics of many columns by radix selection (AGG7, AGG9, IMP1, bins of the forests).

A double's 64 bits, with the sign bit flipped (all bits for negative numbers), order like the number. The value of a
rank is found digit by digit from the top: one pass counts the rows by the next ``DIGIT`` bits among those whose
higher bits are known, for all columns and ranks together. A pass sends (column, known bits, digit, rows, least,
largest) - partial counts, summed by Spark - and a running sum over the at most 2 ** DIGIT digits of a prefix leaves
one row a rank for the driver. A digit whose least and largest value agree is done, so columns of few values take one
pass; any takes 64 / DIGIT. Nothing is sorted, collected or sampled, and a value that holds a third of all rows is
one count a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_bounded

#: Bits of a digit; counted cells that a task holds before it sends them on.
DIGIT, CELLS = 16, 1 << 20

_SIGN = np.uint64(1 << 63)
_COUNTS = "col int, prefix bigint, digit int, n bigint, least double, largest double"


def order_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys that order like the (finite or infinite) doubles; -0.0 and 0.0 are one value."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _digit_counts(values: np.ndarray, known: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """(place in ``known``, digit, rows, least, largest) of the values whose first ``level`` digits (of ``bits`` bits) are in
    ``known`` (sorted)."""
    keys = order_keys(values)
    if level:
        top = keys >> np.uint64(64 - level * bits)
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        keys = keys[known[at] == top]
    keys = np.sort(keys)
    head = keys >> np.uint64(64 - (level + 1) * bits)
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(keys) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(keys)]])[:len(first)] - 1
    place = np.searchsorted(known, head[first] >> np.uint64(bits)) if level else np.zeros(len(first), np.int64)
    digit = (head[first] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return [place, digit, last - first + 1, _doubles(keys[first]), _doubles(keys[last])]


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _SIGN, keys ^ _SIGN, ~keys).view(np.float64)


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One row a (place, digit)."""
    place, digit, n, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((digit, place))
    place, digit = place[order], digit[order]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (digit[1:] != digit[:-1])])) if len(place) else order
    if not len(first):
        return [place, digit, n, low, high]
    return [place[first], digit[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first),
            np.maximum.reduceat(high[order], first)]


def _pass(df: DataFrame, level: int, known: dict[int, np.ndarray]) -> DataFrame:
    """Counts of the next digit, for the columns (by number) and known prefixes given; ``df`` has double columns."""
    bits, cells = DIGIT, CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {c: [] for c in known}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for c, parts in held.items():
                if parts:
                    place, digit, n, low, high = _merged(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), c, np.int32)), pa.array(known[c].view(np.int64)[place]),
                         pa.array(digit.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(low), pa.array(high)],
                        ["col", "prefix", "digit", "n", "least", "largest"])
                    parts.clear()

        for batch in batches:
            for c, parts in held.items():
                values = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                part = _digit_counts(values[~np.isnan(values)], known[c], level, bits)
                if len(part[0]):
                    parts.append(part)
                    size += len(part[0])
                if len(parts) > 64:
                    before = sum(len(p[0]) for p in parts)
                    parts[:] = [_merged(parts)]
                    size += len(parts[0][0]) - before
            if size > cells:
                yield from flush()
                size = 0
        yield from flush()

    counts = df.mapInArrow(count, _COUNTS)
    return counts.groupBy("col", "prefix", "digit").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def rank_values(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value}: the values at 0-based ranks of the sorted column, NULL and NaN left out.

    A rank the column does not have (negative, or its rows or more) is left out of the result. Columns are read as
    doubles. Passes of the data: 64 / DIGIT at most, for all columns and ranks at once.
    """
    spark, cols = df.sparkSession, [c for c, r in ranks.items() if len(r)]
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    open_ = [(i, 0, int(r), int(r)) for i, c in enumerate(cols) for r in sorted(set(ranks[c])) if r >= 0]  # col, prefix, rank, rank within
    found: dict[tuple[str, int], float] = {}
    for level in range(64 // DIGIT):
        if not open_:
            break
        known = {c: np.array(sorted({p for k, p, _, _ in open_ if k == c}), np.uint64) for c in sorted({t[0] for t in open_})}
        counts = _pass(data, level, known)
        digits = Window.partitionBy("col", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(digits), F.lit(0)))
        wanted = spark.createDataFrame([(c, int(np.uint64(p).view(np.int64)), r, k) for c, p, r, k in open_], "col int, prefix bigint, rank bigint, inside bigint")
        hits = counts.join(F.broadcast(wanted), ["col", "prefix"]).where("inside >= before AND inside < before + n")
        rows = collect_bounded(hits, len(open_), "rank_values")
        open_ = []
        for r in rows:
            if r["least"] == r["largest"] or level == 64 // DIGIT - 1:
                found[(cols[r["col"]], r["rank"])] = r["least"]
            else:
                prefix = (int(np.int64(r["prefix"]).view(np.uint64)) << DIGIT) | r["digit"]
                open_.append((r["col"], prefix, r["rank"], r["inside"] - r["before"]))
    return found
