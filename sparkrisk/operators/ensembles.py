"""Cross-validation, feature drop and tuning of forests in one growth (MDL1, MDL4, MDL11, MDL12, DOR4).

Every function here makes one binned table and one list of models (see :mod:`.forest`): all folds, settings or
left-out features grow level by level in the same passes, and one scoring pass counts the confusion of all of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rank import hash_of
from ..session import collect_bounded, cut_lineage
from . import cells as C
from . import forest as H
from . import kernel_svm as K
from .radix import rank_values

#: Hex digits of the row hash by which down-samples are cut: 52 bits, exact as a double.
HASH_DIGITS = 13
#: Of these, the first by which rows are counted to find where the cuts are, and (class, fold, digits) counted at most.
FIRST_DIGITS, FIRST_COUNTS = 3, 1_000_000


# SMP5 inside folds ------------------------------------------------------------
#: A fold that no row is in: all rows train.
NO_FOLD = 0


def fold_members(df: DataFrame, label: str, key: str | Sequence[str], folds: Sequence[int], seed: int = 42, fold_col: str = "fold") -> Column:
    """A bit for each of ``folds``, in their order: does its down-sampled training part hold the row?

    The rows are those of ``down_sample`` on the rows outside the fold: of each class the first m in seeded order, m
    the size of the smallest class. One pass counts rows by the first digits of the hash (52 bits), which tells between
    which digits each cut falls; the rows of these digits are written down, and one radix selection over them finds the
    cuts (rows equal in the 52 bits at a cut all stay). Membership is an expression: no row is ranked or moved.
    """
    if len(folds) > H.MAX_MODELS:
        raise ValueError(f"{len(folds)} folds: at most {H.MAX_MODELS}")
    keys = [key] if isinstance(key, str) else list(key)
    h = hash_of(df, seed, *keys)
    at = F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("double")
    labelled = df.where(F.col(label).isNotNull())
    of = labelled.select(label, fold_col).distinct().limit(FIRST_COUNTS).count() * 16 ** FIRST_DIGITS
    digits = F.substring(h, 1, FIRST_DIGITS) if of <= FIRST_COUNTS else F.lit("")  # many folds or classes: all rows are selected from
    rows = collect_bounded(labelled.groupBy(label, fold_col, digits.alias("_d")).agg(F.count("*").alias("n")), FIRST_COUNTS, "fold_members")
    classes = sorted({r[label] for r in rows}, key=str)
    told: dict = {}
    for r in rows:
        told.setdefault((r[label], r[fold_col]), {})[r["_d"]] = r["n"]
    cols, ranks, some = {}, {}, set()
    for i, f in enumerate(folds):
        by_class: list[dict] = [{} for _ in classes]
        for (c, g), counts in told.items():
            if g != f:
                mine = by_class[classes.index(c)]
                for k, n in counts.items():
                    mine[k] = mine.get(k, 0) + n
        train = [sum(x.values()) for x in by_class]
        least = min((n for n in train if n), default=0)
        for j, (c, n) in enumerate(zip(classes, train)):
            if n > least:
                before = 0
                for k in sorted(by_class[j]):
                    if before + by_class[j][k] >= least:
                        break
                    before += by_class[j][k]
                cols[f"f{i}_c{j}"] = F.when((F.col("_l") == F.lit(c)) & (F.col("_f") != f) & (F.col("_d") == k), F.col("_at"))
                ranks[f"f{i}_c{j}"] = [least - 1 - before]
                some.add(k)
    found = {}
    if cols:
        near = labelled.select(F.col(label).alias("_l"), F.col(fold_col).alias("_f"), digits.alias("_d"), at.alias("_at"))
        if "" not in some:
            near = cut_lineage(near.where(F.col("_d").isin(*some)))
        found = rank_values(near.select(*[v.alias(n) for n, v in cols.items()]), ranks)
    cuts = {name: value for (name, _), value in found.items()}
    bits = F.lit(0).cast("bigint")
    for i, f in enumerate(folds):
        inside = F.lit(False)
        for j, c in enumerate(classes):
            of = F.col(label) == F.lit(c)
            inside = inside | (of & (at <= F.lit(cuts[f"f{i}_c{j}"])) if f"f{i}_c{j}" in cuts else of)
        bits = bits + F.when(F.coalesce(inside & (F.col(fold_col) != f), F.lit(False)), F.lit(1 << i)).otherwise(0).cast("bigint")
    return bits


# MDL11 / DOR4 -----------------------------------------------------------------
def _bags(specs: Sequence[H.Spec]):
    """The measures that the trees of ``specs`` need of a table's cells."""
    return lambda cells: [C.tree_measure(cells, s, t) for s in specs for t in range(s.trees)]


def grown_counts(table: DataFrame, bins: H.Bins, specs: Sequence[H.Spec], part: Mapping[str, str], keep: Sequence[str], max_depth: int,
                 class_weights: Mapping | None = None) -> DataFrame:
    """Confusion of all ``specs``, grown over the table's cells where these are few, else over its rows; equal counts."""
    cells = C.fold_rows(table, bins, _bags(specs), keep)
    if cells is None:
        table = cut_lineage(H.deal(table, bins.rows))
        return H.confusion(table, H.grow(table, bins, specs, max_depth, class_weights=class_weights), part)
    return C.confusion(cells, C.grow(cells, specs, max_depth, class_weights=class_weights), part)


def cross_validate_forests(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                           k: int = 5, mtry: Sequence[int] = (0,), trees: int = 50, max_depth: int = 10, max_bins: int = 64,
                           class_weights: Mapping | None = None, down_sampled: bool = True, seed: int = 42,
                           fold_col: str = "fold", bins: H.Bins | None = None) -> DataFrame:
    """(mtry, fold, part, truth, prediction, n) of a forest a fold and ``mtry``, all grown together.

    Training rows are those outside the fold (down-sampled if asked); ``part`` is "train" for these and "held_out" for the
    fold. Cuts, levels and classes come from all rows (or are ``bins``, of the same rows); a forest sees only its training
    rows' labels.
    """
    if k * len(mtry) > 10_000:
        raise ValueError(f"{k} folds x {len(mtry)} settings: too many models")
    bins = bins or H.fit_bins(df, label, numeric, categorical, max_bins)
    if down_sampled:
        member = fold_members(df, label, key, range(1, k + 1), seed, fold_col)
    else:
        member = sum((F.when(F.col(fold_col) != f, F.lit(1 << (f - 1))).otherwise(0) for f in range(1, k + 1)), F.lit(0))
    table = H.bin_table(df, bins, key, seed, [F.col(fold_col).alias("_fold")], member, even=H.narrow(df))
    specs = [H.Spec(f"{m}/{f}", f - 1, None, m, trees, seed) for m in mtry for f in range(1, k + 1)]
    part = {s.name: f"CASE WHEN _fold = {s.bit + 1} THEN 'held_out' WHEN (_member & {1 << s.bit}L) <> 0 THEN 'train' END" for s in specs}
    counts = grown_counts(table, bins, specs, part, ["_fold"], max_depth, class_weights)
    names = F.split("model", "/")
    return counts.select(names[0].cast("int").alias("mtry"), names[1].cast("int").alias("fold"), "part", "truth", "prediction", "n")


def final_forest(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (), mtry: int = 0,
                 trees: int = 50, max_depth: int = 10, max_bins: int = 64, class_weights: Mapping | None = None, seed: int = 42
                 ) -> tuple[DataFrame, H.Forest]:
    """(binned table, forest) of one forest on all labelled rows of ``df``."""
    bins = H.fit_bins(df, label, numeric, categorical, max_bins)
    table = H.bin_table(df, bins, key, seed)
    return table, H.grow(table, bins, [H.Spec("forest", 0, None, mtry, trees, seed)], max_depth, class_weights=class_weights)


# MDL7 -------------------------------------------------------------------------
def cross_validate_machines(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                            k: int = 5, degree: int = 3, dims: int = 0, cost: float = 1.0, class_weights: Mapping | None = None,
                            seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """(model, part, truth, prediction, n) of a polynomial machine a fold ("fold 1" ...), trained on the down-sampled rows
    outside it, and of one on all down-sampled rows ("final"), fitted together. The scaling is that of all rows."""
    scaled = K.fit_scaled(df, label, numeric, categorical)
    member = fold_members(df, label, key, [*range(1, k + 1), NO_FOLD], seed, fold_col)
    table = K.scale_table(df, scaled, [F.col(fold_col).alias("_fold")], member)
    specs = [K.Machine(f"fold {f}", f - 1) for f in range(1, k + 1)] + [K.Machine("final", k)]
    fitted = K.fit_machines(table, scaled, specs, degree, dims, cost, class_weights, seed=seed)
    part = {s.name: f"CASE WHEN _fold = {s.bit + 1} THEN 'held_out' WHEN (_member & {1 << s.bit}L) <> 0 THEN 'train' END" for s in specs}
    return K.confusion(table, fitted, part)


# MDL12 ------------------------------------------------------------------------
def leave_one_out_forests(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                          split_col: str = "split", mtry: int = 0, trees: int = 50, max_depth: int = 10, max_bins: int = 64,
                          class_weights: Mapping | None = None, seed: int = 42, bins: H.Bins | None = None) -> DataFrame:
    """(dropped, part, truth, prediction, n): a forest without each feature in turn, trained on the rows whose
    ``split_col`` is "train", all grown together."""
    bins = bins or H.fit_bins(df, label, numeric, categorical, max_bins)
    table = H.bin_table(df, bins, key, seed, [F.col(split_col).alias("_split")], (F.col(split_col) == "train").cast("bigint"), even=H.narrow(df))
    names = [*numeric, *categorical]
    specs = [H.Spec(str(i), 0, tuple(x for x in names if x != f), mtry, trees, seed) for i, f in enumerate(names)]
    counts = grown_counts(table, bins, specs, {s.name: "_split" for s in specs}, ["_split"], max_depth, class_weights)
    dropped = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("model").cast("int") + 1)
    return counts.select(dropped.alias("dropped"), "part", "truth", "prediction", "n")


# DOR4 -------------------------------------------------------------------------
def bag_counts(table: DataFrame, seed: int, trees: int) -> DataFrame:
    """(tree, drawn, rows, out_of_bag) of each tree's bag over a binned table: draws, rows drawn, rows not drawn."""

    def count(batches):
        import pyarrow as pa
        total = np.zeros((trees, 3), np.int64)
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for t in range(trees):
                times = H.bag(h1, h2, seed, t)
                total[t] += times.sum(), np.count_nonzero(times), np.count_nonzero(times == 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees, dtype=np.int32)), *[pa.array(total[:, i]) for i in range(3)]],
                                         ["tree", "drawn", "rows", "out_of_bag"])

    one = table.select("_h1", "_h2").mapInArrow(count, "tree int, drawn bigint, rows bigint, out_of_bag bigint")
    return one.groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("drawn", "rows", "out_of_bag")])


def oob_error(table: DataFrame, grown: H.Forest) -> dict[str, tuple[int, int]]:
    """{model: (rows voted on, wrong ones)} by votes only of the trees that did not draw the row."""
    counts = H.confusion(table, grown, {s.name: f"CASE WHEN (_member & {1 << s.bit}L) <> 0 THEN 'all' END" for s in grown.specs}, out_of_bag=True)
    rows = counts.groupBy("model").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") != F.col("prediction"), F.col("n")).otherwise(0)).alias("e")).collect()
    return {r["model"]: (r["n"], r["e"]) for r in rows}


def tune_mtry_oob(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                  start: int = 7, factor: float = 2.0, improve: float = 0.05, trees: int = 60, max_depth: int = 10, max_bins: int = 64,
                  class_weights: Mapping | None = None, seed: int = 42) -> DataFrame:
    """(mtry, n_voted, n_wrong, oob_error, best) of every value tried, ascending.

    From ``start`` (at most all features) the candidates a split are divided by ``factor`` again and again while the
    out-of-bag error falls by the share ``improve`` of the last one, then multiplied likewise from ``start``. One binned
    table serves all forests; the two first steps of both directions grow together.
    """
    bins = H.fit_bins(df, label, numeric, categorical, max_bins)
    table = H.bin_table(df, bins, key, seed)
    cells = C.fold_rows(table, bins, _bags([H.Spec("bags", 0, None, 0, trees, seed)]), rows=True)
    p = len(bins.features)
    tried: dict[int, tuple[int, int]] = {}

    def error(values: Sequence[int]) -> None:
        new = [v for v in dict.fromkeys(values) if v not in tried]
        if new:
            specs = [H.Spec(str(v), 0, None, v, trees, seed) for v in new]
            if cells is None:
                found = oob_error(table, H.grow(table, bins, specs, max_depth, class_weights=class_weights))
            else:
                found = oob_error(cells.rows, C.grow(cells, specs, max_depth, class_weights=class_weights))
            tried.update({v: found.get(str(v), (0, 0)) for v in new})

    def rate(v: int) -> float:
        return tried[v][1] / tried[v][0] if tried[v][0] else 0.0

    down = lambda v: max(1, int(np.ceil(v / factor)))
    up = lambda v: min(p, int(v * factor))
    first = max(1, min(start, p))
    error([first, down(first), up(first)])
    best = first
    for step in (down, up):
        at, last = first, rate(first)
        while True:
            nxt = step(at)
            if nxt == at:
                break
            error([nxt])
            gain = (last - rate(nxt)) / last if last > 0 else 0.0
            best = min(best, nxt, key=lambda v: (rate(v), v))
            if gain < improve:
                break
            at, last = nxt, rate(nxt)
    rows = [(v, n, e, rate(v), v == best) for v, (n, e) in sorted(tried.items())]
    return df.sparkSession.createDataFrame(rows, "mtry int, n_voted bigint, n_wrong bigint, oob_error double, best boolean")


# MDL4 -------------------------------------------------------------------------
def upper_errors(wrong: float, rows: float, cf: float) -> float:
    """Errors to expect in a leaf of ``rows`` rows of which ``wrong`` are of other classes: rows times the error rate under
    which so few errors have probability ``cf``."""
    if rows <= 0:
        return 0.0
    if wrong >= rows:
        return rows
    if wrong <= 0:
        return rows * (1.0 - cf ** (1.0 / rows))
    return rows * (1.0 - stats.beta_ppf(cf, rows - wrong, wrong + 1))


def prune(tree: H.Tree, cf: float = 0.25, weights: np.ndarray | None = None) -> H.Tree:
    """The tree with every split undone that does not lower the errors to expect (pessimistic, from the leaves up).

    Works on the collected counts of nodes and classes only. ``weights`` are class weights, which enter as rows.
    """
    counts = tree.counts * (np.ones(tree.counts.shape[1]) if weights is None else weights)
    rows = counts.sum(axis=1)
    own = np.array([upper_errors(n - c.max(), n, cf) for n, c in zip(rows.tolist(), counts)])
    feature, expected = tree.feature.copy(), own.copy()
    for node in range(len(feature) - 1, -1, -1):  # children come after their parent
        if feature[node] < 0:
            continue
        kids = tree.first[node] + np.arange(int(tree.goes[node].max()) + 1)
        below = expected[kids].sum()
        if own[node] <= below + 0.1:
            feature[node] = -1
        else:
            expected[node] = below
    return _rebuilt(tree, feature)


def _rebuilt(tree: H.Tree, feature: np.ndarray) -> H.Tree:
    """The nodes that are still reached, in their old order."""
    reached = np.zeros(len(feature), bool)
    reached[0] = True
    for node in range(len(feature)):
        if reached[node] and feature[node] >= 0:
            reached[tree.first[node] + np.arange(int(tree.goes[node].max()) + 1)] = True
    old = np.flatnonzero(reached)
    new = np.cumsum(reached) - 1
    leaf = feature[old] < 0
    first = np.where(leaf, np.arange(len(old)), new[np.minimum(tree.first[old], len(feature) - 1)])
    goes = np.where(leaf[:, None], 0, tree.goes[old]).astype(np.uint8)
    return replace(tree, feature=feature[old], first=first, goes=goes, counts=tree.counts[old], gain=np.where(leaf, 0, tree.gain[old]),
                   depth=tree.depth[old], open=np.zeros(0, np.int64), jump=None)


def gain_ratio_tree(table: DataFrame, bins: H.Bins, bit: int = 0, max_depth: int = 10, min_rows: int = 2, cf: float | None = 0.25,
                    class_weights: Mapping | None = None) -> H.Forest:
    """A single tree on the rows of membership ``bit``: a child a category, splits by gain ratio among the tests of at least
    average gain, pruned pessimistically at ``cf`` (None: unpruned)."""
    grown = H.grow(table, bins, [H.Spec("tree", bit, None, 0, 1, 0, bagged=False)], max_depth, "gain_ratio", class_weights, min_rows)
    if cf is not None:
        grown.trees = [prune(t, cf, grown.class_weights) for t in grown.trees]
    return grown


def tree_rows(grown: H.Forest, spark, number: int = 0) -> DataFrame:
    """The tree as rows: node, depth, feature (NULL: leaf), gain, split_at (the cut of a number), first_child, children, n,
    prediction."""
    t, b = grown.trees[number], grown.bins
    rows = []
    for i in range(len(t.feature)):
        leaf = t.feature[i] < 0
        shares, name = grown.shares(t)[i], b.features[t.feature[i]]
        at = None if leaf or name not in b.cuts else b.cuts[name][int(np.flatnonzero(t.goes[i, :len(b.cuts[name]) + 1] == 0).max())]
        rows.append((i, int(t.depth[i]), None if leaf else name, None if leaf else float(t.gain[i]), at,
                     None if leaf else int(t.first[i]), 0 if leaf else int(t.goes[i].max()) + 1, int(t.counts[i].sum()),
                     str(b.classes[int(shares.argmax())])))
    return spark.createDataFrame(rows, "node int, depth int, feature string, gain double, split_at double, first_child int, children int, n bigint, prediction string")
