"""Boosted trees of all folds and ways of rebalancing grown together (MDL5, MDL6, MDL11, SMP5, SMP6).

One binned table (see :mod:`.forest`) serves all models. In each round the next tree of every model grows in the same
passes, a level a pass. Weights are whole numbers made of the rows' copies and of the rounds that missed them, so equal
rows grow equal trees however they are partitioned; a round's error is read off its leaves, and one pass a round writes
down, a bit a model, which rows it missed.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import hash_name
from ..session import cut_lineage
from . import cells as C
from . import forest as H
from .ensembles import _rebuilt, fold_members
from .sample import drawn_again

#: Bits of a row's weight at most (a block's sums stay exact in doubles), of a table's sums, and of a word of copies.
WEIGHT_BITS, SUM_BITS, WORD_BITS = 36, 61, 62
#: Least error of a round: one without errors would vote without bound.
LEAST_ERROR = 1e-10
#: Counts that a task holds before it sends them on.
HELD = 1 << 17


def merged(tree: H.Tree) -> H.Tree:
    """The tree with leaves of one parent joined, from below, while all of them predict the same class."""
    feature, best = tree.feature.copy(), tree.counts.argmax(axis=1)
    for node in range(len(feature) - 1, -1, -1):  # children come after their parent
        if feature[node] >= 0:
            kids = tree.first[node] + np.arange(int(tree.goes[node].max()) + 1)
            if (feature[kids] < 0).all() and (best[kids] == best[kids[0]]).all():
                feature[node] = -1
    return _rebuilt(tree, feature)


# MDL6 -------------------------------------------------------------------------
def boost(table: DataFrame, bins: H.Bins, specs: Sequence[H.Spec], rounds: int = 3, max_depth: int = 10, cells: C.Cells | None = None) -> H.Forest:
    """SAMME (multi-class AdaBoost) of entropy trees for every spec: each round the weight of missed rows grows by exp(vote).

    A model ends with a round that misses nothing, or before one that is no better than chance (kept if it is the first).
    Of each spec the name, the bit, the features and the copies count. With the table's ``cells`` (folded for
    :func:`measures`) equal trees grow over these, and which cells a round missed is told by its trees: no pass writes it down.
    """
    specs = [replace(s, trees=1, mtry=0, bagged=False) for s in specs]
    copies = [s.weigh.copies if s.weigh else None for s in specs]
    most = [1.0 + c[2] if c else 1.0 for c in copies]
    misses: list[list] = [[] for _ in specs]
    before: list[list] = [[] for _ in specs]  # a model's earlier trees and the factors of their misses
    units = [1.0] * len(specs)
    chance, active, trees = 1.0 - 1.0 / len(bins.classes), list(range(len(specs))), []
    for r in range(rounds):
        now = [replace(specs[s], weigh=H.Weigh(copies[s], tuple(misses[s]), units[s])) for s in active]
        if cells is None:
            grown, going = H.grow(table, bins, now, max_depth, "entropy"), []
        else:
            grown, going = C.grow(cells, now, max_depth, "entropy", missed={i: before[s] for i, s in enumerate(active)}), []
        for s, tree in zip(active, grown.trees):
            tree = merged(tree)
            leaves = tree.counts[tree.feature < 0]
            total, wrong = int(leaves.sum()), int((leaves.sum(axis=1) - leaves.max(axis=1)).sum())
            error = wrong / total if total else 0.0
            if error >= chance:
                if not r:
                    trees.append(replace(tree, spec=s))
                continue
            vote = math.log((1.0 - max(error, LEAST_ERROR)) / max(error, LEAST_ERROR)) + math.log(len(bins.classes) - 1 or 1)
            trees.append(replace(tree, spec=s, number=r, vote=vote))
            if error <= LEAST_ERROR or r == rounds - 1:
                continue
            going.append((s, tree))
            misses[s].append((f"_m{r}", s, math.exp(vote)))
            before[s].append((tree, math.exp(vote)))
            top = math.prod(m[2] for m in misses[s]) * most[s]
            units[s] = min(2.0 ** WEIGHT_BITS / top, 2.0 ** SUM_BITS * units[s] / (total + wrong * math.exp(vote)))
        active = [s for s, _ in going]
        if not active:
            break
        if cells is None:
            table = cut_lineage(table.withColumn(f"_m{r}", _missed(table, going, len(bins.features))))
    done = [replace(s, weigh=H.Weigh(c) if c else None) for s, c in zip(specs, copies)]
    return H.Forest(bins, done, trees, np.ones(len(bins.classes)))


def _missed(table: DataFrame, trees: Sequence[tuple[int, H.Tree]], features: int):
    """A bit for each of (bit, tree): does the tree predict another class than the row's?"""
    shared = table.sparkSession.sparkContext.broadcast(pickle.dumps(list(trees)))

    @F.arrow_udf("bigint")
    def of(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        trees = pickle.loads(shared.value)
        for y, *cols in it:
            y = y.to_numpy(zero_copy_only=False)
            bins = np.array([c.to_numpy(zero_copy_only=False) for c in cols], np.int16).reshape(features, -1)
            rows, bits = np.arange(len(y)), np.zeros(len(y), np.int64)
            for bit, tree in trees:
                said = tree.counts.argmax(axis=1)[tree.walk(bins, rows, int(tree.depth.max()))]
                bits |= (said != y).astype(np.int64) << bit
            yield pa.array(bits)

    return of("_y", *[F.col(f"_b{i}") for i in range(features)])


def vote_counts(table: DataFrame, forest: H.Forest, part: Mapping[str, str]) -> DataFrame:
    """(model, part, truth, probability, n): rows by the class shares that a model's trees vote for, copies counted.

    ``probability`` has a share a class, in the order of the classes, for a rule that decides by it (``cost_sensitive``);
    ``part`` is that of :func:`.forest.confusion`. A task sends a row for each of the shares it met, not for each row.
    """
    spark, names = table.sparkSession, [s.name for s in forest.specs]
    features, classes, extra = len(forest.bins.features), len(forest.bins.classes), H._extra(forest.specs)
    shared = spark.sparkContext.broadcast(pickle.dumps(forest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(shared.value)
        trees = [forest.of(i) for i in range(len(forest.specs))]
        total: dict[tuple, int] = {}

        def send() -> pa.RecordBatch:
            keys = list(total)
            share = np.frombuffer(b"".join(k[3] for k in keys), np.float64)
            cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(share) + 1, classes), pa.int32()), pa.array(share)),
                    pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(cols, ["model", "part", "truth", "probability", "n"])

        def add(held: list) -> None:
            block = next(H._blocks(iter(held), features, extra))
            table = pa.Table.from_batches(held)
            for i, spec in enumerate(forest.specs):
                parts = table.column(f"_p{i}").combine_chunks().dictionary_encode()
                code = parts.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                some = np.flatnonzero((code >= 0) & (block[1] >= 0))
                if not len(some) or not trees[i]:
                    continue
                group, bins, rows, leaves = code[some] * classes + block[1][some], block[0][:, some], np.arange(len(some)), []
                for t in trees[i]:
                    leaves.append(t.walk(bins, rows, int(t.depth.max())))
                    _, first, group = np.unique(group * len(t.feature) + leaves[-1], return_index=True, return_inverse=True)
                share = sum(t.vote * forest.shares(t)[leaf[first]] for t, leaf in zip(trees[i], leaves)) / sum(t.vote for t in trees[i])
                times = spec.weigh.times(block[5] if extra else {}, some) if spec.weigh else None
                for row, p, n in zip(some[first].tolist(), share, np.bincount(group, times).tolist()):
                    key = (i, parts.dictionary[int(code[row])].as_py(), int(block[1][row]), p.tobytes())
                    total[key] = total.get(key, 0) + int(n)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= H.BLOCK:
                add(held)
                held, size = [], 0
            if len(total) > HELD:
                yield send()
        if size:
            add(held)
        yield send()

    cols = ["_y", "_member", "_h1", "_h2", *extra, *[f"_b{i}" for i in range(features)]]
    told = table.select(*cols, *[F.expr(part[n]).cast("string").alias(f"_p{i}") for i, n in enumerate(names)])
    counts = (told.mapInArrow(count, "model int, part string, truth int, probability array<double>, n bigint")
              .groupBy("model", "part", "truth", "probability").agg(F.sum("n").alias("n")))
    return _named(counts, forest)


def measures(specs: Sequence[H.Spec], part: Mapping[str, str], spark):
    """What boosting and its counts need of a table's cells: the rows, or the copies, of training rows and of parts."""
    def of(cells: C.Cells) -> list[C.Measure]:
        copied = [s for s in specs if s.weigh and s.weigh.copies]
        return [C.spec_measure(cells, s) for s in specs] + [C.Measure(k, None, s.weigh.copies) for s in copied for k in cells.part(spark, part[s.name]).values()]

    return of


def cell_vote_counts(cells: C.Cells, forest: H.Forest, part: Mapping[str, str]) -> DataFrame:
    """What :func:`vote_counts` counts row by row, from the cells."""
    spark, classes = cells.chunks.sparkSession, len(forest.bins.classes)
    parts = {sql: cells.part(spark, sql) for sql in dict.fromkeys(part[s.name] for s in forest.specs)}
    told = []  # of each model its parts and the measures that are added up for them
    for s in forest.specs:
        copied = s.weigh and s.weigh.copies
        told.append({p: [cells.measures[C.Measure(k, None, s.weigh.copies)]] if copied else list(k) for p, k in parts[part[s.name]].items()})
    shared = spark.sparkContext.broadcast(pickle.dumps((forest, told)))

    def each(bins: np.ndarray, y: np.ndarray, sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        forest, told = pickle.loads(shared.value)
        rows, found = np.arange(len(y)), []
        for i, mine in enumerate(told):
            trees, group = forest.of(i), y
            if not trees:
                continue
            leaves = []
            for t in trees:
                leaves.append(t.walk(bins, rows, int(t.depth.max())))
                _, first, group = np.unique(group * len(t.feature) + leaves[-1], return_index=True, return_inverse=True)
            share = sum(t.vote * forest.shares(t)[leaf[first]] for t, leaf in zip(trees, leaves)) / sum(t.vote for t in trees)
            for p, of in mine.items():
                total = np.zeros(len(first), np.int64)
                np.add.at(total, group, sum(sums[k] for k in of))
                found += [(i, p, int(y[row]), one.tolist(), int(n)) for row, one, n in zip(first, share, total) if n]
        cols = list(zip(*found)) if found else [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["model", "part", "truth", "probability", "n"])

    used = sorted({k for t in told for of in t.values() for k in of})
    counts = (C.by_chunk(cells, used, each, "model int, part string, truth int, probability array<double>, n bigint")
              .groupBy("model", "part", "truth", "probability").agg(F.sum("n").alias("n")))
    return _named(counts, forest)


def _named(counts: DataFrame, forest: H.Forest) -> DataFrame:
    name = F.array(*[F.lit(s.name) for s in forest.specs])
    cls = F.array(*[F.lit(c) for c in forest.bins.classes])
    return counts.select(F.element_at(name, F.col("model") + 1).alias("model"), "part", F.element_at(cls, F.col("truth") + 1).alias("truth"),
                         "probability", "n")


# SMP6 inside folds --------------------------------------------------------------
def with_copies(df: DataFrame, label: str, key: str | Sequence[str], folds: Sequence[int], seed: int = 42, fold_col: str = "fold"
                ) -> tuple[DataFrame, list[tuple[str, int, int] | None]]:
    """``df`` with the copies that ``up_sample`` makes of each row on the rows outside each of ``folds``, and where they are.

    Copies are packed into words: (column, shift, mask) a fold, None where no row is copied. No row is repeated.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = [c for c in [hash_name(seed, *keys)] if c in df.columns]
    found = {}
    for i, f in enumerate(folds):
        again = drawn_again(df.where(F.col(fold_col) != f).select(*keys, label, *hashed), label, keys, seed)
        if again is not None:
            found[i] = again.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(keys)], F.lit(i).alias("_i"), "_u_extra")
    if not found:
        return df, [None] * len(folds)
    long = None
    for part in found.values():
        long = part if long is None else long.unionByName(part)
    wide = cut_lineage(long.groupBy(*[f"_k{j}" for j in range(len(keys))])
                       .agg(*[F.coalesce(F.sum(F.when(F.col("_i") == i, F.col("_u_extra"))), F.lit(0)).alias(f"_e{i}") for i in found]))
    most = max(wide.agg(*[F.max(f"_e{i}") for i in found]).first())
    width = int(most).bit_length()
    a_word = WORD_BITS // width
    place = {i: (f"_t{n // a_word}", n % a_word * width, (1 << width) - 1) for n, i in enumerate(found)}
    words = {w: sum((F.shiftleft(F.col(f"_e{i}"), p[1]) for i, p in place.items() if p[0] == w), F.lit(0).cast("bigint"))
             for w in sorted({p[0] for p in place.values()})}
    packed = wide.select(*[f"_k{j}" for j in range(len(keys))], *[v.alias(w) for w, v in words.items()])
    same = F.lit(True)
    for j, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    out = df.join(packed, same, "left").select(*df.columns, *[F.coalesce(F.col(w), F.lit(0).cast("bigint")).alias(w) for w in words])
    return out, [place.get(i) for i in range(len(folds))]


# MDL11 ------------------------------------------------------------------------
def cross_validate_boosted(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                           k: int = 5, rounds: int = 3, max_depth: int = 10, max_bins: int = 64, seed: int = 42,
                           fold_col: str = "fold", bins: H.Bins | None = None) -> tuple[DataFrame, list]:
    """((rebalance, fold, part, truth, probability, n), classes) of boosted trees a fold, whose training rows are those
    outside the fold, down-sampled ("down") or up-sampled ("up"); all grow together.

    ``part`` is "train" for the rebalanced training rows (copies counted) and "held_out" for the fold. Cuts, levels and
    classes come from all rows (or are ``bins``, of the same rows); a tree sees only its training rows' labels.
    """
    if 2 * k > H.MAX_MODELS:
        raise ValueError(f"{k} folds, rebalanced in two ways: at most {H.MAX_MODELS} models")
    folds = list(range(1, k + 1))
    bins = bins or H.fit_bins(df, label, numeric, categorical, max_bins)
    told, copies = with_copies(df, label, key, folds, seed, fold_col)
    member = fold_members(df, label, key, folds, seed, fold_col)
    for f in folds:
        member = member + F.when((F.col(fold_col) != f) & F.col(label).isNotNull(), F.lit(1 << (k + f - 1))).otherwise(0).cast("bigint")
    words = sorted({c[0] for c in copies if c})
    table = H.bin_table(told, bins, key, seed, [F.col(fold_col).alias("_fold"), *words], member, even=H.narrow(df))
    specs = [H.Spec(f"down/{f}", f - 1) for f in folds] + [H.Spec(f"up/{f}", k + f - 1, weigh=H.Weigh(c) if c else None) for f, c in zip(folds, copies)]
    part = {s.name: f"CASE WHEN _fold = {s.name.split('/')[1]} THEN 'held_out' WHEN (_member & {1 << s.bit}L) <> 0 THEN 'train' END" for s in specs}
    cells = C.fold_rows(table, bins, measures(specs, part, df.sparkSession), ["_fold"])
    if cells is None:
        table = cut_lineage(H.deal(table, bins.rows))
        votes = vote_counts(table, boost(table, bins, specs, rounds, max_depth), part)
    else:
        votes = cell_vote_counts(cells, boost(table, bins, specs, rounds, max_depth, cells), part)
    names = F.split("model", "/")
    return votes.select(names[0].alias("rebalance"), names[1].cast("int").alias("fold"), "part", "truth", "probability", "n"), bins.classes
