"""Histogram forests: all trees of all folds and settings grown together, level by level (MDL1, MDL3, MDL4, MDL11, MDL12, DOR4).

The table is binned once (``bin_table``): a small integer a feature, the label's code, and two hashed numbers of the row
key. Every model (``Spec``) names the rows it trains on (a bit of a membership column), its features, its number of
trees and of candidate features a split. All trees of all models share one pass of the binned table a level: each task
adds up, for the nodes open in each tree, the rows by (tree, node, candidate feature, bin, class); a second stage sums
those tables tree by tree and picks the best split of each node. The driver sees splits only, never rows.

* Rows find their node again in every pass by walking the tree, so no per-row state is kept between passes and a
  lost task is simply read again.
* How often a tree draws a row is a Poisson number of the row's hashed key and the tree's number (``bag``): the same
  on any partitioning and, by integer arithmetic, in SQL. Tables hold integer counts, so sums do not depend on their
  order: equal rows grow equal trees, however they are partitioned.
* Open nodes are dealt to passes so that a task's tables stay under CELLS numbers.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import hash_of
from ..session import cut_lineage
from .features import fit_levels
from .radix import rank_values

#: Numbers (8 bytes each) that a task's count tables may hold in one pass; rows that it works on at a time.
#: Few rows at a time keep the arrays of a tree in the cache, and a task's memory off the size of its input.
CELLS, BLOCK = 1 << 23, 10_000
#: Binned tables are dealt to this many tasks a core, but no task gets fewer rows than TASK_ROWS.
TASKS, TASK_ROWS = 2, 20_000
#: Nodes that the first steps of a walk may end in, to be taken at once (bits of a number).
JUMP = 64
#: What the tables of a regression hold in place of classes; its label is a whole number of at most this many bits.
TARGET, TARGET_BITS = ["rows", "sum"], 32
#: Bins of a feature at most, with the one for missing values.
MAX_BINS = 256
#: Models that one membership column can tell apart.
MAX_MODELS = 62

#: P(Poisson(1) <= k) for k = 0, 1, ... in units of 2 ** -32.
POISSON = np.array([math.floor(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) * 2 ** 32)
                    for k in range(12)], np.uint64)

#: The same by the upper 16 bits of the number; -1 where these do not decide.
_POISSON_TOP = np.searchsorted(POISSON, np.arange(1 << 16, dtype=np.uint64) << np.uint64(16), side="right").astype(np.int8)
_POISSON_TOP[(POISSON[POISSON < 1 << 32] >> np.uint64(16)).astype(int)] = -1

_M64 = (1 << 64) - 1
#: The place of a number's only bit: a de Bruijn sequence times the bit has another upper six bits for each place.
_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, np.int64)
_PLACE[((np.uint64(1) << np.arange(64, dtype=np.uint64)) * _BRUIJN >> np.uint64(58)).astype(int)] = np.arange(64)


# --- bins --------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """How a table is binned: per feature the cuts (numeric) or levels (categorical), and the label's classes.

    A numeric value's bin is the number of cuts below it; a level's bin its place; the last bin of a feature is for
    missing values and levels not seen.
    """

    label: str
    classes: list
    features: list[str]
    cuts: dict[str, list[float]]
    levels: dict[str, list[str]]
    rows: int | None = None  # of the table the bins were made from
    target: tuple[float, float] | None = None  # least value and unit of a numeric label, whose ``classes`` are TARGET
    groups: dict[str, list[str]] = field(default_factory=dict)  # features that stand for several, see :func:`group_exclusive`

    def sizes(self) -> np.ndarray:
        return np.array([len(self.groups[f]) + 1 if f in self.groups else
                         len(self.cuts[f]) + 2 if f in self.cuts else len(self.levels[f]) + 1 for f in self.features])

    def apart(self) -> np.ndarray:
        return np.array([f in self.groups for f in self.features])

    def ordered(self) -> np.ndarray:
        return np.array([f in self.cuts for f in self.features])


def fit_bins(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), max_bins: int = 64,
             regression: bool = False) -> Bins:
    """Cuts at the values of the ranks i / max_bins (exact, of distinct ones each once), levels and classes in order.

    ``regression``: the label is a number, kept in units of its range / 2 ** TARGET_BITS, so that sums of it are exact.
    """
    if not 2 <= max_bins <= MAX_BINS - 2:
        raise ValueError(f"max_bins {max_bins}: from 2 to {MAX_BINS - 2}")
    n = df.agg(*[F.count(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(f"n{i}") for i, c in enumerate(numeric)],
               F.count(F.lit(1)).alias("rows")).first()
    ranks = {c: sorted({i * n[j] // max_bins for i in range(1, max_bins)}) if n[j] else [] for j, c in enumerate(numeric)}
    values = rank_values(df, ranks)
    top = df.agg(*[F.max(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(numeric)],
                 F.lit(0)).first()
    # a cut at the largest value would leave an empty side
    cuts = {c: sorted({v for (k, _), v in values.items() if k == c} - {top[j]}) for j, c in enumerate(numeric)}
    levels = fit_levels(df, list(categorical)) if categorical else {}
    wide = [c for c, v in levels.items() if len(v) > MAX_BINS - 1]
    if wide:
        raise ValueError(f"{wide}: over {MAX_BINS - 1} levels; group rare ones first")
    if regression:
        y = F.nanvl(F.col(f"`{label}`").cast("double"), F.lit(None))
        low, high = df.agg(F.min(y), F.max(y)).first()
        span = (high - low) if low is not None else 0.0
        if not math.isfinite(span):
            raise ValueError(f"{label}: its range is not a number")
        return Bins(label, list(TARGET), [*numeric, *categorical], cuts, levels, n["rows"], (low or 0.0, span / ((1 << TARGET_BITS) - 1)))
    classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(MAX_BINS + 1).collect()]
    if len(classes) > MAX_BINS:
        raise ValueError(f"{label}: over {MAX_BINS} classes")
    return Bins(label, classes, [*numeric, *categorical], cuts, levels, n["rows"])


def group_exclusive(df: DataFrame, bins: Bins, exclusive: Sequence[Sequence[str]]) -> Bins:
    """``bins`` with one feature in place of each group of ``exclusive`` numeric ones, as the dummies of a category are.

    The new feature's bin is the place (from 1) of the member above its cut, or 0; a split sets one bin apart from the rest,
    which is what the members' own splits do, so trees are the same (see :func:`ungroup`) and rows are counted once a group.
    A group is made only if it holds for all rows of ``df``: no member is missing or has more than one cut, and no row
    has two above theirs. One aggregate tells.
    """
    taken, able = set(), []
    for g in map(list, exclusive):
        if 2 <= len(set(g)) == len(g) < MAX_BINS and not taken & set(g) and all(len(bins.cuts.get(c, [0, 0])) <= 1 for c in g):
            able.append(g)
            taken |= set(g)
    if not able:
        return bins

    def above(c: str):
        x = F.col(f"`{c}`").cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(2)).otherwise(_above(bins, c))

    row = df.agg(*[F.max(F.aggregate(F.array(*map(above, g)), F.lit(0), lambda a, x: a + x)).alias(f"g{i}")
                   for i, g in enumerate(able)]).first()
    groups = {f"{g[0]} and others": g for i, g in enumerate(able) if row[f"g{i}"] is not None and row[f"g{i}"] <= 1}
    groups = {f: g for f, g in groups.items() if f not in bins.features}
    first, inside = {g[0]: f for f, g in groups.items()}, {c for g in groups.values() for c in g}
    return replace(bins, features=[first.get(c, c) for c in bins.features if c in first or c not in inside], groups=groups)


def _above(bins: Bins, c: str):
    """1 where the member of a group is above its cut, else 0."""
    return (F.col(f"`{c}`").cast("double") > F.lit(bins.cuts[c][0])).cast("int") if bins.cuts[c] else F.lit(0)


def bin_table(df: DataFrame, bins: Bins, key: str | Sequence[str], seed: int = 42, keep: Sequence[str] = (),
              member=None, even: bool = True) -> DataFrame:
    """The binned table, written once: ``keep`` columns, ``_y`` (class code, -1 without), ``_member`` (bits of the models
    that train on the row, or 1), ``_h1`` and ``_h2`` (32 bits each of the key's seeded md5), ``_b0`` ... the bins.

    Its rows are dealt evenly to TASKS partitions a core, however few files, row groups or partitions ``df`` has: the
    passes over it are what a forest's time goes into. Not ``even``: a table that is only folded into cells (see :mod:`.cells`),
    which deals its rows itself, keeps the partitions of ``df``; see :func:`narrow`."""
    keys = [key] if isinstance(key, str) else list(key)
    h = hash_of(df, seed, *keys)
    half = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("bigint")
    y = F.lit(-1)
    if bins.target:
        low, unit = bins.target
        value = F.nanvl(F.col(f"`{bins.label}`").cast("double"), F.lit(None))
        y = F.coalesce(F.round((value - F.lit(low)) / F.lit(unit or 1.0)), F.lit(-1.0))
    for i, c in enumerate([] if bins.target else bins.classes):
        y = F.when(F.col(f"`{bins.label}`") == F.lit(c), i).otherwise(y)
    raw = df.select(*keep, y.cast("bigint" if bins.target else "int").alias("_y"), (F.lit(1) if member is None else member).cast("bigint").alias("_member"),
                    half(1).alias("_h1"), half(9).alias("_h2"), *_bin_inputs(bins))
    if even:
        raw = deal(raw, bins.rows)
    return cut_lineage(raw.select(*[c for c in raw.columns if c not in bins.features], *[c.alias(f"_b{i}") for i, c in enumerate(_bin_columns(bins))]))


def narrow(df: DataFrame) -> bool:
    """Has ``df``, a written table, too few partitions for all cores?"""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def deal(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in TASKS even partitions a core; fewer if it has few ``rows``."""
    parts = TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts if rows is None else min(parts, max(1, rows // TASK_ROWS)))


def _bin_inputs(bins: Bins) -> list:
    """What the bins are made of: the features, and the bins of groups."""
    place = {f: F.greatest(*[_above(bins, c) * F.lit(i) for i, c in enumerate(g, 1)]) for f, g in bins.groups.items()}
    return [place[f].cast("smallint").alias(f) if f in place else F.col(f"`{f}`") for f in bins.features]


def _bin_columns(bins: Bins) -> list:
    return [F.col(f"`{f}`") if f in bins.groups else _numeric_bin(bins.cuts[f])(F.col(f"`{f}`").cast("double")) if f in bins.cuts
            else _level_bin(bins.levels[f])(F.col(f"`{f}`").cast("string")) for f in bins.features]


def _cut_bins(edges: np.ndarray, values: pa.Array) -> np.ndarray:
    x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(x), len(edges) + 1, np.searchsorted(edges, x, side="left")).astype(np.int16)


def _level_bins(known: list[str], values: pa.Array) -> np.ndarray:
    at = pc.index_in(values, pa.array(known, values.type))
    return at.fill_null(len(known)).cast(pa.int16()).to_numpy(zero_copy_only=False)


def _numeric_bin(cuts: list[float]):
    edges = np.array(cuts, np.float64)

    @F.arrow_udf("smallint")
    def of(values: pa.Array) -> pa.Array:
        return pa.array(_cut_bins(edges, values))

    return of


def _level_bin(levels: list[str]):
    known = list(levels)

    @F.arrow_udf("smallint")
    def of(values: pa.Array) -> pa.Array:
        return pa.array(_level_bins(known, values))

    return of


# --- bags --------------------------------------------------------------------------------------------------

def bag_factors(seed: int, tree: int) -> tuple[int, int, int]:
    """The three numbers of a tree's bag: 64 bits each, by a fixed scattering of (seed, tree)."""
    out = []
    for k in range(3):
        x = (seed * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9 + (k + 1) * 0x94D049BB133111EB) & _M64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & _M64
        out.append((x ^ (x >> 31)) | (k < 2))
    return tuple(out)


def bag(h1: np.ndarray, h2: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often the tree draws each row: Poisson(1) of ((a * h1 + b * h2 + c) mod 2 ** 64) div 2 ** 32."""
    a, b, c = (np.uint64(x) for x in bag_factors(seed, tree))
    u = h1.astype(np.uint64, copy=False) * a
    u += h2.astype(np.uint64, copy=False) * b
    u += c
    u >>= np.uint64(32)
    times = _POISSON_TOP[(u >> np.uint64(16)).view(np.int64)]
    open_ = np.flatnonzero(times < 0)
    times[open_] = np.searchsorted(POISSON, u[open_], side="right")
    return times


# --- models ------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Weigh:
    """Whole-number weights of a model's training rows, so that sums of them are exact.

    A row counts once and the number in ``copies`` (column, shift, mask) more; for every (column, bit, factor) of
    ``misses`` whose bit is set its weight is multiplied. ``unit`` is the weight of 1; products under it count as 1.
    """

    copies: tuple[str, int, int] | None = None
    misses: tuple[tuple[str, int, float], ...] = ()
    unit: float = 1.0

    def times(self, extra: Mapping[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """1 and the copies of each of ``rows``."""
        if self.copies is None:
            return np.ones(len(rows))
        name, shift, mask = self.copies
        return 1.0 + ((extra[name][rows] >> shift) & mask)

    def of(self, extra: Mapping[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        weight = np.full(len(rows), self.unit)
        for name, bit, factor in self.misses:
            weight *= np.where((extra[name][rows] >> bit) & 1 == 1, factor, 1.0)
        return np.maximum(np.rint(weight), 1.0) * self.times(extra, rows)

    def columns(self) -> list[str]:
        return [*([self.copies[0]] if self.copies else []), *[m[0] for m in self.misses]]


@dataclass(frozen=True)
class Spec:
    """One model: a name, the membership bit of its training rows, features (None: all), candidates a split (0: all),
    trees, whether its trees draw rows (else every training row counts once), and the rows' weights where they have any."""

    name: str
    bit: int = 0
    features: tuple[str, ...] | None = None
    mtry: int = 0
    trees: int = 50
    seed: int = 42
    bagged: bool = True
    weigh: Weigh | None = None


@dataclass
class Tree:
    """Nodes in the order they were opened: feature (-1: leaf), first child, gain, rows by class; ``goes[node, bin]`` is
    added to the first child."""

    spec: int
    number: int
    feature: np.ndarray
    first: np.ndarray
    goes: np.ndarray
    counts: np.ndarray
    gain: np.ndarray
    depth: np.ndarray
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    jump: tuple | None = None  # see :func:`_jump`
    vote: float = 1.0  # weight of its class shares among the model's trees

    def walk(self, bins: np.ndarray, rows: np.ndarray, steps: int) -> np.ndarray:
        """The node of each of ``rows`` after ``steps`` splits; ``bins`` has a row a feature."""
        node = None
        if self.jump and self.jump[0] <= steps and len(self.jump[1]) <= 3 * self.jump[0]:
            done, used, masks, nodes = self.jump
            for f, mask in zip(used, masks):
                part = mask[bins[f][rows]]
                node = part if node is None else np.bitwise_and(node, part, out=node)
            node *= _BRUIJN
            node >>= np.uint64(58)
            node = nodes[node.view(np.int64)]
            steps -= done
        if node is None:
            node = np.zeros(len(rows), np.int64)
        width, n = self.goes.shape[1], bins.shape[1]
        flat, goes, base = bins.ravel(), self.goes.ravel(), np.maximum(self.feature, 0) * n
        for _ in range(steps):
            at = base[node]
            at += rows
            at = flat[at]
            to = self.first[node]
            node *= width
            node += at
            to += goes[node]
            node = to
        return node


def _jump(tree: Tree, steps: int) -> tuple | None:
    """(steps, features, masks, nodes): where ``steps`` splits lead, at once; None if to more than JUMP nodes.

    ``masks[i, bin]`` has a bit for each node that can be reached with that bin of feature i: the bits of a row's bins of all
    features have one in common, its node.
    """
    ends = [(0, {})]
    for _ in range(steps):
        after = []
        for node, ways in ends:
            f = int(tree.feature[node])
            if f < 0:
                after.append((node, ways))
                continue
            for k in range(int(tree.goes[node].max()) + 1):
                way = tree.goes[node] == k
                after.append((int(tree.first[node]) + k, {**ways, f: ways[f] & way if f in ways else way}))
        ends = after
        if len(ends) > JUMP:
            return None
    used = sorted({f for _, ways in ends for f in ways})
    if not used:
        return None
    masks = np.zeros((len(used), tree.goes.shape[1]), np.uint64)
    for i, (_, ways) in enumerate(ends):
        for j, f in enumerate(used):
            masks[j] |= np.where(ways[f], np.uint64(1 << i), np.uint64(0)) if f in ways else np.uint64(1 << i)
    return steps, used, masks, np.array([n for n, _ in ends])[np.minimum(_PLACE, len(ends) - 1)]


def jump_far(tree: Tree) -> None:
    """Sets the tree's longest jump."""
    for steps in range(1, int(tree.depth.max()) + 1):
        jump = _jump(tree, steps)
        if jump is None:
            break
        tree.jump = jump


@dataclass
class Forest:
    """Grown trees of every spec over one way of binning."""

    bins: Bins
    specs: list[Spec]
    trees: list[Tree]
    class_weights: np.ndarray

    def of(self, spec: int) -> list[Tree]:
        return [t for t in self.trees if t.spec == spec]

    def depth(self) -> int:
        return max((int(t.depth.max()) for t in self.trees), default=0)

    def shares(self, tree: Tree) -> np.ndarray:
        """Weighted class shares of each node."""
        w = tree.counts * self.class_weights
        return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def _candidates(tree: Tree, nodes: np.ndarray, allowed: np.ndarray, mtry: int, seed: int) -> np.ndarray:
    """Features tried at each node, ascending: the ``mtry`` of the lowest scattered (seed, tree, node, feature)."""
    if not mtry or mtry >= len(allowed):
        return np.tile(allowed, (len(nodes), 1))
    x = (np.uint64((seed * 0x9E3779B97F4A7C15 + tree.number * 0xD6E8FEB86659FD93) & _M64)
         + nodes.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F) + allowed.astype(np.uint64)[None, :] * np.uint64(0x165667B19E3779F9))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.sort(allowed[np.argsort(x ^ (x >> np.uint64(31)), axis=1, kind="stable")[:, :mtry]], axis=1)


# --- one level ---------------------------------------------------------------------------------------------

@dataclass
class Work:
    """A tree's open nodes in one pass, their candidates, and where each (node, candidate) starts in the count table."""

    index: int
    nodes: np.ndarray
    tried: np.ndarray
    at: np.ndarray
    cells: int
    step: int


def _extra(specs: Sequence[Spec]) -> list[str]:
    """Columns that the specs' weights are made of."""
    return sorted({c for s in specs if s.weigh for c in s.weigh.columns()})


def _blocks(batches: Iterator[pa.RecordBatch], features: int, extra: Sequence[str] = ()) -> Iterator[tuple]:
    """(bins as a row a feature, class, membership, two hashes) of up to BLOCK rows, and the ``extra`` columns by name if any."""

    def block(held: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(held)
        col = lambda name: table.column(name).to_numpy()
        bins = np.empty((features, table.num_rows), np.int16)
        for i in range(features):
            bins[i] = col(f"_b{i}")
        more = ({c: col(c) for c in extra},) if extra else ()
        return bins, col("_y").astype(np.int64), col("_member"), col("_h1"), col("_h2"), *more

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield block(held)
            held, size = [], 0
    if size:
        yield block(held)


class Members:
    """The rows of a block that train the models of one membership bit; the last bit asked for is kept."""

    def __init__(self, block: tuple, classes: int, target: bool = False):
        self.block, self.classes, self.target, self.bit = block, 1 if target else classes, target, None

    def of(self, bit: int) -> tuple:
        """(bins, bins times classes plus the row's class, two hashes, label); for a regression bins take the second place."""
        if bit != self.bit:
            bins, y, member, h1, h2 = self.block[:5]
            self.at = rows = np.flatnonzero((y >= 0) & ((member >> bit) & 1 == 1))
            mine = bins[:, rows].astype(np.int64)
            y = y[rows]
            self.bit, self.rows = bit, (mine, mine if self.target else mine * self.classes + y, h1[rows].view(np.uint64), h2[rows].view(np.uint64), y)
        return self.rows


def _counts(spec: Spec, tree: Tree, work: Work, members: Members, out: np.ndarray) -> None:
    """Adds a block's rows to the tree's table of (open node, candidate, bin, class or TARGET)."""
    bins, codes, h1, h2, y = members.of(spec.bit)
    n, times = bins.shape[1], None
    if spec.bagged:
        times = bag(h1, h2, spec.seed, tree.number)
        rows = np.flatnonzero(times != 0)
        times = times[rows].astype(np.float64)
    else:
        rows = np.arange(n)
        if spec.weigh:
            times = spec.weigh.of(members.block[5] if len(members.block) > 5 else {}, members.at)
    place = np.full(len(tree.feature), -1)
    place[work.nodes] = np.arange(len(work.nodes))
    place = place[tree.walk(bins, rows, work.step)]
    if len(work.nodes) < len(tree.feature) and (place < 0).any():
        some = np.flatnonzero(place >= 0)
        rows, place, times = rows[some], place[some], times if times is None else times[some]
    flat = codes.ravel()
    if members.target:
        times = np.ones(len(rows)) if times is None else times
        total, pair = times * y[rows], out.reshape(-1, 2)  # of one block: whole numbers, exact
    if (work.tried == work.tried[0]).all():  # a node's candidates lie side by side: each is counted in a table of its own
        nodes, starts = len(work.nodes), work.at[0]
        of_node = out.reshape(nodes, -1)
        for f, a, b in zip(work.tried[0], starts, [*starts[1:], work.cells // nodes]):
            cells = (b - a) * members.classes
            cell = place * cells
            cell += codes[f][rows]
            if members.target:
                one = np.stack([np.bincount(cell, w, nodes * cells) for w in (times, total)], axis=1).reshape(nodes, -1)
                of_node[:, 2 * a:2 * b] += one.astype(np.int64)
            else:
                one = np.bincount(cell, times, nodes * cells).reshape(nodes, -1)
                of_node[:, a * members.classes:b * members.classes] += one.astype(out.dtype, copy=False)
        return
    for j in range(work.tried.shape[1]):
        f = work.tried[:, j]
        if (f == f[0]).all():
            cell = codes[f[0]][rows]
        else:
            cell = (f * n)[place]
            cell += rows
            cell = flat[cell]
        cell += (work.at[:, j] * members.classes)[place]
        if members.target:
            pair[:, 0] += np.bincount(cell, times, len(pair)).astype(np.int64)
            pair[:, 1] += np.bincount(cell, total, len(pair)).astype(np.int64)
        else:  # of one block: whole numbers, exact
            out += np.bincount(cell, times, len(out)).astype(out.dtype, copy=False)


def _level(table: DataFrame, forest: Forest, works: list[Work], choose) -> dict[int, list]:
    """One pass: the tables of all ``works`` summed over all tasks, and what ``choose`` makes of each tree's."""
    sc = table.sparkSession.sparkContext
    classes, features, target = len(forest.bins.classes), len(forest.bins.features), forest.bins.target is not None
    extra = _extra(forest.specs)
    whole = target or any(s.weigh for s in forest.specs)
    shared, grown = sc.broadcast(pickle.dumps(works)), sc.broadcast(pickle.dumps((forest.specs, [forest.trees[w.index] for w in works])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works, (specs, trees) = pickle.loads(shared.value), pickle.loads(grown.value)
        # counts are exact in doubles up to 2 ** 53; sums of a label or of weights need the whole number
        tables = [np.zeros(w.cells * classes, np.int64 if whole else np.float64) for w in works]
        for block in _blocks(batches, features, extra):
            members = Members(block, classes, target)
            for w, tree, out in zip(works, trees, tables):
                _counts(specs[tree.spec], tree, w, members, out)
        for i, out in enumerate(tables):
            if out.any():
                small = out.max() < 1 << 32
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out.astype(np.uint32 if small else np.int64).tobytes()], pa.binary())], ["work", "counts"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works = pickle.loads(shared.value)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                size, raw = works[i].cells * classes, raw.as_buffer()  # not copied
                part = np.frombuffer(raw, np.uint32 if raw.size == 4 * size else np.int64)
                if i in sums:
                    sums[i] += part
                else:
                    sums[i] = part.astype(np.int64)
        for i, total in sums.items():
            best = choose(works[i], total.reshape(-1, classes))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps(best)], pa.binary())], ["work", "best"])

    parts = max(1, min(len(works), 16 * sc.defaultParallelism))  # few trees each: a task reads every task's tables of its own
    counted = table.select("_y", "_member", "_h1", "_h2", *extra, *[f"_b{i}" for i in range(features)]).mapInArrow(count, "work int, counts binary")
    rows = counted.repartition(parts, "work").mapInArrow(pick, "work int, best binary").collect()  # a row a tree
    shared.unpersist()
    grown.unpersist()
    return {r["work"]: pickle.loads(r["best"]) for r in rows}


# --- splits ------------------------------------------------------------------------------------------------

def impurity(weights: np.ndarray, criterion: str) -> np.ndarray:
    """Gini impurity or entropy (nats) of class weights (last axis), and 0 where there are none."""
    total = weights.sum(axis=-1, keepdims=True)
    p = weights / np.where(total > 0, total, 1)
    if criterion == "gini":
        return np.where(total[..., 0] > 0, 1 - (p * p).sum(axis=-1), 0.0)
    return -(p * np.log(np.where(p > 0, p, 1))).sum(axis=-1)


def _variance_gain(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Fall of the variance, as a share of the squared range, by splitting off ``left``; the last axis is TARGET."""
    n, nl = whole[..., 0].astype(float), left[..., 0].astype(float)
    nr = n - nl
    off = (left[..., 1] - nl * (whole[..., 1] / np.where(n > 0, n, 1))) / 2.0 ** TARGET_BITS
    return off * off / np.where(nl > 0, nl, 1) / np.where(nr > 0, nr, 1)


@dataclass
class Splitter:
    """Best split of each open node from its counts; see :func:`grow` for the criteria."""

    sizes: np.ndarray
    ordered: np.ndarray
    weights: np.ndarray
    criterion: str
    min_rows: int
    min_gain: float
    apart: np.ndarray | None = None  # features of which one bin is set apart from the rest

    def __call__(self, work: Work, counts: np.ndarray) -> dict:
        nodes, tried = len(work.nodes), work.tried.shape[1]
        width = int(self.sizes.max())
        gains = np.full((nodes, tried), -np.inf)
        values = np.full((nodes, tried), -np.inf)  # what is compared: the gain, or the gain ratio
        goes = np.zeros((nodes, tried, width), np.uint8)
        for f in np.unique(work.tried):
            node, j = np.nonzero(work.tried == f)
            cells = work.at[node, j][:, None] + np.arange(self.sizes[f])
            table = counts[cells]  # node, bin, class
            gain, value, way = self._multiway(table) if self.criterion == "gain_ratio" and not self.ordered[f] else self._binary(table, self.ordered[f], self.apart is not None and self.apart[f])
            gains[node, j], values[node, j], goes[node, j, :self.sizes[f]] = gain, value, way
        if self.criterion == "gain_ratio":  # only tests of at least the average gain are compared
            real = gains > self.min_gain
            mean = np.where(real, gains, 0).sum(axis=1) / np.maximum(real.sum(axis=1), 1)
            values = np.where(real & (gains >= mean[:, None] - 1e-12), values, -np.inf)
        best = values.argmax(axis=1)
        at = np.arange(nodes)
        good = (gains[at, best] > self.min_gain) & np.isfinite(values[at, best])
        feature = np.where(good, work.tried[at, best], -1)
        way = goes[at, best]
        children = np.where(good, way.max(axis=1) + 1, 0)
        first = work.at[:, 0]
        own = np.add.reduceat(counts, first, axis=0) if nodes else counts[:0]
        # rows of the first candidate only: its cells reach to the next candidate
        ends = first + self.sizes[work.tried[:, 0]]
        run = np.vstack([np.zeros((1, counts.shape[1]), counts.dtype), counts.cumsum(axis=0)])
        own = run[ends] - run[first]
        below = []
        for i in np.flatnonzero(good):
            cells = work.at[i, best[i]] + np.arange(self.sizes[feature[i]])
            kids = np.zeros((children[i], counts.shape[1]), np.int64)
            np.add.at(kids, way[i, :len(cells)], counts[cells])
            below.append(kids)
        return {"feature": feature, "goes": way, "children": children, "own": own, "gain": np.where(good, gains[at, best], 0.0),
                "below": np.concatenate(below) if below else np.zeros((0, counts.shape[1]), np.int64)}

    def _binary(self, table: np.ndarray, ordered: bool, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best cut of the bins in two: in their order, or categories by their share of the last class (with more than
        two classes: of the node's most frequent one), which for two classes finds the best of all subsets. ``apart``: one
        bin but the first and all others."""
        m, size, _ = table.shape
        weights = table * self.weights
        order = np.tile(np.arange(size), (m, 1))
        if not ordered and not apart:
            total = weights.sum(axis=2)
            cls = np.full(m, table.shape[2] - 1) if table.shape[2] == 2 else weights.sum(axis=1).argmax(axis=1)
            share = np.take_along_axis(weights, cls[:, None, None], axis=2)[:, :, 0] / np.where(total > 0, total, 1)
            if self.criterion == "variance":  # by mean
                total = table[:, :, 0]
                share = table[:, :, 1] / np.where(total > 0, total, 1)
            order = np.argsort(np.where(total > 0, share, np.inf), axis=1, kind="stable")  # empty bins last
            table = np.take_along_axis(table, order[:, :, None], axis=1)
        left = table.cumsum(axis=1)
        whole = left[:, -1:, :]
        left = whole - table[:, 1:, :] if apart else left[:, :-1, :]
        right = whole - left
        if self.criterion == "variance":
            rows_left, rows_right = left[:, :, 0], right[:, :, 0]
        else:
            rows_left, rows_right = left.sum(axis=2), right.sum(axis=2)
        valid = (rows_left >= self.min_rows) & (rows_right >= self.min_rows) & (rows_left > 0) & (rows_right > 0)
        wl, wr, wt = left * self.weights, right * self.weights, whole * self.weights
        kind = "gini" if self.criterion == "gini" else "entropy"
        sl, sr, st = wl.sum(axis=2), wr.sum(axis=2), wt.sum(axis=2)
        fl, fr = sl / np.where(st > 0, st, 1), sr / np.where(st > 0, st, 1)
        if self.criterion == "variance":
            gain = _variance_gain(left, whole)
        else:
            gain = impurity(wt, kind) - fl * impurity(wl, kind) - fr * impurity(wr, kind)
        gain = np.where(valid, gain, -np.inf)
        value = gain
        if self.criterion == "gain_ratio":
            info = -(fl * np.log(np.where(fl > 0, fl, 1)) + fr * np.log(np.where(fr > 0, fr, 1)))
            value = np.where(valid, gain / np.where(info > 0, info, 1), -np.inf)
        best = gain.argmax(axis=1)  # the cut is chosen by gain; tests of different features by value
        at = np.arange(m)
        way = np.zeros((m, size), np.uint8)
        if apart:
            way[at, best + 1] = 1
            return gain[at, best], value[at, best], way
        np.put_along_axis(way, order, (np.arange(size)[None, :] > best[:, None]).astype(np.uint8), axis=1)
        empty = np.zeros((m, size), bool)
        np.put_along_axis(empty, order, (table[:, :, 0] if self.criterion == "variance" else table.sum(axis=2)) == 0, axis=1)
        if not ordered:  # levels that the node has not seen go with the larger side
            way = np.where(empty, (rows_right[at, best] > rows_left[at, best]).astype(np.uint8)[:, None], way)
        return gain[at, best], value[at, best], way

    def _multiway(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A child a category; at least two of them need ``min_rows`` rows."""
        m, size, _ = table.shape
        rows = table.sum(axis=2)
        weights = table * self.weights
        each, whole = weights.sum(axis=2), weights.sum(axis=1)
        part = each / np.maximum(each.sum(axis=1, keepdims=True), 1e-300)
        gain = impurity(whole, "entropy") - (part * impurity(weights, "entropy")).sum(axis=1)
        info = -(part * np.log(np.where(part > 0, part, 1))).sum(axis=1)
        valid = (rows >= max(1, self.min_rows)).sum(axis=1) >= 2
        way = np.where(rows > 0, (rows > 0).cumsum(axis=1) - 1, 0)
        largest = np.take_along_axis(way, rows.argmax(axis=1)[:, None], axis=1)
        way = np.where(rows > 0, way, largest).astype(np.uint8)
        gain = np.where(valid, gain, -np.inf)
        return gain, np.where(valid, gain / np.where(info > 0, info, 1), -np.inf), way


# --- growing -----------------------------------------------------------------------------------------------

def start(bins: Bins, specs: Sequence[Spec], criterion: str = "gini", class_weights: Mapping | None = None, min_rows: int = 1,
          min_gain: float = 1e-9) -> tuple[Forest, Splitter, list[np.ndarray]]:
    """(forest of bare roots, splitter, features of each spec) that :func:`grow` begins with."""
    if (criterion == "variance") != (bins.target is not None):
        raise ValueError("a numeric label, and only that, is split by variance")
    if not bins.classes or not bins.features:
        raise ValueError("a forest needs a feature and labelled rows")
    specs = list(specs)
    if any(not 0 <= s.bit <= MAX_MODELS for s in specs):
        raise ValueError(f"membership bits run from 0 to {MAX_MODELS}")
    weights = np.array([float((class_weights or {}).get(c, 1.0)) for c in bins.classes])
    k, width, sizes = len(bins.classes), int(bins.sizes().max()), bins.sizes()
    trees = [Tree(i, t, np.full(1, -1), np.zeros(1, np.int64), np.zeros((1, width), np.uint8), np.zeros((1, k), np.int64),
                  np.zeros(1), np.zeros(1, np.int64)) for i, s in enumerate(specs) for t in range(s.trees)]
    forest = Forest(bins, specs, trees, weights)
    choose = Splitter(sizes, bins.ordered(), weights, criterion, min_rows, min_gain, bins.apart())
    allowed = [np.array(sorted(bins.features.index(f) for f in (s.features if s.features is not None else bins.features))) for s in specs]
    return forest, choose, allowed


def grow(table: DataFrame, bins: Bins, specs: Sequence[Spec], max_depth: int = 10, criterion: str = "gini",
         class_weights: Mapping | None = None, min_rows: int = 1, min_gain: float = 1e-9) -> Forest:
    """All trees of all ``specs`` on a binned table (see :func:`bin_table`).

    ``criterion``: "gini" or "entropy" (two children; categories are cut in two by class share), or "gain_ratio" (a
    child a category; of the tests with at least the average gain, that with the best ratio of gain to split
    information), or "variance" for a table binned for a regression. ``min_rows``: least drawn rows of a child. Rows without a label train nothing. A node stays a leaf at
    ``max_depth``, if it is pure or no candidate gains over ``min_gain``. A model without training rows has single
    leaves without counts and predicts the first class.
    """
    forest, choose, allowed = start(bins, specs, criterion, class_weights, min_rows, min_gain)
    specs, trees, k, sizes = forest.specs, forest.trees, len(bins.classes), bins.sizes()
    for depth in range(max_depth):
        todo = []
        for i, tree in enumerate(trees):
            if not len(tree.open):
                continue
            tried = _candidates(tree, tree.open, allowed[tree.spec], specs[tree.spec].mtry, specs[tree.spec].seed)
            for part in _cut(tree.open, tried, sizes, k):
                nodes, some = tree.open[part], tried[part]
                at = np.concatenate([[0], np.cumsum(sizes[some].ravel())])
                todo.append(Work(i, nodes, some, at[:-1].reshape(some.shape), int(at[-1]), depth))
        if not todo:
            break
        for works in _passes(todo, k):
            found = _level(table, forest, works, choose)
            for i, w in enumerate(works):
                if i in found:
                    _extend(trees[w.index], w, found[i], depth + 1, depth + 1 < max_depth, min_rows, bins.target is not None)
        for tree in trees:
            if len(tree.open) and (depth == 0 or tree.jump and tree.jump[0] == depth):  # until it leads to too many nodes
                tree.jump = _jump(tree, depth + 1) or tree.jump
            tree.open = tree.open[tree.depth[tree.open] > depth]
    return forest


def _cut(nodes: np.ndarray, tried: np.ndarray, sizes: np.ndarray, classes: int) -> list[slice]:
    """Slices of a tree's open nodes whose tables stay under CELLS."""
    each = sizes[tried].sum(axis=1).cumsum() * classes // CELLS
    edges = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
    return [slice(a, b) for a, b in zip(edges, [*edges[1:], len(nodes)])]


def _passes(todo: list[Work], classes: int) -> Iterator[list[Work]]:
    held, size = [], 0
    for w in todo:
        if held and size + w.cells * classes > CELLS:
            yield held
            held, size = [], 0
        held.append(w)
        size += w.cells * classes
    if held:
        yield held


def _extend(tree: Tree, work: Work, best: dict, depth: int, more: bool, min_rows: int, target: bool = False) -> None:
    """Adds the children of the split nodes; those that can split again are open."""
    n = len(tree.feature)
    nodes, children = work.nodes, best["children"]
    tree.counts[nodes] = best["own"]
    split = np.flatnonzero(children)
    tree.feature[nodes[split]] = best["feature"][split]
    tree.gain[nodes[split]] = best["gain"][split]
    tree.goes[nodes[split]] = best["goes"][split]
    tree.first[nodes[split]] = n + np.concatenate([[0], np.cumsum(children[split])])[:-1]
    new = int(children.sum())
    below = best["below"]
    tree.feature = np.concatenate([tree.feature, np.full(new, -1)])
    tree.first = np.concatenate([tree.first, n + np.arange(new)])
    tree.goes = np.concatenate([tree.goes, np.zeros((new, tree.goes.shape[1]), np.uint8)])
    tree.counts = np.concatenate([tree.counts, below])
    tree.gain = np.concatenate([tree.gain, np.zeros(new)])
    tree.depth = np.concatenate([tree.depth, np.full(new, depth)])
    if more:
        drawn = below[:, 0] if target else below.sum(axis=1)
        open_ = (target | ((below > 0).sum(axis=1) > 1)) & (drawn >= 2 * max(1, min_rows))
        tree.open = np.concatenate([tree.open, n + np.flatnonzero(open_)])


# --- use ---------------------------------------------------------------------------------------------------

def _votes(forest: Forest, block: tuple, spec: int, out_of_bag: bool = False) -> np.ndarray:
    """Mean class shares (weighted by the trees' votes) of a model's trees for each row of a block; NaN where no tree votes."""
    bins, _, _, h1, h2 = block[:5]
    # rows of the same bins side by side go the same way: the first of each run walks
    new = np.ones(bins.shape[1], bool)
    new[1:] = (bins[:, 1:] != bins[:, :-1]).any(axis=0)
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    bins, rows = np.ascontiguousarray(bins[:, first]), np.arange(len(first))
    s = forest.specs[spec]
    apart = out_of_bag and s.bagged
    size = len(new) if apart else len(first)
    total, n = np.zeros((size, len(forest.bins.classes))), np.zeros(size)
    for tree in forest.of(spec):
        share = tree.vote * forest.shares(tree)[tree.walk(bins, rows, int(tree.depth.max()))]
        if apart:
            some = np.flatnonzero(bag(h1, h2, s.seed, tree.number) == 0)
            total[some] += share[run[some]]
            n[some] += tree.vote
        else:
            total += share
            n += tree.vote
    if not apart:
        total, n = total[run], n[run]
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / n[:, None]


def probabilities(table: DataFrame, forest: Forest, spec: int = 0, out: str = "probability", predicted: str = "predicted") -> DataFrame:
    """``table`` (binned) with the mean class shares of a model's trees and the class of the largest (first of equals)."""
    shared = table.sparkSession.sparkContext.broadcast(pickle.dumps((forest, spec)))
    features = len(forest.bins.features)

    @F.arrow_udf("array<double>")
    def of(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        forest, spec = pickle.loads(shared.value)
        for cols in it:
            bins = np.array([c.to_numpy(zero_copy_only=False) for c in cols], np.int16).reshape(features, -1)
            none = np.zeros(bins.shape[1], np.int64)
            share = _votes(forest, (bins, none, none, none, none), spec)
            flat = pa.array(share.ravel())
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, share.shape[1]), pa.int32()), flat)

    scored = table.withColumn(out, of(*[F.col(f"_b{i}") for i in range(features)]))
    classes = F.array(*[F.lit(c) for c in forest.bins.classes])
    return scored.withColumn(predicted, F.element_at(classes, F.array_position(out, F.array_max(out)).cast("int")))


def confusion(table: DataFrame, forest: Forest, part: Mapping[str, str], out_of_bag: bool = False) -> DataFrame:
    """(model, part, truth, prediction, n) of every model in one pass; counts are summed in each task first.

    ``part[name]`` is an SQL expression over the binned table that names the row's part for that model; rows where it is
    NULL, and rows without a label, are not counted. ``out_of_bag``: only trees that did not draw a row vote on it, and
    rows that every tree drew are left out.
    """
    spark, names = table.sparkSession, [s.name for s in forest.specs]
    features, classes = len(forest.bins.features), len(forest.bins.classes)
    shared = spark.sparkContext.broadcast(pickle.dumps(forest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(shared.value)
        total: dict[tuple, int] = {}
        held: list = []

        def add(held: list) -> None:
            block = next(_blocks(iter(held), features))
            table = pa.Table.from_batches(held)
            for i in range(len(forest.specs)):
                parts = table.column(f"_p{i}").combine_chunks().dictionary_encode()
                code = parts.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                some = np.flatnonzero((code >= 0) & (block[1] >= 0))
                if not len(some):
                    continue
                share = _votes(forest, tuple(x[..., some] for x in block), i, out_of_bag)
                heard = ~np.isnan(share[:, 0])
                cell = ((code[some] * classes + block[1][some]) * classes + np.nan_to_num(share).argmax(axis=1))[heard]
                for c, n in zip(*np.unique(cell, return_counts=True)):
                    key = (i, parts.dictionary[int(c) // classes // classes].as_py(), int(c) // classes % classes, int(c) % classes)
                    total[key] = total.get(key, 0) + int(n)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                add(held)
                held, size = [], 0
        if size:
            add(held)
        rows = [(*k, n) for k, n in total.items()]
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["model", "part", "truth", "prediction", "n"])

    cols = ["_y", "_member", "_h1", "_h2", *[f"_b{i}" for i in range(features)]]
    told = table.select(*cols, *[F.expr(part[n]).cast("string").alias(f"_p{i}") for i, n in enumerate(names)])
    counts = (told.mapInArrow(count, "model int, part string, truth int, prediction int, n bigint")
              .groupBy("model", "part", "truth", "prediction").agg(F.sum("n").alias("n")))
    return named_counts(counts, forest)


def named_counts(counts: DataFrame, forest: Forest) -> DataFrame:
    """Counts by (model, part, truth, prediction) with names in place of numbers."""
    name = F.array(*[F.lit(s.name) for s in forest.specs])
    cls = F.array(*[F.lit(c) for c in forest.bins.classes])
    return counts.select(F.element_at(name, F.col("model") + 1).alias("model"), "part", F.element_at(cls, F.col("truth") + 1).alias("truth"),
                         F.element_at(cls, F.col("prediction") + 1).alias("prediction"), "n")


def importances(forest: Forest, spec: int = 0) -> list[tuple[str, float]]:
    """(feature, share of all gains weighted by drawn rows), largest first: per tree normalised, averaged, normalised."""
    total = np.zeros(len(forest.bins.features))
    for tree in forest.of(spec):
        own = np.zeros(len(total))
        split = tree.feature >= 0
        np.add.at(own, tree.feature[split], tree.gain[split] * (tree.counts[split] * forest.class_weights).sum(axis=1))
        if own.sum() > 0:
            total += own / own.sum()
    total = total / total.sum() if total.sum() > 0 else total
    return sorted(zip(forest.bins.features, total.tolist()), key=lambda t: (-t[1], t[0]))


# --- regression --------------------------------------------------------------------------------------------

#: Least fall of the variance (share of the squared range) of a regression's split: more than rounding makes.
LEAST_FALL = 1e-18


@dataclass
class RegressionForest:
    """Grown regression trees; the prediction is the mean of the trees' leaf means."""

    forest: Forest

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        bins = self.forest.bins
        shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(self.forest))

        @F.arrow_udf("double")
        def of(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            forest = pickle.loads(shared.value)
            bins = forest.bins
            low, unit = bins.target
            edges = {f: np.array(c, np.float64) for f, c in bins.cuts.items()}
            heard = [(t, t.counts[:, 1] / np.maximum(t.counts[:, 0], 1)) for t in forest.trees if t.counts[0, 0]]
            for cols in it:
                codes = np.array([_cut_bins(edges[f], c) if f in edges else _level_bins(bins.levels[f], c)
                                  for f, c in zip(bins.features, cols)], np.int64)
                rows, total = np.arange(codes.shape[1]), np.zeros(codes.shape[1])
                for t, mean in heard:
                    total += mean[t.walk(codes, rows, int(t.depth.max()))]
                yield pa.array(low + unit * total / len(heard)) if heard else pa.nulls(codes.shape[1], pa.float64())

        # binned where it is scored: another function would be another Python worker a task. Not called deterministic, as a
        # filter on the prediction would otherwise be pushed below it and score all rows again
        return df.withColumn(out, of.asNondeterministic()(*[F.col(f"`{f}`").cast("double" if f in bins.cuts else "string") for f in bins.features]))


def regression_forest(df: DataFrame, label: str, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                      trees: int = 100, max_depth: int = 10, max_bins: int = 64, seed: int = 42,
                      exclusive: Sequence[Sequence[str]] = ()) -> RegressionForest:
    """A forest on a numeric label, every feature a candidate at each split; rows without a label train nothing.

    ``exclusive``: groups of numeric features of which a row has one above its least value at most (dummies of a category).
    Their rows are counted once a group; the trees are the same without. Groups that do not hold are not used.
    """
    bins = fit_bins(df, label, numeric, categorical, max_bins, regression=True)
    grouped = group_exclusive(df, bins, exclusive)
    table = bin_table(df, grouped, key, seed)
    forest = grow(table, grouped, [Spec("forest", 0, None, 0, trees, seed)], max_depth, "variance", min_gain=LEAST_FALL)
    return RegressionForest(ungroup(forest, bins))


def ungroup(forest: Forest, bins: Bins) -> Forest:
    """``forest``, grown over groups, with the members' own splits: over ``bins``, from which the groups were made."""
    if not forest.bins.groups:
        return forest
    sizes, place = bins.sizes(), {f: i for i, f in enumerate(bins.features)}
    trees = []
    for t in forest.trees:
        feature, goes = t.feature.copy(), np.zeros((len(t.feature), int(sizes.max())), np.uint8)
        for node in np.flatnonzero(t.feature >= 0):
            f = forest.bins.features[t.feature[node]]
            if f in forest.bins.groups:
                f = forest.bins.groups[f][int(t.goes[node].argmax()) - 1]
                goes[node, 1:sizes[place[f]]] = 1
            else:
                goes[node, :sizes[place[f]]] = t.goes[node, :sizes[place[f]]]
            feature[node] = place[f]
        trees.append(replace(t, feature=feature, goes=goes, jump=None))
    for t in trees:
        jump_far(t)
    return replace(forest, bins=bins, trees=trees)
