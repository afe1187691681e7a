"""Forests over the distinct rows of a binned table, a tree a task (MDL1, MDL3, MDL6, MDL12, DOR4).

Rows of the same bins and class (a cell) go the same way in every tree, so all a tree needs of them is how often it draws
them together. ``fold_rows`` sorts a binned table (see :mod:`.forest`) by cell once and adds up, per cell, each measure the
models ask for: rows of a kind, draws of a bag, copies. The numbers are whole, so trees, votes and confusions are those of
the row by row passes, bit by bit.

Cells are as many as the bins allow and not as the rows: where they stay under MAX_CELLS, their bins are handed to all
tasks, and each task reads the totals of one measure and grows the trees that use it to the end, without a pass a level.
Where they do not, ``fold_rows`` returns None and the level-wise passes of :func:`.forest.grow` do the work.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import forest as H

#: Cells at most (a task holds their bins, a byte a feature); kinds of rows; measures; bits of a packed code.
MAX_CELLS, MAX_KINDS, MAX_MEASURES, CODE_BITS = 1 << 22, 512, 8192, 62
#: Rows that are folded at a time, at most; numbers that a task holds before it sends them on; rows a sorted part has at most.
PIECE, HELD, PART_ROWS = 1 << 17, 1 << 23, 1_000_000
#: Cells that a tree works on at a time.
BLOCK = 1 << 14


@dataclass(frozen=True)
class Measure:
    """What is added up over the rows of ``kinds``: 1 a row, a tree's draws (``bag``: seed, number), or 1 and the copies
    (column, shift, mask) of each."""

    kinds: tuple[int, ...]
    bag: tuple[int, int] | None = None
    copies: tuple[str, int, int] | None = None


@dataclass
class Cells:
    """Chunks of cells: (chunk, measure, n, data); measure -1 holds the bins and classes, the others their totals."""

    chunks: DataFrame
    bins: H.Bins
    kinds: list[dict]  # of rows: the values of ``_member`` and of the kept columns
    measures: dict[Measure, int]
    rows: DataFrame | None = None  # the binned rows in the order of their cells, where they were asked for
    held: tuple | None = None

    def of(self, bit: int) -> tuple[int, ...]:
        """Kinds whose rows train the models of a membership bit."""
        return tuple(i for i, k in enumerate(self.kinds) if k["_member"] >> bit & 1)

    def part(self, spark, sql: str) -> dict[str, tuple[int, ...]]:
        """{part: kinds} by an SQL expression over ``_member`` and the kept columns; kinds where it is NULL are left out."""
        rows = self._told(spark).select("_kind", F.expr(sql).cast("string").alias("part")).collect()
        out: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["_kind"]):
            if r["part"] is not None:
                out.setdefault(r["part"], []).append(r["_kind"])
        return {p: tuple(k) for p, k in out.items()}

    def _told(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *k.values()) for i, k in enumerate(self.kinds)], self.schema)

    schema: str = ""

    def codes(self) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """(first cell of each chunk, bins as a row a feature, class) of all cells."""
        if self.held is None:
            found = sorted((r["chunk"], r["n"], r["data"]) for r in self.chunks.where("measure = -1").select("chunk", "n", "data").collect())  # under MAX_CELLS
            starts = np.concatenate([[0], np.cumsum([n for _, n, _ in found])]).astype(np.int64)
            rows = [np.frombuffer(d, np.uint8).reshape(-1, n) for _, n, d in found]
            whole = np.concatenate(rows, axis=1) if rows else np.zeros((len(self.bins.features) + 1, 0), np.uint8)
            self.held = {c: int(s) for (c, _, _), s in zip(found, starts)}, whole[:-1], whole[-1]
        return self.held


def kind_measures(cells_kinds: int) -> list[Measure]:
    return [Measure((i,)) for i in range(cells_kinds)]


def spec_measure(cells: Cells, spec: H.Spec) -> Measure:
    """The measure that holds how often each cell trains a tree of the spec (by the tree's number, see :func:`tree_measure`)."""
    return Measure(cells.of(spec.bit), None, spec.weigh.copies if spec.weigh else None)


def tree_measure(cells: Cells, spec: H.Spec, number: int) -> Measure:
    return Measure(cells.of(spec.bit), (spec.seed, number)) if spec.bagged else spec_measure(cells, spec)


# --- folding -------------------------------------------------------------------------------------------------

def _radices(bins: H.Bins) -> list[list[tuple[int, int]]]:
    """(place among bins and class, size) of the digits of each packed code, the class last."""
    sizes = [*bins.sizes().tolist(), len(bins.classes)]
    words, bits = [[]], 0.0
    for i, s in enumerate(sizes):
        more = float(np.log2(max(s, 2)))
        if bits + more > CODE_BITS:
            words.append([])
            bits = 0.0
        words[-1].append((i, s))
        bits += more
    return words


def _packed(words: list[list[tuple[int, int]]], features: int) -> list:
    out = []
    for i, word in enumerate(words):
        code = F.lit(0).cast("bigint")
        for at, size in word:
            code = code * F.lit(size) + F.col(f"_b{at}" if at < features else "_y").cast("bigint")
        out.append(code.alias(f"_c{i}"))
    return out


def _unpacked(words: list[list[tuple[int, int]]], codes: Sequence[np.ndarray]) -> np.ndarray:
    """Bins and class, a row each."""
    out = np.empty((sum(len(w) for w in words), len(codes[0])), np.uint8)
    for word, code in zip(words, codes):
        for at, size in reversed(word):
            code, digit = np.divmod(code, size)
            out[at] = digit
    return out


def _few(labelled: DataFrame, bins: H.Bins, names: Sequence[str]) -> tuple[list, bool]:
    """(kinds with their rows, are the distinct (bins, class) under MAX_CELLS?) by one pass: at most the product of the bins'
    sizes or the rows, or else by a sketch of each kind, put together."""
    spark = labelled.sparkSession
    most = float(np.prod([*bins.sizes().astype(float), len(bins.classes)]))
    if min(most, MAX_CELLS if bins.rows is None else bins.rows) < MAX_CELLS:
        return labelled.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).limit(MAX_KINDS + 1).collect(), True
    row = F.xxhash64(*[f"_b{i}" for i in range(len(bins.features))], "_y")
    found = labelled.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.hll_sketch_agg(row, F.lit(14)).alias("_s")).limit(MAX_KINDS + 1).collect()
    sketches = spark.createDataFrame([(bytes(r["_s"]),) for r in found], "s binary")
    return found, (sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()[0] or 0) <= 0.95 * MAX_CELLS


def fold_rows(table: DataFrame, bins: H.Bins, measures, keep: Sequence[str] = (), rows: bool = False) -> Cells | None:
    """The cells of a binned table with the totals of ``measures(cells)`` and of every kind's rows; None if cells are many.

    A kind is a combination of ``_member`` and the ``keep`` columns; parts and training rows are sets of kinds. Rows are
    sorted by cell over all tasks, with the row's hash behind it: a cell of any number of rows is dealt to several tasks
    and its totals come in parts, which add up like cells. ``rows`` keeps the sorted rows.
    """
    if bins.target or not bins.classes or not bins.features:
        return None
    spark, features = table.sparkSession, len(bins.features)
    labelled = table.where("_y >= 0")
    names = ["_member", *keep]
    found, few = _few(labelled, bins, names)
    if not few or len(found) > MAX_KINDS or not found:
        return None
    kinds = sorted(({c: r[c] for c in names} for r in found), key=lambda k: [(v is None, str(v)) for v in k.values()])
    schema = "_kind int, " + ", ".join(f"{c} {t}" for c, t in table.select(*names).dtypes)
    cells = Cells(table, bins, kinds, {}, schema=schema)
    wanted = list(dict.fromkeys([*kind_measures(len(kinds)), *measures(cells)]))
    if len(wanted) > MAX_MEASURES:
        return None
    cells.measures = {m: i for i, m in enumerate(wanted)}
    words = _radices(bins)
    codes = [f"_c{i}" for i in range(len(words))]
    extra = sorted({m.copies[0] for m in wanted if m.copies})
    told = labelled.join(F.broadcast(cells._told(spark).select("_kind", *[F.col(c).alias(f"_k_{c}") for c in names])),
                         [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names])
    more = ["_y", "_member", *[f"_b{i}" for i in range(features)]] if rows else []
    told = told.select(*_packed(words, features), "_kind", "_h1", "_h2", *extra, *more)
    parts = max(H.TASKS * spark.sparkContext.defaultParallelism, sum(r["_n"] for r in found) // PART_ROWS)
    parts = max(1, min(parts, sum(r["_n"] for r in found) // H.TASK_ROWS))
    told = told.repartitionByRange(parts, *codes, "_kind", "_h1").sortWithinPartitions(*codes, "_kind")
    if rows:
        told = cells.rows = cut_lineage(told)
    shared = spark.sparkContext.broadcast(pickle.dumps((wanted, words, len(kinds))))
    width = len(words)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, words, kinds = pickle.loads(shared.value)
        task, sent = TaskContext.get().partitionId(), 0
        bags = list(dict.fromkeys(m.bag for m in wanted if m.bag))
        copies = list(dict.fromkeys(m.copies for m in wanted if m.copies))
        of = {b: [(i, m.kinds) for i, m in enumerate(wanted) if (m.bag or m.copies) == b] for b in [*bags, *copies, None]}

        def totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """(bins and classes, measures by cell) of some sorted rows."""
            col = lambda name: table.column(name).to_numpy()
            code, kind = [col(f"_c{i}") for i in range(width)], col("_kind")
            new = np.ones(len(kind), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in code])
            first = np.flatnonzero(new)
            new[1:] |= kind[1:] != kind[:-1]
            start = np.flatnonzero(new)
            cell, kind = np.searchsorted(first, start, side="right") - 1, kind[start]
            out = np.zeros((len(wanted), len(first)), np.int64)
            each = np.zeros((kinds, len(first)), np.int64)

            def put(what, sums: np.ndarray) -> None:
                each[kind, cell] = sums  # a kind has one run a cell
                for i, some in of[what]:
                    for k in some:
                        out[i] += each[k]

            put(None, np.diff(start, append=table.num_rows))
            if bags:
                h1, h2 = (col(c).view(np.uint64) for c in ("_h1", "_h2"))
            for b in bags:
                put(b, np.add.reduceat(H.bag(h1, h2, *b), start, dtype=np.int64))
            for name, shift, mask in copies:
                put((name, shift, mask), np.add.reduceat(1 + ((col(name) >> shift) & mask), start, dtype=np.int64))
            return _unpacked(words, [c[first] for c in code]), out

        def send(done: list) -> pa.RecordBatch:
            nonlocal sent
            codes, sums = (np.concatenate(x, axis=1) for x in zip(*done))
            data = [codes.tobytes(), *[row.astype(_least(row)).tobytes() for row in sums]]
            n, m = codes.shape[1], len(data)
            chunk, sent = (task << 32) + sent, sent + 1
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk, np.int64)), pa.array(np.arange(-1, m - 1, dtype=np.int32)),
                                               pa.array(np.full(m, n, np.int32)), pa.array(data, pa.binary())], ["chunk", "measure", "n", "data"])

        piece = max(1, min(PIECE, HELD // len(wanted)))
        held, size, done, numbers = [], 0, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= piece:
                done.append(totals(pa.Table.from_batches(held)))
                numbers += done[-1][1].size
                held, size = [], 0
            if numbers >= HELD:
                yield send(done)
                done, numbers = [], 0
        if size:
            done.append(totals(pa.Table.from_batches(held)))
        if done:
            yield send(done)

    cells.chunks = cut_lineage(told.mapInArrow(fold, "chunk bigint, measure int, n int, data binary"))
    return cells


def _least(row: np.ndarray) -> type:
    """The shortest type that holds a row of counts."""
    top = int(row.max()) if len(row) else 0
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64


def _numbers(data, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) // max(n, 1)])


# --- growing -------------------------------------------------------------------------------------------------

def grow(cells: Cells, specs: Sequence[H.Spec], max_depth: int = 10, criterion: str = "gini", class_weights: Mapping | None = None,
         min_rows: int = 1, min_gain: float = 1e-9, missed: Mapping[int, Sequence[tuple[H.Tree, float]]] | None = None) -> H.Forest:
    """What :func:`.forest.grow` makes of the table's rows: equal trees.

    ``missed``: of each spec's place the earlier trees whose misses raise a cell's weight, and the factor of each; they
    take the place of ``Weigh.misses``.
    """
    spark = cells.chunks.sparkSession
    forest, choose, allowed = H.start(cells.bins, specs, criterion, class_weights, min_rows, min_gain)
    need: dict[int, list[int]] = {}
    for i, tree in enumerate(forest.trees):
        need.setdefault(cells.measures[tree_measure(cells, forest.specs[tree.spec], tree.number)], []).append(i)
    if not forest.trees:
        return forest
    place = {m: p for p, m in enumerate(need)}
    shared = spark.sparkContext.broadcast((cells.codes(), forest, choose, allowed, need, dict(missed or {})))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, bins, y), forest, choose, allowed, need, missed = shared.value
        times, measure = np.zeros(len(y), np.int64), None
        for batch in batches:
            for chunk, of, n, data in zip(*(batch.column(c).to_pylist() if c < 3 else batch.column(c) for c in (0, 1, 2, 3))):
                measure = of
                data = data.as_buffer()
                times[starts[chunk]:starts[chunk] + n] = _numbers(data, n)
        for i in need[measure] if measure is not None else ():
            tree = forest.trees[i]
            _grown(tree, forest.specs[tree.spec], bins, y, times, allowed[tree.spec], choose, max_depth, min_rows, missed.get(tree.spec, ()))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], ["tree", "grown"])

    at = F.element_at(F.create_map(*[F.lit(v) for kv in place.items() for v in kv]), F.col("measure"))
    told = cells.chunks.where(F.col("measure").isin(*need)).select("chunk", "measure", "n", "data", at.alias("_p"))
    rows = told.repartitionById(len(place), F.col("_p")).drop("_p").mapInArrow(make, "tree int, grown binary").collect()  # a row a tree
    shared.unpersist()
    for r in rows:
        forest.trees[r["tree"]] = pickle.loads(r["grown"])
    return forest


def _grown(tree: H.Tree, spec: H.Spec, bins: np.ndarray, y: np.ndarray, times: np.ndarray, allowed: np.ndarray, choose: H.Splitter,
           max_depth: int, min_rows: int, missed: Sequence[tuple[H.Tree, float]]) -> None:
    """Grows a tree to the end over the cells and how often it draws each."""
    classes = tree.counts.shape[1]
    width = tree.goes.shape[1]
    blocks = []  # bins, class, weight, node of the cells that are in open nodes
    for a in range(0, len(y), BLOCK):
        some = a + np.flatnonzero(times[a:a + BLOCK])
        if not len(some):
            continue
        mine, w, cls = bins[:, some], times[some], y[some].astype(np.int64)
        if spec.weigh:
            w = w * np.maximum(np.rint(_factors(mine, cls, missed, spec.weigh.unit)), 1.0).astype(np.int64)
        blocks.append([mine, cls, w, np.zeros(len(some), np.int64)])
    sizes = choose.sizes
    for depth in range(max_depth):
        if not len(tree.open):
            break
        tried = H._candidates(tree, tree.open, allowed, spec.mtry, spec.seed)
        works = []
        for part in H._cut(tree.open, tried, sizes, classes):
            nodes, some = tree.open[part], tried[part]
            at = np.concatenate([[0], np.cumsum(sizes[some].ravel())])
            works.append(H.Work(0, nodes, some, at[:-1].reshape(some.shape), int(at[-1]), depth))
        found = []
        for work in works:
            out = np.zeros(work.cells * classes, np.int64)
            place = np.full(len(tree.feature), -1)
            place[work.nodes] = np.arange(len(work.nodes))
            whole = len(works) == 1
            one = (work.tried == work.tried[0]).all(axis=0)
            for mine, cls, w, node in blocks:
                p = place[node]
                if whole:
                    rows, c, t = None, cls, w
                else:
                    rows = np.flatnonzero(p >= 0)
                    p, c, t = p[rows], cls[rows], w[rows]
                flat = mine.ravel()
                for j in range(work.tried.shape[1]):
                    if one[j]:
                        code = mine[work.tried[0, j]] if rows is None else mine[work.tried[0, j]][rows]
                    else:
                        code = (work.tried[:, j] * mine.shape[1])[p]
                        code += np.arange(mine.shape[1]) if rows is None else rows
                        code = flat[code]
                    cell = work.at[:, j][p]
                    cell += code
                    cell *= classes
                    cell += c
                    np.add.at(out, cell, t)
            if out.any():
                found.append((work, choose(work, out.reshape(-1, classes))))
        for work, best in found:
            H._extend(tree, work, best, depth + 1, depth + 1 < max_depth, min_rows)
        tree.open = tree.open[tree.depth[tree.open] > depth]
        if not len(tree.open):
            break
        open_, goes = np.zeros(len(tree.feature), bool), tree.goes.ravel()
        open_[tree.open] = True
        left = []
        for mine, cls, w, node in blocks:
            code = (np.maximum(tree.feature, 0) * mine.shape[1])[node]
            code += np.arange(len(node))
            code = mine.ravel()[code]
            to = node * width
            to += code
            to = tree.first[node] + goes[to]
            stay = open_[to]
            if stay.all():
                left.append([mine, cls, w, to])
            elif stay.any():
                some = np.flatnonzero(stay)
                left.append([mine[:, some], cls[some], w[some], to[some]])
        blocks = left
    tree.open = tree.open[:0]
    H.jump_far(tree)


def _factors(mine: np.ndarray, cls: np.ndarray, missed: Sequence[tuple[H.Tree, float]], unit: float) -> np.ndarray:
    weight, rows = np.full(len(cls), unit), np.arange(len(cls))
    for tree, factor in missed:
        said = tree.counts.argmax(axis=1)[tree.walk(mine, rows, int(tree.depth.max()))]
        weight *= np.where(said != cls, factor, 1.0)
    return weight


# --- use -----------------------------------------------------------------------------------------------------

def by_chunk(cells: Cells, measures: Sequence[int], each, schema: str) -> DataFrame:
    """``each(bins, class, {measure: totals})`` of every chunk's cells; yields record batches of ``schema``. A chunk's rows read by one task."""
    wanted = frozenset(measures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            for chunk, of, n, data in zip(*(batch.column(c).to_pylist() if c < 3 else batch.column(c) for c in (0, 1, 2, 3))):
                data = data.as_buffer()
                mine = held.setdefault(chunk, {})
                mine[of] = np.frombuffer(data, np.uint8).reshape(-1, n) if of < 0 else _numbers(data, n).astype(np.int64)
                if len(mine) == len(wanted) + 1:
                    codes = held.pop(chunk).pop(-1)
                    yield from each(codes[:-1], codes[-1].astype(np.int64), mine)

    told = cells.chunks.where(F.col("measure").isin(-1, *wanted)).select("chunk", "measure", "n", "data")
    chunks = list(cells.codes()[0])
    if len(chunks) > MAX_MEASURES:
        return told.repartition(MAX_MEASURES, "chunk").mapInArrow(run, schema)
    at = F.element_at(F.create_map(*[F.lit(v) for kv in zip(chunks, range(len(chunks))) for v in kv]), F.col("chunk"))
    return told.repartitionById(len(chunks), at).mapInArrow(run, schema)  # a chunk a task


def confusion(cells: Cells, forest: H.Forest, part: Mapping[str, str]) -> DataFrame:
    """(model, part, truth, prediction, n) as :func:`.forest.confusion` counts them row by row."""
    spark = cells.chunks.sparkSession
    parts = {sql: cells.part(spark, sql) for sql in dict.fromkeys(part[s.name] for s in forest.specs)}
    told = [parts[part[s.name]] for s in forest.specs]
    shared = spark.sparkContext.broadcast(pickle.dumps((forest, told)))
    used = sorted({k for t in told for some in t.values() for k in some})

    def each(bins: np.ndarray, y: np.ndarray, rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if "loaded" not in memo:
            memo["loaded"] = pickle.loads(shared.value)
        forest, told = memo["loaded"]
        classes, total = len(forest.bins.classes), []
        for i, mine in enumerate(told):
            counts = {p: np.zeros(classes * classes, np.int64) for p in mine}
            for a in range(0, len(y), H.BLOCK):
                some = slice(a, a + H.BLOCK)
                none = np.zeros(len(y[some]), np.int64)
                share = H._votes(forest, (np.ascontiguousarray(bins[:, some]), none, none, none, none), i)
                heard = ~np.isnan(share[:, 0])
                cell = y[some] * classes + np.nan_to_num(share).argmax(axis=1)
                for p, of in mine.items():
                    np.add.at(counts[p], cell[heard], sum(rows[k][some] for k in of)[heard])
            total += [(i, p, int(c) // classes, int(c) % classes, int(n[c])) for p, n in counts.items() for c in np.flatnonzero(n)]
        cols = list(zip(*total)) if total else [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["model", "part", "truth", "prediction", "n"])

    memo: dict = {}
    counts = (by_chunk(cells, used, each, "model int, part string, truth int, prediction int, n bigint")
              .groupBy("model", "part", "truth", "prediction").agg(F.sum("n").alias("n")))
    return H.named_counts(counts, forest)
