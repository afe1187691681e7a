"""Polynomial-kernel support vector machines on an explicit feature map, all folds fitted together (MDL7, DOR5).

The kernel (gamma x.y + coef0) ** degree is a product of feature vectors of finite size. ``PolyMap`` gives them exactly
(every monomial, weighted by the root of its coefficient) or, where these are too many, as a tensor sketch: ``degree``
count sketches of the row multiplied by fast Fourier transforms, whose products have the kernel as their mean.

The machine minimises |w|^2 / 2 + cost * sum of weighted squared hinge losses by Newton steps. One pass of the table per
step adds up, for every model (fold, final fit), the gradient and Hessian over the rows inside its margin; rows are
mapped in the tasks, once for all models, and only matrices of dims x dims leave them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .features import fit_levels
from .forest import deal

#: Dimensions of a map at most (a task holds dims ** 2 numbers a model), and rows mapped at a time.
MAX_DIMS, BLOCK = 2048, 2048
#: Rows in the margins of the same models from which their product is worked out once.
SHARED = 32
#: Combinations of levels at most for which rows are kept apart, and rows of one that are packed together.
MAX_PATTERNS, PACKED = 64, 1 << 16
#: Newton steps at most; a step that changes the weights by less than this share ends the fit.
STEPS, TOLERANCE = 25, 1e-4
#: Columns of predictors at most.
MAX_COLUMNS = 5000


# --- maps --------------------------------------------------------------------------------------------------

class PolyMap:
    """Feature vectors whose products are (gamma x.y + coef0) ** degree.

    ``dims`` 0: exactly, by comb(d' + degree - 1, degree) weighted monomials (d' = d, one more with coef0); else a
    tensor sketch of ``dims`` numbers, right on average, with an error that falls as 1 / sqrt(dims).
    """

    def __init__(self, d: int, degree: int = 3, dims: int = 0, gamma: float | None = None, coef0: float = 0.0, seed: int = 42):
        self.gamma, self.coef0, self.degree = 1.0 / max(d, 1) if gamma is None else gamma, coef0, degree
        inner = d + (coef0 > 0)
        if dims:
            rng = np.random.default_rng(seed)
            self.place = rng.integers(0, dims, (degree, inner))
            self.sign = rng.choice(np.array([-1.0, 1.0]), (degree, inner))
            self.dims, self.monomials = dims, None
        else:
            self.monomials = np.array(list(combinations_with_replacement(range(inner), degree)), np.int64).reshape(-1, degree)
            repeats = [[math.factorial(c) for c in np.unique(m, return_counts=True)[1].tolist()] for m in self.monomials]
            self.root = np.sqrt([math.factorial(degree) / math.prod(r) for r in repeats])
            self.dims = len(self.monomials)
        if self.dims > MAX_DIMS:
            raise ValueError(f"{self.dims} dimensions: at most {MAX_DIMS}; choose a tensor sketch (dims) of fewer")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x * math.sqrt(self.gamma)
        if self.coef0 > 0:
            x = np.hstack([x, np.full((len(x), 1), math.sqrt(self.coef0))])
        if self.monomials is not None:
            x = np.ascontiguousarray(x.T)  # whole columns are gathered
            z = x[self.monomials[:, 0]] if self.degree else np.ones((self.dims, x.shape[1]))
            for k in range(1, self.degree):
                z *= x[self.monomials[:, k]]
            z *= self.root[:, None]
            return np.ascontiguousarray(z.T)
        total = None
        for place, sign in zip(self.place, self.sign):
            sketch = np.zeros((len(x), self.dims))
            for j, (at, s) in enumerate(zip(place.tolist(), sign.tolist())):
                sketch[:, at] += s * x[:, j]
            turned = np.fft.rfft(sketch, axis=1)
            total = turned if total is None else total * turned
        return np.fft.irfft(total, n=self.dims, axis=1)


# --- table -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scaled:
    """Predictors as standardised numbers: (column, level or None, mean, deviation), and the two classes in order."""

    label: str
    classes: list
    columns: list[tuple[str, str | None, float, float]]
    rows: int | None = None  # of the table the scaling was made from


def _raw(column: str, level: str | None) -> Column:
    if level is None:
        return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None))
    return F.coalesce((F.col(f"`{column}`").cast("string") == F.lit(level)).cast("double"), F.lit(0.0))


def fit_scaled(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Scaled:
    """Mean and population deviation of numbers and of a dummy for every level; columns without spread are left out."""
    levels = fit_levels(df, list(categorical)) if categorical else {}
    terms = [(c, None) for c in numeric] + [(c, v) for c, vs in levels.items() for v in vs]
    if len(terms) > MAX_COLUMNS:
        raise ValueError(f"{len(terms)} predictors: at most {MAX_COLUMNS}")
    row = df.agg(*[f(_raw(*t)).alias(f"{n}{i}") for i, t in enumerate(terms) for n, f in (("m", F.avg), ("s", F.stddev_pop))],
                 F.count(F.lit(1)).alias("rows")).first()
    columns = [(c, v, row[f"m{i}"], row[f"s{i}"]) for i, (c, v) in enumerate(terms) if row[f"s{i}"]]
    classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(3).collect()]
    if len(classes) > 2:
        raise ValueError(f"{label}: a support vector machine tells two classes apart")
    return Scaled(label, classes, columns, row["rows"])


def scale_table(df: DataFrame, scaled: Scaled, keep: Sequence = (), member: Column | None = None) -> DataFrame:
    """Written once: ``keep`` columns, ``_y`` (-1, 1; 0 without a label), ``_member`` (bits of the models that train on the
    row), ``_x0`` ... (a gap has the column's mean, 0); in even partitions for all cores."""
    y = F.lit(0)
    for c, v in zip(scaled.classes, (-1, 1)):
        y = F.when(F.col(f"`{scaled.label}`") == F.lit(c), v).otherwise(y)
    xs = [F.coalesce((_raw(c, v) - F.lit(m)) / F.lit(s), F.lit(0.0)).alias(f"_x{i}") for i, (c, v, m, s) in enumerate(scaled.columns)]
    table = df.select(*keep, y.cast("int").alias("_y"), (F.lit(1) if member is None else member).cast("bigint").alias("_member"), *xs)
    return cut_lineage(deal(table, scaled.rows))


@dataclass(frozen=True)
class Machine:
    """One model: a name and the membership bit of its training rows."""

    name: str
    bit: int = 0


@dataclass
class Machines:
    """Fitted machines over one map: weights (the last is the constant) a model, and the steps taken."""

    scaled: Scaled
    map: PolyMap
    specs: list[Machine]
    weights: np.ndarray
    steps: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = self.map(x)
        return z @ self.weights[:, :-1].T + self.weights[:, -1]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(predictors, rows) of at most BLOCK rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            x = np.empty((part.num_rows, d))
            for i in range(d):
                x[:, i] = part.column(f"_x{i}").to_numpy(zero_copy_only=False)
            yield x, part


# --- fit ---------------------------------------------------------------------------------------------------

def _products(z: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """For each model (column of ``inside``) the product z' z of its rows.

    Folds overlap, so most rows lie inside the margins of the same few sets of models: the product of the rows of a set is
    worked out once and added to each model in it. Rows of sets that few share are left to each model.
    """
    size, models = z.shape[1], inside.shape[1]
    out = [np.zeros((size, size)) for _ in range(models)]
    sets = inside @ (np.int64(1) << np.arange(models)) if models < 63 else np.packbits(inside, axis=1)
    found, which, n = np.unique(sets, axis=None if models < 63 else 0, return_inverse=True, return_counts=True)
    which, rest = which.ravel(), np.zeros(len(z), bool)
    for k in range(len(found)):
        rows = np.flatnonzero(which == k)
        of = np.flatnonzero(inside[rows[0]])
        if n[k] < SHARED and len(of):
            rest[rows] = True
        elif len(of):
            part = z[rows]
            part = part.T @ part
            for j in of:
                out[j] += part
    for j in range(models):
        part = z[rest & inside[:, j]]
        if len(part):
            out[j] += part.T @ part
    return out


def _sums(table: DataFrame, fitted: Machines, open_: list[int], class_weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each open model: sum of c z z', of c z y over the rows inside its margin, and its loss, by one pass."""
    sc, size = table.sparkSession.sparkContext, fitted.map.dims + 1
    d = len(fitted.scaled.columns)
    shared = sc.broadcast(pickle.dumps((fitted, open_, class_weights)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, open_, class_weights = pickle.loads(shared.value)
        total = {m: np.zeros((size + 1, size)) for m in open_}
        loss = dict.fromkeys(open_, 0.0)
        for x, part in _blocks(batches, d):
            y, member = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_member"))
            z = np.hstack([fitted.map(x), np.ones((len(x), 1))])
            margin = z @ fitted.weights[open_].T
            cost = class_weights[(y > 0).astype(int)]
            bits = np.array([fitted.specs[m].bit for m in open_])
            inside = (y != 0)[:, None] & (member[:, None] >> bits & 1 == 1) & (y[:, None] * margin < 1)
            for j, h in enumerate(_products(z * np.sqrt(cost)[:, None], inside)):
                total[open_[j]][:size] += h
            slopes = z.T @ (inside * (cost * y)[:, None])
            losses = (inside * cost[:, None] * (1 - y[:, None] * margin) ** 2).sum(axis=0)
            for j, m in enumerate(open_):
                total[m][size] += slopes[:, j]
                loss[m] += float(losses[j])
        for m in open_:
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([total[m].tobytes()], pa.binary()), pa.array([loss[m]])], ["model", "sums", "loss"])

    return _merged_sums(table.mapInArrow(add, _SUMS), len(open_), size, shared)


_SUMS = "model int, sums binary, loss double"


def _merged_sums(parts: DataFrame, models: int, size: int, shared) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for m, raw, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = np.frombuffer(raw)
                total[m] = [total[m][0] + part, total[m][1] + loss] if m in total else [part.copy(), loss]
        for m, (sums, loss) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([loss])], ["model", "sums", "loss"])

    rows = parts.repartition(models, "model").mapInArrow(merge, _SUMS).collect()  # a row a model
    shared.unpersist()
    out = {}
    for r in rows:
        sums = np.frombuffer(r["sums"]).reshape(size + 1, size)
        out[r["model"]] = sums[:size], sums[size], r["loss"]
    return out


# --- rows of the same levels ---------------------------------------------------------------------------------

class Packed(NamedTuple):
    """Rows of a scaled table by the pattern of their dummies: (pattern, n, data). Among the rows of a pattern the map is a
    matrix times the monomials, up to the degree, of the numbers alone: sums are taken over these, which are fewer."""

    rows: DataFrame
    numbers: list[int]  # columns that are no dummies
    powers: np.ndarray  # monomials of them: a row each of places in (1, numbers ...)
    turn: dict[int, np.ndarray]  # of each pattern: (dims + 1, monomials), the last row for the constant


def _patterns(scaled: Scaled) -> tuple[list[int], list[int], np.ndarray]:
    """(numbers, dummies, both values of each dummy)."""
    of = [i for i, c in enumerate(scaled.columns) if c[1] is not None]
    return ([i for i in range(len(scaled.columns)) if i not in of], of,
            np.array([[(v - scaled.columns[i][2]) / scaled.columns[i][3] for v in (0.0, 1.0)] for i in of]).reshape(-1, 2))


def _turn(mapped: PolyMap, numbers: list[int], powers: np.ndarray, dummies: dict[int, float]) -> np.ndarray:
    place = {tuple(p): i for i, p in enumerate(powers.tolist())}
    at = {c: i + 1 for i, c in enumerate(numbers)}
    scale = math.sqrt(mapped.gamma)
    out = np.zeros((mapped.dims + 1, len(powers)))
    for row, (monomial, root) in enumerate(zip(mapped.monomials.tolist(), mapped.root)):
        value, left = float(root), []
        for c in monomial:
            if c in at:
                value *= scale
                left.append(at[c])
            else:  # a dummy, or the constant that coef0 stands for
                value *= dummies[c] * scale if c in dummies else math.sqrt(mapped.coef0)
        out[row, place[tuple(sorted([0] * (mapped.degree - len(left)) + left))]] += value
    out[mapped.dims, place[(0,) * mapped.degree]] = 1.0
    return out


def pack(table: DataFrame, scaled: Scaled, mapped: PolyMap) -> Packed | None:
    """None where it would not pay: the map is a sketch, the numbers' monomials are not much fewer, or patterns are many."""
    numbers, dummies, values = _patterns(scaled)
    if mapped.monomials is None or not dummies or len(dummies) > 62 or 2 * math.comb(len(numbers) + mapped.degree, mapped.degree) > mapped.dims:
        return None
    bits = sum(((F.col(f"_x{i}") > 0).cast("bigint") * F.lit(1 << j) for j, i in enumerate(dummies)), F.lit(0).cast("bigint"))
    found = [r[0] for r in table.where("_y <> 0").select(bits.alias("p")).distinct().limit(MAX_PATTERNS + 1).collect()]
    if len(found) > MAX_PATTERNS:
        return None
    powers = np.array(list(combinations_with_replacement(range(len(numbers) + 1), mapped.degree)), np.int64).reshape(-1, mapped.degree)
    turn = {p: _turn(mapped, numbers, powers, {i: float(values[j, p >> j & 1]) for j, i in enumerate(dummies)}) for p in found}
    names = [f"_x{i}" for i in numbers]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            col = lambda name: rows.column(name).to_numpy()
            pattern = col("_pattern")
            order = np.argsort(pattern, kind="stable")
            which, first = np.unique(pattern[order], return_index=True)
            parts = np.split(order, first[1:])
            x = np.array([col(c) for c in names]).reshape(len(names), -1)
            data = [b"".join((x[:, at].tobytes(), col("_member")[at].tobytes(), col("_y")[at].astype(np.int8).tobytes())) for at in parts]
            return pa.RecordBatch.from_arrays([pa.array(which), pa.array([len(at) for at in parts], pa.int32()), pa.array(data, pa.binary())], ["pattern", "n", "data"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    told = table.where("_y <> 0").select(*names, "_member", "_y", bits.alias("_pattern"))
    return Packed(cut_lineage(told.mapInArrow(put, "pattern bigint, n int, data binary")), numbers, powers, turn)


def _packed_sums(packed: Packed, fitted: Machines, open_: list[int], class_weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """What :func:`_sums` finds, from the packed rows."""
    size, d = fitted.map.dims + 1, len(packed.numbers)
    shared = packed.rows.sparkSession.sparkContext.broadcast(pickle.dumps((packed.powers, packed.turn, fitted.weights, [fitted.specs[m].bit for m in open_], open_, class_weights)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, turn, weights, bits, open_, class_weights = pickle.loads(shared.value)
        few, bits = len(powers), np.array(bits)
        sums: dict[int, np.ndarray] = {}
        loss = np.zeros(len(open_))
        for batch in batches:
            for pattern, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_buffer()
                numbers = np.frombuffer(data, np.float64, d * n).reshape(d, n)
                member, y = np.frombuffer(data, np.int64, n, 8 * d * n), np.frombuffer(data, np.int8, n, 8 * (d + 1) * n)
                mine = sums.setdefault(pattern, np.zeros((len(open_), few + 1, few)))
                w = weights[open_] @ turn[pattern]
                for a in range(0, n, BLOCK):
                    some = slice(a, a + BLOCK)
                    x = np.vstack([np.ones((1, len(y[some]))), numbers[:, some]])
                    m = x[powers[:, 0]] if powers.shape[1] else np.ones((1, x.shape[1]))
                    for k in range(1, powers.shape[1]):
                        m *= x[powers[:, k]]
                    sign = y[some].astype(np.float64)
                    cost = class_weights[(y[some] > 0).astype(int)]
                    left = 1 - sign * (w @ m)
                    inside = (left > 0) & (member[some] >> bits[:, None] & 1 == 1)
                    for j, h in enumerate(_products(np.ascontiguousarray((m * np.sqrt(cost)).T), inside.T)):
                        mine[j, :few] += h
                    mine[:, few] += (inside * (cost * sign)) @ m.T
                    loss += (inside * cost * left ** 2).sum(axis=1)
        for j, model in enumerate(open_):
            total = np.zeros((size + 1, size))
            for pattern, mine in sums.items():
                t = turn[pattern]
                total[:size] += t @ mine[j, :few] @ t.T
                total[size] += t @ mine[j, few]
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([float(loss[j])])], ["model", "sums", "loss"])

    return _merged_sums(packed.rows.mapInArrow(add, _SUMS), len(open_), size, shared)


def fit_machines(table: DataFrame, scaled: Scaled, specs: Sequence[Machine], degree: int = 3, dims: int = 0, cost: float = 1.0,
                 class_weights: Mapping | None = None, gamma: float | None = None, coef0: float = 0.0, seed: int = 42) -> Machines:
    """All ``specs`` fitted together on a scaled table; a model without rows of both classes keeps zero weights.

    A Newton step solves (1 + 2 cost H) w = 2 cost g over the rows inside the margin; where the objective rose, the step is
    halved. The constant is not penalised (but by 1e-6, to be unique).
    """
    mapped = PolyMap(len(scaled.columns), degree, dims, gamma, coef0, seed)
    weights = np.array([float((class_weights or {}).get(c, 1.0)) for c in scaled.classes] + [1.0, 1.0])[:2]
    size = mapped.dims + 1
    fitted = Machines(scaled, mapped, list(specs), np.zeros((len(specs), size)), 0)
    penalty = np.ones(size)
    penalty[-1] = 1e-6
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # objective, weights, step that led there
    open_ = list(range(len(specs)))
    packed = pack(table, scaled, mapped) if len(scaled.classes) == 2 else None
    for fitted.steps in range(1, STEPS + 1):
        if not open_ or len(scaled.classes) < 2:
            break
        found = _packed_sums(packed, fitted, open_, weights) if packed else _sums(table, fitted, open_, weights)
        still = []
        for m in open_:
            if m not in found:
                continue
            h, g, loss = found[m]
            w = fitted.weights[m]
            value = 0.5 * float((penalty * w * w).sum()) + cost * loss
            if m in best and value > best[m][0] * (1 + 1e-12):
                step = best[m][2] / 2
                if np.abs(step).max() > TOLERANCE * max(1e-12, np.abs(best[m][1]).max()):
                    best[m] = best[m][0], best[m][1], step
                    fitted.weights[m] = best[m][1] + step
                    still.append(m)
                else:
                    fitted.weights[m] = best[m][1]
                continue
            goal = np.linalg.solve(np.diag(penalty) + 2 * cost * h, 2 * cost * g)
            step = goal - w
            best[m] = value, w.copy(), step
            if np.abs(step).max() > TOLERANCE * max(1e-12, np.abs(goal).max()):
                fitted.weights[m] = goal
                still.append(m)
        open_ = still
    return fitted


# --- use ---------------------------------------------------------------------------------------------------

def decisions(table: DataFrame, fitted: Machines, model: int = 0, out: str = "decision", predicted: str = "predicted") -> DataFrame:
    """``table`` (scaled) with a machine's signed distance and class."""
    shared = table.sparkSession.sparkContext.broadcast(pickle.dumps(fitted))
    d = len(fitted.scaled.columns)

    @F.arrow_udf("double")
    def of(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fitted = pickle.loads(shared.value)
        for cols in it:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols])
            yield pa.array(np.concatenate([fitted.margins(x[i:i + BLOCK])[:, model] for i in range(0, len(x), BLOCK)] + [np.zeros(0)]))

    scored = table.withColumn(out, of(*[F.col(f"_x{i}") for i in range(d)]))
    low, high = fitted.scaled.classes
    return scored.withColumn(predicted, F.when(F.col(out) > 0, F.lit(high)).otherwise(F.lit(low)))


def confusion(table: DataFrame, fitted: Machines, part: Mapping[str, str]) -> DataFrame:
    """(model, part, truth, prediction, n) of every machine in one pass; ``part`` as in :func:`.forest.confusion`."""
    sc, d, names = table.sparkSession.sparkContext, len(fitted.scaled.columns), [m.name for m in fitted.specs]
    shared = sc.broadcast(pickle.dumps(fitted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, total = pickle.loads(shared.value), {}
        for x, rows in _blocks(batches, d):
            y, margin = rows.column("_y").to_numpy(zero_copy_only=False), fitted.margins(x)
            for m in range(len(fitted.specs)):
                parts = rows.column(f"_p{m}").dictionary_encode()
                code = parts.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                some = (code >= 0) & (y != 0)
                cell = code[some] * 4 + (y[some] > 0) * 2 + (margin[some, m] > 0)
                for c, n in zip(*np.unique(cell, return_counts=True)):
                    key = m, parts.dictionary[int(c) // 4].as_py(), int(c) // 2 % 2, int(c) % 2
                    total[key] = total.get(key, 0) + int(n)
        cols = list(zip(*[(*k, n) for k, n in total.items()])) if total else [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["model", "part", "truth", "prediction", "n"])

    told = table.select("_y", *[f"_x{i}" for i in range(d)], *[F.expr(part[n]).cast("string").alias(f"_p{i}") for i, n in enumerate(names)])
    counts = (told.mapInArrow(count, "model int, part string, truth int, prediction int, n bigint")
              .groupBy("model", "part", "truth", "prediction").agg(F.sum("n").alias("n")))
    name, cls = F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(c) for c in fitted.scaled.classes])
    return counts.select(F.element_at(name, F.col("model") + 1).alias("model"), "part", F.element_at(cls, F.col("truth") + 1).alias("truth"),
                         F.element_at(cls, F.col("prediction") + 1).alias("prediction"), "n")
