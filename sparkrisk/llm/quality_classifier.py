"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration (operator 1).

Statistics of a text (shares of character classes, word lengths, repetition) are standardised and mapped to
random cosines, whose inner products approximate a Gaussian kernel. Ridge regression on the labels needs only
the normal equations, which every partition sums over its rows and Spark adds up. An isotonic fit of the
labels over held-back scores makes the result a share of good documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, utf8

#: Bound of the labelled sample (documents, in order of a hash of the id), and partitions it is trained in.
MAX_DOCS, PARTITIONS = 30_000, 32
#: Random features, their seed, the kernel's width (of standardised statistics) and the ridge per row.
FEATURES, SEED, WIDTH, RIDGE = 256, 5, 4.0, 1e-4
#: Standardised statistics are cut off here, so that one odd text cannot leave the kernel's range.
CLIP = 6.0

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "bang", "other", "high")


def _classes() -> np.ndarray:
    kind = np.full(256, _CLASSES.index("other"), np.uint8)
    for name, signs in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                        ("digit", "0123456789"), ("blank", " \t\r\x0b\x0c"), ("newline", "\n"), ("stop", ".,;:"),
                        ("symbol", "#*$%&|<>{}[]~^\\=+_@"), ("bang", "!?")):
        kind[[ord(c) for c in signs]] = _CLASSES.index(name)
    kind[0x80:] = _CLASSES.index("high")
    return kind


KIND = _classes()
STATS = (*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "long_words", "new_words",
         "same_as_last", "repeated_pairs", "log_lines", "repeated_lines")
_MIX = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of each owner."""
    if not len(code):
        return np.zeros(n)
    order = np.lexsort((code, owner))
    o, c = owner[order], code[order]
    first = np.ones(len(c), bool)
    first[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
    return np.bincount(o[first], minlength=n).astype(float)


def _runs(inside: np.ndarray, data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, length, hash) of each maximal run of bytes of one owner where ``inside`` holds."""
    edge = np.ones(len(data), bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(data)))
    place = np.arange(len(data)) - np.repeat(start, size)
    value = _MIX[data] * _MIX[(place * 7 + 3) % 256] + (_MIX[data] >> np.uint64(7))
    code = np.add.reduceat(value, start) if len(start) else np.zeros(0, np.uint64)
    take = inside[start]
    return owner[start][take], size[take], code[take]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATS per text; all zero for a text without bytes. Whole texts, in chunks of bounded bytes."""
    out = [_statistics(*utf8(part)) for part in chunks(texts)]
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros((n, len(STATS)))
    if not len(data):
        return out
    kind = KIND[data]
    counts = np.bincount(owner * len(_CLASSES) + kind, minlength=n * len(_CLASSES)).reshape(n, -1)
    length = np.maximum(size, 1)
    blank, newline = kind == _CLASSES.index("blank"), kind == _CLASSES.index("newline")
    w_owner, w_size, w_code = _runs(~(blank | newline), data, owner)
    words = np.bincount(w_owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    pair = np.flatnonzero(w_owner[1:] == w_owner[:-1])
    pairs = np.bincount(w_owner[pair], minlength=n).astype(float)
    pair_code = w_code[pair] * np.uint64(0x9E3779B97F4A7C15) + w_code[pair + 1]
    same = np.bincount(w_owner[pair][w_code[pair] == w_code[pair + 1]], minlength=n)
    l_owner, _, l_code = _runs(~newline, data, owner)
    lines = np.bincount(l_owner, minlength=n).astype(float)
    columns = [*(counts / length[:, None]).T, np.log1p(size), np.log1p(words),
               np.bincount(w_owner, w_size, minlength=n) / some,
               np.bincount(w_owner, w_size > 15, minlength=n) / some,
               _distinct(w_owner, w_code, n) / some, same / some,
               1 - _distinct(w_owner[pair], pair_code, n) / np.maximum(pairs, 1),
               np.log1p(lines), 1 - _distinct(l_owner, l_code, n) / np.maximum(lines, 1)]
    out[:] = np.column_stack(columns)
    out[size == 0] = 0
    return out


class Model:
    """Standardisation, ridge weights over the random features, and the isotonic curve."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, spread
        self.ridge = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines and a constant; the projection is drawn anew from its seed."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(len(STATS), FEATURES)) / WIDTH
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        return np.hstack([np.cos(z @ w + shift) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares curve: pooled neighbours, each pool at its mean score.

    Pools are drawn towards the overall share by one row, so none is surely 0 or 1; between knots the curve
    is straight, so scores keep their order.
    """
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # label sum, rows, score sum
    prior = (label.sum() + 1) / (len(label) + 2)
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        pools.append([y, 1.0, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x = np.array([p[2] / p[1] for p in pools])
    y = np.maximum.accumulate(np.array([(p[0] + prior) / (p[1] + 1) for p in pools]))
    return x, y


def document_statistics(text: Column) -> Column:
    """array<double> of STATS."""

    @F.arrow_udf("array<double>")
    def stats(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            rows = statistics(texts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATS), pa.int32()),
                                           pa.array(rows.ravel(), pa.float64()))

    return stats(text)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """(features' products, features times label, rows) over all rows (s: statistics, y: label).

    Each partition sends one row: its sums, packed. Spark adds them by position.
    """
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]) + size + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            stats = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(STATS))
            y = batch.column(1).to_numpy()
            z = model.features(stats)
            total += np.concatenate([(z.T @ z)[upper], z.T @ y, [len(y)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.select("s", "y").mapInArrow(sums, "v array<double>")
    added = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(len(upper[0]) + size + 1)  # as long as the packed sums, whatever the rows
    for i, v in added:
        total[i] = v
    a = np.zeros((size, size))
    a[upper] = total[:len(upper[0])]
    return a + np.triu(a, 1).T, total[len(upper[0]):-1], int(total[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model | None:
    """Train on at most MAX_DOCS labelled documents outside the held-out fold; None if there is none.

    Ids with differing labels and NULL ids or labels are left out. Two thirds fit the ridge, one third the
    isotonic curve (all of them both where that third is empty).
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_m"))
             .where("y = _m").select("_id", F.col("y").cast("double").alias("y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(MAX_DOCS))
    learn = F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(3)) != 0
    rows = (docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
            .join(F.broadcast(known), F.col("_key") == F.col("_id"))
            .select(learn.alias("learn"), "y", document_statistics(F.col("_text")).alias("s"))
            .coalesce(PARTITIONS).persist())
    try:
        one = [F.col("s")[i] for i in range(len(STATS))]
        moments = rows.agg(*[F.avg(c) for c in one], *[F.stddev_pop(c) for c in one]).first()
        if moments[0] is None:
            return None
        mean, spread = np.array(moments[:len(STATS)]), np.array(moments[len(STATS):])
        model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
        a, b, n = normal_equations(rows.where("learn"), model)
        if not n:
            a, b, n = normal_equations(rows, model)
        penal = np.full(len(a), RIDGE * n)
        penal[-1] = 1e-9
        model.ridge = np.linalg.solve(a + np.diag(penal), b)
        held = rows.where(~F.col("learn")).select("s", "y").collect() or rows.select("s", "y").collect()
    finally:
        rows.unpersist()
    y = np.array([r["y"] for r in held])
    model.x, model.y = isotonic(model.raw(np.array([r["s"] for r in held])), y)
    return model


def quality(text: Column, model: Model | None) -> Column:
    """Score of a text from 0 to 1; NULL counts as empty; without a model every score is 0.5."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array(model.score(statistics(texts)), pa.float64())

    return score(text)


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from ``threshold`` on).

    Row-wise over whole texts. NULL and empty texts have the score of all-zero statistics; repeated rows are
    scored each; other columns are not read, so they cannot clash; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), held_out(id_col).alias("_h"), quality(F.col(text_col), model).alias("_s"))
    return rows.select(F.col(id_col), F.col("_h").alias("held_out"), F.col("_s").alias("score"),
                       (F.col("_s") >= threshold).cast("int").alias("predicted"))
