"""Toxicity by a subsequence string kernel machine with Nystroem landmarks (operator 2).

The kernel of two strings sums, over the common subsequences of ORDER letters that span at most SPAN + 1
characters, DECAY per skipped character on either side; other characters only widen a gap, so insults with
inserted or separated letters still match. A character is a code point, and a run of signs, blanks or other
non-letters, however long, counts as one. Landmarks are the words that tell sentences of toxic documents
from sentences of clean ones, and frequent words; a linear machine is trained on the kernel's Nystroem map of
labelled sentences' windows. The decision is linear in the subsequence counts, so after training it collapses
into one weight per subsequence: scoring a text costs a table lookup per character and gap pattern, exactly
equal to evaluating the kernel against every landmark. A document's margin is that of its worst window.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, utf8

#: Kernel: letters in a subsequence, characters it may reach over, decay per skipped character.
ORDER, SPAN, DECAY = 4, 6, 0.7
#: Subsequence starts that a window sums.
WINDOW = 12
#: Bounds of the training sample: documents per class, sentences per class, landmarks per kind.
MAX_DOCS, MAX_SENTENCES, LANDMARKS = {1: 3000, 0: 6000}, {1: 5000, 0: 20_000}, 64
#: Windows of each class that a machine starts from.
MAX_WINDOWS = 4000
#: Characters of the pieces that longer sentences are cut into for training; scoring has no such bound.
TRAIN_CHARS = 1000
#: G statistic of a sure landmark word (the best others stand in where no word reaches it), and shrinkage of the machine.
LEAST_G, RIDGE = 25.0, 1e-3

GAPS = [g for g in combinations(range(1, SPAN + 1), ORDER - 1)]
#: Digits and signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def _letters() -> np.ndarray:
    """Code of each ASCII byte: 1-26 letters without case, 0 for everything else."""
    code = np.zeros(256, np.int32)
    for k in range(26):
        code[ord("a") + k] = code[ord("A") + k] = k + 1
    for sign, letter in LOOKALIKE.items():
        code[ord(sign)] = code[ord(letter)]
    return code


CODE = _letters()
PAD = SPAN + WINDOW


@cache
def other_letters() -> np.ndarray:
    """Code of each code point beyond ASCII: 27-31 for letters of any script, 0 for everything else."""
    letter = np.fromiter((chr(k).isalpha() for k in range(0x80, sys.maxunicode + 1)), bool)
    return np.concatenate([np.zeros(0x80, np.int8),
                           np.where(letter, 27 + np.arange(0x80, sys.maxunicode + 1) % 64 % 5, 0).astype(np.int8)])


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of UTF-8 texts and their offsets: one place per letter, and one per run of other characters."""
    code = CODE[data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        point = data[wide].astype(np.int64)
        size = 2 + (point >= 0xE0) + (point >= 0xF0)
        point &= 0x7F >> size
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | data[np.minimum(wide[more] + k, len(data) - 1)] & 0x3F
        code[wide] = other_letters()[np.minimum(point, sys.maxunicode)]
        first = np.flatnonzero(data & 0xC0 != 0x80)
        code, offsets = code[first], np.searchsorted(first, offsets)
    keep = code != 0
    keep[1:] |= keep[:-1].copy()
    keep[offsets[:-1][offsets[:-1] < len(code)]] = True
    kept = np.flatnonzero(keep)
    return code[kept], np.searchsorted(kept, offsets)


def spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts with PAD zeros after each, and where each text starts (last: the end)."""
    codes, offsets = places(data, offsets)
    starts = offsets + PAD * np.arange(len(offsets))
    out = np.zeros(int(starts[-1]), np.int32)
    for s, a, b in zip(starts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        out[s:s + b - a] = codes[a:b]
    return out, starts


def window_sums(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the subsequence weights of the WINDOW starts from each position on."""
    n = len(codes) - SPAN
    if n <= 0:
        return np.zeros(0)
    at = [codes[g:g + n] for g in range(SPAN + 1)]
    first = at[0] << 15
    second = {g: first | (at[g] << 10) for g in range(1, SPAN + 1)}
    value = np.zeros(n, np.float32)
    for g1, g2 in combinations(range(1, SPAN), 2):
        third = second[g1] | (at[g2] << 5)
        for g3 in range(g2 + 1, SPAN + 1):
            value += weight[g3 - ORDER + 1][third | at[g3]]
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return sums[np.minimum(np.arange(n) + WINDOW, n)] - sums[:-1]


def decayed(table: np.ndarray) -> list[np.ndarray]:
    """The weight table for each number of skipped characters."""
    return [(table * DECAY ** k).astype(np.float32) for k in range(SPAN - ORDER + 2)]


def largest(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest window of each text: windows that begin in it (those in the padding reach the next text)."""
    if not len(sums):
        return np.zeros(len(starts) - 1)
    bounds = np.column_stack([starts[:-1], starts[1:] - PAD]).ravel()
    return np.maximum(np.maximum.reduceat(sums, bounds)[::2], 0.0)  # an empty text gives its padding's zero


def worst_windows(texts: pa.Array, weight: list[np.ndarray]) -> np.ndarray:
    """The largest window sum of each text; 0 for texts without letters."""
    out = []
    for part in chunks(texts):
        codes, starts = spread(*utf8(part))
        out.append(largest(window_sums(codes, weight), starts))
    return np.concatenate(out) if out else np.zeros(0)


# --- training (on the driver, over the bounded sample) -----------------------------------------------------

Features = tuple[np.ndarray, np.ndarray]


def codes_of(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return places(data, np.array([0, len(data)]))[0]


def features(text: bytes) -> Features:
    """(keys, decayed counts) of the subsequences that start in the first WINDOW characters of ``text``."""
    return counted(codes_of(text))


def counted(places: np.ndarray) -> Features:
    """The same of a window's codes."""
    codes = places.tolist() + [0] * SPAN
    out: dict[int, float] = {}
    for i in range(min(WINDOW, len(places))):
        if not codes[i]:
            continue
        for gap in GAPS:
            rest = [codes[i + g] for g in gap]
            if all(rest):
                key = codes[i]
                for c in rest:
                    key = key << 5 | c
                out[key] = out.get(key, 0.0) + DECAY ** (gap[-1] - ORDER + 1)
    return np.fromiter(out, np.int32, len(out)), np.fromiter(out.values(), np.float32, len(out))


def kernel(a: list[Features], b: list[Features]) -> np.ndarray:
    """Kernel matrix of two lists of feature maps."""
    keys = np.unique(np.concatenate([k for k, _ in b])) if b else np.zeros(0, np.int32)
    right = np.zeros((len(keys) + 1, len(b)), np.float32)  # the last row stands for keys that b lacks
    for j, (k, v) in enumerate(b):
        right[np.searchsorted(keys, k), j] = v
    out = np.zeros((len(a), len(b)))
    for i, (k, v) in enumerate(a):
        at = np.searchsorted(keys, k)
        known = at < len(keys)
        known[known] = keys[at[known]] == k[known]
        out[i] = v[known] @ right[at[known]]
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (last: bias) of a linear machine with squared hinge loss, by Newton steps over the margin's rows."""
    x = np.hstack([z, np.ones((len(z), 1))])
    penal = np.full(x.shape[1], ridge)
    penal[-1] = ridge / 100
    w = np.zeros(x.shape[1])
    loss = np.inf
    for _ in range(40):
        slack = 1 - y * (x @ w)
        on = slack > 0
        now = 0.5 * (penal * w * w).sum() + 0.5 * (cost[on] * slack[on] ** 2).sum()
        if loss - now < 1e-9 * max(1.0, now) and np.isfinite(loss):
            break
        loss = now
        c = cost[on][:, None]
        step = np.linalg.solve((x[on] * c).T @ x[on] + np.diag(penal), x[on].T @ (c[:, 0] * y[on]))
        size = 1.0  # halve the step until the loss falls
        while size > 1e-4:
            trial = w + size * (step - w)
            s = np.maximum(1 - y * (x @ trial), 0)
            if 0.5 * (penal * trial * trial).sum() + 0.5 * (cost * s ** 2).sum() <= now + 1e-12:
                break
            size /= 2
        w = trial
    return w


def spoiled(word: str) -> list[str]:
    """The word with a sign, a blank or a letter put between its letters: positives that the margin must hold."""
    return [s.join(word) for s in (".", "-", " ", "*")] + [
        word[:k] + s + word[k:] for s in ("x", ".") for k in range(1, len(word))]


def train(sentences: list[tuple[str, int]], words: list[str], common: list[str]) -> tuple[np.ndarray, float]:
    """Weight per subsequence and bias. ``sentences``: (text, 1 from toxic documents, else 0); ``words``: the
    telling landmarks; ``common``: the others. Positives are windows at telling words, negatives windows of
    clean sentences, chosen anew where the last machine is nearest to failing."""
    landmarks = [features(w.encode()) for w in [*words, *common]]
    landmarks = [x for x in landmarks if len(x[0])]
    k_ll = kernel(landmarks, landmarks)
    scale = 1 / np.sqrt(np.diag(k_ll))
    values, vectors = np.linalg.eigh(k_ll * scale * scale[:, None])
    keep = values > 1e-6 * values.max()
    root = scale[:, None] * (vectors[:, keep] / np.sqrt(values[keep]))  # K(x, L) @ root is the Nystroem map
    telling = set(words)
    good, seen = [], set()
    for text, label in sentences:
        if label:
            low = text.lower()
            for m in re.finditer(r"[^\W\d_]+", low):
                if m.group() in telling:
                    piece = codes_of(low[m.start():].encode())[:WINDOW + SPAN]
                    if piece.tobytes() not in seen and len(good) < MAX_WINDOWS:
                        seen.add(piece.tobytes())
                        good.append(counted(piece))
    plain = len(good)
    good += [features(s.encode()) for w in words for s in [w, *spoiled(w)]]
    codes, starts = spread(*utf8(pa.array([t.lower() for t, label in sentences if not label], pa.string())))
    sizes = np.diff(starts) - PAD
    rng = np.random.default_rng(11)
    bad = []
    for k in rng.permutation(len(sizes))[:MAX_WINDOWS]:
        at = starts[k] + int(rng.integers(0, max(1, sizes[k] - WINDOW)))
        bad.append(counted(codes[at:at + WINDOW + SPAN]))
    z_good = kernel(good, landmarks) @ root
    cost_good = np.concatenate([np.full(plain, 1.0), np.full(len(good) - plain, max(0.2, plain / 4 / max(1, len(good) - plain)))])
    cost_good *= 2000 / cost_good.sum()
    for _ in range(4):
        z_bad = kernel(bad, landmarks) @ root
        z = np.vstack([z_good, z_bad])
        y = np.concatenate([np.ones(len(z_good)), -np.ones(len(z_bad))])
        cost = np.concatenate([cost_good, np.full(len(z_bad), 8000 / len(z_bad))])
        w = squared_hinge(z, y, cost)
        alpha = root @ w[:-1]
        table = np.zeros(1 << (5 * ORDER))
        for (k, v), a in zip(landmarks, alpha):
            table[k] += v * a
        hard = []
        sums = window_sums(codes, decayed(table))
        for k in np.argsort(-largest(sums, starts), kind="stable")[:1500].tolist():
            if sizes[k]:
                at = starts[k] + int(np.argmax(sums[starts[k]:starts[k] + sizes[k]]))
                hard.append(counted(codes[at:at + WINDOW + SPAN]))
        bad += hard
    return table, float(w[-1])


def squashed(margin: np.ndarray) -> np.ndarray:
    """The margin as it is up to twice the machine's own, and slower growing beyond.

    Whole insults lie far beyond the margin, spoiled ones just there; without this the curve's middle would
    lie halfway to the whole ones, and spoiled insults below it.
    """
    size = np.abs(margin)
    return np.sign(margin) * (np.minimum(size, 2) + 0.3 * np.log1p(np.maximum(size - 2, 0)))


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve through smoothed labels, by damped Newton steps."""
    pos, neg = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(margin).max(initial=0.0)))
    x = np.column_stack([margin / scale, np.ones(len(margin))])
    ridge = np.array([1e-3, 1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.array([0.0, math.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return max(0.0, float(w[0]) / scale), float(w[1])


class Model:
    """Subsequence weights, bias, and the calibration of the margin."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, offset: float):
        self.keys = np.flatnonzero(table).astype(np.int32)
        self.values = table[self.keys]
        self.bias, self.slope, self.offset = bias, slope, offset

    def weight(self) -> list[np.ndarray]:
        table = np.zeros(1 << (5 * ORDER))
        table[self.keys] = self.values
        return decayed(table)

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squashed(worst + self.bias) + self.offset, -30, 30)))


def _sentences(rows: DataFrame) -> DataFrame:
    """(y, s): distinct sentences of the labelled texts, long ones in pieces; copies count once."""
    parts = F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+"))
    cut = F.lit(rf"(?s).{{1,{TRAIN_CHARS - 1}}}(?:\s|$)|.{{1,{TRAIN_CHARS}}}")  # behind a blank if there is one
    pieces = F.when(F.length("s") <= TRAIN_CHARS, F.array("s")).otherwise(F.regexp_extract_all("s", cut, F.lit(0)))
    return (rows.select("y", parts.alias("s")).withColumn("s", F.trim("s"))
            .select("y", F.explode(pieces).alias("s")).withColumn("s", F.trim("s"))
            .where(F.length("s") > 0).distinct())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model | None:
    """Train on labelled documents outside the held-out fold.

    None, and so scores of 0, without documents and sentences of both classes, or if no word of ORDER letters
    or more is in a larger share of the toxic sentences than of the others. Where no word is sure (few or
    mostly copied toxic sentences), the best ones by G are the landmarks.

    The sample is bounded by MAX_DOCS per class, in order of a hash of the id; ids with differing labels and
    NULL ids or labels are left out. Word statistics over its sentences are a Spark aggregate; bounded
    numbers of landmark words and sentences come to the driver.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_m"))
             .where("y = _m").select("_id", F.col("y").cast("int").alias("y")))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y, most in MAX_DOCS.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_key", "text", "y")).persist()
    try:
        per_class = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
        if not per_class.get(0) or not per_class.get(1):
            return None
        learn = F.pmod(F.xxhash64(F.col("_key"), F.lit(1)), F.lit(3)) != 0  # the rest calibrates
        sentences = _sentences(rows.where(learn)).persist()
        word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit(r"\p{L}+"), F.lit(0))))
        counts = sentences.select("y", word.alias("w")).where(F.length("w") >= ORDER).groupBy("w").agg(
            F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        total = {r[0]: r[1] for r in sentences.groupBy("y").count().collect()}
        n1, n0 = total.get(1, 0), total.get(0, 0)
        if not n1 or not n0:
            return None
        e1, e0 = (F.col("a") + F.col("b")) * n1 / (n1 + n0), (F.col("a") + F.col("b")) * n0 / (n1 + n0)
        g = 2 * (F.col("a") * F.log(F.col("a") / e1) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / e0)).otherwise(0))
        sure = (F.col("a") >= 3) & (F.col("a") * n0 > 6 * F.col("b") * n1) & (F.col("g") >= LEAST_G)
        over = (counts.where((F.col("a") > 0) & (F.col("a") * n0 > F.col("b") * n1)).withColumn("g", g)
                .withColumn("sure", sure).orderBy(F.desc("sure"), F.desc("g"), "w").limit(LANDMARKS).collect())
        telling = [r for r in over if r["sure"]] or over
        if not telling:
            return None
        common = counts.where("b > 0").orderBy(F.desc("b"), "w").limit(LANDMARKS).collect()
        words = [r["w"] for r in telling]
        has = F.size(F.array_intersect(F.regexp_extract_all(F.lower("s"), F.lit(r"\p{L}+"), F.lit(0)),
                                       F.array(*map(F.lit, words)))) > 0
        sample = []
        for y, most in MAX_SENTENCES.items():
            some = sentences.where((F.col("y") == y) & (has if y else F.lit(True)))
            sample += [(r["s"], y) for r in some.orderBy(F.xxhash64("s"), "s").limit(most).collect()]
        sentences.unpersist()
        skip = set(words)
        table, bias = train(sample, words, [r["w"] for r in common if r["w"] not in skip])
        model = Model(table, bias, 1.0, 0.0)
        held = rows.where(~learn) if rows.where(~learn).groupBy("y").count().count() == 2 else rows
        pairs = held.select("y", worst_window(F.col("text"), model).alias("m")).collect()
    finally:
        rows.unpersist()
    y = np.array([r["y"] for r in pairs])
    margin = np.array([r["m"] for r in pairs]) + bias
    share = np.where(y == 1, sizes[1] / per_class[1], sizes[0] / per_class[0])  # undo the classes' bounds
    model.slope, model.offset = platt(squashed(margin), y, share * len(y) / share.sum())
    return model


def worst_window(text: Column, model: Model) -> Column:
    """Largest window sum of each text under a model (small: its nonzero weights)."""

    @F.arrow_udf("double")
    def worst(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = model.weight()
        for texts in it:
            yield pa.array(worst_windows(texts, weight), pa.float64())

    return worst(text)


def toxicity(text: Column, model: Model | None) -> Column:
    """Score of a text from 0 to 1; NULL counts as empty; without a model every score is 0."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = model.weight()
        for texts in it:
            yield pa.array(model.score(worst_windows(texts, weight)), pa.float64())

    return score(text)


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from ``threshold`` on).

    Row-wise over whole texts. NULL and empty texts have a margin of the bias alone; repeated rows are scored
    each; other columns are not read, so they cannot clash; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), held_out(id_col).alias("_h"), toxicity(F.col(text_col), model).alias("_s"))
    return rows.select(F.col(id_col), F.col("_h").alias("held_out"), F.col("_s").alias("score"),
                       (F.col("_s") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, with all their columns."""
    return docs.where(toxicity(F.col(text_col), model) < threshold)
