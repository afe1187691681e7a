"""Runs of periodic words (operator 12): maximal stretches that repeat a block of words at least three times.

A run is a stretch with smallest period q (words q apart are identical) and a length of at least
max(MIN_WORDS, REPEATS * q) that no neighbouring word extends keeping the period.

Short periods (below SCAN) are found by scanning every lag directly. Longer ones are found scale by scale, each
scale serving the periods q in [b, GROWTH * b):

* The grams of k = b // 2 words are hashed; in every window of 2 * b words the grams of the smallest hash are
  the window's minimizers. A run of period q holds a window and its copy q words on, whose minimizers stand at
  the same places in both, so two equal minimizers at distance q lie in the run.
* Grams that themselves lie in a found run of a period of at most k // 3 are no minimizers: all their copies lie in
  such runs too (k >= MIN_WORDS, and shorter periods are complete by then), and a window with such grams only
  would be periodic as a whole and so would the run, by a period that divides q. What is left cannot overlap its
  own copy by more than 2 / 3, so a minimizer has about ten partners within reach at most.
* A pair of equal minimizers at a distance q of the scale is a seed. Seeds whose q words before or after are no
  exact copy are dropped by hash; the others are extended to both sides word by word.

Words are compared by number, equal only for equal words, so hashes decide nothing but where to look.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Production parameters: least words of a run, least repeats of its period.
MIN_WORDS, REPEATS = 24, 3
#: Periods below this are scanned directly; scales start here (its half must hold MIN_WORDS words).
SCAN = 48
#: A scale's periods end below GROWTH times its first: a window of 2 * b words must exceed q + k / 3.
GROWTH = 1.75

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ONES = np.uint64(0x0101010101010101)
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class Numbers(dict):
    """Numbers words by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(words: list[bytes], known: Numbers) -> np.ndarray:
    """A number a word, the same for equal words of one ``known``."""
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scattered 64-bit codes of numbers (shift, multiply, shift)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Hashes of any stretch of a sequence from one sum over powers of an odd factor (modulo 2 ** 64)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up = np.full(n, _FACTOR, np.uint64)
        down = np.full(n, _INVERSE, np.uint64)
        if n:
            up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down) if n else down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up), out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hash of every stretch of k words."""
        n = len(self.down) - k + 1
        return (self.sums[k:] - self.sums[:-k]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def _slide(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """best(values[i:i + width]) for every i, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:len(out) - step], out[step:])
        have += step
    return out


def scan_short(words: np.ndarray, bounds: np.ndarray, found: list[list[tuple[int, int, int]]]) -> None:
    """Runs of periods below SCAN in the sequences ``words[bounds[i]:bounds[i + 1]]``, which are set SCAN unique
    words apart so that no lag reaches from one into the next."""
    for q in range(1, SCAN):
        least = max(MIN_WORDS, REPEATS * q) - q
        same = np.zeros(-(-(len(words) + 8) // 8) * 8, np.uint8)
        if len(words) > q:
            np.equal(words[:-q], words[q:], out=same[:len(words) - q].view(bool))
        full = np.flatnonzero(same.view(np.uint64) == _ONES) * 8  # a stretch of 16 or more holds eight aligned ones
        i = 0
        while i < len(full):
            start = at = int(full[i])
            while start and same[start - 1]:
                start -= 1
            end = at + 8
            while True:
                piece = same[end:end + 4096]
                gap = int(piece.argmin()) if len(piece) else 0
                if len(piece) and piece[gap]:
                    end += len(piece)
                    continue
                end += gap
                break
            i = int(np.searchsorted(full, end))
            if end - start >= least:
                doc = int(np.searchsorted(bounds, start, side="right")) - 1
                found[doc].append((start - int(bounds[doc]), end - start + q, q))


def minimizers(hashes: np.ndarray, usable: np.ndarray, windows: int) -> np.ndarray:
    """Places whose hash is the smallest of the usable ones in some window of ``windows`` places."""
    top = np.iinfo(np.uint64).max
    h = np.where(usable, np.minimum(hashes, top - np.uint64(1)), top)
    if len(h) < windows:
        return np.zeros(0, np.int64)
    low = _slide(h, windows, np.minimum)
    pad = np.zeros(windows - 1, np.uint64)
    reach = _slide(np.concatenate([pad, low, pad]), windows, np.maximum)  # largest minimum of the windows over a place
    return np.flatnonzero((h == reach) & usable)


def _stretch(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The maximal stretch [start, end) around ``at`` in which each word equals the one q words on."""
    end, step, last = at, 64, len(words) - q
    while end < last:
        stop = min(last, end + step)
        wrong = np.flatnonzero(words[end:stop] != words[end + q:stop + q])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = stop, step * 2
    start, step = at, 64
    while start > 0:
        stop = max(0, start - step)
        wrong = np.flatnonzero(words[stop:start] != words[stop + q:start + q])
        if len(wrong):
            start = stop + int(wrong[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def scan_scales(words: np.ndarray, found: list[tuple[int, int, int]]) -> None:
    """Adds the runs of periods of SCAN and more of one sequence; ``found`` has those of all shorter ones."""
    n, b = len(words), SCAN
    prefix = Prefix(words) if n >= REPEATS * b else None
    while n >= REPEATS * b:
        upto = int(GROWTH * b)
        k = b // 2
        hashes = prefix.grams(k)
        usable = np.ones(len(hashes), bool)
        for start, length, q in found:
            if q <= k // 3:
                usable[start:max(start, start + length - k + 1)] = False
        places = minimizers(hashes, usable, 2 * b - k + 1)
        order = np.lexsort((places, hashes[places]))
        places, codes = places[order], hashes[places[order]]
        seeds = []
        for step in range(1, len(places)):
            near = (codes[step:] == codes[:-step]) & (places[step:] - places[:-step] < upto)
            if not near.any():
                break
            lag = (places[step:] - places[:-step])[near]
            some = lag >= b
            seeds.append(np.array([lag[some], places[:-step][near][some]]))
        if seeds:
            lag, at = np.hstack(seeds)
            after = (at + 2 * lag <= n)
            square = np.zeros(len(at), bool)
            square[after] = prefix.of(at[after], lag[after]) == prefix.of(at[after] + lag[after], lag[after])
            before = (at >= lag) & (at + lag <= n)
            square[before] |= prefix.of(at[before] - lag[before], lag[before]) == prefix.of(at[before], lag[before])
            end, was = -1, 0
            order = np.lexsort((at[square], lag[square]))
            for q, place in zip(lag[square][order].tolist(), at[square][order].tolist()):
                if q == was and place < end:
                    continue
                start, end = _stretch(words, place, q)
                was = q
                if end - start + q >= max(MIN_WORDS, REPEATS * q):
                    found.append((start, end - start + q, q))
        b = upto


def _smallest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Each stretch once, with its smallest period, by start and then period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        key = start, length
        best[key] = min(q, best.get(key, q))
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def runs_of(sequences: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each sequence of word numbers (not negative)."""
    bounds = np.cumsum([0] + [len(s) + SCAN for s in sequences])
    words = -1 - np.arange(bounds[-1], dtype=np.int32 if bounds[-1] < 1 << 31 else np.int64)  # unique fillers
    for s, at in zip(sequences, bounds):
        words[at:at + len(s)] = s
    found: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    scan_short(words, bounds, found)
    for s, rows in zip(sequences, found):
        if len(s) >= REPEATS * SCAN:
            rows[:] = _smallest(rows)
            scan_scales(s, rows)
    return [_smallest(rows) for rows in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """False for words that a run holds after its first period; None if all stay."""
    if not runs:
        return None
    keep = np.ones(n, bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return keep


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _batches(ids: pa.Array, texts: pa.Array, change) -> Iterator[tuple[list[list[bytes]], list]]:
    """Words of the texts, and their runs, a chunk of texts at a time."""
    done = 0
    for part in chunks(texts):
        known = Numbers()
        words = [(t or b"").split() for t in part.cast(pa.binary()).to_pylist()]
        if change is not None:
            words = [change(i, w) for i, w in zip(ids.slice(done, len(part)).to_pylist(), words)]
        done += len(part)
        yield words, runs_of([word_numbers(w, known) for w in words])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: of documents whose crc32(doc_id) is a multiple of ten, a tail made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


def find_runs(text: Column) -> Column:
    """The runs of a text: array of (start, length, period), by start and then period. NULL and empty: none."""

    @F.arrow_udf(RUNS)
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for texts in it:
            rows = [[dict(zip(("start", "length", "period"), r)) for r in runs]
                    for _, found in _batches(pa.nulls(len(texts)), texts, None) for runs in found]
            yield pa.array(rows, kind)

    return of(text)


def collapse(text: Column) -> Column:
    """The text's words, joined by one space, without what its runs repeat after their first period."""

    @F.arrow_udf("string")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            out = []
            for words, found in _batches(pa.nulls(len(texts)), texts, None):
                for w, runs in zip(words, found):
                    keep = kept_words(len(w), runs)
                    out.append(b" ".join(w if keep is None else compress(w, keep.tolist())).decode())
            yield pa.array(out, pa.string())

    return of(text)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=planted) -> DataFrame:
    """One row per input row: id, n_runs, the strongest run (start, length, period, exponent_milli; NULLs without a
    run) and the digests of all runs and of the collapsed text.

    ``change(id, words)`` may alter the words first (the contract plants runs). NULL, empty and blank texts have no
    words, no runs and the digest of the empty text; a NULL id is never altered. Repeated rows come back each.
    Only the two columns are read, so others cannot clash; an empty table gives no rows. A text is worked on whole:
    its arrays take about 100 bytes a word.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    out_type = "struct<" + ",".join(f"{c}:bigint" for c in names) + ",runs_sha256:string,collapsed_sha256:string>"

    @F.arrow_udf(out_type)
    def digest(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in it:
            rows: list[list] = []
            for words, found in _batches(ids, texts, change):
                for w, runs in zip(words, found):
                    top = strongest(runs)
                    keep = kept_words(len(w), runs)
                    text = b" ".join(w if keep is None else compress(w, keep.tolist()))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rows.append([len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
                                 hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()])
            cols = list(zip(*rows)) or [()] * 7
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(cols)],
                                             names + ["runs_sha256", "collapsed_sha256"])

    return (docs.select(F.col(id_col), digest(F.col(id_col), F.col(text_col)).alias("d"))
            .select(F.col(id_col), *[F.col(f"d.{c}") for c in names + ["runs_sha256", "collapsed_sha256"]]))
